"""Further registered queries: votes over mixed types, runs, generation, logs and streams, each beside its oracle."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from evalscale import views as V
from evalscale.functions import text as X
from evalscale.operators import dedupe, merging, reselect, scaling, select
from evalscale.plans import config, sweep
from evalscale.queries import _EX, _POOL, MOCK, ORACLES, generated, mock_prompts, query
from evalscale.schemas import EXAMPLE
from evalscale.sources import folders, unitlog
from evalscale.streaming import incremental, stateful

_MIXED = f"""{_POOL},
mixed AS (SELECT dataset, model, concat('ttc_n', n) AS method, n, example_id, sample_index, ord // 7 % 4 AS form, CAST(token_count % 3 AS VARCHAR) AS v, CAST(example_id % 3 AS VARCHAR) AS gold,
  CASE WHEN ord // 5 % 3 = 1 THEN '' WHEN ord // 5 % 3 = 2 THEN CASE WHEN example_id % 2 = 0 THEN 'number' ELSE 'text' END END AS typ FROM pool, (VALUES (1), (4), (8), (16)) AS t(n) WHERE sample_index < n),
kinds AS (SELECT {_EX}, arg_min(typ, sample_index) FILTER (typ <> '') AS kind, max(typ) FILTER (sample_index = 0) AS head FROM mixed GROUP BY ALL),
keyed AS (SELECT *, CASE form WHEN 0 THEN v WHEN 1 THEN v || '.0' WHEN 2 THEN '' ELSE v || '.' END AS answer, CASE WHEN form = 1 THEN v || '0' ELSE v END AS plain FROM mixed JOIN kinds USING ({_EX})),
votes AS (SELECT {_EX}, CASE WHEN form = 2 THEN '__empty_' || sample_index WHEN kind = 'number' THEN 'num:' || v ELSE plain END AS vote_key, count(*) AS votes, min(sample_index) AS p FROM keyed GROUP BY ALL),
won AS (SELECT *, row_number() OVER (PARTITION BY {_EX} ORDER BY votes DESC, p) AS nth FROM votes)"""


@query(
    "mixed_type_votes",
    f"""WITH {_MIXED} SELECT {_EX}, p AS selected_sample_index, answer AS selected_answer, votes, vote_key, form <> 2 AND CASE WHEN head = 'number' THEN v ELSE plain END = gold AS is_correct
FROM won JOIN keyed USING ({_EX}) WHERE nth = 1 AND sample_index = p""",
)
def mixed_type_votes(spark, sf_dir):
    """A4 with F14: answers of a group are pooled by the type that its first typed sample names; a match goes by the first sample."""
    rows = V.mixed_candidates(spark, sf_dir).withColumn("pos", F.col("sample_index"))
    chosen = reselect.reselect(rows, ["majority_vote"], dedupe=False)
    kinds = select.group_type(rows, EXAMPLE).withColumnRenamed("answer_type", "kind")
    key = X.vote_key(F.col("selected_answer"), F.col("kind"), F.col("selected_sample_index"))
    return chosen.join(kinds, EXAMPLE).select(*EXAMPLE, "selected_sample_index", "selected_answer", F.array_max(F.map_values("vote_counts")).alias("votes"), key.alias("vote_key"), "is_correct")


@query("answer_types", f"WITH {_MIXED} SELECT {_EX}, kind AS answer_type FROM kinds")
def answer_types(spark, sf_dir):
    """samples name a type or not; the group takes the first that is named, if any."""
    return select.group_type(V.mixed_candidates(spark, sf_dir).withColumn("pos", F.col("sample_index")), EXAMPLE)


@query("mixed_vote_counts", f"WITH {_MIXED} SELECT {_EX}, vote_key, votes FROM votes")
def mixed_vote_counts(spark, sf_dir):
    rows = V.mixed_candidates(spark, sf_dir).withColumn("pos", F.col("sample_index"))
    return select.select(rows, EXAMPLE, "majority_vote").select(*EXAMPLE, F.explode("vote_counts").alias("vote_key", "votes"))


_UNEVEN = f"""{_POOL},
uneven AS (SELECT dataset, model, n, example_id, sample_index, CASE ord % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'none' WHEN 4 THEN '1000000000' ELSE '1000000000.4' END AS answer,
  CASE WHEN example_id % 2 = 0 THEN '1000000000' ELSE 'none' END AS gold FROM pool, (VALUES (1), (4), (8), (16)) AS t(n) WHERE sample_index < n),
votes AS (SELECT dataset, model, n, example_id, substr(lower(answer), 1, 4) AS vote_key, count(*) AS votes, min(sample_index) AS p FROM uneven GROUP BY ALL),
won AS (SELECT *, row_number() OVER (PARTITION BY dataset, model, n, example_id ORDER BY votes DESC, p) AS nth FROM votes),
picked AS (SELECT dataset, model, n, example_id, answer = gold AS ok FROM won JOIN uneven USING (dataset, model, n, example_id) WHERE nth = 1 AND sample_index = p),
passed AS (SELECT dataset, model, n, example_id, bool_or(answer = gold) AS passed FROM uneven GROUP BY ALL)"""


@query(
    "uneven_matches",
    f"WITH {_UNEVEN} SELECT dataset, model, n, count(*) AS total_examples, count(*) FILTER (ok) AS select_correct, count(*) FILTER (passed) AS pass_at_n_correct FROM picked JOIN passed USING (dataset, model, n, example_id) GROUP BY ALL",
)
def uneven_matches(spark, sf_dir):
    """Answers that are pooled by one key and of which only some match: the first one of the key decides."""
    return scaling.pooled_conditions(V.uneven_pool(spark, sf_dir), V.SIZES)


class SlowBackend(sweep.EchoBackend):
    """The stand-in after a wait of up to five milliseconds, so that requests end in another order than they began."""

    def generate(self, system, user, temperature, max_tokens, seed, top_p):
        made = super().generate(system, user, temperature, max_tokens, seed, top_p)
        time.sleep(made.token_count % 6 / 1000)
        return made


@query("generate_concurrent", ORACLES["generate_mock"])
def generate_concurrent(spark, sf_dir):
    """The samples of `generate_mock` with 16 requests in flight in each task."""
    return generated(spark, sf_dir, SlowBackend, concurrent=16, timeout_s=30.0)


#: Rows of a file of a stream, about.
FILE_ROWS = 500_000


def _dealt(rows, folder: str, batch, file_rows: int = FILE_ROWS) -> int:
    """Rows as the files of a stream, as many for each batch number, in its order; how many files a batch has."""
    numbered = rows.withColumn("__batch", batch)
    counts = {r[0]: r[1] for r in numbered.groupBy("__batch").count().collect()}  # a handful
    files = max(1, -(-sum(counts.values()) // (max(1, len(counts)) * file_rows)))
    for n in sorted(counts):
        own = numbered.where(F.col("__batch") == n).drop("__batch")
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(folder)
    return files


def _stream(spark, folder: str, files: int):
    return incremental.stream_rows(spark, folder, spark.read.parquet(folder).schema, files_per_batch=files)


_SHIP = ["l_shipdate", "l_partkey", "l_suppkey"]


@query("stream_keep_last", ORACLES["dedupe_keep_last"])
def stream_keep_last(spark, sf_dir):
    """T5: the log in four shuffled batches as a stream; what its state holds at the end."""
    stateful.with_state_store(spark)
    base = folders.scratch(spark, "stream-keep-last")
    rows = V.append_log(spark, sf_dir)
    files = _dealt(rows, f"{base}/in", F.pmod(F.xxhash64(*rows.columns), F.lit(4)))
    stateful.run_through(stateful.keep_newest(_stream(spark, f"{base}/in", files), ["l_orderkey", "l_linenumber"], _SHIP), None, f"{base}/state", "update")
    return stateful.kept_values(spark, f"{base}/state").select("key.*", "value.max.*").select(*rows.columns)


_ANSWERED = "SELECT event_type AS method, user_id, event_id AS ord, ts, user_id % 3 = 0 AS is_correct FROM events"


@query("stream_newest", f"WITH s AS ({_ANSWERED}) SELECT user_id, method, epoch_us(ts) AS at, ord, is_correct FROM (SELECT *, row_number() OVER (PARTITION BY user_id, method ORDER BY ts DESC, ord DESC) AS nth FROM s) WHERE nth = 1")
def stream_newest(spark, sf_dir):
    """T5 with a time to live that none outlives here: changes of each batch, of which the newest one of a key counts."""
    base, files = _answered_stream(spark, sf_dir, "stream-newest")
    found = stateful.keep_newest_for(_stream(spark, f"{base}/in", files).where("ord >= 0"), ["user_id", "method"], "ord", 366 * 86_400_000, "40 days")
    stateful.run_through(found, f"{base}/out", f"{base}/state", "update")
    return dedupe.keep_last(spark.read.parquet(f"{base}/out"), ["user_id", "method"], ("at", "ord")).select("user_id", "method", "at", "ord", "is_correct")


@query("stream_running_accuracy", f"WITH s AS ({_ANSWERED}) SELECT method, ord, CAST(count(*) FILTER (is_correct) OVER w AS BIGINT) AS correct, count(*) OVER w AS scored FROM s WINDOW w AS (PARTITION BY method ORDER BY ts, ord)")
def stream_running_accuracy(spark, sf_dir):
    """A18 on a stream whose rows come up to a sixth of the whole time late: one row per selection, in event order."""
    base, files = _answered_stream(spark, sf_dir, "stream-running")
    late = int(spark.read.parquet(f"{base}/in").where("ord >= 0").agg((F.max("ts").cast("long") - F.min("ts").cast("long")) / 3).first()[0] or 0) + 2
    stateful.run_through(stateful.running_in_order(_stream(spark, f"{base}/in", files), ["method"], f"{late} seconds"), f"{base}/out", f"{base}/state", "append")
    return spark.read.parquet(f"{base}/out").where("ord >= 0").select("method", "ord", "correct", "scored")


def _answered_stream(spark, sf_dir, name: str) -> tuple[str, int]:
    """Selections in batches by time of which the rows overlap, then two closing batches of no method, whose time passes all others; and the files of a batch."""
    stateful.with_state_store(spark)
    base = folders.scratch(spark, name)
    e = V.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("method"), "user_id", F.col("event_id").alias("ord"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 3 == 0).alias("is_correct"))
    first, last = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if first is None:
        rows.write.parquet(f"{base}/in")
        return base, 1
    part = (last - first) // 6 + 1
    files = _dealt(rows, f"{base}/in", F.floor((F.unix_micros("ts") - first) / part) + F.pmod(F.xxhash64("ord"), F.lit(2)))
    for k in (1, 2):
        closing = spark.range(0, files, 1, files).select(F.lit("").alias("method"), F.lit(-1).cast("long").alias("user_id"), F.lit(-k).cast("long").alias("ord"), F.timestamp_micros(F.lit(last + 4 * k * part)).alias("ts"), F.lit(False).alias("is_correct"))
        closing.write.mode("append").parquet(f"{base}/in")  # a row in each file
    return base, files


#: Items of orders by status and priority; the runs of item j are r(j % 7) and, for every third, r(j * 3 % 7) too; every eleventh names none.
_SETS = """items AS (SELECT o_orderstatus AS dataset, o_orderpriority AS model, 'x' AS method, 1 AS n, j AS ord, count(*) AS total_examples, CAST(sum(o_custkey % 5) AS BIGINT) AS total_tokens,
  CASE WHEN j % 11 = 10 THEN []::VARCHAR[] WHEN j % 3 = 0 AND j % 7 <> j * 3 % 7 THEN list_sort([concat('r', j % 7), concat('r', j * 3 % 7)]) ELSE [concat('r', j % 7)] END AS ids
  FROM (SELECT *, o_custkey % 24 AS j FROM orders) GROUP BY ALL)"""


def _fold_sql(source: str, name: str) -> str:
    """CTEs that fold the items of `source` (conditions, ord, ids and counts) one by one, and `name`, those kept with their decisions."""
    key = "dataset, model, method, n"
    return f"""{name}_i AS (SELECT *, CASE WHEN len(ids) > 0 THEN ids ELSE [concat('anonymous ', ord)] END AS own, row_number() OVER (PARTITION BY {key} ORDER BY ord) AS i FROM {source}),
{name}_f AS (SELECT {key}, i, own AS covered, 1 AS sets, total_examples AS examples, [ord] AS kept, 'first' AS decision, ord FROM {name}_i WHERE i = 1
  UNION ALL SELECT {key}, x.i,
    CASE WHEN NOT list_has_any(covered, own) THEN list_concat(covered, own) ELSE covered END, sets + CASE WHEN NOT list_has_any(covered, own) THEN 1 ELSE 0 END,
    CASE WHEN list_has_any(covered, own) AND sets = 1 AND list_has_all(covered, own) AND list_has_all(own, covered) AND total_examples > examples THEN total_examples ELSE examples END,
    CASE WHEN NOT list_has_any(covered, own) THEN list_append(kept, x.ord) WHEN sets = 1 AND list_has_all(covered, own) AND list_has_all(own, covered) AND total_examples > examples THEN [x.ord] ELSE kept END,
    CASE WHEN NOT list_has_any(covered, own) THEN 'added' WHEN sets = 1 AND list_has_all(covered, own) AND list_has_all(own, covered) AND total_examples > examples THEN 'replaced' WHEN list_has_all(covered, own) THEN 'covered' ELSE 'overlap' END, x.ord
  FROM {name}_f f JOIN {name}_i x USING ({key}) WHERE x.i = f.i + 1),
{name}_e AS (SELECT {key}, arg_max(kept, i) AS kept FROM {name}_f GROUP BY ALL),
{name} AS (SELECT {key}, CAST(sum(total_examples) AS BIGINT) AS total_examples, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, list_sort(list_distinct(flatten(list(ids)))) AS ids
  FROM {name}_i JOIN {name}_e USING ({key}) WHERE list_contains(kept, ord) GROUP BY ALL)"""


def _set_items(spark, sf_dir):
    j = F.col("o_custkey") % 24
    one, two = F.concat(F.lit("r"), F.col("ord") % 7), F.concat(F.lit("r"), F.col("ord") * 3 % 7)
    rows = V.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("model"), F.lit("x").alias("method"), F.lit(1).alias("n"), j.alias("ord"))
    rows = rows.agg(F.count(F.lit(1)).alias("total_examples"), F.sum(F.col("o_custkey") % 5).alias("total_tokens"))
    return rows.withColumn("run_ids", F.when(F.col("ord") % 11 == 10, F.array().cast("array<string>")).when(F.col("ord") % 3 == 0, F.array(one, two)).otherwise(F.array(one)))


@query("merge_decisions", f"WITH RECURSIVE {_SETS}, {_fold_sql('items', 'm')} SELECT dataset, model, ord, decision FROM m_f")
def merge_decisions(spark, sf_dir):
    """What becomes of each item whose set of runs is new, counted already, or both in part."""
    return merging.folded(_set_items(spark, sf_dir)).select("dataset", "model", "ord", "decision")


@query(
    "merge_merged",
    f"""WITH RECURSIVE {_SETS}, early AS (SELECT * FROM items WHERE ord < 10), late AS (SELECT * FROM items WHERE ord >= 10), {_fold_sql('early', 'a')}, {_fold_sql('late', 'b')},
again AS (SELECT *, 0 AS ord FROM a UNION ALL SELECT *, 1 AS ord FROM b), {_fold_sql('again', 'c')} SELECT dataset, model, total_examples, total_tokens, array_to_string(ids, ';') AS run_ids FROM c""",
)
def merge_merged(spark, sf_dir):
    """Two merged tables merged once more."""
    items = _set_items(spark, sf_dir)
    halves = [merging.merge_runs(items.where(c)).withColumn("ord", F.lit(k)) for k, c in enumerate(("ord < 10", "ord >= 10"))]
    done = merging.merge_runs(halves[0].unionByName(halves[1]))
    return done.select("dataset", "model", "total_examples", "total_tokens", F.array_join("run_ids", ";").alias("run_ids"))


@query("logged_units", ORACLES["generate_mock"])
def logged_units(spark, sf_dir):
    """Units logged as they end, half of them before a break; the rest is what the log's keys leave."""
    path = folders.scratch(spark, "unit-log")
    prompts = mock_prompts(spark, sf_dir).withColumn(unitlog.KEY, F.col("example_id"))
    through = sweep.unit_sampler(SlowBackend, 4, MOCK, 7, 0.5, False, 8, 30.0)
    unitlog.append(prompts.where(F.xxhash64("example_id") % 2 == 0), path, units=5, through=through)
    left = prompts.join(unitlog.logged_keys(spark, path), unitlog.KEY, "left_anti") if folders.listing(spark, path) else prompts
    unitlog.append(left, path, units=5, through=through)
    rows = unitlog.logged_rows(spark, path)
    return rows.select("example_id", "sample_index", "sample_seed", "token_count", "estimated_cost", X.extract_answer(F.col("response"), F.lit("number")).alias("extracted_answer"))


@query(
    "expand_methods",
    """WITH m AS (SELECT n_name AS name, n_regionkey AS r, n_nationkey AS k, unnest(CASE WHEN n_nationkey % 2 = 0 THEN [1, 4, 4 + 4 * n_regionkey] ELSE [1 + n_regionkey] END) AS n FROM nation)
SELECT CASE WHEN k % 2 = 0 THEN concat(name, '_n', n) ELSE name END AS method, CASE WHEN n = 1 AND k % 2 = 0 THEN 'first' ELSE 'majority_vote' END AS selection, CAST(n AS INT) AS n,
  CASE WHEN n = 1 AND k % 2 = 0 THEN 0.0 ELSE CAST((k % 5) / 10.0 AS DOUBLE) END AS temperature, CASE WHEN k % 4 = 0 THEN name END AS nested_group_id,
  CAST(CASE WHEN k % 4 = 0 THEN greatest(4, 4 + 4 * r) END AS INT) AS nested_max_n, CASE WHEN k % 3 = 0 THEN 'yo' ELSE 'en' END AS reasoning_language FROM m""",
)
def expand_methods(spark, sf_dir):
    """a method, or a sweep, of each nation."""
    rows = [
        {"name": r.n_name, "prompt_style": "yoruba_cot" if r.n_nationkey % 3 == 0 else "english_cot", "selection": "majority_vote", "temperature": r.n_nationkey % 5 / 10, "nested_n": r.n_nationkey % 4 == 0}
        | ({"n_values": [1, 4, 4 + 4 * r.n_regionkey]} if r.n_nationkey % 2 == 0 else {"n": 1 + r.n_regionkey})
        for r in V.table(spark, sf_dir, "nation").collect()  # configuration: a row per method
    ]
    return sweep.method_table(spark, config.expand_methods(rows)).select("method", "selection", "n", "temperature", "nested_group_id", "nested_max_n", "reasoning_language")
