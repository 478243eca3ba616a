"""Registered queries over the driver tables, each beside its DuckDB oracle."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalscale import views as V
from evalscale.functions import ingest as N
from evalscale.functions import prompts as P
from evalscale.functions import text as X
from evalscale.operators import compare, dedupe, merging, metrics, numbering, reselect, resume, scaling, select
from evalscale.plans import config, sweep
from evalscale.plans import run as runs
from evalscale.schemas import CONDITION, EXAMPLE
from evalscale.sources import logs, raw

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_POOL = """pool AS (SELECT concat('d', user_id % 2) AS dataset, concat('m', event_id % 3) AS model, user_id AS example_id,
  CAST(row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) - 1 AS INTEGER) AS sample_index,
  CAST(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) % 5 AS VARCHAR) AS extracted_answer, CAST(user_id % 5 AS VARCHAR) AS gold_answer, event_id AS ord,
  value AS latency_s, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS token_count, concat('r', event_id % 4) AS run_id, event_type FROM events)"""
_CAND = f"{_POOL},\ncand AS (SELECT *, concat('ttc_n', n) AS method FROM pool, (VALUES (1), (4), (8), (16)) AS t(n) WHERE sample_index < n)"
_VOTES = f"""{_CAND},
votes AS (SELECT dataset, model, method, n, example_id, extracted_answer AS answer, count(*) AS c, min(sample_index) AS p FROM cand GROUP BY ALL),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, model, method, n, example_id ORDER BY c DESC, p) AS nth FROM votes) WHERE nth = 1)"""
_EX = "dataset, model, method, n, example_id"
_MARK = "sel AS (SELECT *, CAST(example_id % 5 AS VARCHAR) = answer AS is_correct FROM chosen)"


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections of the candidate view by majority vote."""
    c = V.candidates(spark, sf_dir)
    s = reselect.reselect(c, ["majority_vote"], dedupe=False)
    return s.withColumns({"ord": F.col("example_id"), "run_id": F.lit("r0"), **{x: F.lit(x) for x in ("model_size_label", "prompt_style", "reasoning_language", "selection")}})


@query(
    "scaling_table",
    f"""WITH {_VOTES}, {_MARK},
per AS (SELECT {_EX}, bool_or(extracted_answer = gold_answer) AS passed FROM cand GROUP BY ALL)
SELECT dataset, model, n, count(*) AS total_examples, count(*) FILTER (is_correct) AS select_correct, count(*) FILTER (passed) AS pass_correct,
  round(count(*) FILTER (passed) / count(*), 6) AS pass_at_n_rate, round(count(*) FILTER (is_correct) / count(*), 6) AS accuracy,
  round(count(*) FILTER (passed) / count(*) - count(*) FILTER (is_correct) / count(*), 6) AS gap
FROM per JOIN sel USING ({_EX}) GROUP BY dataset, model, n""",
)
def scaling_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: pass@N, select@N and their gap by dataset, model and sample count, in one pass over pooled votes."""
    rows = scaling.pooled_conditions(V.pool(spark, sf_dir), V.SIZES)
    total, good, passed = F.col("total_examples"), F.col("select_correct"), F.col("pass_at_n_correct")
    rates = {"pass_at_n_rate": passed / total, "accuracy": good / total, "gap": passed / total - good / total}
    return rows.select("dataset", "model", "n", "total_examples", "select_correct", passed.alias("pass_correct"), *[F.round(c, 6).alias(k) for k, c in rates.items()])


@query("majority_vote", f"WITH {_VOTES} SELECT {_EX}, p AS selected_sample_index, answer AS selected_answer FROM chosen")
def majority_vote(spark, sf_dir):
    return select.select(V.candidates(spark, sf_dir), EXAMPLE, "majority_vote").drop("vote_counts")


@query("vote_counts", f"WITH {_VOTES} SELECT {_EX}, concat('num:', answer) AS vote_key, c AS votes FROM votes")
def vote_counts(spark, sf_dir):
    rows = select.select(V.candidates(spark, sf_dir), EXAMPLE, "majority_vote")
    return rows.select(*EXAMPLE, F.explode("vote_counts").alias("vote_key", "votes"))


@query("first_select", f"WITH {_CAND} SELECT {_EX}, 0 AS selected_sample_index, extracted_answer AS selected_answer FROM cand WHERE sample_index = 0")
def first_select(spark, sf_dir):
    return select.select(V.candidates(spark, sf_dir), EXAMPLE, "first").drop("vote_counts")


@query("pass_at_n", f"WITH {_CAND} SELECT {_EX}, bool_or(extracted_answer = gold_answer) AS passed FROM cand GROUP BY ALL")
def pass_at_n(spark, sf_dir):
    return metrics.pass_per_example(V.candidates(spark, sf_dir))


@query("pass_at_n_group", f"WITH {_CAND} SELECT {_EX}, bool_or(extracted_answer = gold_answer) AS passed FROM cand GROUP BY ALL")
def pass_at_n_group(spark, sf_dir):
    return metrics.pass_per_group(V.candidates(spark, sf_dir))


_LAST = "l_orderkey, l_linenumber"


@query(
    "dedupe_keep_last",
    f"SELECT * EXCLUDE nth FROM (SELECT *, row_number() OVER (PARTITION BY {_LAST} ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS nth FROM lineitem) WHERE nth = 1",
)
def dedupe_keep_last(spark, sf_dir):
    return dedupe.keep_last(V.append_log(spark, sf_dir), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])


@query(
    "dedupe_first_position",
    """SELECT l_orderkey, l_linenumber, min(ord) AS first_ord, max(ord) AS ord, arg_max(l_partkey, ord) AS l_partkey, arg_max(l_quantity, ord) AS l_quantity
FROM (SELECT *, epoch_us(l_shipdate) // 1000000 * 100000000 + l_partkey * 1000 + l_suppkey AS ord FROM lineitem) GROUP BY ALL""",
)
def dedupe_first_position(spark, sf_dir):
    order = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    rows = V.append_log(spark, sf_dir).withColumn("ord", order).select("l_orderkey", "l_linenumber", "ord", "l_partkey", "l_quantity")
    return dedupe.keep_last_at_first(rows, ["l_orderkey", "l_linenumber"])


@query("dedupe_dropped", "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS dropped FROM lineitem")
def dedupe_dropped(spark, sf_dir):
    return dedupe.duplicates_dropped(V.append_log(spark, sf_dir), ["l_orderkey", "l_linenumber"])


@query("group_positions", f"WITH {_CAND} SELECT {_EX}, ord, CAST(row_number() OVER (PARTITION BY {_EX} ORDER BY sample_index, ord) - 1 AS INTEGER) AS pos FROM cand")
def group_positions(spark, sf_dir):
    return dedupe.positions(V.candidates(spark, sf_dir).drop("pos"), EXAMPLE).select(*EXAMPLE, "ord", "pos")


def _e1(spark, sf_dir):
    p = V.pool(spark, sf_dir).withColumns({"method": F.col("event_type"), "finish_reason": F.when(F.col("latency_s") > 50, "length").otherwise("stop"), "is_correct": F.col("extracted_answer") == F.col("gold_answer")})
    return p.where("sample_index = 0"), p


_E1 = f"WITH {_POOL}, sels AS (SELECT event_type AS method, extracted_answer = gold_answer AS ok, ord, model, dataset FROM pool WHERE sample_index = 0)"


@query("e1_accuracy", f"{_E1} SELECT method, count(*) AS total, count(*) FILTER (ok) AS correct FROM sels GROUP BY method")
def e1_accuracy(spark, sf_dir):
    return metrics.method_accuracy(_e1(spark, sf_dir)[0])


@query(
    "e1_truncation",
    f"""{_E1}, cut AS (SELECT event_type AS method, count(*) AS candidates, count(*) FILTER (latency_s > 50) AS truncated FROM pool GROUP BY ALL)
SELECT method, total, correct, candidates, truncated, round(correct / total, 6) AS accuracy, round(truncated / candidates, 6) AS truncation_rate
FROM (SELECT method, count(*) AS total, count(*) FILTER (ok) AS correct FROM sels GROUP BY method) LEFT JOIN cut USING (method)""",
)
def e1_truncation(spark, sf_dir):
    rows = metrics.truncation_rate(*_e1(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("accuracy", "truncation_rate")})


@query("truncated_rows", f"WITH {_POOL} SELECT event_type AS method, ord, model FROM pool WHERE latency_s > 50 AND event_type IN ('click', 'view', 'purchase')")
def truncated_rows(spark, sf_dir):
    rows = _e1(spark, sf_dir)[1]
    return rows.where(metrics.truncated(rows) & F.col("method").isin("click", "view", "purchase")).select("method", "ord", "model")


@query("first_labels", f"{_E1} SELECT arg_min(model, ord) AS model, arg_min(dataset, ord) AS dataset FROM sels")
def first_labels(spark, sf_dir):
    return metrics.first_labels(_e1(spark, sf_dir)[0])


_RATES = """round(select_correct / total_examples, 6) AS accuracy, round(pass_at_n_correct / total_examples, 6) AS pass_at_n_rate,
  round(total_tokens / total_examples, 6) AS mean_tokens_per_example, round(total_tokens / nullif(select_correct, 0), 6) AS tokens_per_correct,
  round(total_latency_s / nullif(select_correct, 0), 4) AS latency_s_per_correct, round(select_correct / total_examples / (total_tokens / 1000.0), 9) AS accuracy_per_1k_tokens"""
_TOTALS = f"""totals AS (SELECT dataset, model, method, n,
  CASE WHEN count(s_ok) > 0 THEN count(s_ok) ELSE count(passed) END AS total_examples, count(*) FILTER (s_ok) AS select_correct,
  CASE WHEN count(s_ok) > 0 THEN count(*) FILTER (passed AND s_ok IS NOT NULL) ELSE count(*) FILTER (passed) END AS pass_at_n_correct,
  CAST(coalesce(sum(c), 0) AS BIGINT) AS total_candidates, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens, round(CAST(coalesce(sum(latency), 0) AS DOUBLE), 4) AS total_latency_s
FROM (SELECT {_EX}, bool_or(extracted_answer = gold_answer) AS passed, count(*) AS c, sum(token_count) AS tokens, sum(CAST(latency_s AS DECIMAL(18, 6))) AS latency FROM {{cand}} GROUP BY ALL)
FULL JOIN (SELECT {_EX}, is_correct AS s_ok FROM {{sel}}) USING ({_EX}) GROUP BY ALL)"""
_TOTAL_COLUMNS = [*CONDITION, "total_examples", "select_correct", "pass_at_n_correct", "total_candidates", "total_tokens", "total_latency_s"]


def _conditions(spark, sf_dir, c: DataFrame, s: DataFrame) -> DataFrame:
    return metrics.conditions(c, s).withColumn("total_latency_s", F.round("total_latency_s", 4))


@query("condition_metrics", f"WITH {_VOTES}, {_MARK}, {_TOTALS.format(cand='cand', sel='sel')} SELECT *, {_RATES} FROM totals")
def condition_metrics(spark, sf_dir):
    rows = _conditions(spark, sf_dir, V.candidates(spark, sf_dir), chosen(spark, sf_dir))
    rates = metrics.with_efficiency(metrics.with_rates(rows))
    digits = {"accuracy": 6, "pass_at_n_rate": 6, "mean_tokens_per_example": 6, "tokens_per_correct": 6, "latency_s_per_correct": 4, "accuracy_per_1k_tokens": 9}
    return rates.select(*_TOTAL_COLUMNS, *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(
    "outer_join_conditions",
    f"""WITH {_VOTES}, {_MARK}, {_TOTALS.format(cand="(SELECT * FROM cand WHERE example_id % 7 <> 0 AND NOT (n = 8 AND model = 'm1'))", sel="(SELECT * FROM sel WHERE example_id % 5 <> 0 AND n <> 4)")}
SELECT * FROM totals""",
)
def outer_join_conditions(spark, sf_dir):
    """Candidates without selections, selections without candidates, and conditions with one side only."""
    c = V.candidates(spark, sf_dir).where("example_id % 7 <> 0 and not (n = 8 and model = 'm1')")
    return _conditions(spark, sf_dir, c, chosen(spark, sf_dir).where("example_id % 5 <> 0 and n <> 4")).select(*_TOTAL_COLUMNS)


@query(
    "reselect_report",
    f"""WITH {_VOTES}, {_MARK},
both_ AS (SELECT {_EX}, is_correct, 'majority_vote' AS strategy FROM sel UNION ALL SELECT {_EX}, extracted_answer = gold_answer, 'first' FROM cand WHERE sample_index = 0),
passed AS (SELECT dataset, model, method, n, count(*) AS total, count(*) FILTER (ok) AS pass_correct FROM (SELECT {_EX}, bool_or(extracted_answer = gold_answer) AS ok FROM cand GROUP BY ALL) GROUP BY ALL),
s AS (SELECT dataset, model, method, n, strategy, count(*) FILTER (is_correct) AS select_correct, count(*) AS selected FROM both_ GROUP BY ALL)
SELECT *, round(pass_correct / total, 6) AS pass_at_n_rate, round(select_correct / selected, 6) AS select_rate, round(pass_correct / total - select_correct / selected, 6) AS gap
FROM passed JOIN s USING (dataset, model, method, n)""",
)
def reselect_report(spark, sf_dir):
    rows = reselect.reselection_report(V.candidates(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("pass_at_n_rate", "select_rate", "gap")})


_ITEMS = f"""items AS (SELECT dataset, model, method, n, run_id, nth, count(*) AS total_examples, count(*) FILTER (extracted_answer = gold_answer) AS select_correct, CAST(sum(token_count) AS BIGINT) AS total_tokens,
  CAST(nth * 10 + CAST(substr(run_id, 2) AS INTEGER) * 7 % 5 + CAST(substr(run_id, 2) AS INTEGER) AS BIGINT) AS ord FROM (SELECT *, CAST(example_id % 3 AS INTEGER) AS nth FROM cand) GROUP BY ALL)"""


def _items(spark, sf_dir):
    """V4: conditions of four runs in three parts each, in a mixed order."""
    r = F.substring("run_id", 2, 9).cast("int")
    c = V.candidates(spark, sf_dir).withColumn("nth", (F.col("example_id") % 3).cast("int"))
    rows = c.groupBy(*CONDITION, "run_id", "nth").agg(
        F.count(F.lit(1)).alias("total_examples"), F.count_if(F.col("extracted_answer") == F.col("gold_answer")).alias("select_correct"), F.sum("token_count").alias("total_tokens")
    )
    return rows.withColumn("ord", (F.col("nth") * 10 + r * 7 % 5 + r).cast("long"))


@query(
    "merge_runs",
    f"""WITH {_CAND}, {_ITEMS},
f AS (SELECT *, first_value(run_id) OVER (PARTITION BY dataset, model, method, n ORDER BY ord) AS r1 FROM items),
o AS (SELECT *, min(ord) FILTER (run_id <> r1) OVER (PARTITION BY dataset, model, method, n) AS p FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY dataset, model, method, n, run_id ORDER BY CASE WHEN run_id = r1 THEN -total_examples ELSE 0 END, ord) AS w FROM o WHERE run_id <> r1 OR p IS NULL OR ord < p)
SELECT dataset, model, method, n, CAST(sum(total_examples) AS BIGINT) AS total_examples, CAST(sum(select_correct) AS BIGINT) AS select_correct, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  string_agg(run_id, ';' ORDER BY run_id) AS run_ids FROM k WHERE w = 1 GROUP BY ALL""",
)
def merge_runs(spark, sf_dir):
    return metrics.merge_runs(_items(spark, sf_dir)).withColumn("run_ids", F.concat_ws(";", "run_ids"))


_COMPARE = compare.Comparison("m0", "m2", 1, ("m1", "m9"), None, "ttc_n*", "ttc", None)


def _metrics(spark, sf_dir):
    """V5: the conditions as E4 input; dataset d1 has no large baseline in the dataset `e`."""
    pool = V.pool(spark, sf_dir).withColumn("estimated_cost", F.col("token_count") / 1000.0 * 0.5)
    rows = metrics.with_rates(scaling.pooled_conditions(pool, V.SIZES, totals=True).withColumn("total_latency_s", F.round("total_latency_s", 4)))
    both = F.array(F.col("dataset"), F.when((F.col("dataset") == "d0") & (F.col("model") == "m0"), "e"))
    rows = rows.withColumn("dataset", F.explode(F.array_compact(both)))
    return rows.withColumns({"method": F.concat(F.lit("ttc_n"), F.col("n").cast("string")), "ord": F.col("n").cast("long")})


_E4 = f"""{_VOTES}, {_MARK}, {_TOTALS.format(cand='cand', sel='sel')},
m AS (SELECT * EXCLUDE accuracy, select_correct / total_examples AS accuracy FROM (SELECT *, 0 AS accuracy FROM totals UNION ALL SELECT * REPLACE ('e' AS dataset), 0 FROM totals WHERE dataset = 'd0' AND model = 'm0')),
small AS (SELECT * FROM m WHERE model = 'm0'), large AS (SELECT * FROM m WHERE model = 'm2' AND n = 1)"""


@query(
    "e4_paper_table",
    f"""WITH {_E4} SELECT small.dataset, small.n AS small_n, small.method AS small_method, large.method AS large_method, round(small.accuracy, 6) AS small_accuracy, round(large.accuracy, 6) AS large_accuracy,
  round(small.accuracy - large.accuracy, 6) AS accuracy_delta, small.accuracy + 1e-12 >= large.accuracy AS matches_or_beats_large,
  round(small.total_tokens / large.total_tokens, 6) AS token_ratio_vs_large, round(small.total_latency_s / large.total_latency_s, 6) AS latency_ratio_vs_large
FROM small LEFT JOIN large USING (dataset)""",
)
def e4_paper_table(spark, sf_dir):
    rows = compare.paper_table(_metrics(spark, sf_dir), _COMPARE)
    digits = ("small_accuracy", "large_accuracy", "accuracy_delta", "token_ratio_vs_large", "latency_ratio_vs_large")
    return rows.select("dataset", "small_n", "small_method", "large_method", "matches_or_beats_large", *[F.round(c, 6).alias(c) for c in digits])


_PER = f"""{_E4}, per AS (SELECT dataset, coalesce(bool_or(large.n IS NOT NULL), false) AS has_large, min(small.n) FILTER (small.accuracy + 1e-12 >= large.accuracy) AS min_n
FROM (SELECT DISTINCT dataset FROM m) LEFT JOIN small USING (dataset) LEFT JOIN large USING (dataset) GROUP BY dataset)"""


@query("e4_min_n", f"WITH {_PER} SELECT * FROM per")
def e4_min_n(spark, sf_dir):
    return compare.per_dataset(_metrics(spark, sf_dir), _COMPARE)


@query(
    "e4_headline",
    f"""WITH {_PER} SELECT coalesce(string_agg(concat(dataset, ':', min_n), ',' ORDER BY dataset) FILTER (has_large AND min_n IS NOT NULL), '') AS matched,
  coalesce(string_agg(dataset, ',' ORDER BY dataset) FILTER (has_large AND min_n IS NULL), '') AS unmatched, coalesce(string_agg(dataset, ',' ORDER BY dataset) FILTER (NOT has_large), '') AS missing,
  median(min_n) FILTER (has_large) AS median_min_n FROM per""",
)
def e4_headline(spark, sf_dir):
    rows = compare.headline(_metrics(spark, sf_dir), _COMPARE)
    matched = F.transform("datasets_matched", lambda x: F.concat_ws(":", x["dataset"], x["min_n"].cast("string")))
    return rows.select(
        F.concat_ws(",", matched).alias("matched"), F.concat_ws(",", "datasets_unmatched").alias("unmatched"), F.concat_ws(",", "datasets_missing_large_baseline").alias("missing"),
        F.col("median_min_n_to_match").alias("median_min_n"),
    )


@query(
    "e4_one_dataset",
    f"WITH {_E4} SELECT small.dataset, small.n AS small_n, round(small.accuracy, 6) AS small_accuracy, round(large.accuracy, 6) AS large_accuracy FROM small LEFT JOIN large USING (dataset) WHERE dataset = 'e'",
)
def e4_one_dataset(spark, sf_dir):
    """A comparison over some of the datasets, here the one without a large baseline."""
    rows = compare.paper_table(_metrics(spark, sf_dir), replace(_COMPARE, datasets=("e",)))
    return rows.select("dataset", "small_n", *[F.round(c, 6).alias(c) for c in ("small_accuracy", "large_accuracy")])


@query(
    "distinct_conditions",
    f"WITH {_CAND}, {_ITEMS} SELECT dataset, model, method, n, run_id, total_examples, ord FROM (SELECT *, row_number() OVER (PARTITION BY dataset, model, method, n ORDER BY total_examples DESC, ord) AS w FROM items) WHERE w = 1",
)
def distinct_conditions(spark, sf_dir):
    """O3: of a condition's many rows that with most examples, the earliest if they tie."""
    return compare.distinct_conditions(_items(spark, sf_dir)).select(*CONDITION, "run_id", "total_examples", "ord")


@query("condition_labels", f"WITH {_CAND} SELECT dataset, model, method, n, arg_min(run_id, ord) AS model_size_label, arg_min(event_type, ord) AS prompt_style, string_agg(DISTINCT run_id, ';' ORDER BY run_id) AS run_ids FROM cand GROUP BY ALL")
def condition_labels(spark, sf_dir):
    """The labels of a condition are those of its first candidate; and the runs that its examples come from."""
    c = V.candidates(spark, sf_dir).withColumns({"model_size_label": F.col("run_id"), "prompt_style": F.col("event_type")})
    rows = metrics.conditions(c, chosen(spark, sf_dir).where("n < 0"))
    return rows.select(*CONDITION, "model_size_label", "prompt_style", F.concat_ws(";", "run_ids").alias("run_ids"))


@query(
    "unit_costs",
    f"""WITH {_POOL} SELECT concat_ws(chr(9), 'nested', dataset, model, 'ttc', CAST(example_id AS VARCHAR)) AS key, count(*) AS generations, CAST(sum(token_count) AS BIGINT) AS tokens, round(CAST(sum(CAST(latency_s AS DECIMAL(18, 6))) AS DOUBLE), 4) AS latency_s FROM pool GROUP BY ALL""",
)
def unit_costs(spark, sf_dir):
    """Samples, tokens and seconds of each unit, by what was really generated."""
    key = sweep.unit_key(F.lit("nested"), F.col("dataset"), F.col("model"), F.lit("ttc"), F.col("example_id").cast("string"))
    return runs.unit_costs(V.pool(spark, sf_dir).withColumn("key", key), ["key"]).withColumn("latency_s", F.round("latency_s", 4))


@query("e4_ladder", f"WITH {_E4} SELECT dataset, model, method, n, round(accuracy, 6) AS accuracy FROM m WHERE model IN ('m1', 'm9') AND n = 1")
def e4_ladder(spark, sf_dir):
    return compare.ladder(_metrics(spark, sf_dir), _COMPARE).select("dataset", "model", "method", "n", F.round("accuracy", 6).alias("accuracy"))


@query("e4_sample_counts", f"WITH {_E4} SELECT DISTINCT dataset, n FROM m WHERE model = 'm0'")
def e4_sample_counts(spark, sf_dir):
    return compare.sample_counts(_metrics(spark, sf_dir), ["m0"])


@query(
    "method_filter",
    """SELECT e AS method, f AS wanted, CASE WHEN f = '' OR f = '*' THEN true WHEN f LIKE '%*' THEN starts_with(e, rtrim(f, '*')) ELSE e = f OR starts_with(e, f || '_') OR starts_with(e, f || '-') END AS ok
FROM (SELECT DISTINCT concat(event_type, s) AS e FROM events, (VALUES (''), ('_n4'), ('-x'), ('n4')) t(s)), (VALUES (''), ('*'), ('cl*'), ('click'), ('view')) u(f)""",
)
def method_filter(spark, sf_dir):
    names = V.table(spark, sf_dir, "events").select(F.explode(F.array(*[F.concat(F.col("event_type"), F.lit(s)) for s in ("", "_n4", "-x", "n4")])).alias("method")).distinct()
    wanted = ("", "*", "cl*", "click", "view")
    tests = F.array(*[F.struct(F.lit(w).alias("wanted"), compare.method_matches(F.col("method"), w).alias("ok")) for w in wanted])
    return names.select("method", F.explode(tests).alias("t")).select("method", "t.wanted", "t.ok")


# ---- text functions -------------------------------------------------------------------------------------------------

_RESPONSE = f"""{_POOL}, resp AS (SELECT *, CASE ord % 6 WHEN 0 THEN 'Step one.' || chr(10) || 'Final answer: ' || extracted_answer || '  ' || chr(10) || 'bye'
  WHEN 1 THEN '<think>Answer: 99' || chr(10) || '</think>so' || chr(10) || 'Answer - **' || extracted_answer || '**'
  WHEN 2 THEN 'reasoning here' || chr(10) || chr(10) || ' the value is ' || extracted_answer || chr(10) WHEN 3 THEN 'Idahun ikeyin: ' || extracted_answer || '.0'
  WHEN 4 THEN 'ANSWER: first' || chr(10) || 'final answer: ' || extracted_answer || ',000 items' ELSE '' END AS response FROM pool),
think AS (SELECT *, regexp_replace(regexp_replace(response, '(?is)<think>.*?</think>', chr(10), 'g'), '(?is)<think>.*$', chr(10)) AS visible FROM resp),
marked AS (SELECT *, regexp_extract_all(visible, '(?im)^\\s*(?:final\\s+answer|answer|idahun\\s+ikeyin)\\s*[:\\-]\\s*(.+?)\\s*$', 1) AS a, list_filter(list_transform(string_split(visible, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM think),
final AS (SELECT *, trim(coalesce(a[-1], l[-1], ''), '`*_ ') AS answer FROM marked),
num AS (SELECT *, CASE WHEN regexp_matches(answer, '[0-9]') THEN replace(regexp_extract(answer, '-?[0-9]+(,[0-9]{{3}})*(\\.[0-9]+)?'), ',', '') ELSE answer END AS number FROM final)"""


def _responses(spark, sf_dir):
    return V.pool(spark, sf_dir).withColumn("response", V.response_text())


@query("strip_think", f"WITH {_RESPONSE} SELECT ord, visible FROM think")
def strip_think(spark, sf_dir):
    return _responses(spark, sf_dir).select("ord", X.strip_thinking(F.col("response")).alias("visible"))


@query("final_answer", f"WITH {_RESPONSE} SELECT ord, answer FROM final")
def final_answer(spark, sf_dir):
    return _responses(spark, sf_dir).select("ord", X.final_answer(F.col("response")).alias("answer"))


@query("extract_number", f"WITH {_RESPONSE} SELECT ord, number, TRY_CAST(number AS DOUBLE) AS value FROM num")
def extract_number(spark, sf_dir):
    rows = _responses(spark, sf_dir).withColumn("answer", X.final_answer(F.col("response")))
    return rows.select("ord", X.extract_number(F.col("answer")).alias("number"), X.parse_number(F.col("answer")).alias("value"))


@query(
    "extract_choice",
    f"""WITH {_RESPONSE}, cand AS (SELECT ord, CASE ord % 4 WHEN 0 THEN 'The answer is (' || chr(CAST(65 + ord % 6 AS INTEGER)) || ').' WHEN 1 THEN 'b) Two' WHEN 2 THEN 'three!' ELSE 'seven' END AS t FROM pool)
SELECT ord, CASE WHEN ord % 4 = 0 AND ord % 6 <= 3 THEN chr(CAST(65 + ord % 6 AS INTEGER)) WHEN ord % 4 = 0 THEN t WHEN ord % 4 = 1 THEN 'B' WHEN ord % 4 = 2 THEN 'C' ELSE t END AS choice FROM cand""",
)
def extract_choice(spark, sf_dir):
    letter = F.char(65 + F.col("ord") % 6)
    text = F.when(F.col("ord") % 4 == 0, F.concat(F.lit("The answer is ("), letter, F.lit(")."))).when(F.col("ord") % 4 == 1, "b) Two").when(F.col("ord") % 4 == 2, "three!").otherwise("seven")
    offered = F.array(*[F.lit(c) for c in ("A. One", "B. Two", "C. Three", "D. Four")])
    return V.pool(spark, sf_dir).select("ord", X.extract_choice(text, offered).alias("choice"))


@query(
    "exact_match",
    f"""WITH {_RESPONSE} SELECT ord, CASE WHEN TRY_CAST(number AS DOUBLE) IS NOT NULL THEN abs(CAST(number AS DOUBLE) - CAST(gold_answer AS DOUBLE)) <= 1e-6 ELSE false END AS same,
  lower(replace(answer, '.', '')) = gold_answer AS same_text FROM num""",
)
def exact_match(spark, sf_dir):
    rows = _responses(spark, sf_dir).withColumn("answer", X.final_answer(F.col("response")))
    return rows.select(
        "ord", X.exact_match(F.col("answer"), F.col("gold_answer"), F.lit("number")).alias("same"), X.exact_match(F.col("answer"), F.col("gold_answer"), F.lit("text")).alias("same_text")
    )


@query(
    "vote_key",
    f"""WITH {_RESPONSE} SELECT ord, CASE WHEN answer = '' THEN concat('__empty_', sample_index) ELSE concat('num:', CAST(CAST(number AS DOUBLE) AS BIGINT)) END AS k FROM num""",
)
def vote_key(spark, sf_dir):
    rows = _responses(spark, sf_dir).withColumn("answer", X.final_answer(F.col("response")))
    return rows.select("ord", X.vote_key(F.col("answer"), F.lit("number"), F.col("sample_index")).alias("k"))


_PUNCT_RE = "[!-/:-@\\[-`{-~]"


@query(
    "normalize_text",
    f"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '^\\p{{L}}[.)]', ''), ' ' || chr(10) || chr(9) || chr(13))), '{_PUNCT_RE}', '', 'g'), '\\s+', ' ', 'g')) AS t
FROM documents""",
)
def normalize_text(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text")).alias("t"))


@query("token_fallback", "SELECT doc_id, greatest(1, len(regexp_extract_all(text, '[^\\s]+'))) AS tokens FROM documents")
def token_fallback(spark, sf_dir):
    none = F.lit(None).cast("long")
    return V.table(spark, sf_dir, "documents").select("doc_id", X.words_or_usage(none, F.lit(0), F.col("text")).alias("tokens"))


# ---- planning and resuming ------------------------------------------------------------------------------------------

_SWEEP = [{"name": "ttc", "prompt_style": "english_cot", "selection": "majority_vote", "n_values": [1, 4, 8, 16], "temperature": 0.7, "greedy_n1": False, "nested_n": True}]


@query("nested_slices", f"WITH {_CAND} SELECT dataset, model, method, n, example_id, sample_index, ord, 'ttc' AS nested_group_id, 16 AS nested_pool_n, CASE WHEN n = 1 THEN 'majority_vote' ELSE 'majority_vote' END AS selection FROM cand")
def nested_slices(spark, sf_dir):
    rows = sweep.nested_slices(V.pool(spark, sf_dir), config.expand_methods(_SWEEP), "ttc", 16)
    return rows.select(*EXAMPLE, "sample_index", "ord", "nested_group_id", "nested_pool_n", "selection")


def _units(spark, sf_dir):
    examples = V.pool(spark, sf_dir).select("dataset", F.col("example_id").cast("string").alias("example_id")).distinct()
    models = spark.createDataFrame([("m0",), ("m1",), ("m2",)], "model string")
    methods = sweep.method_table(spark, config.expand_methods([*_SWEEP, {"name": "plain", "prompt_style": "yoruba_cot"}]))
    return sweep.plan_units(examples, models, methods).select("key")


_UNITS = """units AS (SELECT concat_ws(chr(9), k, dataset, model, meth, example_id) AS key, CAST(example_id AS BIGINT) AS e FROM (SELECT DISTINCT concat('d', user_id % 2) AS dataset, CAST(user_id AS VARCHAR) AS example_id FROM events),
  (VALUES ('m0'), ('m1'), ('m2')) a(model), (VALUES ('nested', 'ttc'), ('standalone', 'plain')) b(k, meth))"""


@query("plan_units", f"WITH {_UNITS} SELECT key FROM units")
def plan_units(spark, sf_dir):
    return _units(spark, sf_dir)


@query("pending_units", f"WITH {_UNITS} SELECT key FROM units WHERE e % 3 <> 0")
def pending_units(spark, sf_dir):
    units = _units(spark, sf_dir)
    done = units.where(F.element_at(F.split("key", "\t"), -1).cast("long") % 3 == 0)
    return sweep.pending(units, done)


_SLICED = f"""{_VOTES}, rows_ AS (SELECT *, concat_ws(chr(9), 'nested', dataset, model, 'ttc', CAST(example_id AS VARCHAR)) AS key FROM cand),
sels AS (SELECT *, concat_ws(chr(9), 'nested', dataset, model, 'ttc', CAST(example_id AS VARCHAR)) AS key FROM chosen WHERE NOT (example_id % 4 = 0 AND n = 16)),
whole AS (SELECT key FROM sels GROUP BY key HAVING count(DISTINCT method) = 4)"""


def _recovered(spark, sf_dir, checkpoint=None):
    tags = {"nested": F.lit(True), "nested_group_id": F.lit("ttc")}
    c = V.candidates(spark, sf_dir).withColumns(tags)
    s = chosen(spark, sf_dir).withColumns(tags).where("not (example_id % 4 = 0 and n = 16)")
    return resume.recover(c, s, {"ttc": [f"ttc_n{n}" for n in V.SIZES]}, checkpoint)


@query("recovered_units", f"WITH {_SLICED} SELECT key FROM whole")
def recovered_units(spark, sf_dir):
    return _recovered(spark, sf_dir).completed


@query(
    "checkpointed_units",
    f"""WITH {_SLICED}, logged AS (SELECT DISTINCT concat_ws(chr(9), 'nested', dataset, model, 'ttc', CAST(example_id AS VARCHAR)) AS key FROM pool WHERE example_id % 4 < 2 UNION SELECT DISTINCT concat_ws(chr(9), 'standalone', dataset, 'm9', 'x', CAST(example_id AS VARCHAR)) FROM pool)
SELECT key FROM (SELECT key FROM whole UNION SELECT key FROM logged) WHERE key NOT IN (SELECT key FROM sels WHERE key NOT IN (SELECT key FROM whole))""",
)
def checkpointed_units(spark, sf_dir):
    """U4: what the checkpoint or the outputs show as done, less what the outputs show as broken."""
    pool = V.pool(spark, sf_dir).select("dataset", "model", F.col("example_id").cast("string").alias("example_id"), F.lit(None).cast("string").alias("key"))
    nested = pool.where(F.col("example_id").cast("long") % 4 < 2).withColumns({"unit_type": F.lit("nested"), "group_id": F.lit("ttc"), "method": F.lit(None).cast("string")})
    alone = pool.withColumns({"model": F.lit("m9"), "unit_type": F.lit("standalone"), "group_id": F.lit(None).cast("string"), "method": F.lit("x")})
    return _recovered(spark, sf_dir, nested.unionByName(alone)).completed


@query("incomplete_units", f"WITH {_SLICED} SELECT DISTINCT key FROM sels WHERE key NOT IN (SELECT key FROM whole)")
def incomplete_units(spark, sf_dir):
    return _recovered(spark, sf_dir).incomplete


@query("recovered_rows", f"WITH {_SLICED} SELECT dataset, model, method, n, example_id, sample_index FROM rows_ WHERE key NOT IN (SELECT key FROM sels WHERE key NOT IN (SELECT key FROM whole))")
def recovered_rows(spark, sf_dir):
    return _recovered(spark, sf_dir).candidates.select(*EXAMPLE, "sample_index")


@query("orphan_units", f"WITH {_CAND} SELECT DISTINCT concat_ws(chr(9), 'standalone', dataset, model, method, CAST(example_id AS VARCHAR)) AS key FROM cand WHERE example_id % 3 = 0")
def orphan_units(spark, sf_dir):
    """Candidates of units of their own that have no selection."""
    tags = {"nested": F.lit(False), "nested_group_id": F.lit(None).cast("string")}
    s = chosen(spark, sf_dir).withColumns(tags).where("example_id % 3 <> 0")
    return resume.recover(V.candidates(spark, sf_dir).withColumns(tags), s, {}).incomplete


# ---- ingestion and prompts ------------------------------------------------------------------------------------------


@query(
    "ingest_choices",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE CAST(l_linenumber % 3 AS INTEGER) WHEN 0 THEN l_returnflag || '#' || l_linestatus || '#x' WHEN 1 THEN l_returnflag || '#' || l_linestatus ELSE NULL END AS choices FROM lineitem""",
)
def ingest_choices(spark, sf_dir):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    text = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("['"), flag, F.lit("', \""), status, F.lit("\", 'x']"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit(" "), flag, F.lit(" || || "), status))
    rows = N.with_list(V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text")), "listed", F.col("text"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(N.coerce_choices(F.col("text"), F.col("listed")), "#").alias("choices"))


@query(
    "choices_of_columns",
    "SELECT p_partkey, concat_ws('#', 'A. ' || p_brand, CASE WHEN p_size % 2 = 0 THEN 'B. ' || p_type END, 'D. ' || CAST(p_size AS VARCHAR)) AS choices FROM part",
)
def choices_of_columns(spark, sf_dir):
    columns = {"options_A": F.col("p_brand"), "B": F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(""), "d": F.col("p_size").cast("string")}
    return V.table(spark, sf_dir, "part").select("p_partkey", F.array_join(N.choices_of_columns(columns), "#").alias("choices"))


@query(
    "answer_label",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <= 3 THEN chr(CAST(65 + o_orderkey % 7 AS INTEGER)) ELSE CAST(o_orderkey % 7 AS VARCHAR) END AS digit, upper(o_orderstatus) AS letter,
  CASE WHEN o_orderkey % 30 <= 25 THEN chr(CAST(65 + o_orderkey % 30 AS INTEGER)) ELSE CAST(o_orderkey % 30 AS VARCHAR) END AS number FROM orders""",
)
def answer_label(spark, sf_dir):
    digit, number = (F.col("o_orderkey") % 7).cast("string"), F.col("o_orderkey") % 30
    return V.table(spark, sf_dir, "orders").select(
        "o_orderkey", N.answer_label(digit).alias("digit"), N.answer_label(F.lower("o_orderstatus")).alias("letter"), N.answer_label(number, numeric=True).alias("number")
    )


@query("language_filter", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de')")
def language_filter(spark, sf_dir):
    own = F.when(F.col("lang") == "en", " yor ").when(F.col("lang") == "de", "")
    other = F.when(F.col("lang").isin("fr", "es"), "french")
    return V.table(spark, sf_dir, "documents").where(N.is_language([own, other], "yor")).select("doc_id")


@query("answer_list", "SELECT o_orderkey, o_orderstatus AS first, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM orders")
def answer_list(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("['"), F.col("o_orderstatus"), F.lit("', 'b']"))).otherwise(F.col("o_orderstatus"))
    rows = N.with_list(V.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "listed", F.col("text"))
    answers = N.answer_list(F.col("text"), F.col("listed"))
    return rows.select("o_orderkey", N.first_answer(answers).alias("first"), F.size(answers).alias("n"))


@query("infer_task", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'math' WHEN lang = 'fr' THEN 'reading_comprehension' ELSE 'qa' END AS task FROM documents")
def infer_task(spark, sf_dir):
    kind, own = F.lit("text"), F.when(F.col("source") == "src1", "x_GSM").otherwise("other")
    path = F.when(F.col("lang") == "fr", "data/Reading/x").otherwise("data/x")
    return V.table(spark, sf_dir, "documents").select("doc_id", N.infer_task(kind, own, path).alias("task"))


@query("example_ids", "SELECT doc_id, concat(source, '_file_', lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR), 6, '0')) AS id FROM documents")
def example_ids(spark, sf_dir):
    rows = numbering.running(V.table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", {"row": F.lit(1)})
    return rows.select("doc_id", N.synthetic_id(F.col("source"), F.lit("file"), F.col("row")).alias("id"))


def _math_items(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").join(V.table(spark, sf_dir, "labels"), "doc_id")
    rows = d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question"), F.when(F.col("quality") == 1, F.col("n_chars").cast("string")).otherwise("0").alias("answer_number"), F.when(F.col("toxic") == 1, "").otherwise("12 ").alias("answer"), F.when(F.col("lang") == "es", "es").alias("lang"))
    return raw.normalize(rows, raw.SOURCES["afrimgsm"], "test")


_MATH = "m AS (SELECT doc_id, lang, text, CASE WHEN quality = 1 THEN CAST(n_chars AS VARCHAR) WHEN toxic = 1 THEN '' ELSE '12' END AS gold FROM documents JOIN labels USING (doc_id))"


@query("normalize_record", f"WITH {_MATH} SELECT concat('afrimgsm_test_', doc_id) AS id, gold AS gold_answer, 'number' AS answer_type, 'math' AS task FROM m WHERE lang <> 'es' AND gold <> ''")
def normalize_record(spark, sf_dir):
    return raw.retained(_math_items(spark, sf_dir), strict=False).select("id", "gold_answer", "answer_type", "task")


@query("split_counts", f"WITH {_MATH} SELECT 'test' AS split, count(*) AS raw, count(*) FILTER (lang <> 'es' AND gold <> '') AS retained, count(*) FILTER (lang <> 'es' AND gold = '') AS skipped FROM m")
def split_counts(spark, sf_dir):
    return raw.split_counts(_math_items(spark, sf_dir))


_EXEMPLARS = {"math": [P.Exemplar("Mo ní ìwé 2. Mo ra 3 sí i. Mélòó ni?", "2 + 3 = 5.", "2 + 3 = 5 ni.", "5", "I have 2 books. I buy 3 more. How many?")]}


_SAMPLE = {"en": "2 + 3 = 5.", "yo": "2 + 3 = 5 ni.", "translate": "2 + 3 = 5."}


def _written_block(mode: str) -> str:
    """The worked example as it should read, for the oracles."""
    english = "English translation:\nI have 2 books. I buy 3 more. How many?\n\n" if mode == "translate" else ""
    return f"""Examples:

---

Question:
Mo ní ìwé 2. Mo ra 3 sí i. Mélòó ni?

{english}Reasoning:
{_SAMPLE[mode]}

Final answer: 5

---

Now answer the following question using the same format.

"""


_YORUBA_SYSTEM = """You are a careful reasoning assistant.

Read the Yoruba problem carefully, preserve the quantities and relationships, and solve only from the information given."""
_RULES = """Instructions:
- Use the examples only as formatting guides, not as source facts.
"""
_QUANTITY = "- First identify the {0}quantities and whether they mean add, subtract, multiply, or divide.\n"
_END = "- Finish with exactly one line:\nFinal answer: <answer>"
_PIVOT_RULES = f"{_RULES}- Translate the Yoruba question into English.\n- Solve the translated question by reasoning step by step in English.\n{_END}"
_PIVOT_USER = f"concat('{_written_block('translate')}Question (Yoruba):\n', text, '\n\nAnswer format:\nFinal answer: <number>\n\n{_PIVOT_RULES}')"


@query(
    "prompt_render",
    f"""SELECT item_id, concat('System:', chr(10), '{_YORUBA_SYSTEM}', chr(10), chr(10), 'User:', chr(10), CASE WHEN item_id % 2 = 0 THEN '{_written_block("en")}' ELSE '' END, 'Question (Yoruba):', chr(10), text,
  CASE WHEN item_id % 3 = 0 THEN concat(chr(10), chr(10), 'Choices:', chr(10), 'A. yes', chr(10), 'B) no', chr(10), 'C. B. odd') ELSE '' END,
  chr(10), chr(10), 'Answer format:', chr(10), 'Final answer: ', CASE WHEN item_id % 3 = 0 THEN '<option letter>' WHEN item_id % 2 = 0 THEN '<number>' ELSE '<concise Yoruba answer>' END, chr(10), chr(10), '{_RULES}{_QUANTITY.format("Yoruba ")}- Reason step by step in English.\n{_END}') AS prompt
FROM benchmark""",
)
def prompt_render(spark, sf_dir):
    even, third = F.col("item_id") % 2 == 0, F.col("item_id") % 3 == 0
    choices = F.when(third, F.array(F.lit("yes "), F.lit("B) no"), F.lit("B. odd")))
    kind = F.when(third, "choice").when(even, "number").otherwise("text")
    prompt = P.render("english_cot", _EXEMPLARS, F.when(even, "math").otherwise("qa"), F.lit("own"), F.col("text"), choices, kind)
    return V.table(spark, sf_dir, "benchmark").select("item_id", P.as_text(prompt).alias("prompt"))


def _seed_values(base: int, items: int = 200, samples: int = 4) -> str:
    """Expected seeds, straight from the standard library's BLAKE2b: eight bytes, big end first, modulo 2**31."""
    made = ((i, k, hashlib.blake2b(f"{base}\0{i}\0{k}".encode(), digest_size=8).hexdigest()) for i in range(items) for k in range(samples))
    return ", ".join(f"({i}, {k}, {int(h, 16) % 2**31})" for i, k, h in made)


@query("sample_seed", f"SELECT item_id, sample_index, CAST(seed AS BIGINT) AS seed FROM benchmark JOIN (VALUES {_seed_values(20260708)}) t(item_id, sample_index, seed) USING (item_id)")
def sample_seed(spark, sf_dir):
    rows = V.table(spark, sf_dir, "benchmark").withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.select("item_id", "sample_index", sweep.seeds(20260708, F.col("item_id").cast("string"), F.col("sample_index")).alias("seed"))


@query(
    "generate_mock",
    f"""WITH seeds AS (SELECT * FROM (VALUES {_seed_values(7)}) t(item_id, sample_index, seed)),
made AS (SELECT item_id, sample_index, seed, CAST(concat('0x', substr(sha1(concat('{_YORUBA_SYSTEM}', chr(0), {_PIVOT_USER}, chr(0), seed)), 1, 4)) AS INTEGER) % 20 AS v FROM benchmark JOIN seeds USING (item_id))
SELECT CAST(item_id AS VARCHAR) AS example_id, sample_index, CAST(seed AS BIGINT) AS sample_seed, CAST(3 + v AS BIGINT) AS token_count, (3 + v) / 1000.0 * 0.5 AS estimated_cost, CAST(v AS VARCHAR) AS extracted_answer FROM made""",
)
def generate_mock(spark, sf_dir):
    return generated(spark, sf_dir, sweep.EchoBackend)


MOCK = config.method({"name": "bon", "prompt_style": "translate_pivot", "selection": "majority_vote", "n": 4, "temperature": 0.7})


def mock_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = P.render("translate_pivot", _EXEMPLARS, F.lit("math"), F.lit("own"), F.col("text"), F.lit(None).cast("array<string>"), F.lit("number"))
    return V.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("example_id"), prompt.alias("prompt"))


def generated(spark: SparkSession, sf_dir: str, backend, **options) -> DataFrame:
    """Prompts, four seeded samples each from a backend, and their extracted answers."""
    rows = sweep.generate(mock_prompts(spark, sf_dir), backend, 4, MOCK, 7, 0.5, **options)
    return rows.select("example_id", "sample_index", "sample_seed", "token_count", "estimated_cost", X.extract_answer(F.col("response"), F.lit("number")).alias("extracted_answer"))


@query(
    "prompt_styles",
    f"""WITH i AS (SELECT item_id, text, item_id % 2 = 1 AS en FROM benchmark),
own AS (SELECT item_id, CASE WHEN en THEN '{_YORUBA_SYSTEM.replace('the Yoruba problem', 'the problem')}' ELSE '{_YORUBA_SYSTEM}' END AS own_system,
  CASE WHEN en THEN 'Question' ELSE 'Question (Yoruba)' END AS label, CASE WHEN en THEN '{_QUANTITY.format('')}' ELSE '{_QUANTITY.format('Yoruba ')}' END AS quantity, text, en FROM i),
parts AS (
  SELECT item_id, 'yoruba_cot' AS style, '{_YORUBA_SYSTEM}' AS system, concat('{_written_block('yo')}', label, ':\n', text) AS problem, concat('{_RULES}', quantity, '- Reason step by step in Yoruba.\n{_END}') AS rules FROM own
  UNION ALL SELECT item_id, 'translate_pivot', '{_YORUBA_SYSTEM}', concat('{_written_block('translate')}Question (Yoruba):\n', text), '{_PIVOT_RULES}' FROM own
  UNION ALL SELECT item_id, 'best_of_n_cot', own_system, concat(CASE WHEN en THEN replace('{_written_block('en')}', 'Mo ní ìwé 2. Mo ra 3 sí i. Mélòó ni?', 'I have 2 books.') ELSE '{_written_block('en')}' END, label, ':\n', text),
    concat('{_RULES}', quantity, '- Reason step by step in English.\n{_END}') FROM own)
SELECT item_id, style, concat('System:\n', system, '\n\nUser:\n', problem, '\n\nAnswer format:\nFinal answer: <number>\n\n', rules) AS prompt FROM parts""",
)
def prompt_styles(spark, sf_dir):
    """The other styles, for texts in either language; one style is an alias with examples of its own for English sources."""
    english = P.Exemplar("I have 2 books.", "2 + 3 = 5.", "", "5", "")
    source = F.when(F.col("item_id") % 2 == 1, "afrimgsm_translate").otherwise("own")
    rows, none = V.table(spark, sf_dir, "benchmark"), F.lit(None).cast("array<string>")
    texts = [F.struct(F.lit(s).alias("style"), P.as_text(P.render(s, _EXEMPLARS | {"math_en": [english]}, F.lit("math"), source, F.col("text"), none, F.lit("number"))).alias("prompt")) for s in P.STYLES[1:]]
    return rows.select("item_id", F.explode(F.array(*texts)).alias("p")).select("item_id", "p.style", "p.prompt")


def _items_of(rows: DataFrame, key: str, split: str) -> DataFrame:
    return raw.normalize(rows, raw.SOURCES[key], split).select("id", "question", "gold_answer", "answer_type", "task", F.array_join("choices", "#").alias("choices"), "error")


@query(
    "normalize_choice",
    f"""WITH r AS (SELECT concat('afrimmlu_test_', p_partkey) AS id, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS question, CASE WHEN p_size % 6 <= 3 THEN chr(65 + p_size % 6) ELSE CAST(p_size % 6 AS VARCHAR) END AS gold_answer,
  CASE WHEN p_partkey % 3 = 0 THEN p_brand || '#x#None' WHEN p_partkey % 3 = 1 THEN p_brand || '#' || p_type END AS choices FROM part)
SELECT id, question, gold_answer, 'choice' AS answer_type, 'qa' AS task, choices, CASE WHEN question = '' THEN 'question' END AS error FROM r""",
)
def normalize_choice(spark, sf_dir):
    """F21, choices: written as a list, between bars, or missing; answers as numbers."""
    k = F.col("p_partkey")
    choices = F.when(k % 3 == 0, F.concat(F.lit("['"), "p_brand", F.lit("', \"x\", None]"))).when(k % 3 == 1, F.concat("p_brand", F.lit(" || "), "p_type")).otherwise("")
    question = F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit("\n")))
    return _items_of(V.table(spark, sf_dir, "part").select(k.alias("id"), question.alias("question"), (F.col("p_size") % 6).cast("string").alias("answer"), choices.alias("choices")), "afrimmlu", "test")


@query(
    "normalize_answers",
    """SELECT concat('afriqa_train_', o_orderkey) AS id, o_orderpriority AS question, CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 0 THEN o_orderstatus WHEN 1 THEN 'it''s' WHEN 2 THEN o_orderstatus ELSE '' END AS gold_answer,
  'text' AS answer_type, 'qa' AS task, CAST(NULL AS VARCHAR) AS choices, CAST(NULL AS VARCHAR) AS error FROM orders""",
)
def normalize_answers(spark, sf_dir):
    """F21, answers: a plain list, one with escapes, a bare text, or none."""
    form = F.col("o_orderkey") % 4
    answers = F.when(form == 0, F.concat(F.lit("['"), "o_orderstatus", F.lit("', 'b']"))).when(form == 1, r"['it\'s', 2.50]").when(form == 2, F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")))
    return _items_of(V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("question"), answers.alias("answers")), "afriqa", "train")


@query(
    "normalize_reading",
    """SELECT concat('naijarc_validation_', c_custkey) AS id, concat('Àyọkà:', chr(10), c_mktsegment, chr(10), chr(10), 'Ìbéèrè:', chr(10), c_name) AS question, CASE WHEN c_custkey % 2 = 0 THEN 'B' ELSE upper(substr(c_mktsegment, 1, 1)) END AS gold_answer,
  'choice' AS answer_type, 'reading_comprehension' AS task, concat_ws('#', 'A. ' || c_name, CASE WHEN c_custkey % 2 = 0 THEN 'C. ' || c_mktsegment END) AS choices, CAST(NULL AS VARCHAR) AS error FROM customer""",
)
def normalize_reading(spark, sf_dir):
    """F21, reading: story and question in one text, choices from columns, the answer under either spelling."""
    even = F.col("c_custkey") % 2 == 0
    rows = V.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("story"), F.concat("c_name", F.lit(" ")).alias("question"), F.col("c_name").alias("options_A"), F.when(even, F.col("c_mktsegment")).alias("c"),
        F.when(even, "1").alias("Answer"), F.lower(F.substring("c_mktsegment", 1, 1)).alias("answer_text"),
    )
    rows = rows.withColumn("Answer", F.coalesce("Answer", "answer_text")).drop("answer_text")
    return _items_of(rows, "naijarc", "validation")


@query(
    "metrics_csv",
    f"""WITH {_CAND}, {_ITEMS} SELECT dataset, model, method, CAST(n AS VARCHAR) AS n, CAST(sum(total_examples) AS VARCHAR) AS total_examples, string_agg(DISTINCT run_id, ';' ORDER BY run_id) AS run_ids FROM items GROUP BY dataset, model, method, items.n""",
)
def metrics_csv(spark, sf_dir):
    """K3: the text form of the CSV sink."""
    rows = _items(spark, sf_dir).groupBy(*CONDITION).agg(F.sum("total_examples").alias("total_examples"), F.array_sort(F.collect_set("run_id")).alias("run_ids"))
    return logs.csv_ready(rows)


# ---- smaller functions and rules ------------------------------------------------------------------------------------


@query(
    "running_accuracy",
    f"{_E1} SELECT method, ord, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS BIGINT) AS correct, count(*) OVER w AS scored FROM sels WINDOW w AS (PARTITION BY method ORDER BY ord)",
)
def running_accuracy(spark, sf_dir):
    """A18 on a stored log: correct and scored so far after each selection."""
    rows = _e1(spark, sf_dir)[0].select("method", "ord", "is_correct")
    return numbering.running(rows, ["method"], "ord", {"correct": F.col("is_correct").cast("long"), "scored": F.lit(1)}).drop("is_correct")


@query(
    "checkpoint_keys",
    f"""WITH {_POOL} SELECT DISTINCT CASE ord % 4 WHEN 0 THEN concat('k', example_id) WHEN 1 THEN concat_ws(chr(9), 'standalone', dataset, model, event_type, CAST(example_id AS VARCHAR))
  ELSE concat_ws(chr(9), 'nested', dataset, model, 'g', CAST(example_id AS VARCHAR)) END AS key FROM pool WHERE ord % 4 <> 3""",
)
def checkpoint_keys(spark, sf_dir):
    """Rows with a key, structured rows of both kinds, and torn ones."""
    form = F.col("ord") % 4
    log = V.pool(spark, sf_dir).select(
        F.when(form == 0, F.concat(F.lit("k"), F.col("example_id"))).when(form == 1, "").alias("key"), F.when(form == 1, "standalone").when(form == 2, "nested").alias("unit_type"), "dataset", "model",
        F.col("event_type").alias("method"), F.lit("g").alias("group_id"), F.col("example_id").cast("string").alias("example_id"),
    )
    return resume.checkpoint_keys(log)


@query(
    "generic_normalize",
    """SELECT concat('own_dev_', o_orderkey) AS id, o_orderpriority AS question, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS gold_answer, CASE WHEN o_orderkey % 2 = 0 THEN 'language' END AS error,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'a#b' END AS choices FROM orders""",
)
def generic_normalize(spark, sf_dir):
    """Any spelling of the fields, with the first fault of each row."""
    k = F.col("o_orderkey")
    rows = V.table(spark, sf_dir, "orders").select(
        k.cast("string").alias("uid"), F.lit("").alias("question"), F.concat(F.lit(" "), "o_orderpriority").alias("prompt"), F.when(k % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("label"),
        F.when(k % 2 == 0, "fr").otherwise("yoruba").alias("locale"), F.when(k % 5 > 0, "a||b").alias("options"),
    )
    items = raw.normalize(rows, raw.Source("own", "generic", "g", ("dev",)), "dev")
    return items.select("id", "question", "gold_answer", "error", F.array_join("choices", "#").alias("choices"))


@query(
    "numeric_equal",
    f"WITH {_POOL} SELECT ord, true AS with_point, (token_count * 1000 = token_count * 1000 + ord % 2) AS with_commas, false AS text_and_number FROM pool",
)
def numeric_equal(spark, sf_dir):
    k = F.col("token_count")
    commas = F.format_string("%,d", k * 1000)
    return V.pool(spark, sf_dir).select(
        "ord", X.numbers_equal(F.concat(k.cast("string"), F.lit(".0")), k.cast("string")).alias("with_point"), X.numbers_equal(commas, (k * 1000 + F.col("ord") % 2).cast("string")).alias("with_commas"),
        X.numbers_equal(F.lit("none"), k.cast("string")).alias("text_and_number"),
    )


@query("strip_label", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment ELSE lower(c_mktsegment) END AS bare, c_name AS clean FROM customer")
def strip_label(spark, sf_dir):
    """F9, F10"""
    label = F.when(F.col("c_custkey") % 3 == 0, " b) ").when(F.col("c_custkey") % 3 == 1, "Ọ.").otherwise("")
    text = F.when(F.col("c_custkey") % 3 == 2, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    return V.table(spark, sf_dir, "customer").select(
        "c_custkey", X.strip_choice_label(F.concat(label, text)).alias("bare"), X.clean_answer(F.concat(F.lit(" **`"), "c_name", F.lit("_`** \n"))).alias("clean")
    )


@query("run_id_sets", f"WITH {_CAND}, {_ITEMS} SELECT dataset, model, method, n, string_agg(DISTINCT run_id, ';' ORDER BY run_id) FILTER (run_id IN ('r1', 'r2')) AS shared, string_agg(DISTINCT run_id, ';' ORDER BY run_id) FILTER (run_id NOT IN ('r1', 'r2')) AS other FROM items GROUP BY ALL")
def run_id_sets(spark, sf_dir):
    """Intersection and difference of run-id sets."""
    rows = _items(spark, sf_dir).groupBy(*CONDITION).agg(F.collect_set("run_id").alias("run_ids"))
    return merging.run_sets(rows, ["r1", "r2"]).select(*CONDITION, F.array_join("shared", ";").alias("shared"), F.array_join("other", ";").alias("other"))
