"""Registered queries over sources and sinks: given tables written in a format of the logs and read again, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalscale import views as V
from evalscale.operators import metrics
from evalscale.queries import _E4, _metrics, query
from evalscale.schemas import CANDIDATE_JSON, SELECTION_JSON
from evalscale.sources import folders, logs, raw


def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


@query("jsonl_round_trip", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_custkey % 2 = 0 AS even FROM customer")
def jsonl_round_trip(spark, sf_dir):
    """JSON lines with nulls kept, read strictly, scalars as text."""
    path = f"{folders.scratch(spark, 'jsonl')}/rows.jsonl"
    rows = V.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"), (F.col("c_custkey") % 2 == 0).alias("even"))
    logs.write_jsonl(rows, path)
    found = logs.read_jsonl(spark, path, _texts("c_custkey", "c_name", "segment", "even"))
    return found.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "segment", logs.boolean(F.col("even")).alias("even"))


@query("jsonl_lenient", "SELECT p_partkey, p_name FROM part WHERE p_partkey % 5 <> 0")
def jsonl_lenient(spark, sf_dir):
    """Every fifth line is torn; a lenient scan drops it."""
    path = folders.scratch(spark, "jsonl")
    line = F.to_json(F.struct("p_partkey", "p_name"))
    V.table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 5 == 0, F.substring(line, 1, 9)).otherwise(line)).write.text(path)
    found = logs.read_jsonl(spark, path, _texts("p_partkey", "p_name"), strict=False)
    return found.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name")


def _separated(spark, sf_dir, kind: str, sep: str):
    path = f"{folders.scratch(spark, kind)}/rows.{kind}"
    note = F.concat("p_name", F.lit(sep), F.lit(' "'), "p_brand", F.lit('"\nnext'))
    V.table(spark, sf_dir, "part").select("p_partkey", note.alias("note"), "p_type").write.csv(path, sep=sep, header=True, escape='"', quoteAll=True)
    return raw.read_raw(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "note", "p_type")


_NOTE = "SELECT p_partkey, p_name || {0} || ' \"' || p_brand || '\"' || chr(10) || 'next' AS note, p_type FROM part"


@query("csv_scan", _NOTE.format("','"))
def csv_scan(spark, sf_dir):
    """Separators, quotes and line ends inside values."""
    return _separated(spark, sf_dir, "csv", ",")


@query("tsv_scan", _NOTE.format("chr(9)"))
def tsv_scan(spark, sf_dir):
    """S5"""
    return _separated(spark, sf_dir, "tsv", "\t")


@query("json_rows_scan", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, CAST(o_custkey % 3 = 0 AS VARCHAR) AS third FROM orders")
def json_rows_scan(spark, sf_dir):
    """Rows of JSON lines, all values as text."""
    path = f"{folders.scratch(spark, 'json')}/rows.jsonl"
    V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 3 == 0).alias("third")).write.json(path)
    return raw.read_raw(spark, path).select("o_orderkey", "o_orderpriority", "third")


@query("splits_union", "SELECT n_nationkey, n_name, CASE WHEN n_regionkey % 2 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def splits_union(spark, sf_dir):
    """A folder per split in one pass; the folder above reads as their union."""
    path = folders.scratch(spark, "splits")
    nation, customer = V.table(spark, sf_dir, "nation"), V.table(spark, sf_dir, "customer")
    rows = customer.join(nation, customer.c_nationkey == nation.n_nationkey).groupBy("n_nationkey", "n_name", F.when(F.col("n_regionkey") % 2 == 0, "test").otherwise("train").alias("split")).agg(F.count(F.lit(1)).alias("customers"))
    logs.write_splits(rows, path)
    return spark.read.schema("n_nationkey int, n_name string, customers long, split string").json(path)


@query(
    "candidate_log",
    """SELECT CASE WHEN event_id % 3 = 0 THEN concat('top', user_id % 4) WHEN event_id % 3 = 1 THEN concat('meta', user_id % 4) ELSE '' END AS dataset, CAST(user_id AS VARCHAR) AS example_id, 'm' AS model, event_type AS method,
  CASE WHEN event_id % 4 = 0 THEN 1 ELSE CAST(event_id % 4 AS INT) END AS n, CAST(event_id AS INT) AS sample_index, CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(user_id % 5 AS VARCHAR) END AS extracted_answer,
  CASE WHEN event_id % 2 = 0 THEN event_id % 100 ELSE 0 END AS token_count, CASE WHEN event_id % 2 = 0 THEN 'number' ELSE CASE WHEN event_id % 3 = 0 THEN 'text' ELSE '' END END AS answer_type, CASE WHEN event_id % 7 = 0 THEN 'length' END AS finish_reason FROM events""",
)
def candidate_log(spark, sf_dir):
    """A candidate log whose rows lack fields, name them in their metadata or write them as text, with defaults filled in."""
    e, path = V.table(spark, sf_dir, "events"), f"{folders.scratch(spark, 'run')}/candidates.jsonl"
    i, u = F.col("event_id"), F.col("user_id")
    meta = F.struct(F.when(i % 3 != 2, F.concat(F.lit("meta"), u % 4)).alias("dataset"), F.when(i % 2 == 0, "number").alias("answer_type"), F.struct(F.when(i % 7 == 0, "length").alias("finish_reason")).alias("backend_metadata"))
    rows = e.select(
        F.when(i % 3 == 0, F.concat(F.lit("top"), u % 4)).when(i % 3 == 1, "").alias("dataset"), u.alias("example_id"), F.lit("m").alias("model"), F.col("event_type").alias("method"), (i % 4).cast("string").alias("n"),
        i.alias("sample_index"), F.when(i % 5 != 0, (u % 5).cast("string")).alias("extracted_answer"), F.when(i % 2 == 0, i % 100).alias("token_count"), F.when(i % 3 == 0, "text").alias("answer_type"), meta.alias("metadata"),
    )
    rows.write.json(path)
    found = logs.candidates(logs.read_jsonl(spark, path, CANDIDATE_JSON))
    return found.select("dataset", "example_id", "model", "method", "n", "sample_index", "extracted_answer", "token_count", "answer_type", "finish_reason")


@query(
    "selection_log",
    "SELECT CAST(user_id AS VARCHAR) AS example_id, CAST(CASE WHEN event_id % 4 = 0 THEN 1 ELSE event_id % 4 END AS INT) AS n, CAST(event_id AS INT) AS selected_sample_index, coalesce(CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true END, false) AS is_correct FROM events",
)
def selection_log(spark, sf_dir):
    """Selections whose truth is a boolean, written as text, or missing."""
    e, path = V.table(spark, sf_dir, "events"), f"{folders.scratch(spark, 'run')}/selections.jsonl"
    i = F.col("event_id")
    # a text and a boolean cannot be of one column, so lines are made by hand
    truth = F.when(i % 5 == 0, "true").when(i % 5 == 1, "false").when(i % 5 == 2, '"False"').when(i % 5 == 3, '"TRUE"').otherwise("null")
    line = F.concat(F.lit('{"example_id":'), F.col("user_id"), F.lit(',"n":'), i % 4, F.lit(',"selected_sample_index":'), i, F.lit(',"is_correct":'), truth, F.lit("}"))
    e.select(line).write.text(path)
    return logs.selections(logs.read_jsonl(spark, path, SELECTION_JSON)).select("example_id", "n", "selected_sample_index", "is_correct")


@query(
    "record_metadata",
    """SELECT concat('afrimgsm_test_', doc_id) AS id, text AS question, trim(text) = '' AS blank, 'test' AS split, 'masakhane/afrimgsm' AS origin, 'answer_number;id;lang;question;source' AS raw_keys,
  concat('answer_number=', n_chars, ';id=', doc_id, ';lang=', lang, ';source=', source) AS rest FROM (SELECT *, 1 FROM documents) WHERE lang IN ('en', 'fr', 'de', 'es')""",
)
def record_metadata(spark, sf_dir):
    """What a record is enriched with, and what is left of it beyond the fields that are used."""
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question"), F.col("n_chars").cast("string").alias("answer_number"), "lang", "source")
    items = raw.normalize(d, raw.SOURCES["afrimgsm"], "test").where(F.col("metadata.rest.lang").isin("en", "fr", "de", "es"))
    rest = F.array_join(F.transform(F.array_sort(F.map_entries("metadata.rest")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return items.select("id", "question", (F.col("question") == "").alias("blank"), "metadata.split", F.col("metadata.hf_id").alias("origin"), F.array_join("metadata.raw_keys", ";").alias("raw_keys"), rest.alias("rest"))


@query(
    "cost_efficiency",
    f"WITH {_E4} SELECT dataset, model, n, round(accuracy / (total_tokens / 2000.0), 9) AS accuracy_per_cost, round(accuracy / (total_tokens / 1000.0), 9) AS accuracy_per_1k_tokens, round(total_latency_s / nullif(select_correct, 0), 4) AS latency_s_per_correct FROM m",
)
def cost_efficiency(spark, sf_dir):
    """A12, with the ratio to cost."""
    rows = metrics.with_efficiency(_metrics(spark, sf_dir))
    return rows.select("dataset", "model", "n", F.round("accuracy_per_cost", 9).alias("accuracy_per_cost"), F.round("accuracy_per_1k_tokens", 9).alias("accuracy_per_1k_tokens"), F.round("latency_s_per_correct", 4).alias("latency_s_per_correct"))


@query(
    "examples_scan",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS nth FROM part)
SELECT CASE WHEN p_partkey % 4 = 0 THEN concat('own-', p_partkey) ELSE concat('store_rows_', lpad(CAST(nth AS VARCHAR), 6, '0')) END AS id, p_name AS question, CAST(p_size AS VARCHAR) AS gold_answer,
  CASE WHEN p_partkey % 3 = 0 THEN 'number' ELSE 'text' END AS answer_type, CASE WHEN p_partkey % 5 = 0 THEN concat(p_brand, '#', p_type) ELSE '' END AS choices, nth AS row_number FROM r""",
)
def examples_scan(spark, sf_dir):
    """Inference examples of one file, with ids by row number where a row has none, and blanks off."""
    path = f"{folders.scratch(spark, 'examples')}/rows.jsonl"
    k = F.col("p_partkey")
    part = V.table(spark, sf_dir, "part").orderBy("p_partkey").select(
        F.when(k % 4 == 0, F.concat(F.lit("own-"), k)).alias("id"), F.concat(F.lit(" "), "p_name", F.lit("\t")).alias("question"), F.col("p_size").alias("gold_answer"), F.when(k % 3 == 0, "number").alias("answer_type"),
        F.when(k % 5 == 0, F.array("p_brand", "p_type")).alias("choices"),
    )
    part.coalesce(1).write.json(path)
    found = logs.read_examples(spark, path, "shop", source="store")
    return found.select("id", "question", "gold_answer", "answer_type", F.array_join(F.coalesce("choices", F.array().cast("array<string>")), "#").alias("choices"), F.col("row_number").cast("long").alias("row_number"))
