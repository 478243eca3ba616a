"""Deterministic evaluation logs derived from the star-schema tables, for queries and benchmarks.

`events` gives candidate answers: user u asks, model event_id % 3 answers k % 5, and
u % 5 is right.  A pool is cut into prefixes of 1, 4, 8 and 16 samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIZES = (1, 4, 8, 16)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: every event as a sample of one pool per (dataset, model, example)."""
    e = table(spark, sf_dir, "events")
    model = F.col("event_id") % 3
    order = Window.partitionBy("user_id", model).orderBy("event_id")
    return e.select(
        F.concat(F.lit("d"), F.col("user_id") % 2).alias("dataset"), F.concat(F.lit("m"), model).alias("model"), F.col("user_id").alias("example_id"),
        (F.row_number().over(order) - 1).alias("sample_index"), (F.get_json_object("props", "$.k").cast("int") % 5).cast("string").alias("extracted_answer"),
        (F.col("user_id") % 5).cast("string").alias("gold_answer"), F.lit("number").alias("answer_type"), F.col("event_id").alias("ord"), F.col("value").alias("latency_s"),
        F.get_json_object("props", "$.k").cast("long").alias("token_count"), F.concat(F.lit("r"), F.col("event_id") % 4).alias("run_id"), "event_type", "ts",
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1n: the pool's prefixes, as candidate rows of methods ttc_n1 to ttc_n16."""
    rows = pool(spark, sf_dir)
    sizes = F.filter(F.array(*[F.lit(n) for n in SIZES]), lambda n: n > F.col("sample_index"))
    rows = rows.withColumn("n", F.explode(sizes)).withColumn("pos", F.col("sample_index"))
    return rows.withColumns(
        {
            "method": F.concat(F.lit("ttc_n"), F.col("n").cast("string")), "estimated_cost": F.col("token_count") / 1000.0 * 0.5, "model_size_label": F.col("model"),
            "prompt_style": F.lit("english_cot"), "reasoning_language": F.lit("en"), "selection": F.lit("majority_vote"),
        }
    )


def response_text() -> Column:
    """V2: a response around each sample's answer, in six forms by event_id % 6."""
    k = F.col("extracted_answer")
    form = F.col("ord") % 6
    return (
        F.when(form == 0, F.concat(F.lit("Step one.\nFinal answer: "), k, F.lit("  \nbye")))
        .when(form == 1, F.concat(F.lit("<think>Answer: 99\n</think>so\nAnswer - **"), k, F.lit("**")))
        .when(form == 2, F.concat(F.lit("reasoning here\n\n the value is "), k, F.lit("\n")))
        .when(form == 3, F.concat(F.lit("Idahun ikeyin: "), k, F.lit(".0")))
        .when(form == 4, F.concat(F.lit("ANSWER: first\nfinal answer: "), k, F.lit(",000 items")))
        .otherwise(F.lit(""))
    )


def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: line items as an append log with repeated keys."""
    return table(spark, sf_dir, "lineitem")


def _prefixes(rows: DataFrame) -> DataFrame:
    sizes = F.filter(F.array(*[F.lit(n) for n in SIZES]), lambda n: n > F.col("sample_index"))
    return rows.withColumn("n", F.explode(sizes)).withColumn("method", F.concat(F.lit("ttc_n"), F.col("n").cast("string")))


def mixed_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: the pool with answers written in four ways (one empty) and a type that only some samples name, number or text by user."""
    rows = pool(spark, sf_dir)
    value = (F.col("token_count") % 3).cast("string")
    form, named = F.floor(F.col("ord") / 7) % 4, F.floor(F.col("ord") / 5) % 3
    answer = F.when(form == 0, value).when(form == 1, F.concat(value, F.lit(".0"))).when(form == 2, F.lit("")).otherwise(F.concat(value, F.lit(".")))
    kind = F.when(named == 1, "").when(named == 2, F.when(F.col("example_id") % 2 == 0, "number").otherwise("text"))
    return rows.withColumns({"extracted_answer": answer, "answer_type": kind, "gold_answer": (F.col("example_id") % 3).cast("string")})


def mixed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prefixes(mixed_pool(spark, sf_dir))


def uneven_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: the pool with answers that share a vote key though only one of them is the gold answer."""
    form, gold = F.col("ord") % 5, F.when(F.col("example_id") % 2 == 0, "1000000000").otherwise("none")
    answer = F.when(form == 0, "None").when(form == 1, "none").when(form == 4, "1000000000").otherwise("1000000000.4")
    return pool(spark, sf_dir).withColumns({"extracted_answer": answer, "gold_answer": gold})
