"""A training corpus from raw documents: toxic ones go, repeated lines go, near copies go, benchmark leaks go, the rest is packed.

Every stage takes the documents that the one before kept, as a written table, and
all but the last return the columns of `documents`.

    toxicity       documents that score 0.7 or more go
    line_dedup     lines of repeated multi-line chunks go; documents that lose all their text go
    near_dup       of each component of near copies the smallest doc_id stays
    decontaminate  documents that hold a benchmark window go
    pack           the rest as sequences of at most 2048 tokens

Cases: a null or empty text has no lines, no shingles and no benchmark window, so it
stays, and is packed as its closing id alone; a text whose lines all go, goes; of
rows equal in id and text the near-copy stage leaves one; of copies that tie the
smallest doc_id stays, of one doc_id's rows with texts near each other the one with the smallest row
key; a null doc_id comes last and is kept like any other, unless it copies another
row; columns beyond those of `documents`, whatever their names, pass through to the
last stage; empty tables give empty results, and without labels no text is toxic.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalscale.llm.common import ROW_KEY, crc_fold, cut, join_small, made, remove_since, row_key, table
from evalscale.llm.op1_pack import pack as pack_documents
from evalscale.llm.op2_toxicity import drop_toxic, train
from evalscale.llm.op4_decontaminate import decontaminate as find_leaks
from evalscale.llm.op5_jaccard import one_of_each
from evalscale.llm.op10_lines import dedup_lines

TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, table(spark, sf_dir, "labels"), "toxic", crc_fold(F.col("doc_id"), 3) != 1)
    return drop_toxic(docs, model, TOXIC)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = dedup_lines(docs, "line_dedup")
    kept = done.where((F.length(F.trim("text")) > 0) | F.col("text").isNull() | (F.col("line_dedup.removed_lines") == 0))
    shorter = F.when(F.col("line_dedup.removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", shorter.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = cut(find_leaks(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(*ROW_KEY).distinct(), "leaks")
    return join_small(docs.select(F.struct("*").alias("row"), *row_key()), leaks, ROW_KEY, "left_anti", 32).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the last of five stages in one session: executors hold what the others left, so it remembers fewer words
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=80_000, text_bytes=1 << 20)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dup", near_dup), ("decontaminate", decontaminate), ("pack", pack)]

#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        remove_since(spark, mark)  # what the stage wrote on its way, and its input
    return docs
