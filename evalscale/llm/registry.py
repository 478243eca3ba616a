"""Queries and oracle SQL of the corpus operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalscale.llm import sql
from evalscale.llm.common import crc_fold, cut, table


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalscale.llm.op4_decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from evalscale.llm.op1_pack import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalscale.llm.op3_warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalscale.llm.op9_chat import extra, format_conversations, read_back

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.unionByName(extra(spark))))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalscale.llm.op5_jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalscale.llm.op6_media import read_store, write_store

    columns = "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    return read_store(write_store(table(spark, sf_dir, "documents"))).select(*columns)


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalscale.llm.op7_license import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalscale.llm.op10_lines import report

    return report(table(spark, sf_dir, "documents"))


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalscale.llm.op11_filters import audit_documents

    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalscale.llm.op12_secrets import digest, find_secrets, train_on

    documents = table(spark, sf_dir, "documents")
    return digest(find_secrets(documents, train_on(documents)))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalscale.llm.op13_phrases import mine_phrases

    return mine_phrases(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalscale.llm.op2_toxicity import score_documents, train

    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(documents, labels, "toxic", crc_fold(F.col("doc_id"), 3) != 1)
    return decided(score_documents(documents, model), crc_fold(F.col("doc_id"), 3) == 1, 0.7)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalscale.llm.op8_quality import score_documents, train

    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = train(documents, labels, "quality", crc_fold(F.col("doc_id"), 5) != 0)
    return decided(score_documents(documents, field), crc_fold(F.col("doc_id"), 5) == 0, 0.3)


def decided(scored: DataFrame, held_out: Column, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing: all documents are in it, pieces follow gaplessly in documents and in sequences, and only long ones are cut."""
    packed = cut(op1_pack(spark, sf_dir), "packed")
    start = F.coalesce(F.sum("length").over(Window.partitionBy("sequence_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sequences = packed.withColumn("gap", F.col("offset") != start).groupBy("sequence_id").agg(F.max("gap").alias("gap"), F.sum("length").alias("size"))
    bad = sequences.agg(F.count_if(F.col("gap") | (F.col("size") > 2048)).alias("bad_sequences"))
    cuts = (F.col("piece") > 0) & (F.col("start") != F.col("piece") * 2048) | (F.col("piece") == 0) & (F.col("start") != 0)
    pieces = packed.agg(F.count_if(F.col("piece") == 0).alias("documents"), F.countDistinct("doc_id").alias("ids"), F.count_if(cuts | (F.col("length") < 1)).alias("bad_pieces"))
    return pieces.crossJoin(bad)  # one row each


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the media read back, what SQL can compute as well."""
    return op6_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the secret scan, what is exact by contract."""
    return op12_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the license scan, the columns that are exact by contract."""
    return op7_license(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_decontaminate": op4_decontaminate,
    "op5_jaccard": op5_jaccard,
    "op6_media": op6_media,
    "op7_license": op7_license,
    "op8_quality": op8_quality,
    "op9_chat": op9_chat,
    "op10_lines": op10_lines,
    "op11_filters": op11_filters,
    "op12_secrets": op12_secrets,
    "op13_phrases": op13_phrases,
    "pack_sequences": pack_sequences,
    "media_payloads": media_payloads,
    "license_base": license_base,
    "secrets_base": secrets_base,
}
ORACLES: dict[str, str] = {
    "op3_warc": sql.OP3,
    "op4_decontaminate": sql.OP4,
    "op5_jaccard": sql.OP5,
    "op9_chat": sql.OP9,
    "op11_filters": sql.OP11,
    "op13_phrases": sql.OP13,
    "pack_sequences": sql.PACK,
    "media_payloads": sql.MEDIA,
    "license_base": sql.LICENSE,
    "secrets_base": sql.SECRETS,
}
