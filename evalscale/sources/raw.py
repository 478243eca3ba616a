"""Raw benchmark sources: registry, scans and normalisation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evalscale.functions import ingest as N
from evalscale.functions.text import strip_space


@dataclass(frozen=True)
class Source:
    """A benchmark: which normaliser its rows take, its splits, and where it comes from."""

    key: str
    shape: str  # choice, answers, reading or math; else generic
    group: str
    splits: tuple[str, ...]
    config: str = "yor"
    origin: str = ""


# Fixed names of the benchmarks and their splits.
SOURCES = {
    s.key: s
    for s in (
        Source("afrimmlu", "choice", "question-answering", ("validation", "dev", "test"), origin="masakhane/afrimmlu"),
        Source("afrimmlu_translate", "choice", "question-answering", ("test",), origin="masakhane/afrimmlu-translate-test"),
        Source("afriqa", "answers", "question-answering", ("train", "validation", "test"), origin="masakhane/afriqa"),
        Source("naijarc", "reading", "question-answering", ("train", "validation", "test"), origin="aremuadeolajr/NaijaRC"),
        Source("afrimgsm", "math", "math-reasoning", ("train", "test"), origin="masakhane/afrimgsm"),
        Source("afrimgsm_translate", "math", "math-reasoning", ("test",), origin="masakhane/afrimgsm-translate-test"),
    )
}
STORY, QUESTION = "Àyọkà", "Ìbéèrè"


def source(key: str, splits: Iterable[str] | None = None) -> tuple[Source, list[str]]:
    """The source and the splits asked for; unknown names are errors."""
    if key not in SOURCES:
        raise ValueError(f"unknown dataset {key!r}; known: {', '.join(sorted(SOURCES))}")
    found = SOURCES[key]
    wanted = list(found.splits if splits is None else splits)
    unknown = set(wanted) - set(found.splits)
    if unknown:
        raise ValueError(f"{key} has no split {', '.join(sorted(unknown))}")
    return found, wanted


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All values as text; a byte order mark before the first column name is dropped."""
    low = path.lower()
    if low.endswith((".json", ".jsonl")):
        rows = spark.read.option("primitivesAsString", True).json(path)
    elif low.endswith((".tsv", ".csv")):
        rows = spark.read.csv(path, sep="\t" if low.endswith(".tsv") else ",", header=True, multiLine=True, escape='"')
    elif low.endswith(".parquet"):
        rows = spark.read.parquet(path)  # S8: an export of a hosted dataset
    else:
        raise ValueError(f"unsupported file format: {path}")
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def records(spark: SparkSession, rows: Sequence[Mapping[str, object]]) -> DataFrame:
    """Records in memory, all values as text."""
    names = sorted({k for r in rows for k in r})
    data = [tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names))


def _columns(raw: DataFrame) -> dict[str, Column]:
    return {c: F.col(f"`{c}`") for c in raw.columns}


def normalize(raw: DataFrame, s: Source, split: str) -> DataFrame:
    """benchmark items of raw rows, with an `error` column for rows that are not valid and kept metadata."""
    c = _columns(raw)
    text = lambda name: c[name].cast("string") if name in c else F.lit(None).cast("string")
    none = F.lit(None).cast("array<string>")
    own = {"choice": "choices", "answers": "answers"}.get(s.shape)
    if own in c and dict(raw.dtypes)[own].startswith("array"):
        raw = raw.withColumn("__list", c[own].cast("array<string>"))
    else:
        written = text(own) if own else N.first_present([text(k) for k in N.CHOICE_KEYS]) if s.shape not in ("reading", "math") else F.lit(None).cast("string")
        raw = N.with_list(raw, "__list", written) if s.shape not in ("reading", "math") else raw.withColumn("__list", none)
    listed = F.col("__list")
    language = F.lit("yo")
    if s.shape == "choice":
        question, kind, task = text("question"), "choice", F.lit("qa")
        choices = N.coerce_choices(text("choices"), listed)
        gold = N.answer_label(text("answer"))
    elif s.shape == "answers":
        question, kind, task, choices = text("question"), "text", F.lit("qa"), none
        gold = N.first_answer(N.answer_list(text("answers"), listed))
    elif s.shape == "reading":
        whole = F.concat(F.lit(f"{STORY}:\n"), F.coalesce(text("story"), F.lit("")), F.lit(f"\n\n{QUESTION}:\n"), F.coalesce(text("question"), F.lit("")))
        question, kind, task = strip_space(whole), "choice", F.lit("reading_comprehension")
        choices, gold = N.choices_of_columns(c), N.answer_label(N.first_present([text("Answer"), text("answer")]))
    elif s.shape == "math":
        question, kind, task, choices = text("question"), "number", F.lit("math"), none
        number = text("answer_number")
        falsy = number.isNull() | (number == "") | (number.try_cast("double") == 0)
        gold = strip_space(F.coalesce(F.when(~falsy, number), text("answer"), F.lit("")))
    else:  # F22
        question, kind = N.first_present([text(k) for k in N.QUESTION_KEYS]), "text"
        task, gold = F.coalesce(N.present(text("task")), F.lit("qa")), F.coalesce(N.first_present([text(k) for k in N.GOLD_KEYS]), F.lit(""))
        choices = N.coerce_choices(N.first_present([text(k) for k in N.CHOICE_KEYS]), listed)
        own = strip_space(F.coalesce(N.first_present([text(k) for k in N.LANGUAGE_KEYS]), F.lit("yo")))
        language = F.when(own.isin("yo", "yor", "yoruba"), "yo").otherwise(own)
    record = F.map_filter(F.create_map(*[x for n in sorted(c) for x in (F.lit(n), text(n))]), lambda k, v: v.isNotNull()) if c else F.create_map().cast("map<string,string>")
    used = {*N.QUESTION_KEYS, *N.GOLD_KEYS, *N.CHOICE_KEYS}
    kept = F.map_filter(record, lambda k, v: ~k.isin(*used))  # P14
    item = raw.select(
        N.stable_id(F.lit(s.key), F.lit(split), [text(k) for k in ("id", "uid", "example_id")], record).alias("id"), task.alias("task"), language.alias("language"),
        strip_space(F.coalesce(question, F.lit(""))).alias("question"), choices.alias("choices"), strip_space(gold).alias("gold_answer"), F.lit(kind).alias("answer_type"),
        F.lit(s.key).alias("source_dataset"), N.is_language([text(k) for k in N.LANGUAGE_KEYS], s.config).alias("in_language"),
        F.struct(F.lit(split).alias("split"), F.lit(s.origin).alias("hf_id"), F.lit(s.config).alias("hf_config"), F.lit(s.group).alias("hf_group"),
                 F.array(*[F.lit(n) for n in sorted(c)]).cast("array<string>").alias("raw_keys"), kept.alias("rest")).alias("metadata"),
    )
    return item.withColumn("error", N.row_error(F.col("language"), F.col("answer_type"), F.col("question"), F.lit("any")))


def retained(items: DataFrame, strict: bool = True) -> DataFrame:
    """Rows in the language with a gold answer; other faults are errors if `strict`."""
    own = items.where("in_language and gold_answer <> ''")
    if not strict:
        return own.where("error is null").drop("error", "in_language")
    return own.where(F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid "), F.col("error"), F.lit(" in "), F.col("id"))).cast("boolean"))).drop("error", "in_language")


def split_counts(items: DataFrame) -> DataFrame:
    """Raw, retained and skipped rows per split, in the pass that reads them."""
    keep = F.col("in_language") & (F.col("gold_answer") != "")
    return items.groupBy(F.col("metadata.split").alias("split")).agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(keep).alias("retained"), F.count_if(F.col("in_language") & (F.col("gold_answer") == "")).alias("skipped")
    )


def watched(items: DataFrame, splits: Sequence[str]) -> tuple[DataFrame, Observation]:
    """The items, and an observation of what `split_counts` counts, filled by the pass that writes them."""
    seen, split = Observation(), F.col("metadata.split")
    blank = F.col("gold_answer") == ""
    kinds = {"raw": F.lit(True), "retained": F.col("in_language") & ~blank, "skipped": F.col("in_language") & blank}
    return items.observe(seen, *[F.count_if((split == s) & c).alias(f"{k} {s}") for s in splits for k, c in kinds.items()]), seen


def watched_counts(seen: Observation, splits: Sequence[str]) -> list[dict]:
    return [{"split": s, **{k: seen.get[f"{k} {s}"] for k in ("raw", "retained", "skipped")}} for s in sorted(splits)]


def compact(items: DataFrame) -> DataFrame:
    """The four fields that are written."""
    return items.select("answer_type", "choices", "gold_answer", "question")
