"""Normalisation of raw benchmark records as column expressions.

Fields may be null or empty; both mean absent.  Ids of records without one are
the first 12 hex digits of the SHA-1 of the record as JSON with sorted keys.
"""

from __future__ import annotations

import ast
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalscale.functions.text import strip_space

# Spellings of the language, key synonyms, answer types.
LANGUAGE_CODES = ("yo", "yor", "yoruba", "Yoruba", "YOR", "YO")
LANGUAGE_KEYS = ("language", "lang", "locale")
QUESTION_KEYS = ("question", "query", "prompt", "input", "instruction")
GOLD_KEYS = ("gold_answer", "answer", "target", "label", "output", "correct_answer")
CHOICE_KEYS = ("choices", "options", "multiple_choice_targets")
ANSWER_TYPES = ("choice", "freeform", "instruction", "number", "text")


def present(c: Column) -> Column:
    """The value, or null if it is empty."""
    return F.nullif(c.cast("string"), F.lit(""))


def first_present(columns: Sequence[Column]) -> Column:
    """F16"""
    return F.coalesce(*[present(c) for c in columns]) if columns else F.lit(None).cast("string")


def of_keys(raw: Column, keys: Sequence[str]) -> Column:
    """The first present value of a map's keys."""
    return first_present([F.try_element_at(raw, F.lit(k)) for k in keys])


def literal_list(text: str | None) -> list[str] | None:
    """A Python list literal as strings, or None."""
    stripped = (text or "").strip()
    if stripped[:1] + stripped[-1:] != "[]" or len(stripped) < 2:
        return None
    try:
        value = ast.literal_eval(stripped)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return None
    return [str(x) for x in value] if isinstance(value, list) else None


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_literal_list(texts: pd.Series) -> pd.Series:
    """The only per-row Python of ingestion; `with_list` gives it the rows that nothing else can read."""
    return texts.map(literal_list)


# Items that need no Python: strings without escapes, whole numbers and names; lists of more characters are left to it too.
_ITEM = r"""(?:'[^'\\\n\r\x00]*'|"[^"\\\n\r\x00]*"|-?(?:0|[1-9][0-9]*)|True|False|None)"""
_LIST = rf"^\[[ \t\n]*(?:{_ITEM}[ \t\n]*(?:,[ \t\n]*{_ITEM}[ \t\n]*)*+,?[ \t\n]*)?\]\z"
_LIST_CHARS = 2000


def _plain_list(text: Column) -> Column:
    """A list of plain items as strings; null for other texts."""
    items = F.regexp_extract_all(text, F.lit(_ITEM), F.lit(0))
    return F.when((F.length(text) <= _LIST_CHARS) & text.rlike(_LIST), F.transform(items, lambda x: F.when(x.rlike("^['\"]"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)))


def with_list(rows: DataFrame, name: str, text: Column) -> DataFrame:
    """`text` read as a Python list literal of strings, null if it is none; only rows that need it go through Python."""
    step = rows.withColumn("__text", strip_space(text)).withColumn(name, _plain_list(F.col("__text")))
    odd = F.coalesce(F.startswith("__text", F.lit("[")) & F.endswith("__text", F.lit("]")) & F.col(name).isNull(), F.lit(False))
    return step.where(~odd).unionByName(step.where(odd).withColumn(name, parse_literal_list("__text"))).drop("__text")


def coerce_choices(text: Column, listed: Column) -> Column:
    """the list that the text is (see `with_list`), or its parts between double bars; null if there is nothing."""
    parts = F.filter(F.transform(F.split(strip_space(text), r"\|\|"), strip_space), lambda p: p != "")
    return F.when(present(text).isNotNull(), F.coalesce(listed, parts))


def choices_of_columns(columns: dict[str, Column]) -> Column:
    """lettered choices from the first present of four column spellings for each of A to D."""
    found = []
    for label in "ABCD":
        names = [n for n in (f"options_{label}", f"option_{label}", label, label.lower()) if n in columns]
        value = first_present([columns[n] for n in names])
        found.append(F.concat(F.lit(f"{label}. "), value))
    kept = F.filter(F.array(*found), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def answer_label(c: Column, numeric: bool = False) -> Column:
    """0-25 as a letter for integers, 0-3 for digit texts; single characters in upper case."""
    if numeric:
        return F.when(c.isNull(), "").when((c >= 0) & (c <= 25), F.char(65 + c.cast("long"))).otherwise(c.cast("string"))
    text = strip_space(F.coalesce(c.cast("string"), F.lit("")))
    number = F.when(text.rlike(r"^[0-9]+\z"), text).try_cast("decimal(38,0)")
    return F.when((number >= 0) & (number <= 3), F.char(65 + number.cast("long"))).when(number.isNull() & (F.length(text) == 1), F.upper(text)).otherwise(text)


def answer_list(text: Column, listed: Column) -> Column:
    """the list that the text is (see `with_list`), or the text alone; empty if there is none."""
    bare = strip_space(F.coalesce(text, F.lit("")))
    return F.coalesce(listed, F.when(bare != "", F.array(bare)), F.array().cast("array<string>"))


def first_answer(answers: Column) -> Column:
    return F.coalesce(F.try_element_at(answers, F.lit(1)), F.lit(""))


def is_language(columns: Sequence[Column], config: str) -> Column:
    """The record's own language if it names one, else that of its source."""
    own = first_present(columns)
    return F.when(own.isNull(), F.lit(config in ("yo", "yor"))).otherwise(strip_space(own).isin(*LANGUAGE_CODES))


def stable_id(source: Column, split: Column, ids: Sequence[Column], record: Column) -> Column:
    """source, split and the record's own id; else a digest of the record (a map of strings)."""
    own = first_present(ids)
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(record))))
    return F.when(own.isNotNull(), F.concat_ws("_", source, present(split), own)).otherwise(F.concat_ws("_", source, F.substring(F.sha1(ordered.cast("binary")), 1, 12)))


def infer_task(answer_type: Column, source: Column, path: Column) -> Column:
    """F23"""
    low_path, low = F.lower(path), F.lower(source)
    return (
        F.when((answer_type == "number") | low_path.contains("math") | low.contains("gsm"), "math").when(low.isin("naijarc", "yorc") | low_path.contains("reading"), "reading_comprehension").otherwise("qa")
    )


def synthetic_id(source: Column, stem: Column, row_number: Column) -> Column:
    """The id of an example without one."""
    return F.concat(source, F.lit("_"), stem, F.lit("_"), F.lpad(row_number.cast("string"), 6, "0"))


def row_error(language: Column, answer_type: Column, question: Column, gold: Column) -> Column:
    """Why a benchmark row is not valid, or null."""
    return (
        F.when(language != "yo", "language")
        .when(~answer_type.isin(*ANSWER_TYPES), "answer_type")
        .when(strip_space(F.coalesce(question, F.lit(""))) == "", "question")
        .when(strip_space(F.coalesce(gold, F.lit(""))) == "", "gold_answer")
    )
