"""Metrics of conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalscale.functions.text import with_match
from evalscale.operators.dedupe import keep_last, keep_last_together
from evalscale.operators.merging import merge_runs  # noqa: F401  A6 is in a module of its own
from evalscale.schemas import CANDIDATE, CONDITION, EXAMPLE, LABELS


def ratio(top: Column, below: Column, otherwise: float | None = None) -> Column:
    """top / below where below is positive."""
    out = F.when(below > 0, top / below)
    return out if otherwise is None else out.otherwise(F.lit(otherwise))


def matched(candidates: DataFrame) -> DataFrame:
    """Candidates with `right`: whether each equals its own gold answer."""
    return with_match(candidates, "right", "extracted_answer", "gold_answer", "answer_type")


def pass_per_example(candidates: DataFrame, keys: Sequence[str] = EXAMPLE) -> DataFrame:
    """A2: whether any candidate equals its own gold answer."""
    return matched(candidates).groupBy(*keys).agg(F.bool_or("right").alias("passed"))


def pass_per_group(candidates: DataFrame, keys: Sequence[str] = EXAMPLE) -> DataFrame:
    """A3: as A2, with the gold answer and type of each group's first candidate (text if it names none)."""
    # answers are pooled first, so each distinct one is matched once, against the group's gold, without a join
    pooled = candidates.groupBy(*keys, F.coalesce("extracted_answer", F.lit("")).alias("__answer")).agg(F.min(F.struct("pos", "gold_answer", "answer_type")).alias("__first"))
    groups = pooled.groupBy(*keys).agg(F.min("__first").alias("__head"), F.collect_set("__answer").alias("__answers"))
    gold, kind = F.coalesce("__head.gold_answer", F.lit("")), F.coalesce(F.nullif("__head.answer_type", F.lit("")), F.lit("text"))
    rows = groups.select(*keys, gold.alias("__gold"), kind.alias("__kind"), F.explode("__answers").alias("__answer"))
    return with_match(rows, "right", "__answer", "__gold", "__kind").groupBy(*keys).agg(F.bool_or("right").alias("passed"))


def conditions(candidates: DataFrame, selections: DataFrame) -> DataFrame:
    """A1: one row per condition, from candidates and selections that may hold repeated rows.

    If a condition has selections, its examples are the selected ones; else those
    with candidates, none correct.  Tokens, latency and cost count all candidates.
    Candidates are read once and dealt out once, by example: their rows are ranked,
    aggregated and joined there; one more shuffle brings examples to conditions.
    """
    c, s = keep_last_together(candidates, CANDIDATE, EXAMPLE), keep_last_together(selections, EXAMPLE, EXAMPLE)
    c_label, s_label = (F.min(F.struct("ord", *LABELS)).alias(name) for name in ("c_label", "s_label"))
    per = matched(c).groupBy(*EXAMPLE).agg(
        F.bool_or("right").alias("passed"),
        F.count(F.lit(1)).alias("candidates"),
        F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"),
        F.sum(F.coalesce(F.col("latency_s"), F.lit(0.0)).cast("decimal(18,6)")).alias("latency"),
        F.sum(F.coalesce(F.col("estimated_cost"), F.lit(0.0)).cast("decimal(18,9)")).alias("cost"),
        F.array_sort(F.collect_set("run_id")).alias("c_runs"),
        c_label,
    )
    chosen = s.groupBy(*EXAMPLE).agg(F.bool_or(F.coalesce("is_correct", F.lit(False))).alias("correct"), F.array_sort(F.collect_set("run_id")).alias("s_runs"), s_label)
    joined = per.join(chosen, list(EXAMPLE), "full_outer")
    picked = F.col("s_label").isNotNull()
    seen = F.col("c_label").isNotNull()
    totals = joined.groupBy(*CONDITION).agg(
        F.count(F.when(picked, 1)).alias("picked"),
        F.count(F.when(seen, 1)).alias("seen"),
        F.count_if(picked & F.col("correct")).alias("correct"),
        F.count_if(seen & F.col("passed")).alias("passed"),
        F.count_if(picked & seen & F.col("passed")).alias("passed_picked"),
        F.coalesce(F.sum("candidates"), F.lit(0)).alias("total_candidates"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"),
        F.coalesce(F.sum("latency"), F.lit(0)).cast("double").alias("total_latency_s"),
        F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("total_estimated_cost"),
        # examples of the same runs name the same list, so this holds a list per mixture of runs, not per example
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("c_runs", "s_runs"))))).alias("run_ids"),
        F.coalesce(F.min("c_label"), F.min("s_label")).alias("label"),
    )
    some = F.col("picked") > 0
    return totals.select(
        *CONDITION,
        *[F.col(f"label.{x}").alias(x) for x in LABELS],
        F.when(some, F.col("picked")).otherwise(F.col("seen")).alias("total_examples"),
        F.when(some, F.col("correct")).otherwise(F.lit(0)).cast("long").alias("select_correct"),
        F.when(some, F.col("passed_picked")).otherwise(F.col("passed")).alias("pass_at_n_correct"),
        "total_candidates", "total_tokens", "total_latency_s", "total_estimated_cost", "run_ids",
    )


def with_rates(metrics: DataFrame) -> DataFrame:
    """Rates derived from counts."""
    n, right, passed = F.col("total_examples"), F.col("select_correct"), F.col("pass_at_n_correct")
    return metrics.withColumns(
        {
            "accuracy": ratio(right, n, 0.0),
            "pass_at_n_rate": ratio(passed, n, 0.0),
            "gap": ratio(passed, n, 0.0) - ratio(right, n, 0.0),
            "mean_tokens_per_example": ratio(F.col("total_tokens"), n, 0.0),
            "mean_latency_s_per_example": ratio(F.col("total_latency_s"), n, 0.0),
            "tokens_per_correct": ratio(F.col("total_tokens"), right),
        }
    )


def with_efficiency(metrics: DataFrame) -> DataFrame:
    """Null where the denominator is not positive."""
    right, accuracy = F.col("select_correct"), F.col("accuracy")
    return metrics.withColumns(
        {
            "latency_s_per_correct": ratio(F.col("total_latency_s"), right),
            "accuracy_per_1k_tokens": ratio(accuracy, F.col("total_tokens") / 1000.0),
            "accuracy_per_cost": ratio(accuracy, F.col("total_estimated_cost")),
        }
    )


def method_accuracy(selections: DataFrame, dedupe: bool = False) -> DataFrame:
    """Correct and total per method; repeated rows count unless de-duplicated."""
    rows = keep_last(selections, EXAMPLE) if dedupe else selections
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("is_correct", F.lit(False))).alias("correct"))


def truncated(candidates: DataFrame) -> Column:
    """P5: a response cut off by the length limit; null if the backend does not say."""
    return F.col("finish_reason") == "length"


def truncation_rate(selections: DataFrame, candidates: DataFrame) -> DataFrame:
    """Accuracy per method with its truncated share; null without candidates."""
    cut_off = candidates.groupBy("method").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.coalesce(truncated(candidates), F.lit(False))).alias("truncated"))
    joined = method_accuracy(selections).join(cut_off, "method", "left")
    return joined.withColumn("accuracy", ratio(F.col("correct"), F.col("total"), 0.0)).withColumn("truncation_rate", ratio(F.col("truncated"), F.col("candidates")))


def first_labels(selections: DataFrame) -> DataFrame:
    """Model and dataset of the first row of the log."""
    return selections.agg(F.min(F.struct("ord", "model", "dataset")).alias("s")).select("s.model", "s.dataset")
