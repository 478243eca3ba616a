"""Running selection strategies again over saved candidates (E3: W2, A3, A10, J9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalscale.functions.text import with_match
from evalscale.operators.dedupe import keep_last_together, positions
from evalscale.operators.metrics import pass_per_group, ratio
from evalscale.operators.select import select
from evalscale.schemas import CANDIDATE, CONDITION, EXAMPLE


def reselect(candidates: DataFrame, strategies: Sequence[str] = ("first", "majority_vote"), dedupe: bool = True) -> DataFrame:
    """One row per group and strategy: chosen answer, votes and whether it is right."""
    rows = positions(keep_last_together(candidates, CANDIDATE, EXAMPLE) if dedupe else candidates, EXAMPLE)
    out = None
    for name in strategies:
        chosen = select(rows, EXAMPLE, name, ("gold_answer", "answer_type")).withColumn("strategy", F.lit(name))
        out = chosen if out is None else out.unionByName(chosen)
    kind = F.coalesce(F.nullif("answer_type", F.lit("")), F.lit("text"))
    named = out.withColumns({"gold_answer": F.coalesce("gold_answer", F.lit("")), "answer_type": kind})
    return with_match(named, "is_correct", "selected_answer", "gold_answer", "answer_type")


def reselection_report(candidates: DataFrame, strategies: Sequence[str] = ("first", "majority_vote")) -> DataFrame:
    """A10: per condition and strategy, groups, pass rate, selection rate and the gap between them."""
    rows = positions(keep_last_together(candidates, CANDIDATE, EXAMPLE), EXAMPLE)  # the exchange that `reselect` uses too
    passed = pass_per_group(rows).groupBy(*CONDITION).agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("pass_correct"))
    chosen = reselect(candidates, strategies).groupBy(*CONDITION, "strategy").agg(F.count_if("is_correct").alias("select_correct"), F.count(F.lit(1)).alias("selected"))
    joined = passed.join(chosen, CONDITION)
    pass_rate, rate = ratio(F.col("pass_correct"), F.col("total"), 0.0), ratio(F.col("select_correct"), F.col("selected"), 0.0)
    return joined.withColumn("pass_at_n_rate", pass_rate).withColumn("select_rate", rate).withColumn("gap", pass_rate - rate)
