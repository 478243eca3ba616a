"""Conditions of nested sample counts in one pass over their pool: pass@N, select@N by majority vote, and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalscale.functions.text import with_match, with_vote_key
from evalscale.operators.select import typed_groups


def pooled_conditions(pool: DataFrame, sizes: Sequence[int], keys: Sequence[str] = ("dataset", "model"), totals: bool = False) -> DataFrame:
    """One row per `keys` and sample count n: examples, those voted right, those passed; with `totals` samples, tokens, latency and cost.

    The same as cutting the pool (keys, example_id, sample_index, an answer, its gold
    and type) into prefixes, selecting from each by majority vote and joining, without
    a join and with one scan.  Votes are counted as in `select.majority_vote`, by the
    type of each prefix.  The chosen answer is the first one of its key, matched with
    the gold answer and type of the prefix's first sample; a sample passes by its own.
    """
    wanted = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n > F.col("sample_index"))
    amounts = {"tokens": F.coalesce("token_count", F.lit(0)), "latency": F.coalesce("latency_s", F.lit(0.0)).cast("decimal(18,6)"), "cost": F.coalesce("estimated_cost", F.lit(0.0)).cast("decimal(18,9)")} if totals else {}
    answer = F.coalesce("extracted_answer", F.lit(""))
    own = ["answer", "gold_answer", "answer_type"]
    group = [*keys, "n", "example_id"]
    sums = lambda names: [F.sum(n).alias(n) for n in names]
    rows = pool.select(*keys, "example_id", answer.alias("answer"), F.when(answer == "", F.col("sample_index")).alias("empty"), "gold_answer", "answer_type", F.col("sample_index").alias("pos"), *[c.alias(n) for n, c in amounts.items()], F.explode(wanted).alias("n"))
    written = rows.groupBy(*group, *own, "empty").agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("pos"), *sums(amounts)).drop("empty")
    typed = typed_groups(written, group).withColumns({"head_gold": F.col("head.gold_answer"), "head_type": F.coalesce(F.nullif("head.answer_type", F.lit("")), F.lit("text"))}).drop("head")
    judged = with_match(with_match(with_vote_key(typed, "key", "answer", "kind", "pos"), "passed", "answer", "gold_answer", "answer_type"), "right", "answer", "head_gold", "head_type")
    # positions with the match of their answer in the last bit, so that the smallest one brings the match along: hash aggregates, where structs would sort
    first = F.min(F.shiftleft(F.col("pos").cast("long"), 1) + F.col("right").cast("long")).alias("first")
    votes = judged.groupBy(*group, "key").agg(F.sum("votes").alias("votes"), first, F.bool_or("passed").alias("passed"), *sums(amounts))
    rank = F.shiftleft("votes", 33) + F.shiftleft(F.lit((1 << 32) - 1) - F.shiftright("first", 1), 1) + F.col("first") % 2
    best = (F.max(rank) % 2 == 1).alias("best")
    per = votes.groupBy(*group).agg(best, F.bool_or("passed").alias("passed"), F.sum("votes").alias("candidates"), *sums(amounts))
    out = per.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("total_examples"), F.count_if("best").alias("select_correct"), F.count_if("passed").alias("pass_at_n_correct"), *sums(["candidates", *amounts] if totals else []))
    if not totals:
        return out
    named = [F.col("candidates").alias("total_candidates"), F.col("tokens").alias("total_tokens"), F.col("latency").cast("double").alias("total_latency_s"), F.col("cost").cast("double").alias("total_estimated_cost")]
    return out.select(*keys, "n", "total_examples", "select_correct", "pass_at_n_correct", *named)
