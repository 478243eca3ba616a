"""Choosing one answer per group: first and majority vote.

A vote is counted by what its answer means, and that depends on the type of the
group: of its first sample that names one.  So answers are pooled as written,
their groups are gathered, which tells the type and the first sample, and only
then pooled again by key.  All of it is aggregation on keys with a common prefix:
no join, and one shuffle more than grouping takes, or none if rows of a group are
together already.  A group is the samples of one example.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalscale.functions.text import with_vote_key

#: Strategies by name; each takes (rows, keys, carry).  More can be registered.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {}


def strategy(name: str):
    def register(fn):
        STRATEGIES[name] = fn
        return fn

    return register


def select(rows: DataFrame, keys: Sequence[str], name: str, carry: Sequence[str] = ()) -> DataFrame:
    """One row per group of (keys, pos, sample_index, extracted_answer, answer_type): the chosen answer and its votes.

    `carry` names columns of each group's first row to bring along, with the number
    of its rows as `candidate_count`, in the same aggregation.
    """
    if name not in STRATEGIES:
        raise ValueError(f"unsupported selection strategy {name!r}; expected one of {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[name](rows, keys, carry)


def _named(kind: Column) -> Column:
    return F.nullif(kind, F.lit(""))


def group_type(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """the answer type of a group is that of its first row that has one."""
    named = _named(F.col("answer_type"))
    return rows.groupBy(*keys).agg(F.min_by(named, F.when(named.isNotNull(), F.col("pos"))).alias("answer_type"))


def typed_groups(pooled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pooled answers, of which each has the position `pos` of its first sample and that one's `answer_type`, with
    `kind`, the type of their group, and `head`, the row of its first sample.

    Answers are pooled apart by type before, so the first sample that names a type is the first of its row.
    """
    rest = [c for c in pooled.columns if c not in keys and c != "pos"]
    held = pooled.groupBy(*keys).agg(F.collect_list(F.struct("pos", *rest)).alias("__all"))
    named = F.filter("__all", lambda x: _named(x["answer_type"]).isNotNull())
    first = lambda rows: F.reduce(rows, F.element_at("__all", 1), lambda a, b: F.when(b["pos"] < a["pos"], b).otherwise(a))
    kind = F.array_min(F.transform(named, lambda x: F.struct(x["pos"], x["answer_type"])))["answer_type"]
    return held.select(*keys, kind.alias("kind"), first("__all").alias("head"), F.inline("__all"))


def _row(carry: Sequence[str]) -> Column:
    return F.struct("pos", "sample_index", F.coalesce("extracted_answer", F.lit("")).alias("answer"), *carry)


def _output(chosen: DataFrame, keys: Sequence[str], carry: Sequence[str], best: str, head: str) -> DataFrame:
    more = [F.col(f"{head}.{c}").alias(c) for c in carry] + [F.col("candidate_count")] * bool(carry)
    return chosen.select(*keys, F.col(f"{best}.sample_index").alias("selected_sample_index"), F.col(f"{best}.answer").alias("selected_answer"), "vote_counts", *more)


@strategy("first")
def first(rows: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    chosen = rows.groupBy(*keys).agg(F.min(_row(carry)).alias("head"), F.count(F.lit(1)).alias("candidate_count"))
    votes = F.map_from_arrays(F.array("head.answer"), F.array(F.lit(1).cast("long")))
    return _output(chosen.withColumn("vote_counts", votes), keys, carry, "head", "head")


@strategy("majority_vote")
def majority_vote(rows: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    answer = F.coalesce("extracted_answer", F.lit(""))
    # an empty answer is a vote of its own
    apart = rows.withColumns({"__answer": answer, "__empty": F.when(answer == "", F.col("pos"))})
    written = apart.groupBy(*keys, "__answer", "__empty", "answer_type").agg(F.count(F.lit(1)).alias("__votes"), F.min(_row(carry)).alias("__first"))
    typed = typed_groups(written.withColumn("pos", F.col("__first.pos")).drop("__empty"), keys)
    keyed = with_vote_key(typed.select(*keys, "kind", "pos", "__answer", "__votes", "__first"), "__key", "__answer", "kind", "pos")
    pooled = keyed.groupBy(*keys, "__key").agg(F.sum("__votes").alias("__n"), F.min("__first").alias("__first"))
    chosen = pooled.groupBy(*keys).agg(
        F.min(F.struct((-F.col("__n")).alias("less"), "__first")).alias("__best"),
        F.min("__first").alias("head"),
        F.sum("__n").alias("candidate_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("__key", "__n")))).alias("vote_counts"),
    )
    return _output(chosen, keys, carry, "__best.__first", "head")
