"""Keep-last de-duplication of append logs (W1), and stable ordering within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ord",)) -> DataFrame:
    """The newest row of each key.  The rank filter is applied before the shuffle too, so one row per key and task travels."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("__nth", F.row_number().over(newest)).where("__nth = 1").drop("__nth")


def keep_last_together(rows: DataFrame, keys: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """As `keep_last`, dealt out by `groups`, of which the keys are finer: what follows on the groups needs no further shuffle."""
    return keep_last(rows.repartition(*groups), keys)


def keep_last_at_first(rows: DataFrame, keys: Sequence[str], order: str = "ord", first: str = "first_ord") -> DataFrame:
    """As `keep_last`, with the position where the key was first seen in column `first`."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    best = F.max(F.struct(F.col(order), *rest)).alias("__best")
    grouped = rows.groupBy(*keys).agg(F.min(order).alias(first), best)
    return grouped.select(*keys, first, F.col(f"__best.{order}").alias(order), *[F.col(f"__best.{c}").alias(c) for c in rest])


def duplicates_dropped(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows `keep_last` drops."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("dropped"))


def positions(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("sample_index", "ord"), name: str = "pos") -> DataFrame:
    """Each row's place in its group (0 first), by sample index and then append order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
