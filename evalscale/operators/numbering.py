"""Running numbers and totals of groups of any size, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one range of the order column has, about, as long as there are no more ranges than `RANGES`.
WIDTH = 1 << 16
SIDE = 32
RANGES = SIDE * SIDE


def range_bounds(rows: DataFrame, order: str, width: int = WIDTH) -> list:
    """Values of the order column that cut it into ranges with about as many rows each: at most `RANGES` ranges, none cut for `width` rows."""
    shares = F.array(*[F.lit((i + 1) / RANGES) for i in range(RANGES - 1)])
    found = rows.agg(F.count(order).alias("n"), F.percentile_approx(order, shares, F.lit(10 * RANGES)).alias("at")).first()
    ranges = min(RANGES, -(-(found.n or 0) // width))
    return sorted({found.at[RANGES * i // ranges - 1] for i in range(1, ranges)})


def range_of(order: Column, bounds: Sequence) -> Column:
    """How many of the sorted bounds are below a value: found among every 32nd, then among the 32 of that part."""
    if not bounds:
        return F.when(order.isNotNull(), F.lit(0))
    parts = [bounds[i : i + SIDE] for i in range(0, len(bounds), SIDE)]
    below = lambda values: F.size(F.filter(values, lambda b: b < order))
    literal = lambda values: F.array(*[F.lit(v) for v in values])
    whole = below(literal([p[-1] for p in parts]))
    inside = F.coalesce(below(F.try_element_at(F.array(*[literal(p) for p in parts]), whole + 1)), F.lit(0))
    return F.when(order.isNotNull(), F.least(whole * SIDE, F.lit(len(bounds))) + F.greatest(inside, F.lit(0)))


def running(rows: DataFrame, keys: Sequence[str], order: str, totals: Mapping[str, Column], width: int = WIDTH, within: Sequence[str] = ()) -> DataFrame:
    """The rows with each total of their group so far, their own row included, by an order column.

    Groups are cut into ranges of the order column by its quantiles over all rows, so
    a range holds about `width` rows of all groups together however its values lie, and a
    group has as few ranges (rows beyond `RANGES` times the width make ranges longer).
    Totals of ranges are summed up first; then each row adds what its own range has
    before it.  Rows that tie count together, as in a window with a range frame; columns
    `within`, of which the order column is the first, part ties.
    """
    piece = range_of(F.col(order), range_bounds(rows, order, width)).cast("long")
    valued = rows.withColumns({"__piece": piece, **{f"__{n}": c for n, c in totals.items()}})
    pieces = valued.groupBy(*keys, "__piece").agg(*[F.sum(f"__{n}").alias(f"__{n}_piece") for n in totals])
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__piece").alias("__p"), *[F.coalesce(F.sum(f"__{n}_piece").over(before), F.lit(0)).alias(f"__{n}_before") for n in totals])
    inside = Window.partitionBy(*keys, "__piece").orderBy(*(within or (order,)))
    summed = valued.withColumns({n: F.sum(f"__{n}").over(inside) for n in totals})
    same = F.col("__piece").eqNullSafe(F.col("__p"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = summed.join(pieces, same)
    return joined.withColumns({n: F.col(n) + F.col(f"__{n}_before") for n in totals}).select(*rows.columns, *totals)
