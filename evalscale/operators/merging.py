"""Merging the conditions of several runs without counting a run twice.

An item names the set of runs that it counts, so merged conditions can be merged
again.  Run ids of a condition are numbered, a set is the bits of its numbers, and
items are folded in order; bits tell whether a set is new to those merged so far,
within them, or partly both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalscale.schemas import CONDITION, LABELS

SUMS = ["total_examples", "select_correct", "pass_at_n_correct", "total_candidates", "total_tokens", "total_latency_s", "total_estimated_cost"]
BITS = 64


def run_ids(items: DataFrame) -> Column:
    """The runs that each item counts, from `run_ids` or one `run_id`; no run is an empty list."""
    if "run_ids" in items.columns:
        return F.array_distinct(F.array_compact(F.coalesce("run_ids", F.array().cast("array<string>"))))
    return F.array_compact(F.array("run_id"))


def run_bits(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, ord, item, bits): each item's set of runs as words of 64 bits, run ids numbered within the keys.

    An item without runs is a run of its own.
    """
    ids = run_ids(items)
    own = F.when(F.size(ids) > 0, ids).otherwise(F.array(F.concat(F.lit("\0anonymous "), F.col("ord").cast("string"))))
    named = items.select(*keys, "ord", F.struct(*items.columns).alias("item"), F.explode(own).alias("__run"))
    number = (F.dense_rank().over(Window.partitionBy(*keys).orderBy("__run")) - 1).alias("__number")
    words = named.select("*", number).groupBy(*keys, "ord", F.expr(f"__number div {BITS}").alias("__word"))
    words = words.agg(F.bit_or(F.expr(f"shiftleft(1L, __number % {BITS})")).alias("__bits"), F.first("item").alias("item"))
    return words.groupBy(*keys, "ord").agg(F.first("item").alias("item"), F.map_from_entries(F.collect_list(F.struct("__word", "__bits"))).alias("bits"))


def overlap(a: Column, b: Column) -> Column:
    return F.exists(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), lambda w: w != 0)


def within(a: Column, b: Column) -> Column:
    """Whether all bits of a are in b."""
    return F.forall(F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y))), lambda w: w == 0)


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def folded(items: DataFrame, keys: Sequence[str] = CONDITION) -> DataFrame:
    """Each item with `decision`: first, added, replaced (it takes the place of the only one so far, of the same runs but fewer
    examples), covered (its runs are counted already) or overlap (some are); and with `kept`, whether it counts in the end.

    The items of a group of keys, one for each report of it, are gathered and folded by `ord`.
    """
    words = F.col("words")
    rows = run_bits(items, keys).groupBy(*keys).agg(
        F.collect_list(F.struct("ord", F.col("item.total_examples").cast("long").alias("examples"), "bits", "item")).alias("all"),
        F.max(F.array_max(F.map_keys("bits"))).alias("words"),
    )
    dense = lambda x: F.transform(F.sequence(F.lit(0).cast("long"), words), lambda w: F.coalesce(F.try_element_at(x["bits"], w), F.lit(0).cast("long")))
    ordered = F.array_sort("all", lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))
    steps = rows.select(*keys, "words", ordered.alias("all"))
    nothing = F.transform(F.sequence(F.lit(0).cast("long"), words), lambda _: F.lit(0).cast("long"))
    start = F.struct(nothing.alias("covered"), F.lit(0).cast("long").alias("sets"), F.lit(0).cast("long").alias("examples"), F.array().cast("array<string>").alias("decisions"))

    def step(state: Column, x: Column) -> Column:
        bits = dense(x)
        new = ~overlap(state["covered"], bits)
        same = (state["sets"] == 1) & within(bits, state["covered"]) & within(state["covered"], bits)
        larger = same & (x["examples"] > state["examples"])
        decision = (
            F.when(state["sets"] == 0, "first").when(new, "added").when(larger, "replaced").when(within(bits, state["covered"]), "covered").otherwise("overlap")
        )
        return F.struct(
            F.when(new, both(state["covered"], bits)).otherwise(state["covered"]).alias("covered"),
            (state["sets"] + new.cast("long")).alias("sets"),
            F.when(larger | (state["sets"] == 0), x["examples"]).otherwise(state["examples"]).alias("examples"),
            F.concat(state["decisions"], F.array(decision)).alias("decisions"),
        )

    decided = steps.select(*keys, "all", F.aggregate("all", start, step)["decisions"].alias("decisions"))
    # what an item is replaced by comes later, before any is added
    last = F.greatest(F.lit(1), F.size("decisions") - F.coalesce(F.nullif(F.array_position(F.reverse("decisions"), "replaced"), F.lit(0)), F.size("decisions")) + 1)
    dealt = decided.select(last.alias("__from"), F.posexplode(F.arrays_zip(F.col("all"), F.col("decisions"))).alias("__at", "x"))
    kept = (F.col("__at") + 1 >= F.col("__from")) & F.col("x.decisions").isin("first", "replaced", "added")
    return dealt.select("x.all.item.*", F.col("x.decisions").alias("decision"), kept.alias("kept"))


def merge_runs(items: DataFrame, keys: Sequence[str] = CONDITION) -> DataFrame:
    """Conditions of several runs in one row each; what overlaps in part is left out, as it cannot be told apart.

    `items` has a condition's columns, `run_ids` or one `run_id` (null or none: a run of
    its own) and `ord`.  Labels are those of the first kept item that has them.
    """
    kept = folded(items, keys).where("kept").drop("kept", "decision")
    kept = kept.withColumn("__ids", run_ids(items))
    label = lambda c: F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col("ord"))).alias(c)
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("__ids")))).alias("run_ids")
    return kept.groupBy(*keys).agg(*[label(c) for c in LABELS if c in items.columns], *[F.sum(c).alias(c) for c in SUMS if c in items.columns], ids)


def run_sets(rows: DataFrame, known: Sequence[str]) -> DataFrame:
    """Of each row's runs those that are among the known ones, and the others; both sorted."""
    names = F.array(*[F.lit(k) for k in known]).cast("array<string>")
    return rows.withColumns({"shared": F.array_sort(F.array_intersect(run_ids(rows), names)), "other": F.array_sort(F.array_except(run_ids(rows), names))})
