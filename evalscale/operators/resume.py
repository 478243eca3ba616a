"""Resuming an interrupted run, as set algebra.

Completed is what the checkpoint or the outputs show, less what is incomplete: a
unit whose rows are stripped is always done again.  Of a nested sweep a unit is
whole if all methods that are expected now have a selection, so a sweep with more
methods, and so another pool, samples it again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalscale.operators.dedupe import keep_last
from evalscale.plans.sweep import unit_key
from evalscale.schemas import CANDIDATE, EXAMPLE


def row_unit(rows: DataFrame) -> Column:
    """The unit that a candidate or selection row belongs to."""
    nested = F.coalesce(F.col("nested"), F.lit(False)) | (F.coalesce("nested_group_id", F.lit("")) != "")
    group = F.coalesce("nested_group_id", F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return unit_key(F.when(nested, "nested").otherwise("standalone"), text("dataset"), text("model"), F.when(nested, group).otherwise(text("method")), text("example_id").cast("string"))


def checkpoint_keys(log: DataFrame) -> DataFrame:
    """Keys of a checkpoint log (key, unit_type, dataset, model, method, group_id, example_id); rows that name no unit are skipped."""
    made = unit_key(F.col("unit_type"), F.col("dataset"), F.col("model"), F.when(F.col("unit_type") == "nested", F.col("group_id")).otherwise(F.col("method")), F.col("example_id"))
    whole = F.col("unit_type").isin("standalone", "nested") & F.col("dataset").isNotNull() & F.col("model").isNotNull() & F.col("example_id").isNotNull()
    key = F.coalesce(F.nullif("key", F.lit("")), F.when(whole, made))
    return log.select(key.alias("key")).where("key is not null").distinct()


def unit_methods(selections: DataFrame, expected: Mapping[str, Sequence[str]]) -> DataFrame:
    """For each unit with selections, whether all methods that its sweep expects are there; unknown sweeps count as whole."""
    pairs = [x for g, own in expected.items() for x in (F.lit(g), F.array(*[F.lit(m) for m in own]))]
    wanted = F.try_element_at(F.create_map(*pairs), F.col("nested_group_id")) if pairs else F.lit(None).cast("array<string>")
    rows = selections.withColumn("key", row_unit(selections))
    seen = rows.groupBy("key").agg(F.collect_set("method").alias("seen"), F.max("nested_group_id").alias("nested_group_id"))  # at most the sweep's methods
    nested = F.startswith(F.col("key"), F.lit("nested\t"))
    missing = F.size(F.array_except(F.coalesce(wanted, F.array().cast("array<string>")), F.col("seen"))) > 0
    return seen.select("key", (nested & missing).alias("partial"))


@dataclass(frozen=True)
class Recovered:
    candidates: DataFrame
    selections: DataFrame
    completed: DataFrame
    incomplete: DataFrame


def recover(candidates: DataFrame, selections: DataFrame, expected: Mapping[str, Sequence[str]], checkpoint: DataFrame | None = None) -> Recovered:
    """De-duplicated rows of whole units, and the keys of whole and of broken units."""
    c, s = keep_last(candidates, CANDIDATE), keep_last(selections, EXAMPLE)
    c, s = c.withColumn("key", row_unit(c)), s.withColumn("key", row_unit(s))
    units = unit_methods(s.drop("key"), expected)
    partial = units.where("partial").select("key")
    orphan = c.where(F.startswith(F.col("key"), F.lit("standalone\t"))).select("key").distinct().join(s.select("key").distinct(), "key", "left_anti")
    incomplete = partial.unionByName(orphan).distinct()
    completed = units.where(~F.col("partial")).select("key")
    if checkpoint is not None:
        completed = completed.unionByName(checkpoint_keys(checkpoint)).distinct()
    return Recovered(c.join(incomplete, "key", "left_anti"), s.join(incomplete, "key", "left_anti"), completed.join(incomplete, "key", "left_anti"), incomplete)
