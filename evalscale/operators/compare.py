"""A small model at many samples against a large one at few (E4: P6, P7, O2, O3, J2, J10, A13-A15, A17)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalscale.operators.metrics import ratio
from evalscale.schemas import CONDITION

EPSILON = 1e-12


@dataclass(frozen=True)
class Comparison:
    """What is compared.  An empty or null method filter matches any method."""

    small_model: str
    large_model: str
    large_n: int = 1
    include_models: tuple[str, ...] = ()
    datasets: tuple[str, ...] | None = None
    small_method: str | None = None
    large_method: str | None = None
    ladder_method: str | None = None


def method_matches(method: Column, wanted: str | None) -> Column:
    """Any; a prefix before a star; the name itself; or the name with more behind `_` or `-`."""
    if wanted is None or wanted in ("", "*"):
        return F.lit(True)
    if wanted.endswith("*"):
        return F.startswith(method, F.lit(wanted[:-1]))
    return (method == wanted) | F.startswith(method, F.lit(f"{wanted}_")) | F.startswith(method, F.lit(f"{wanted}-"))


def distinct_conditions(metrics: DataFrame) -> DataFrame:
    """O3: of each exact key the row with most examples, the earliest if they tie."""
    best = Window.partitionBy(*CONDITION).orderBy(F.desc("total_examples"), "ord")
    return metrics.withColumn("__nth", F.row_number().over(best)).where("__nth = 1").drop("__nth")


def resolve(metrics: DataFrame, model: Column, method: str | None) -> DataFrame:
    """O2: per (dataset, model, n) the matching method with most examples, then the smallest name."""
    own = metrics.where(model & method_matches(F.col("method"), method) & (F.coalesce("dataset", F.lit("")) != ""))
    best = Window.partitionBy("dataset", "model", "n").orderBy(F.desc("total_examples"), "method")
    return own.withColumn("__nth", F.row_number().over(best)).where("__nth = 1").drop("__nth")


def _allowed(metrics: DataFrame, c: Comparison) -> DataFrame:
    return metrics if c.datasets is None else metrics.where(F.col("dataset").isin(*c.datasets))


def _compared(metrics: DataFrame, c: Comparison) -> DataFrame:
    """Every condition once, with whether it is the small model's row of its n (`__small`), the large one's beside it, and how they compare.

    One scan of the metrics: both sides are picked by windows of the same rows.
    """
    rows = _allowed(distinct_conditions(metrics), c)
    named = F.coalesce("dataset", F.lit("")) != ""
    sides = {
        "__small": named & (F.col("model") == c.small_model) & method_matches(F.col("method"), c.small_method),
        "__large": named & (F.col("model") == c.large_model) & (F.col("n") == c.large_n) & method_matches(F.col("method"), c.large_method),
    }
    rows = rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in sides.items()})
    best = {k: F.col(k) & (F.row_number().over(Window.partitionBy("dataset", "model", "n", k).orderBy(F.desc("total_examples"), "method")) == 1) for k in sides}
    rows = rows.withColumns(best)
    columns = [x for x in metrics.columns if x not in ("dataset", "model", "ord")]
    whole = Window.partitionBy("dataset")
    rows = rows.withColumn("__beside", F.first(F.when(F.col("__large"), F.struct(*columns)), ignorenulls=True).over(whole))
    has = F.col("__beside.accuracy").isNotNull()
    return rows.withColumn("matches_or_beats_large", F.when(has, F.col("accuracy") + EPSILON >= F.col("__beside.accuracy")))


def paper_table(metrics: DataFrame, c: Comparison) -> DataFrame:
    """A row per dataset and n of the small model, with the large one's beside it (null if missing)."""
    columns = [x for x in metrics.columns if x not in ("dataset", "model", "ord")]
    small, large = ([F.col(f"{prefix}{x}").alias(f"{name}_{x}") for x in columns if (name, x) != ("large", "n")] for prefix, name in (("", "small"), ("__beside.", "large")))
    both = _compared(metrics, c).where("__small").select("dataset", *small, *large, "matches_or_beats_large").withColumn("large_n", F.lit(c.large_n))
    return both.withColumns(
        {
            "small_model": F.lit(c.small_model),
            "large_model": F.lit(c.large_model),
            "accuracy_delta": F.col("small_accuracy") - F.col("large_accuracy"),
            "token_ratio_vs_large": ratio(F.col("small_total_tokens"), F.col("large_total_tokens")),
            "latency_ratio_vs_large": ratio(F.col("small_total_latency_s"), F.col("large_total_latency_s")),
        }
    )


def per_dataset(metrics: DataFrame, c: Comparison) -> DataFrame:
    """For each dataset whether the large model has a baseline, and the least n at which the small one matches it."""
    least = F.min(F.when(F.col("__small") & F.col("matches_or_beats_large"), F.col("n")))
    return _compared(metrics, c).where(F.coalesce("dataset", F.lit("")) != "").groupBy("dataset").agg(F.bool_or("__large").alias("has_large"), least.alias("min_n"))


def headline(metrics: DataFrame, c: Comparison) -> DataFrame:
    """Matched, unmatched and missing datasets, and the median of the least n."""
    rows = per_dataset(metrics, c)
    matched = F.col("has_large") & F.col("min_n").isNotNull()
    listed = lambda test, value: F.array_sort(F.collect_list(F.when(test, value)))
    return rows.agg(
        listed(matched, F.struct("dataset", "min_n")).alias("datasets_matched"),
        listed(F.col("has_large") & F.col("min_n").isNull(), F.col("dataset")).alias("datasets_unmatched"),
        listed(~F.col("has_large"), F.col("dataset")).alias("datasets_missing_large_baseline"),
        F.median(F.when(matched, F.col("min_n"))).alias("median_min_n_to_match"),
    )


def ladder(metrics: DataFrame, c: Comparison) -> DataFrame:
    """Further models at the large one's n; those without a row are left out."""
    wanted = c.ladder_method if c.ladder_method is not None else c.large_method
    rows = _allowed(distinct_conditions(metrics), c)
    return resolve(rows, F.col("model").isin(*c.include_models) & (F.col("n") == c.large_n), wanted)


def sample_counts(metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    """The sample counts that each dataset has for the models."""
    return metrics.where(F.col("model").isin(*models)).select("dataset", "n").distinct().orderBy("dataset", "n")
