"""Reports of small aggregates on the driver: tables, bundles and plots."""

from __future__ import annotations

from collections.abc import Sequence
from importlib.util import find_spec
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalscale.operators import compare
from evalscale.operators.metrics import with_efficiency
from evalscale.sources import logs


def rows_of(table: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in table.collect()]


def text_table(rows: Sequence[dict[str, Any]], columns: Sequence[str], width: int = 24) -> str:
    """Fixed-width columns, long values cut."""

    def cell(value: Any) -> str:
        text = "N/A" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)
        return text if len(text) <= width else text[: width - 1] + "…"

    lines = [[*columns], *([cell(r.get(c)) for c in columns] for r in rows)]
    widths = [max(len(line[i]) for line in lines) for i in range(len(columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in lines)


def evaluation(conditions: DataFrame, path: str | Path) -> dict[str, Any]:
    """The conditions of a run as JSON, their fields also at the top if there is just one."""
    rows = rows_of(conditions)
    report = (dict(rows[0]) if len(rows) == 1 else {}) | {"conditions": rows}
    logs.write_json(report, path)
    return report


def reselection(selections: DataFrame, report: DataFrame, folder: str | Path) -> list[dict[str, Any]]:
    """K9: selections by strategy, and the report."""
    logs.write_splits(selections, str(Path(folder) / "selections"), "strategy")
    rows = rows_of(report.orderBy("dataset", "model", "method", "n", "strategy"))
    logs.write_json({"rows": rows}, Path(folder) / "report.json")
    return rows


PAPER = [
    *("dataset", "small_model", "small_method", "small_n"),
    *(f"small_{x}" for x in "accuracy pass_at_n_rate mean_tokens_per_example mean_latency_s_per_example tokens_per_correct latency_s_per_correct accuracy_per_1k_tokens total_estimated_cost".split()),
    *("large_model", "large_method", "large_n"),
    *(f"large_{x}" for x in "accuracy mean_tokens_per_example mean_latency_s_per_example tokens_per_correct latency_s_per_correct".split()),
    *("accuracy_delta", "matches_or_beats_large", "token_ratio_vs_large", "latency_ratio_vs_large"),
]


def comparison(metrics: DataFrame, c: compare.Comparison, folder: str | Path, plots: bool = True) -> dict[str, Any]:
    """The comparison as CSV and JSON, with plots if they can be drawn."""
    rows = with_efficiency(metrics)
    table = compare.paper_table(rows, c).orderBy("dataset", "small_n").select(*PAPER)
    logs.write_csv(table, Path(folder) / "paper_table.csv")
    report = {
        "paper_table": rows_of(table), "datasets": rows_of(compare.per_dataset(rows, c).orderBy("dataset")), "headline": rows_of(compare.headline(rows, c))[0],
        "ladder": rows_of(compare.ladder(rows, c).select("dataset", "model", "method", "n", "accuracy").orderBy("dataset", "model")),
    }
    report["num_datasets"] = len(report["datasets"])
    logs.write_json(report, Path(folder) / "comparison.json")
    if plots and find_spec("matplotlib"):
        points = efficiency_points(rows, c)
        for d in [None, *[x["dataset"] for x in report["datasets"]]] if len(report["datasets"]) > 1 else [None]:
            end = "" if d is None else f"_{d}"
            plot(report["paper_table"], ("dataset", "small_model"), "small_n", "small_accuracy", Path(folder) / f"accuracy{end}.png", d, level="large_accuracy")
            for x in ("total_tokens", "total_latency_s"):
                plot(points, ("dataset", "model"), x, "accuracy", Path(folder) / f"accuracy_by_{x}{end}.png", d, scatter=True)
    return report


def efficiency_points(metrics: DataFrame, c: compare.Comparison) -> list[dict[str, Any]]:
    """What the efficiency plot shows: each side's rows of the comparison, with what they cost."""
    table = compare.paper_table(metrics, c)
    columns = ("model", "n", "accuracy", "total_tokens", "total_latency_s")
    sides = [table.select("dataset", *[F.col(f"{side}_{x}").alias(x) for x in columns]) for side in ("small", "large")]
    return rows_of(sides[0].unionByName(sides[1]).where("accuracy is not null").distinct().orderBy("dataset", "model", "n"))


def plot(
    rows: Sequence[dict[str, Any]], series: Sequence[str], x: str, y: str, path: str | Path, dataset: str | None = None, level: str | None = None, scatter: bool = False
) -> Path | None:
    """One line (or cloud) per series, by rising x, and its dashed level; None without rows or without matplotlib."""
    rows = [r for r in rows if (dataset is None or r.get("dataset") == dataset) and r.get(x) is not None and r.get(y) is not None]
    if not rows:
        return None
    try:
        from matplotlib.figure import Figure
    except ImportError:
        return None
    axes = (figure := Figure(figsize=(7, 4.5))).subplots()
    for name in sorted({tuple(str(r[s]) for s in series) for r in rows}):
        own = sorted((r for r in rows if tuple(str(r[s]) for s in series) == name), key=lambda r: r[x])
        axes.plot([r[x] for r in own], [r[y] for r in own], marker="o", linestyle="" if scatter else "-", label=" / ".join(name))
        if level is not None and own[0].get(level) is not None:
            axes.axhline(own[0][level], linestyle="--", label=f"{name[0]}: large model")
    axes.set(xlabel=x, ylabel=y)
    axes.legend()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    figure.savefig(path)
    return Path(path)


def dump_prompts(prompts: DataFrame, folder: str) -> None:
    """Prompt texts, one folder per task and style."""
    prompts.select("task", "prompt_style", F.col("prompt").alias("value")).write.mode("overwrite").partitionBy("task", "prompt_style").text(folder)
