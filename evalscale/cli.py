"""Command line: evaluate, aggregate, accuracy, truncated, reselect, compare, ingest, prompts, run."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalscale.functions import prompts as P
from evalscale.operators import metrics as M
from evalscale.operators import reselect as R
from evalscale.plans import config as C
from evalscale.plans import run as runs
from evalscale.plans import sweep as S
from evalscale.sources import logs, raw, reports

COLUMNS = ("dataset", "model", "method", "n", "total_examples", "accuracy", "pass_at_n_rate", "gap", "total_tokens", "tokens_per_correct")


def _conditions(spark: SparkSession, folder: Path) -> DataFrame:
    return M.with_rates(M.conditions(logs.read_candidates(spark, [folder]), logs.read_selections(spark, [folder])))


def _merged(spark: SparkSession, folders: Sequence[Path]) -> DataFrame:
    """Conditions per run folder, merged in the folders' order."""
    out = None
    for i, folder in enumerate(dict.fromkeys(logs.run_at(p) for p in folders)):
        rows = M.conditions(logs.read_candidates(spark, [folder]), logs.read_selections(spark, [folder])).withColumns({"run_id": F.lit(folder.name), "ord": F.lit(i)})
        out = rows.drop("run_ids") if out is None else out.unionByName(rows.drop("run_ids"))
    if out is None:
        raise SystemExit("no runs found")
    return M.with_rates(M.merge_runs(out))


def _show(table: DataFrame, columns: Sequence[str]) -> None:
    print(reports.text_table(reports.rows_of(table), columns))


def evaluate(spark, a):
    for folder in logs.find_runs(a.runs) if a.run is None else [logs.run_at(f"{a.runs}/{a.run}")]:
        found = reports.evaluation(_conditions(spark, folder).orderBy("dataset", "model", "method", "n"), Path(a.out or folder) / "evaluation.json")
        print(reports.text_table(found["conditions"], COLUMNS))


def aggregate(spark, a):
    table = _merged(spark, logs.find_runs(a.runs) if a.run is None else [logs.run_at(f"{a.runs}/{a.run}")])
    if a.datasets:
        table = table.where(F.col("dataset").isin(*C.name_set(a.datasets)))
    table = table.orderBy("dataset", "model", "method", "n").cache()
    logs.write_csv(table, Path(a.out) / "metrics.csv")
    reports.evaluation(table, Path(a.out) / "metrics.json")
    rows = reports.rows_of(table)
    for x in ("n", "mean_tokens_per_example"):
        reports.plot(rows, ("dataset", "model"), x, "accuracy", Path(a.out) / f"accuracy_by_{x}.png")
    print(reports.text_table(rows, COLUMNS))


def accuracy(spark, a):
    folder = Path(a.runs) / a.run
    selections, candidates = logs.read_selections(spark, [folder]), logs.read_candidates(spark, [folder])
    _show(M.first_labels(selections), ("model", "dataset"))
    _show(M.truncation_rate(selections, candidates).orderBy("method"), ("method", "correct", "total", "accuracy", "truncated", "candidates", "truncation_rate"))


def truncated(spark, a):
    rows = logs.read_candidates(spark, logs.find_runs(a.runs))
    wanted = C.name_set(a.methods)
    rows = rows.where(M.truncated(rows) & (F.col("method").isin(*wanted) if wanted else F.lit(True)))  # all methods, if none is named
    logs.write_splits(rows, a.out, "method")


def reselect(spark, a):
    names, every = [x.strip() for x in a.strategies.split(",") if x.strip()], []
    folders = (logs.find_runs(a.runs) if a.run is None else [logs.run_at(f"{a.runs}/{a.run}")])[: a.limit]
    for folder in folders:
        rows = logs.read_candidates(spark, [folder]).cache()
        found = reports.reselection(R.reselect(rows, names), R.reselection_report(rows, names), Path(a.out, *[folder.name] * (len(folders) > 1)) if a.out else folder / "reselected")
        every += [{"run": folder.name, **r} for r in found]
        print(reports.text_table(found, ("dataset", "model", "method", "n", "strategy", "total", "pass_at_n_rate", "select_rate", "gap")))
    if len(folders) > 1:
        logs.write_json({"rows": every}, Path(a.out or a.runs) / "summary.json")


def compare(spark, a):
    c = C.comparison_config(a.config, small_model=a.small_model, large_model=a.large_model, large_n=a.large_n, small_method=a.small_method, large_method=a.large_method)
    source = M.with_rates(logs.read_metrics(spark, a.metrics)) if a.metrics else _merged(spark, logs.find_runs(a.runs)).withColumn("ord", F.monotonically_increasing_id())
    found = reports.comparison(source, c, a.out)
    print(reports.text_table(found["paper_table"], ("dataset", "small_n", "small_accuracy", "large_accuracy", "accuracy_delta", "token_ratio_vs_large")))
    print(found["headline"])


def ingest(spark, a):
    out = None
    s, splits = raw.source(a.dataset, C.name_set(a.splits))
    for split in splits:
        found = next((p for p in sorted(Path(a.files).iterdir()) if p.stem == split), None)
        if found is None:
            raise SystemExit(f"no file for split {split} in {a.files}")
        items = raw.normalize(raw.read_raw(spark, str(found)), s, split)
        out = items if out is None else out.unionByName(items)
    out, seen = raw.watched(out, splits)
    kept = raw.retained(out)
    logs.write_splits(kept.select(F.col("metadata.split").alias("split"), "answer_type", "choices", "gold_answer", "question"), str(Path(a.out) / s.group / s.key))
    counts = raw.watched_counts(seen, splits)
    logs.write_json({"dataset": s.key, "origin": s.origin, "splits": counts, "all": sum(r["retained"] for r in counts)}, Path(a.out) / s.group / f"{s.key}.manifest.json")  # beside the folder, which is read whole
    print(reports.text_table(counts, ("split", "raw", "retained", "skipped")))


def prompts(spark, a):
    c = C.load_run_config(a.config)
    exemplars = P.load_exemplars(a.exemplars) if a.exemplars else {}
    examples, out = runs.examples_of(spark, c, limit=a.limit), None
    for style in dict.fromkeys(m.prompt_style for m in c.methods):
        text = P.as_text(P.render(style, exemplars, F.col("task"), F.col("source_dataset"), F.col("question"), F.col("choices"), F.col("answer_type")))
        own = examples.select("task", F.lit(style).alias("prompt_style"), text.alias("prompt"))
        out = own if out is None else out.unionByName(own)
    reports.dump_prompts(out, a.out)


def run(spark, a):
    module, _, name = a.backend.partition(":")
    backend = getattr(import_module(module), name)
    found = runs.run(
        spark, C.load_run_config(a.config), lambda model: backend, P.load_exemplars(a.exemplars) if a.exemplars else {}, C.name_set(a.datasets), C.name_set(a.models), C.name_set(a.methods), a.limit,
        not a.no_resume, a.overwrite,
    )
    print(found)


COMMANDS = {
    evaluate: ("--runs", "--run", "--out"), aggregate: ("--runs", "--run", "--out", "--datasets"), accuracy: ("--runs", "--run"), truncated: ("--runs", "--methods", "--out"),
    reselect: ("--runs", "--run", "--strategies", "--limit", "--out"), compare: ("--runs", "--metrics", "--config", "--small-model", "--large-model", "--large-n", "--small-method", "--large-method", "--out"),
    ingest: ("--dataset", "--splits", "--files", "--out"), prompts: ("--config", "--exemplars", "--limit", "--out"),
    run: ("--config", "--exemplars", "--backend", "--datasets", "--models", "--methods", "--limit", "--no-resume", "--overwrite"),
}
DEFAULTS = {"--runs": "runs", "--strategies": "first,majority_vote", "--backend": f"{S.__name__}:EchoBackend"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="evalscale", description=__doc__)
    commands = out.add_subparsers(required=True)
    for fn, options in COMMANDS.items():
        own = commands.add_parser(fn.__name__)
        own.set_defaults(fn=fn)
        for o in options:
            if o in ("--no-resume", "--overwrite"):
                own.add_argument(o, action="store_true")
            else:
                own.add_argument(o, default=DEFAULTS.get(o), type=int if o in ("--limit", "--large-n") else str)
    return out


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.fn(SparkSession.builder.appName("evalscale").getOrCreate(), a)


if __name__ == "__main__":
    main()
