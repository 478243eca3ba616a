"""Reading and writing run logs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalscale.functions.ingest import ANSWER_TYPES, infer_task, synthetic_id
from evalscale.functions.text import strip_space
from evalscale.operators.numbering import running
from evalscale.schemas import CANDIDATE_JSON, EXAMPLE_JSON, SELECTION_JSON
from evalscale.sources import folders

# Fixed names: folders that are no runs.
NO_RUNS = frozenset({"sample_prompts", "__pycache__", ".git", "_smoke", "smoke", "synthetic", "synthetic_e2"})


#: Lines that one task can number.
TASK_LINES = 1 << 33


def numbered_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Non-blank lines with their file and `ord`, whose order is theirs in the file, of files of any size in one scan.

    A task reads a part of a file, from the first line that begins in it, line by line.
    So the byte where the part begins, and then the line's place among those of its
    task, order the lines: `ord` is both in one number.  In the first part of a file
    that a task reads alone it is the line's number, 0 first.
    """
    place = F.monotonically_increasing_id().bitwiseAND(TASK_LINES - 1)
    order = (F.col("_metadata.file_block_start").cast("decimal(20,0)") * F.lit(TASK_LINES) + place).cast("decimal(38,0)")
    lines = spark.read.text(list(paths), lineSep="\n").select(F.col("_metadata.file_path").alias("path"), order.alias("ord"), F.col("value").alias("text"))
    return lines.where(strip_space(F.col("text")) != "")


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, strict: bool = True) -> DataFrame:
    """One row per line, scalars as text, with `path` and `ord`; a bad line is an error, or dropped."""
    lines = numbered_lines(spark, [paths] if isinstance(paths, str) else paths)
    held = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = lines.select("path", "ord", F.from_json("text", held, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    if strict:
        byte, line = F.floor(F.col("ord") / TASK_LINES).cast("string"), (F.col("ord") % TASK_LINES + 1).cast("decimal(20,0)").cast("string")
        where = F.concat(F.lit("malformed JSON in "), F.col("path"), F.lit(", line "), line, F.when(byte != "0", F.concat(F.lit(" of the task that reads from byte "), byte)).otherwise(""))
        rows = rows.withColumn("r", F.when(F.col("r._bad").isNull(), F.col("r")).otherwise(F.raise_error(where)))
    else:
        rows = rows.where("r._bad is null")
    return rows.select("path", "ord", "r.*").drop("_bad")


def boolean(c: Column) -> Column:
    """Written booleans; other texts are null (never true just for not being empty)."""
    return F.lower(c).try_cast("boolean")


def candidates(rows: DataFrame) -> DataFrame:
    """Typed candidate rows with defaults, from JSON rows."""
    m = "metadata"
    n = F.col("n").try_cast("int")
    return rows.select(
        "run_id", F.coalesce(F.nullif("dataset", F.lit("")), F.col(f"{m}.dataset"), F.lit("")).alias("dataset"), F.coalesce("example_id", F.lit("")).alias("example_id"), "task", "source_dataset",
        F.coalesce("model", F.lit("")).alias("model"), "model_size_label", F.coalesce("method", F.lit("")).alias("method"), "prompt_style", "selection",
        F.col("sample_index").try_cast("int").alias("sample_index"), F.when(n != 0, n).otherwise(1).alias("n"), "reasoning_language", "prompt", "response",
        F.coalesce("extracted_answer", F.lit("")).alias("extracted_answer"), F.coalesce(F.col("token_count").try_cast("long"), F.lit(0)).alias("token_count"),
        F.coalesce(F.col("latency_s").try_cast("double"), F.lit(0.0)).alias("latency_s"), F.coalesce(F.col("estimated_cost").try_cast("double"), F.lit(0.0)).alias("estimated_cost"),
        F.col(f"{m}.gold_answer").alias("gold_answer"), F.coalesce(f"{m}.answer_type", "answer_type", F.lit("")).alias("answer_type"), F.col(f"{m}.choices").alias("choices"),
        boolean(F.col(f"{m}.nested")).alias("nested"), F.col(f"{m}.nested_group_id").alias("nested_group_id"), F.col(f"{m}.nested_pool_n").try_cast("int").alias("nested_pool_n"),
        F.col(f"{m}.sample_seed").try_cast("long").alias("sample_seed"), F.col(f"{m}.backend_metadata.finish_reason").alias("finish_reason"), F.col(f"{m}.backend").alias("backend"), "ord",
    )


def selections(rows: DataFrame) -> DataFrame:
    n = F.col("n").try_cast("int")
    return rows.select(
        "run_id", F.coalesce(F.nullif("dataset", F.lit("")), F.col("metadata.dataset"), F.lit("")).alias("dataset"), F.coalesce("example_id", F.lit("")).alias("example_id"),
        F.coalesce("model", F.lit("")).alias("model"), "model_size_label", F.coalesce("method", F.lit("")).alias("method"), "prompt_style", "selection",
        F.when(n != 0, n).otherwise(1).alias("n"), "reasoning_language", F.col("selected_sample_index").try_cast("int").alias("selected_sample_index"), "selected_answer", "gold_answer",
        "answer_type", F.coalesce(boolean(F.col("is_correct")), F.lit(False)).alias("is_correct"), boolean(F.col("nested")).alias("nested"), "nested_group_id", "ord",
    )


def read_candidates(spark: SparkSession, runs: Iterable[Path | str], strict: bool = True) -> DataFrame:
    """Candidates of several runs in one read, each path once."""
    return candidates(read_jsonl(spark, _files(spark, runs, "candidates.jsonl"), CANDIDATE_JSON, strict))


def read_selections(spark: SparkSession, runs: Iterable[Path | str], strict: bool = True) -> DataFrame:
    return selections(read_jsonl(spark, _files(spark, runs, "selections.jsonl"), SELECTION_JSON, strict))


def is_uri(path: object) -> bool:
    return re.match(r"[a-z][a-z0-9+.-]+:", str(path)) is not None


def run_at(path: Path | str | folders.Entry) -> Path | folders.Entry:
    """A run folder: a path of this machine, or of any file system that Spark knows if it is a URI."""
    if isinstance(path, folders.Entry):
        return path
    if is_uri(path):
        text = str(path).rstrip("/")
        return folders.Entry(text, text.rsplit("/", 1)[1], True, 0)
    return Path(path).resolve()


def _files(spark: SparkSession, runs: Iterable[Path | str | folders.Entry], name: str) -> list[str]:
    found = dict.fromkeys(run_at(r) for r in runs)
    there = lambda r: folders.exists(spark, f"{r.path}/{name}") if isinstance(r, folders.Entry) else (r / name).exists()
    return [f"{r.path}/{name}" if isinstance(r, folders.Entry) else str(r / name) for r in found if there(r)]


def find_runs(base: str | Path, need_manifest: bool = True, need_selections: bool = False, exclude: Iterable[str] = (), hidden: bool = False) -> list[Path | folders.Entry]:
    """Run folders, by name; those of tests, caches and empty logs are left out.  Of a URI they are listed by its file system."""
    excluded = NO_RUNS | set(exclude)
    wanted = ["candidates.jsonl"] + ["manifest.json"] * need_manifest + ["selections.jsonl"] * need_selections

    def named(name: str) -> bool:
        return not (name in excluded or name.startswith(".") or (name.startswith("_") and not hidden) or "smoke" in name.lower() or name.lower().startswith("synthetic"))

    if is_uri(base):
        spark = SparkSession.active()
        found = [e for e in folders.listing(spark, str(base)) if e.is_dir and named(e.name)]
        sizes = [{f.name: f.size for f in folders.listing(spark, e.path) if not f.is_dir} for e in found]
        return [e for e, own in zip(found, sizes, strict=True) if set(wanted) <= own.keys() and own[wanted[0]] > 0]
    base = Path(base)
    whole = lambda p: all((p / w).is_file() for w in wanted) and (p / wanted[0]).stat().st_size > 0
    return sorted(p for p in base.iterdir() if p.is_dir() and named(p.name) and whole(p)) if base.is_dir() else []


def read_examples(spark: SparkSession, path: str, dataset: str | None = None, task: str | None = None, source: str | None = None, limit: int | None = None) -> DataFrame:
    """Inference examples of one file, the first `limit` rows of it."""
    rows = read_jsonl(spark, path, EXAMPLE_JSON)
    rows = running(rows, ["path"], "ord", {"row_number": F.lit(1)})
    if limit is not None:
        rows = rows.where(F.col("row_number") <= limit)
    p = Path(path)
    own = F.coalesce(F.lit(source), F.nullif("source_dataset", F.lit("")), F.lit(dataset), F.lit(p.parent.name))
    kind = F.coalesce("answer_type", F.lit("text"))
    question = strip_space(F.coalesce("question", F.lit("")))
    checked = F.when(~kind.isin(*ANSWER_TYPES), F.raise_error(F.concat(F.lit("answer_type of row "), F.col("row_number").cast("string")))).when(
        question == "", F.raise_error(F.concat(F.lit("no question in row "), F.col("row_number").cast("string")))
    ).otherwise(kind)
    choices = F.when(F.startswith("choices", F.lit("[")), F.from_json("choices", "array<string>")).when(F.col("choices").isNotNull(), F.array("choices"))
    return rows.select(
        F.coalesce(F.nullif("id", F.lit("")), synthetic_id(own, F.lit(p.stem), F.col("row_number"))).alias("id"),
        F.coalesce(F.nullif("task", F.lit("")), F.lit(task), infer_task(kind, own, F.lit(str(p)))).alias("task"),
        question.alias("question"), choices.alias("choices"), strip_space(F.coalesce("gold_answer", F.lit(""))).alias("gold_answer"), checked.alias("answer_type"),
        own.alias("source_dataset"), F.lit(dataset).alias("dataset"), "row_number",
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Conditions of a report, from a list or an object with `conditions`; rates are left to be derived."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    rows = found if isinstance(found, list) else found.get("conditions", [])
    keep = "dataset model method prompt_style reasoning_language selection model_size_label".split()
    counts = "n total_examples select_correct pass_at_n_correct total_candidates total_tokens".split()
    data = [
        tuple([*[str(r.get(k) or "") for k in keep], *[int(r.get(k) or (1 if k == "n" else 0)) for k in counts], float(r.get("total_latency_s") or 0), float(r.get("total_estimated_cost") or 0), i])
        for i, r in enumerate(rows)
    ]
    schema = ", ".join([*[f"{k} string" for k in keep], "n int", *[f"{k} long" for k in counts[1:]], "total_latency_s double, total_estimated_cost double, ord long"])
    return spark.createDataFrame(data, schema)


def swapped_in(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """K6: writes beside the target and then takes its place, so a failed write leaves what was there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", ".new", ".old"))
    files = target.getFileSystem(conf)
    files.delete(fresh, True)
    write(str(fresh))
    if files.exists(target):
        files.delete(old, True)
        files.rename(target, old)
    files.rename(fresh, target)
    files.delete(old, True)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """K1: JSON lines with sorted keys and nulls kept."""
    swapped_in(rows.sparkSession, path, lambda to: rows.select(*sorted(rows.columns)).write.option("ignoreNullFields", "false").json(to))


def write_json(value: Any, path: str | Path) -> None:
    """A small report of the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")


def csv_ready(rows: DataFrame) -> DataFrame:
    """Lists joined by semicolons, booleans in lower case, nulls empty."""
    out = []
    for f in rows.schema:
        c = F.col(f.name)
        out.append((F.concat_ws(";", c.cast("array<string>")) if isinstance(f.dataType, T.ArrayType) else F.coalesce(c.cast("string"), F.lit(""))).alias(f.name))
    return rows.select(*out)


def write_csv(rows: DataFrame, path: str | Path) -> None:
    """K3, K4: one CSV file of a small aggregate; without rows an empty file."""
    found = csv_ready(rows).collect()
    quote = lambda t: '"' + t.replace('"', '""') + '"' if any(ch in t for ch in ',"\n') else t
    lines = [",".join(rows.columns), *(",".join(quote(x) for x in r) for r in found)] if found else []
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("".join(line + "\n" for line in lines), encoding="utf-8")


def write_splits(rows: DataFrame, path: str, column: str = "split") -> None:
    """One folder per value, in one pass; the folder itself reads as their union."""
    rows.write.mode("overwrite").partitionBy(column).json(path)
