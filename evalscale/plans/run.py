"""A whole sampling run on Spark: examples, prompts, pending units, generation, selection, resumable output.

A run folder may be on any file system that Spark knows.  It has

    log/         samples of units as they were made (see `sources.unitlog`), until they are published
    candidates/, selections/, units/, stripped/
                 Parquet by attempt: published rows, which units they are of, and which earlier units they replace
    attempts/    a file for each attempt whose tables are whole; others are not read
    manifest.json

What a job finished before it was lost is in the log and is not made again; what was
written of an attempt that was not finished is never read, and is written anew from
the log.  A unit is done if all methods that its sweep has now are among those that
it was made for; else it is made again, and its earlier rows are void.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evalscale.functions import prompts as P
from evalscale.functions import text as X
from evalscale.operators.reselect import reselect
from evalscale.operators.resume import row_unit
from evalscale.plans import config as C
from evalscale.plans import sweep as S
from evalscale.sources import folders, logs, unitlog

#: Units that a task finishes before it writes them down, if they take less than a few seconds.
SEGMENT_UNITS = 100


def examples_of(spark: SparkSession, c: C.RunConfig, names: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    out = None
    for d in C.named(c.datasets, names):
        own = logs.read_examples(spark, d.path, d.name, d.task, d.source_dataset, limit if limit is not None else d.limit).withColumnRenamed("id", "example_id")
        out = own if out is None else out.unionByName(own)
    return out


def answered(rows: DataFrame, model: C.Model, run_id: str) -> DataFrame:
    """Logged samples with their answers and what names their model and run."""
    answer = X.extract_answer(F.col("response"), F.col("answer_type"), F.col("choices"))
    labels = {"extracted_answer": answer, "model": F.lit(model.name), "model_size_label": F.lit(model.size_label), "run_id": F.lit(run_id), "backend": F.lit(model.backend)}
    return rows.withColumns(labels)


def labelled(rows: DataFrame, m: C.Method) -> DataFrame:
    own = {"method": m.name, "n": m.n, "selection": m.selection, "prompt_style": m.prompt_style, "reasoning_language": m.reasoning_language}
    return rows.withColumns({k: F.lit(v) for k, v in own.items()} | {"nested": F.lit(False), "nested_group_id": F.lit(None).cast("string"), "nested_pool_n": F.lit(None).cast("int")})


def run(
    spark: SparkSession,
    c: C.RunConfig,
    make_backend: Callable[[C.Model], Callable[[], S.Backend]],
    exemplars: Mapping[str, Sequence[P.Exemplar]] | None = None,
    datasets: Sequence[str] | None = None,
    models: Sequence[str] | None = None,
    methods: Sequence[str] | None = None,
    limit: int | None = None,
    resume: bool = True,
    overwrite: bool = False,
    segment_units: int = SEGMENT_UNITS,
) -> dict:
    """Runs what is pending and returns the manifest.  Overwriting, or not resuming, drops all earlier output."""
    base = f"{c.output_dir}/{c.run_id}"
    if overwrite or not resume:
        folders.remove(spark, base)
    alone, groups = C.partition_methods(C.named(c.methods, methods))
    examples = examples_of(spark, c, datasets, limit)
    totals = dict.fromkeys(("units_completed", "units_skipped", "generations", "candidate_rows", "selection_rows"), 0) | {"latency_s": 0.0}
    planned = examples.count()
    for model in C.named(c.models, models):
        factory = make_backend(model)
        for kind, name, own in [*(("standalone", m.name, [m]) for m in alone), *(("nested", g, ms) for g, ms in groups.items())]:
            keyed = examples.withColumn("key", S.unit_key(F.lit(kind), F.col("dataset"), F.lit(model.name), F.lit(name), F.col("example_id")))
            units = published_units(spark, base)
            todo = keyed if units is None else S.pending(keyed, complete_units(units, [m.name for m in own]))
            n = todo.count()
            totals["units_skipped"] += planned - n
            if n:
                log = f"{base}/log/{hashlib.sha1(chr(0).join((model.name, kind, name)).encode()).hexdigest()[:16]}"
                for arm, method, samples in arms_of(own, kind):
                    generate_units(todo, log, arm, method, samples, factory, model, c, exemplars or {}, segment_units)
                for k, v in publish(spark, base, log, todo, model, kind, name, own, c.run_id, units).items():
                    totals[k] += v
    manifest = {"run_id": c.run_id, **totals, "seed": c.seed, "methods": [m.name for m in c.methods], "models": [m.name for m in c.models]}
    folders.write_text(spark, f"{base}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
    return manifest


def arms_of(methods: Sequence[C.Method], kind: str) -> list[tuple[str, C.Method, int]]:
    """What a unit samples: one pool for all of a sweep's methods, and a greedy one beside it if the sweep has that arm."""
    if kind == "standalone":
        return [("pool", methods[0], methods[0].n)]
    greedy, rest = C.split_group(methods)
    pool = [C.pool_method(rest, max(m.n for m in rest))] if rest else []
    return [*(("greedy", m, 1) for m in greedy[:1]), *(("pool", m, m.n) for m in pool)]


def generate_units(todo: DataFrame, log: str, arm: str, method: C.Method, n: int, factory, model: C.Model, c: C.RunConfig, exemplars, segment_units: int) -> None:
    """Samples what the log does not have yet and logs each unit soon after it ended."""
    spark = todo.sparkSession
    rows = todo.withColumn(unitlog.KEY, F.concat_ws("\t", "key", F.lit(f"{arm} {n}")))
    if folders.listing(spark, log):
        rows = rows.join(unitlog.logged_keys(spark, log), unitlog.KEY, "left_anti")
    # requests wait for servers, so all cores get their share of what is left
    rows = rows.repartition(spark.sparkContext.defaultParallelism)
    prompt = P.render(method.prompt_style, exemplars, F.col("task"), F.col("source_dataset"), F.col("question"), F.col("choices"), F.col("answer_type"))
    rows = rows.withColumns({"prompt": prompt, "arm": F.lit(arm)}).drop("question")
    through = S.unit_sampler(factory, n, method, c.seed, model.cost_per_1k_tokens, c.continue_on_error, *c.requests_of(model))
    unitlog.append(rows, log, segment_units, through=through)


def publish(spark: SparkSession, base: str, log: str, todo: DataFrame, model: C.Model, kind: str, name: str, methods: Sequence[C.Method], run_id: str, units: DataFrame | None) -> dict:
    """Candidates, selections and units of the logged units that are to do and have all arms, as one attempt; returns their totals."""
    arms = [f"{arm} {n}" for arm, _, n in arms_of(methods, kind)]
    rows = unitlog.logged_rows(spark, log).join(todo.select("key").distinct(), "key", "left_semi")
    wanted = [F.endswith(F.col(unitlog.KEY), F.lit(f"\t{a}")) for a in arms]
    rows = rows.where(F.array_contains(F.array(*wanted), True))  # the log may have pools of another size
    if len(arms) > 1:
        whole = rows.groupBy("key").agg(F.countDistinct(unitlog.KEY).alias("arms")).where(F.col("arms") == len(arms))
        rows = rows.join(whole.select("key"), "key", "left_semi")
    pool = answered(rows.drop(unitlog.KEY), model, run_id)
    attempt = next_attempt(spark, base)
    at = lambda table: f"{base}/{table}/attempt={attempt}"
    made, cut, chosen = (Observation() for _ in range(3))
    costs = unit_costs(pool, ["key"]).withColumn("methods", F.array(*[F.lit(m.name) for m in methods]))
    costs = costs.observe(made, F.count(F.lit(1)).alias("units"), F.coalesce(F.sum("generations"), F.lit(0)).alias("generations"), F.coalesce(F.sum("latency_s"), F.lit(0.0)).alias("latency_s"))
    costs.write.parquet(at("units"))
    if units is not None:
        again = units.join(spark.read.parquet(at("units")).select("key"), "key", "left_semi").select("key").distinct()
        again.write.parquet(at("stripped"))
    slices = slices_of(pool.drop("key"), methods, name, kind).withColumn("ord", F.monotonically_increasing_id())
    slices.observe(cut, F.count(F.lit(1)).alias("rows")).write.parquet(at("candidates"))
    candidates, selected = spark.read.parquet(at("candidates")), None
    for strategy in sorted({m.selection for m in methods}):
        part = reselect(candidates.where(F.col("selection") == strategy), [strategy], dedupe=False)
        selected = part if selected is None else selected.unionByName(part)
    tags = {"run_id": F.lit(run_id), "nested": F.lit(kind == "nested"), "nested_group_id": F.lit(name if kind == "nested" else None).cast("string"), "ord": F.monotonically_increasing_id()}
    selected.withColumns(tags).observe(chosen, F.count(F.lit(1)).alias("rows")).write.parquet(at("selections"))
    found = {"units_completed": made.get["units"], "generations": made.get["generations"], "latency_s": made.get["latency_s"], "candidate_rows": cut.get["rows"], "selection_rows": chosen.get["rows"]}
    folders.write_text(spark, f"{base}/attempts/{attempt}.json", json.dumps(found | {"model": model.name, "kind": kind, "name": name}))
    folders.remove(spark, log)
    return found


def attempts(spark: SparkSession, base: str) -> list[int]:
    """The attempts whose tables are whole, oldest first."""
    names = [e.name.removesuffix(".json") for e in folders.listing(spark, f"{base}/attempts")]
    return sorted(int(n) for n in names if n.isdigit())


def next_attempt(spark: SparkSession, base: str) -> int:
    return max([int(time.time() * 1000), *(n + 1 for n in attempts(spark, base))])


def _published(spark: SparkSession, base: str, table: str) -> DataFrame | None:
    """A table's rows of whole attempts; None if there are none."""
    own = [f"{base}/{table}/attempt={n}" for n in attempts(spark, base)]
    own = [p for p in own if folders.exists(spark, p)]
    return spark.read.option("basePath", f"{base}/{table}").parquet(*own).withColumn("attempt", F.col("attempt").cast("long")) if own else None


def published_units(spark: SparkSession, base: str) -> DataFrame | None:
    """(key, methods) of each unit as it was made last."""
    rows = _published(spark, base, "units")
    return None if rows is None else rows.groupBy("key").agg(F.max_by("methods", "attempt").alias("methods"))


def complete_units(units: DataFrame, expected: Sequence[str]) -> DataFrame:
    """The keys of units that were made for all the methods expected now."""
    return units.where(F.size(F.array_except(F.array(*[F.lit(m) for m in expected]), F.col("methods"))) == 0).select("key")


def read_run(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Candidates and selections of a run folder, without those of units that were made again later; later attempts come later in append order."""
    out = []
    void = _published(spark, str(base), "stripped")
    for name in ("candidates", "selections"):
        rows = _published(spark, str(base), name)
        if rows is None:
            raise FileNotFoundError(f"{base} has no attempt that was finished")
        if void is not None:
            newest = void.groupBy(F.col("key").alias("__key")).agg(F.max("attempt").alias("__void"))
            rows = rows.withColumn("__unit", row_unit(rows)).join(newest, (F.col("__unit") == F.col("__key")) & (F.col("attempt") < F.col("__void")), "left_anti").drop("__unit")
        out.append(rows.withColumn("ord", F.struct("attempt", "ord")).drop("attempt"))
    return out[0], out[1]


def unit_costs(pool: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What each unit generated, how many tokens and how long: of samples really made, not of the rows cut from them."""
    return pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("generations"), F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"), F.sum(F.coalesce("latency_s", F.lit(0.0)).cast("decimal(18,6)")).cast("double").alias("latency_s"))


def slices_of(pool: DataFrame, methods: Sequence[C.Method], group: str, kind: str) -> DataFrame:
    if kind == "standalone":
        return labelled(pool.drop("arm"), methods[0])
    greedy, rest = C.split_group(methods)
    parts = [S.nested_slices(pool.where("arm = 'greedy'").drop("arm"), greedy, group, 1)] if greedy else []
    if rest:
        parts.append(S.nested_slices(pool.where("arm = 'pool'").drop("arm"), rest, group, max(m.n for m in rest)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
