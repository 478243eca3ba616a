"""Planning and generation as DataFrames: units of work, sample pools, nested slices."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalscale.plans.config import ConfigError, Method
from evalscale.plans.inflight import RequestTimeout, batches_in_order, in_flight


@dataclass(frozen=True)
class Generation:
    response: str
    token_count: int | None
    latency_s: float
    finish_reason: str | None = None


class Backend(Protocol):
    """What generates text.  One is made per task by a factory that can be pickled."""

    def generate(self, system: str, user: str, temperature: float | None, max_tokens: int | None, seed: int | None, top_p: float | None) -> Generation: ...


class EchoBackend:
    """A deterministic stand-in for tests and dry runs: the answer is a digest of prompt and seed."""

    def generate(self, system, user, temperature, max_tokens, seed, top_p) -> Generation:
        key = f"{system}\0{user}\0{seed if temperature else 0}".encode()
        value = int.from_bytes(hashlib.sha1(key).digest()[:2], "big") % 20
        return Generation(f"Reasoning.\nFinal answer: {value}", 3 + value, value / 100, "stop")


def sample_seed(base: int | None, example_id: str, sample_index: int) -> int | None:
    """eight bytes of BLAKE2b over the parts, as a non-negative 31-bit number."""
    if base is None:
        return None
    digest = hashlib.blake2b("\0".join((str(base), example_id, str(sample_index))).encode(), digest_size=8)
    return int.from_bytes(digest.digest(), "big") & 0x7FFFFFFF


def seeds(base: int | None, example_id: Column, sample_index: Column) -> Column:
    if base is None:
        return F.lit(None).cast("long")

    @F.pandas_udf("long")
    def derive(ids: pd.Series, indices: pd.Series) -> pd.Series:
        return pd.Series([sample_seed(base, str(i), int(k)) for i, k in zip(ids, indices, strict=True)])

    return derive(example_id, sample_index)


def method_table(spark: SparkSession, methods: Sequence[Method]) -> DataFrame:
    rows = [(m.name, m.prompt_style, m.selection, m.n, m.temperature, m.max_tokens, m.top_p, m.reasoning_language, m.group, m.group_max_n) for m in methods]
    return spark.createDataFrame(
        rows, "method string, prompt_style string, selection string, n int, temperature double, max_tokens int, top_p double, reasoning_language string, nested_group_id string, nested_max_n int"
    )


def unit_key(kind: Column, dataset: Column, model: Column, method: Column, example_id: Column) -> Column:
    """F35"""
    return F.concat_ws("\t", kind, dataset, model, method, example_id)


def plan_units(examples: DataFrame, models: DataFrame, methods: DataFrame) -> DataFrame:
    """A unit per example, model and method of its own, or per example, model and nested group.

    Models and methods are configuration, of a handful of rows, so they are broadcast.
    """
    group = F.coalesce("nested_group_id", "method")
    kind = F.when(F.col("nested_group_id").isNull(), "standalone").otherwise("nested")
    work = methods.select(kind.alias("unit_type"), group.alias("unit_method")).distinct()
    every = examples.join(F.broadcast(models.select("model")), how="cross").join(F.broadcast(work), how="cross")
    return every.withColumn("key", unit_key(F.col("unit_type"), F.col("dataset"), F.col("model"), F.col("unit_method"), F.col("example_id")))


def pending(units: DataFrame, completed: DataFrame) -> DataFrame:
    """Planned units without the completed ones."""
    return units.join(completed.select("key").distinct(), "key", "left_anti")


def nested_slices(pool: DataFrame, methods: Sequence[Method], group: str, pool_n: int) -> DataFrame:
    """The first n samples of a pool for every method of a sweep, relabelled.

    Each pool row lists the methods that want it and is exploded, so the prefix
    join is a projection without a shuffle.
    """
    too_large = [m.name for m in methods if m.n > pool_n]
    if too_large:
        raise ConfigError(f"the pool of {pool_n} is too small for {', '.join(too_large)}")
    labels = ("method", "n", "selection", "prompt_style", "reasoning_language")
    table = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(labels, (m.name, m.n, m.selection, m.prompt_style, m.reasoning_language), strict=True)]) for m in methods])
    wanted = F.explode(F.filter(table, lambda m: m["n"] > F.col("sample_index")))
    rows = pool.drop(*labels).withColumn("__m", wanted)
    return rows.select("*", *[F.col(f"__m.{k}").alias(k) for k in labels]).drop("__m").withColumns({"nested": F.lit(True), "nested_group_id": F.lit(group), "nested_pool_n": F.lit(pool_n)})


GENERATED = "response string, token_count long, latency_s double, finish_reason string, error string"


def generate(
    prompts: DataFrame, make_backend: Callable[[], Backend], n: int, method: Method, base_seed: int | None, cost_per_1k: float = 0.0, continue_on_error: bool = False, concurrent: int = 1, timeout_s: float | None = None
) -> DataFrame:
    """N samples per prompt row (example_id, prompt struct), in Arrow batches with one backend per task.

    A task has up to `concurrent` requests in flight, each for `timeout_s` at most;
    rows keep their order.  A failed request becomes an empty response with its error;
    or, unless the run goes on after errors, fails the task once its batch has ended.
    """
    temperature, max_tokens, top_p = method.temperature, method.max_tokens, method.top_p
    samples = prompts.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    samples = samples.withColumn("sample_seed", seeds(base_seed, F.col("example_id"), F.col("sample_index")))

    @F.pandas_udf(GENERATED)
    def call(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        backend = make_backend()

        def ask(request: tuple[str, str, float | None]) -> tuple:
            system, user, seed = request
            began = time.monotonic()
            g = backend.generate(system, user, temperature, max_tokens, None if pd.isna(seed) else int(seed), top_p)
            tokens = g.token_count if g.token_count is not None else max(1, len(g.response.split()))
            return g.response, tokens, g.latency_s or time.monotonic() - began, g.finish_reason, None

        requests = (list(zip(*batch, strict=True)) for batch in batches)
        for ended in batches_in_order(requests, ask, concurrent, timeout_s):
            failed = [e for _, e in ended if e is not None]
            if failed and not continue_on_error:
                raise failed[0]
            rows = [got if e is None else ("", 0, timeout_s if isinstance(e, RequestTimeout) else 0.0, None, str(e)) for got, e in ended]
            yield pd.DataFrame(rows, columns=["response", "token_count", "latency_s", "finish_reason", "error"])

    made = samples.withColumn("__g", call(F.col("prompt.system"), F.col("prompt.user"), F.col("sample_seed")))
    cost = F.col("token_count") / 1000.0 * cost_per_1k
    return made.select("*", "__g.*").drop("__g").withColumn("estimated_cost", cost)


def unit_sampler(make_backend: Callable[[], Backend], n: int, method: Method, base_seed: int | None, cost_per_1k: float, continue_on_error: bool, concurrent: int, timeout_s: float | None):
    """A function from batches of prompt rows to a batch for each unit, its n samples, as units end.

    The window of requests is that of `generate`.  After a failure that the run does not
    go on after, no more requests are made; those in flight end, whole units come out,
    and then it is raised.
    """
    temperature, max_tokens, top_p = method.temperature, method.max_tokens, method.top_p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend, rows, samples, failed = make_backend(), {}, {}, []

        def requests() -> Iterator[tuple[dict, int | None]]:
            unit = 0
            for batch in batches:
                for i in range(batch.num_rows):
                    rows[unit], samples[unit] = batch.slice(i, 1), []
                    prompt, example = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("prompt", "example_id"))
                    for k in range(n):
                        if failed:
                            return
                        yield prompt, sample_seed(base_seed, str(example), k)
                    unit += 1

        def ask(request: tuple[dict, int | None]) -> tuple:
            prompt, seed = request
            began = time.monotonic()
            g = backend.generate(prompt["system"], prompt["user"], temperature, max_tokens, seed, top_p)
            tokens = g.token_count if g.token_count is not None else max(1, len(g.response.split()))
            return seed, g.response, tokens, g.latency_s or time.monotonic() - began, g.finish_reason, None

        for place, got, error in in_flight(requests(), ask, concurrent, timeout_s):
            unit, k = divmod(place, n)
            if error is not None and not continue_on_error:
                failed.append((place, error))
                continue
            if error is not None:
                example = rows[unit].column(rows[unit].schema.get_field_index("example_id"))[0].as_py()
                got = sample_seed(base_seed, str(example), k), "", 0, timeout_s if isinstance(error, RequestTimeout) else 0.0, None, str(error)
            samples[unit].append((k, *got))
            if len(samples[unit]) == n:
                index, seed, response, tokens, latency, reason, fault = zip(*sorted(samples.pop(unit), key=lambda x: x[0]), strict=True)
                row = rows.pop(unit).take(pa.array([0] * n)).drop_columns(["prompt"])
                made = {
                    "sample_index": pa.array(index, pa.int32()), "sample_seed": pa.array(seed, pa.int64()), "response": pa.array(response, pa.string()), "token_count": pa.array(tokens, pa.int64()), "latency_s": pa.array(latency, pa.float64()),
                    "finish_reason": pa.array(reason, pa.string()), "error": pa.array(fault, pa.string()), "estimated_cost": pa.array([t / 1000.0 * cost_per_1k for t in tokens], pa.float64()),
                }
                yield pa.RecordBatch.from_arrays([*row.columns, *made.values()], names=[*row.schema.names, *made])
        if failed:
            raise min(failed, key=lambda x: x[0])[1]

    return run
