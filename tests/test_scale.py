"""What must not depend on how data is cut: running totals, pooled conditions, line numbers, segments, swaps."""

import random

import pytest
from pyspark.sql import functions as F

from evalscale.operators import metrics, numbering, reselect, scaling
from evalscale.plans import config as C
from evalscale.plans import run as runs
from evalscale.plans import sweep as S
from evalscale.schemas import EXAMPLE, EXAMPLE_JSON
from evalscale.sources import logs


@pytest.mark.parametrize("width", [1, 3, 1 << 16])
def test_running_totals(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(-20, 40), rng.randrange(5)) for _ in range(300)]
    got = numbering.running(spark.createDataFrame(rows, "g string, at long, v long"), ["g"], "at", {"total": F.col("v"), "n": F.lit(1)}, width).collect()
    want = [(g, at, v, sum(x for k, a, x in rows if k == g and a <= at), sum(k == g and a <= at for k, a, _ in rows)) for g, at, v in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_pooled_conditions_are_those_of_slices_and_selections(spark):
    rng, sizes = random.Random(1), (1, 3, 8)
    answers = ["1", "1.0", "2", "", "two", "Two!"]
    pool = [
        (d, m, e, i, rng.choice(answers), gold, kind, rng.randrange(50), round(rng.random(), 3), round(rng.random(), 4))
        for d in "xy" for m in "pq" for e in range(6) for gold, kind in [rng.choice([("1", "number"), ("two", "text"), ("", "text")])] for i in range(rng.randint(1, 8))
    ]
    pool = spark.createDataFrame(pool, "dataset string, model string, example_id long, sample_index int, extracted_answer string, gold_answer string, answer_type string, token_count long, latency_s double, estimated_cost double")
    pooled = scaling.pooled_conditions(pool, sizes, totals=True)
    labels = {x: F.lit("l") for x in ("model_size_label", "prompt_style", "reasoning_language", "selection")} | {"run_id": F.lit("r"), "ord": F.monotonically_increasing_id()}
    wanted = F.explode(F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n > F.col("sample_index")))
    candidates = pool.withColumn("n", wanted).withColumns({"method": F.concat(F.lit("m"), F.col("n")), **labels})
    chosen = reselect.reselect(candidates, ["majority_vote"]).withColumns(labels)
    whole = metrics.conditions(candidates, chosen)
    columns = ["dataset", "model", "n", "total_examples", "select_correct", "pass_at_n_correct", "total_candidates", "total_tokens"]
    both = [sorted(tuple(r) for r in t.select(*columns, F.round("total_latency_s", 6), F.round("total_estimated_cost", 6)).collect()) for t in (pooled, whole)]
    assert both[0] == both[1] and len(both[0]) == 12
    assert "example_id" in EXAMPLE and scaling.pooled_conditions(pool.limit(0), sizes).count() == 0


def test_lines_of_parts_of_files_keep_their_order_in_one_scan(spark, tmp_path):
    rng = random.Random(2)
    files = {f"f{k}.jsonl": ["" if rng.random() < 0.1 else "é" * rng.randint(1, 90) for _ in range(n)] for k, n in enumerate([1, 700, 1500])}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = logs.numbered_lines(spark, [str(tmp_path / n) for n in files])
        rows = found.collect()
        assert len({(r.path, r.ord) for r in rows}) == len(rows)
        got = [(p, t) for p, _, t in sorted((r.path.rsplit("/", 1)[1], r.ord, r.text) for r in rows)]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Exchange" not in plan
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(name, t) for name, lines in files.items() for t in lines if t]


def test_compressed_lines_and_faulty_ones(spark, tmp_path):
    import gzip

    (tmp_path / "a.jsonl.gz").write_bytes(gzip.compress(b'{"x": 1}\n\n{"x": 2}\n'))
    assert [(r.text, int(r.ord)) for r in logs.numbered_lines(spark, [str(tmp_path / "a.jsonl.gz")]).orderBy("ord").collect()] == [('{"x": 1}', 0), ('{"x": 2}', 2)]
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\n' * 400 + '{"id": \n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        with pytest.raises(Exception, match=r"b.jsonl, line \d+ of the task that reads from byte 3000"):
            logs.read_jsonl(spark, str(tmp_path / "b.jsonl"), EXAMPLE_JSON).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_failed_write_leaves_the_old_output(spark, tmp_path):
    path = str(tmp_path / "out")
    logs.write_jsonl(spark.createDataFrame([(1,)], "a int"), path)
    logs.write_jsonl(spark.createDataFrame([(2,)], "a int"), path)
    with pytest.raises(Exception, match="broken"):
        logs.write_jsonl(spark.createDataFrame([(3,)], "a int").withColumn("a", F.raise_error(F.lit("broken")).cast("int")), path)
    assert [r.a for r in spark.read.json(path).collect()] == [2]


def test_runs_in_segments(spark, tmp_path):
    (tmp_path / "test.jsonl").write_text("".join(f'{{"question": "{i}+{i}?", "gold_answer": "{2 * i}", "answer_type": "number"}}\n' for i in range(7)))
    row = {
        "run_id": "r", "output_dir": str(tmp_path / "runs"), "seed": 3, "datasets": [{"name": "d", "path": str(tmp_path / "test.jsonl")}], "models": [{"name": "m"}],
        "methods": [{"name": "bon", "prompt_style": "english_cot", "selection": "majority_vote", "n_values": [1, 4], "temperature": 0.7, "nested_n": True}],
    }
    found = runs.run(spark, C.run_config(row), lambda model: S.EchoBackend, segment_units=3)
    assert {k: found[k] for k in ("units_completed", "units_skipped", "generations", "candidate_rows", "selection_rows")} == {
        "units_completed": 7, "units_skipped": 0, "generations": 7 * 5, "candidate_rows": 7 * 5, "selection_rows": 7 * 2,
    }
    candidates, selections = runs.read_run(spark, tmp_path / "runs" / "r")
    assert (candidates.count(), selections.count()) == (35, 14) and found["latency_s"] > 0
    units = spark.read.parquet(f"{tmp_path}/runs/r/units")
    assert units.count() == 7 and {r.generations for r in units.collect()} == {5}
    assert runs.run(spark, C.run_config(row), lambda model: S.EchoBackend, segment_units=3)["units_skipped"] == 7


def test_ranges_follow_the_rows_not_the_values(spark):
    """Values far apart, and all but one row in one spot: ranges stay few and even."""
    sparse = spark.range(0, 5000).selectExpr("id % 3 as g", "id * 1000000007 as at", "1 as v")
    bounds = numbering.range_bounds(sparse, "at", 100)
    assert 45 <= len(bounds) <= 50
    sizes = [r["count"] for r in sparse.groupBy(numbering.range_of(F.col("at"), bounds)).count().collect()]
    assert max(sizes) <= 130 and sum(sizes) == 5000
    got = {(r.g, r.at): r.n for r in numbering.running(sparse, ["g"], "at", {"n": F.lit(1)}, 100).collect()}
    assert got == {(i % 3, i * 1000000007): i // 3 + 1 for i in range(5000)}
    assert 900 < len(numbering.range_bounds(spark.range(0, 4000), "id", 1)) < numbering.RANGES  # no more than so many
    few = spark.createDataFrame([(x,) for x in (5, 5, 5, 9)], "x long")
    assert [r[0] for r in few.select(numbering.range_of(F.col("x"), [1, 5, 7])).collect()] == [1, 1, 1, 3]
    assert numbering.range_bounds(few.limit(0), "x", 1) == []
