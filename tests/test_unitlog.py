import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalscale.plans import config as C
from evalscale.plans import sweep as S
from evalscale.sources import unitlog


def rows(spark, units, each=3, parts=2):
    n = units * each
    return spark.range(0, n, 1, 1).select(F.concat(F.lit("u"), F.floor(F.col("id") / each)).alias("log_key"), "id").repartitionByRange(parts, "id").sortWithinPartitions("id")


def test_segments_hold_whole_units_and_the_newest_counts(spark, tmp_path):
    path = f"{tmp_path}/log"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        unitlog.append(rows(spark, 40, parts=1), path, units=4, seconds=60)
        sizes = [r["count"] for r in spark.read.parquet(path).groupBy("log_key", F.col("_metadata.file_name")).count().collect()]
        assert sizes == [3] * 40 and 8 <= len(os.listdir(path)) <= 10
        open(f"{path}/_torn.open", "w").close()  # what a lost task left behind
        unitlog.append(rows(spark, 10, parts=1).withColumn("id", -F.col("id")), path, units=100, seconds=60)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert unitlog.logged_keys(spark, path).count() == 40
    assert sorted(r.id for r in unitlog.logged_rows(spark, path).collect()) == sorted([-i for i in range(30)] + list(range(30, 120)))


def test_the_open_unit_is_cut_off():
    batches = [pa.RecordBatch.from_pydict({"log_key": list(k), "i": list(range(len(k)))}) for k in ("aab", "bb", "b")]
    tail, whole = unitlog._open_unit(batches, "b")
    assert [t.num_rows for t in tail] == [1, 2, 1] and [w.to_pydict()["log_key"] for w in whole] == [["a", "a"]]
    assert unitlog._open_unit(batches[1:], "b")[1] == []


METHOD = C.method({"name": "x", "prompt_style": "english_cot", "n": 3, "temperature": 0.7})


def batch(texts):
    return pa.RecordBatch.from_pylist([{"example_id": f"e{i}", "prompt": {"system": "s", "user": t}, "log_key": f"k{i}", "extra": i} for i, t in enumerate(texts)])


class Backend(S.EchoBackend):
    def generate(self, system, user, *rest):
        if user == "fail":
            raise RuntimeError("refused")
        return super().generate(system, user, *rest)


@pytest.mark.parametrize("width", [1, 5])
def test_units_come_out_as_they_end(width):
    run = lambda texts, go_on: S.unit_sampler(Backend, 3, METHOD, 7, 1.0, go_on, width, None)(iter([batch(texts[:2]), batch(texts[2:])]))
    out = list(run(["a", "b", "c", "fail"], True))
    assert len(out) == 4 and all(b.num_rows == 3 and b.column("sample_index").to_pylist() == [0, 1, 2] and len(set(b.column("log_key").to_pylist())) == 1 for b in out)
    by = {(b.column("log_key")[0].as_py(), b.column("extra")[0].as_py(), b.column("error")[0].as_py()): b.column("sample_seed").to_pylist() for b in out}
    assert by["k0", 0, None] == [S.sample_seed(7, "e0", k) for k in range(3)] and ("k1", 1, "refused") in by
    got = []
    with pytest.raises(RuntimeError, match="refused"):
        for b in run(["a", "b", "fail", "c"], False):
            got.append(b.column("extra")[0].as_py())
    assert got == [0, 1]  # what ended before is there
