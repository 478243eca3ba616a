import pickle
import subprocess
import sys
from pathlib import Path

import numpy as np

from evalscale.llm.common import packed_longs
from evalscale.llm.text import Lookup


def test_packed_values_are_the_column(spark):
    df = spark.range(-5, 100_000, 1, 7).selectExpr("id * 92233720368547 as h", "'x' as other")
    got = packed_longs(df, "h")
    assert sorted(got.view(np.int64).tolist()) == [i * 92233720368547 for i in range(-5, 100_000)]
    assert len(packed_longs(df.limit(0), "h")) == 0


def test_a_lookup_travels_as_its_values():
    values = np.random.default_rng(1).integers(0, 1 << 64, 300_000, np.uint64)
    sent = pickle.dumps(Lookup(values))
    assert len(sent) < 9 * len(values)
    again = pickle.loads(sent)
    at, index = again.find(np.concatenate([values[:100], values[:100] + np.uint64(1)]))
    assert np.array_equal(again.values[index], np.concatenate([values[:100], values[:100] + np.uint64(1)])[at]) and len(at) >= 100


def test_four_million_hashes_take_the_driver_little_memory():
    script = """
import resource
from pyspark.sql import SparkSession
from evalscale.llm.common import packed_longs
from evalscale.llm.text import Lookup
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
held = Lookup(packed_longs(spark.range(0, 1 << 22, 1, 8).selectExpr("xxhash64(id) as h"), "h"))
shown = spark.sparkContext.broadcast(held)
print("PEAK", len(held.values), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=300)
    n, peak = map(int, done.stdout.split("PEAK")[1].split()[:2])
    assert n == 1 << 22 and peak < 300, peak
