import threading
import time

import pytest
from pyspark.sql import functions as F

from evalscale.plans import config as C
from evalscale.plans import sweep as S
from evalscale.plans.inflight import RequestTimeout, batches_in_order, in_flight, in_order


def test_order_is_kept_whatever_ends_first():
    def work(x):
        time.sleep(0.01 * (5 - x))
        return x * 10

    assert in_order([1, 2, 3, 4], work, 4) == ([10, 20, 30, 40], [])
    assert [i for i, _, _ in in_flight([1, 2, 3, 4], work, 4)] == [3, 2, 1, 0]
    assert in_order([1, 2, 3], lambda x: x + 1, 1) == ([2, 3, 4], []) and in_order([], work, 3) == ([], [])
    with pytest.raises(ValueError):
        list(in_flight([1], work, 0))


@pytest.mark.parametrize("width", [1, 3])
def test_a_failure_leaves_the_others(width):
    def work(x):
        if x == 2:
            raise RuntimeError("fail-2")
        return x * 10

    results, errors = in_order([1, 2, 3], work, width)
    assert results == [10, None, 30] and [(i, str(e)) for i, e in errors] == [(1, "fail-2")]


def test_no_more_calls_than_the_window_and_items_are_taken_late():
    lock, now, most, taken = threading.Lock(), [0], [0], []

    def work(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.005)
        with lock:
            now[0] -= 1
        return x

    source = (taken.append(i) or i for i in range(40))
    for k, _ in enumerate(in_flight(source, work, 4)):
        assert len(taken) <= k + 5
    assert most[0] == 4 and len(taken) == 40


def test_deadlines():
    hang = threading.Event()
    began = time.monotonic()
    results, errors = in_order(range(6), lambda x: hang.wait(20) if x == 1 else x, 2, 0.2)
    assert results == [0, None, 2, 3, 4, 5] and isinstance(errors[0][1], RequestTimeout) and time.monotonic() - began < 5
    # as many as the window hang: the rest is not sent
    results, errors = in_order(range(5), lambda x: hang.wait(20), 2, 0.1)
    assert results == [None] * 5 and ["not sent" in str(e) for _, e in errors] in ([False, False, True, True, True], [False, False, False, True, True])
    hang.set()


def test_the_window_stays_full_over_batches():
    batches = [[1, 2, 3], [], [4], [5, 6, 7, 8], []]
    got = [[r for r, _ in b] for b in batches_in_order(iter(batches), lambda x: time.sleep(0.03) or -x, 8)]
    assert got == [[-x for x in b] for b in batches]
    began = time.monotonic()
    assert len(list(batches_in_order(([i] for i in range(24)), lambda x: time.sleep(0.05), 8))) == 24
    assert time.monotonic() - began < 0.6


def sleeping():
    class Sleeping(S.EchoBackend):  # defined here, so that it travels by value
        def generate(self, system, user, temperature, max_tokens, seed, top_p):
            time.sleep(0.02 + 0.01 * (seed % 3))
            if "fail" in user:
                raise RuntimeError("refused")
            if "hang" in user:
                time.sleep(30)
            return super().generate(system, user, temperature, max_tokens, seed, top_p)

    return Sleeping


def prompts(spark, texts):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "example_id string, user string")
    return rows.coalesce(1).select("example_id", F.struct(F.lit("sys").alias("system"), F.col("user")).alias("prompt"))


def test_generation_in_a_task(spark):
    method = C.method({"name": "x", "prompt_style": "english_cot", "n": 4, "temperature": 0.7})
    rows = prompts(spark, [f"q{i}" for i in range(15)])
    run = lambda width: (time.monotonic(), [tuple(r) for r in S.generate(rows, sleeping(), 4, method, 1, 0.5, concurrent=width).select("example_id", "sample_index", "response", "token_count").collect()], time.monotonic())
    run(1)
    (a, serial, b), (c, wide, d) = run(1), run(10)
    assert serial == wide and len(wide) == 60 and (d - c) < (b - a) * 0.5
    mixed = prompts(spark, ["q", "fail", "hang", "r"])
    got = S.generate(mixed, sleeping(), 1, method, 1, continue_on_error=True, concurrent=3, timeout_s=0.5).orderBy("example_id").collect()
    assert [(r.error, bool(r.response)) for r in got] == [(None, True), ("refused", False), ("no answer after 0.5 s", False), (None, True)] and got[2].latency_s == 0.5
    with pytest.raises(Exception, match="refused"):
        S.generate(mixed, sleeping(), 1, method, 1, concurrent=3, timeout_s=0.5).collect()


def test_only_served_models_have_several_requests():
    row = {"datasets": [{"name": "d", "path": "p"}], "models": [{"name": "a"}, {"name": "b", "backend": "openai_compatible", "request_timeout_s": 5}], "methods": [{"name": "x", "prompt_style": "english_cot"}], "max_concurrent": 16}
    c = C.run_config(row)
    assert [c.requests_of(m) for m in c.models] == [(1, 120.0), (16, 5.0)]
