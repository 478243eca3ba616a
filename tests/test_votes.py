import random

import pytest
from pyspark.sql import functions as F

from evalscale.operators import reselect, scaling, select
from evalscale.operators.metrics import pass_per_example

KEYS = ["dataset", "model", "method", "n", "example_id"]
ROW = "example_id string, sample_index int, extracted_answer string, answer_type string, gold_answer string"


def table(spark, rows):
    return spark.createDataFrame(rows, ROW).withColumns({"dataset": F.lit("d"), "model": F.lit("m"), "method": F.lit("x"), "n": F.lit(4), "pos": F.col("sample_index"), "ord": F.col("sample_index")})


def test_the_group_has_one_type(spark):
    """Of 12 (a number), 11 and 11.0 (of no type) the two last are one answer."""
    rows = table(spark, [("e", 0, "12", "number", "11"), ("e", 1, "11", None, "11"), ("e", 2, "11.0", "", "11"), ("f", 0, "11", None, "11"), ("f", 1, "11.0", None, "11"), ("f", 2, "11.0", "text", "11")])
    got = {r.example_id: r for r in reselect.reselect(rows, ["majority_vote"], dedupe=False).collect()}
    assert (got["e"].selected_answer, got["e"].vote_counts, got["e"].is_correct, got["e"].candidate_count) == ("11", {"num:11": 2, "num:12": 1}, True, 3)
    assert (got["f"].selected_answer, got["f"].vote_counts, got["f"].is_correct) == ("11.0", {"11": 1, "110": 2}, False)


def test_the_first_sample_of_a_key_decides_the_match(spark):
    rows = [("a", 0, "None", "number", "none"), ("a", 1, "none", "number", "none"), ("b", 0, "1000000000.4", "number", "1000000000"), ("b", 1, "1000000000", "number", "1000000000")]
    found = scaling.pooled_conditions(table(spark, rows), (2,)).first()
    assert (found.total_examples, found.select_correct, found.pass_at_n_correct) == (2, 0, 2)


ANSWERS = [None, "", " ", "11", "11.0", "11.", "1,100", "None", "none", "NONE.", "A. x", "x", "1000000000", "1000000000.4", "nan", "é", "é", "-0", "0"]


@pytest.mark.parametrize("seed", range(3))
def test_one_pass_equals_cutting_selecting_and_joining(spark, seed):
    rng = random.Random(seed)
    rows = []
    for e in range(40):
        own = rng.sample(ANSWERS, rng.randint(1, 6))
        kinds = rng.choice([["number"], ["text", None], [None], ["", "number"], [None, "number", "choice"]])
        rows += [(f"e{e}", i, rng.choice(own), rng.choice(kinds), rng.choice(own[:2]) if rng.random() < 0.3 else own[0]) for i in range(rng.randint(1, 8))]
    pool = table(spark, rows).cache()
    sizes = (1, 2, 4, 8)
    cut = pool.drop("n").withColumn("n", F.explode(F.array(*[F.lit(n) for n in sizes]))).where("sample_index < n").cache()
    chosen = reselect.reselect(cut, ["majority_vote"], dedupe=False)
    selected = {r.n: (r.t, r.c) for r in chosen.groupBy("n").agg(F.count(F.lit(1)).alias("t"), F.count_if("is_correct").alias("c")).collect()}
    passed = {r.n: r.c for r in pass_per_example(cut, KEYS).groupBy("n").agg(F.count_if("passed").alias("c")).collect()}
    got = {r.n: r for r in scaling.pooled_conditions(pool, sizes, totals=False).collect()}
    assert {n: (r.total_examples, r.select_correct) for n, r in got.items()} == selected and {n: r.pass_at_n_correct for n, r in got.items()} == passed
    # the type of a group against its definition, and every vote counted once
    kinds = {tuple(r[k] for k in KEYS): r.answer_type for r in select.group_type(cut, KEYS).collect()}
    by_group = {}
    for r in cut.collect():
        by_group.setdefault(tuple(r[k] for k in KEYS), []).append(r)
    assert kinds == {k: next((r.answer_type for r in sorted(own, key=lambda r: r.pos) if r.answer_type), None) for k, own in by_group.items()}
    for r in chosen.collect():
        own = by_group[tuple(r[k] for k in KEYS)]
        assert sum(r.vote_counts.values()) == r.candidate_count == len(own)
        assert r.selected_answer == (next(x for x in own if x.pos == r.selected_sample_index).extracted_answer or "")
