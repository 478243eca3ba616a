import random

import pytest

from evalscale.operators import merging

SCHEMA = "dataset string, model string, method string, n int, run_ids array<string>, ord long, total_examples long, select_correct long, selection string"


def plain(items):
    """Items (runs, examples, correct) folded one by one: decisions, and the places of those kept."""
    covered, sets, size, kept, decisions = set(), 0, 0, [], []
    for i, (runs, examples, _) in enumerate(items):
        own = set(runs) or {f"anonymous {i}"}
        if not sets:
            covered, sets, size, kept, what = own, 1, examples, [i], "first"
        elif not covered & own:
            covered, sets, kept, what = covered | own, sets + 1, [*kept, i], "added"
        elif own == covered and sets == 1 and examples > size:
            size, kept, what = examples, [i], "replaced"
        else:
            what = "covered" if own <= covered else "overlap"
        decisions.append(what)
    return decisions, kept


def table(spark, groups):
    rows = [(d, "m", "x", 4, runs, i, e, c, "" if i % 2 else f"s{i}") for d, items in groups.items() for i, (runs, e, c) in enumerate(items)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed, runs", [(1, 4), (2, 9), (3, 150)])
def test_against_a_plain_fold(spark, seed, runs):
    rng = random.Random(seed)
    some = lambda: rng.sample([f"run {k}" for k in range(runs)], rng.choice([0, 1, 1, 1, 2, min(3, runs), runs // 2]))
    groups = {f"d{g}": [(some() if rng.random() < 0.7 or k == 0 else None, rng.randint(0, 9), rng.randint(0, 5)) for k in range(rng.randint(1, 12))] for g in range(12)}
    for own in groups.values():  # repeat the first, larger and smaller
        own[1:1] = [(own[0][0], own[0][1] + rng.choice([-1, 0, 5]), 1)] * rng.randint(0, 2)
    groups = {d: [(r or [], e, c) for r, e, c in own] for d, own in groups.items()}
    decided = {(r.dataset, r.ord): (r.decision, r.kept) for r in merging.folded(table(spark, groups)).collect()}
    merged = {r.dataset: r for r in merging.merge_runs(table(spark, groups)).collect()}
    for d, own in groups.items():
        decisions, kept = plain(own)
        assert [decided[d, i] for i in range(len(own))] == [(x, i in kept) for i, x in enumerate(decisions)]
        want = [own[i] for i in kept]
        got = merged[d]
        assert (got.total_examples, got.select_correct, got.run_ids) == (sum(e for _, e, _ in want), sum(c for *_, c in want), sorted({r for rs, *_ in want for r in rs}))
        assert got.selection == next((f"s{i}" for i in kept if i % 2 == 0), None)


@pytest.mark.parametrize("items, want", [
    ([(["a", "b"], 30, 12), (["a"], 10, 4)], (30, ["a", "b"])),  # counted already
    ([(["a"], 10, 4), (["a", "b"], 30, 12)], (10, ["a"])),  # in part: left out
    ([(["a"], 5, 1), (["a"], 50, 20)], (50, ["a"])),
    ([(["a"], 5, 1), (["b"], 5, 1), (["a", "b"], 50, 20)], (10, ["a", "b"])),
    ([([], 5, 1), (None, 7, 2)], (12, [])),
])
def test_cases(spark, items, want):
    r = merging.merge_runs(table(spark, {"d": items})).first()
    assert (r.total_examples, r.run_ids) == want


def test_merged_tables_merge_again(spark):
    a, b = (merging.merge_runs(table(spark, {"d": own})).withColumn("ord", merging.F.lit(k)) for k, own in enumerate(([(["a"], 10, 1), (["b"], 20, 2)], [(["c"], 5, 3), (["a"], 9, 9)])))
    both = merging.merge_runs(a.unionByName(b)).first()
    assert (both.total_examples, both.run_ids) == (30, ["a", "b"])  # the second shares a run, so it is left out
    assert merging.merge_runs(table(spark, {})).count() == 0
