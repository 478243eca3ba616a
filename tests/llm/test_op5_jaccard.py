import random
from collections import Counter

import numpy as np
import pytest

from evalscale.llm.graph import components
from evalscale.llm.op5_jaccard import jaccard_components, join_regions, region_links, regions_of, shipped

SCHEMA = "doc_id long, text string, fp string, lang string"


def shingles(text, k=5):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def near_copies(seed, groups=6, size=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows, passage = [], [word() for _ in range(25)]
    for g in range(groups):
        base = [word() for _ in range(rng.randint(8, 90))] + (passage if g % 2 else [])
        for _ in range(size if g else 4 * size):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(words))
                words[i : i + rng.randint(0, 1)] = [word() for _ in range(rng.randint(0, 2))]
            rows.append(" ".join(words))
    rows += [None, "", " \n ", "one", "ONE", "two words", "two  words", "x " * 3000, rows[0], rows[0]]
    rng.shuffle(rows)
    return list(enumerate(rows))


def run(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, "clash", None) for d, t in rows], SCHEMA)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, **options).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = near_copies(seed)
    assert run(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("cap, cap_bytes, least", [(6, 1 << 20, 2), (10, 1 << 20, 1000), (1000, 4000, 2)])
def test_regions_beyond_a_task_are_split(spark, cap, cap_bytes, least):
    rows = near_copies(5, groups=3, size=14)
    assert run(spark, rows, cap=cap, cap_bytes=cap_bytes, least=least) == brute_force(rows)


def loosely_alike(seed, n=240):
    """Texts that share a notice and most sentences of their subject: alike, but most are no near copies."""
    rng = random.Random(seed)
    sentence = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(9))
    notice, subjects = " ".join(sentence() for _ in range(4)), [[sentence() for _ in range(10)] for _ in range(6)]
    texts = [" ".join([notice, *rng.sample(subjects[i % 6], 8), *(sentence() for _ in range(rng.randint(1, 3)))]) for i in range(n)]
    return list(enumerate([*texts, *(t.rsplit(" ", 2)[0] for t in texts[:20])]))


def test_cells_and_windows_are_made_on_a_plain_corpus(spark):
    """Every region goes through pivots; those that are no near copies go through cells, with copies in their windows."""
    rows = loosely_alike(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    regions, trace = {}, Counter()
    for r in shipped(docs, regions_of(docs), 5).collect():
        regions.setdefault(r.region, []).append((r.fp, np.frombuffer(bytes(r.tokens), np.uint64)))
    for name, held in regions.items():
        names, sets = zip(*sorted(held, key=lambda x: x[0]), strict=True)
        region_links(names, sets, np.ones(len(held), bool), 80, centre=name, trace=trace)
    every = sum(len(h) * (len(h) - 1) // 2 for h in regions.values())
    assert trace["regions"] > 100 and trace["cells"] > 100 and trace["copies"] > 100 and trace["pairs"] < every / 2
    assert run(spark, rows) == brute_force(rows)


def hubs(seed, linked=2, size=40, n=200):
    """Hubs, each linked with the one before and with variants that are linked with it alone."""
    rng = np.random.default_rng(seed)
    fresh = lambda k: rng.integers(1 << 40, 1 << 62, k).astype(np.uint64)
    edited = lambda x, k: np.unique(np.concatenate([rng.permutation(x)[: len(x) - k], fresh(k)]))
    centres = [np.unique(fresh(n))]
    while len(centres) < linked:
        centres.append(edited(centres[-1], n * 7 // 100))
    sets = centres + [edited(c, n * 10 // 100) for c in centres for _ in range(size)]
    return [sets[i] for i in rng.permutation(len(sets))]


def roots_of(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("seed, linked, depth", [(1, 2, 4), (2, 2, 4), (3, 4, 4), (4, 2, 0)])
def test_hubs_near_different_pivots_are_compared(spark, seed, linked, depth):
    sets = hubs(seed, linked)
    near = {(i, j) for i in range(len(sets)) for j in range(i) if (b := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 80 * (len(sets[i]) + len(sets[j]) - b)}
    rows = [(7, i, True, i, bytearray(x.tobytes())) for i, x in enumerate(sets)]
    got = {(r.a, r.b) for r in join_regions(spark.createDataFrame(rows, "region long, fp long, asks boolean, group long, tokens binary"), 80, cap=16, depth=depth).collect()}
    assert {(max(p), min(p)) for p in got} <= near
    assert set(roots_of(len(sets), near)) == {0} and roots_of(len(sets), got) == roots_of(len(sets), near)


def test_repeated_rows_nulls_and_no_rows(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (7, None), (7, None)]
    assert run(spark, rows) == [(1, 6 - 4, 1), (3, 2, 1), (3, 2, 1), (7, 0, 7), (7, 0, 7)]
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert {r.component_id for r in jaccard_components(docs).collect()} == {4}
    assert run(spark, []) == []


def test_region_links_join_what_near_sets_join():
    rng = np.random.default_rng(0)
    for _ in range(60):
        base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(40, 61)], rng.integers(0, 1 << 40, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(30)]
        asks = rng.random(30) < 0.5
        want = {(i, j) for i in range(30) for j in range(i) if (asks[i] or asks[j]) and (b := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 80 * (len(sets[i]) + len(sets[j]) - b)}
        got = region_links(list(range(30)), sets, asks, 80)
        assert {(max(p), min(p)) for p in got} <= {(i, j) for i in range(30) for j in range(i) if (b := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 80 * (len(sets[i]) + len(sets[j]) - b)}
        roots = {}

        def root(x, roots=roots):
            while roots.get(x, x) != x:
                x = roots[x]
            return x

        for a, b in got:
            roots[root(a)] = root(b)
        assert all(root(i) == root(j) for i, j in want)


def test_cells_are_joined_recursively():
    """Clusters far from each other: each is a cell, with few copies, and its own cells are smaller."""
    rng = np.random.default_rng(7)
    fresh = lambda k: rng.integers(1 << 40, 1 << 62, k).astype(np.uint64)
    common, sets = fresh(8), []
    for _ in range(5):
        centre = fresh(100)
        for _ in range(4):
            inner = np.concatenate([rng.permutation(centre)[:85], fresh(15)])
            sets += [np.unique(np.concatenate([common, rng.permutation(inner)[:95], fresh(5)])) for _ in range(6)]
    sets = [sets[i] for i in rng.permutation(len(sets))]
    near = {(i, j) for i in range(len(sets)) for j in range(i) if (b := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 80 * (len(sets[i]) + len(sets[j]) - b)}
    trace = Counter()
    got = region_links(range(len(sets)), sets, np.ones(len(sets), bool), 80, trace=trace)
    assert {(max(p), min(p)) for p in got} <= near and roots_of(len(sets), got) == roots_of(len(sets), near) and len(near) > 30
    assert trace["regions"] > 5 and trace["cells"] > 10 and trace["copies"] > 0 and trace["pairs"] < len(sets) * len(sets) / 5


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n) if i % 50 != 49], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: i // 50 * 50 for i in range(n)}
