import hashlib
import random
import re

import pytest

from evalscale.llm import op4_decontaminate as module
from evalscale.llm.op4_decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_force(docs, items, window=10):
    out = []
    for d, t in docs:
        w, hit, own = words(t), set(), set()
        for i, text in items:
            x = words(text)
            n = min(window, len(x))
            for a in range(len(x) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[a : a + n]:
                        hit |= set(range(p, p + n))
                        own.add(i)
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def data(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "Cd", "é", "x1", "the", "of"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 9, 10, 11, 25, 25])] + [(100, None), (7, "of the")]
    docs = [(0, None), (1, ""), (2, "!!"), (3, "of"), (4, "OF, the! of - THE")]
    for d in range(5, 30):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        parts[1:1] = [rng.choice(items)[1] or ""]
        docs.append((d, ". ".join(parts)))
    return [*docs, docs[6], docs[6]], items


@pytest.mark.parametrize("seed, bits, shuffled", [(1, 26, False), (2, 26, True), (3, 8, False), (4, 8, True)])
def test_against_brute_force(spark, monkeypatch, seed, bits, shuffled):
    """Also with a filter that lets most of the words pass, and with no side broadcast."""
    if shuffled:
        monkeypatch.setattr(module, "join_measured", lambda left, right, on, how, size: left.join(right, on, how))
    docs, items = data(seed)
    left = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, n_hit string")
    right = spark.createDataFrame([*items, items[3], (None, "ab cd")], "item_id long, text string")
    got = decontaminate(left, right, bits=bits).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute_force(docs, items)
    assert all(r.n_hit == sum(s.length for s in r.spans) for r in got)


def test_empty_sides(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.contaminated) for r in decontaminate(docs, items).collect()] == [(2, False)]
    assert decontaminate(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_documents_are_read_twice_whatever_the_benchmark(spark, monkeypatch):
    """The same plans, one pass to count and one to match, for a benchmark of some windows and of thousands."""
    reads = []
    for n in ("shingle_counts", "scan"):
        monkeypatch.setattr(module, n, lambda *a, f=getattr(module, n): reads.append(f) or f(*a))
    rng = random.Random(5)
    text = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    items = [(i, text(60)) for i in range(200)]
    docs = [(i, f"{text(200)} {' '.join(items[i][1].split()[5:17])} {text(30)}" if i < 50 else text(300)) for i in range(80)]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    for some in (items[:2], items):
        got = {r.doc_id: (r.n_hit, r.items) for r in decontaminate(left, spark.createDataFrame(some, "item_id long, text string")).collect()}
        assert got == {d: (12, [d]) if d < min(50, len(some)) else (0, []) for d, _ in docs}
    assert len(reads) == 4


def test_a_very_long_text_and_a_window_in_every_document(spark):
    rng = random.Random(6)
    passage = " ".join(f"w{i}" for i in range(12))
    long = " ".join(str(rng.randrange(9)) for _ in range(400_000))
    docs = [(0, f"{long} {passage}"), *[(i, f"{i} {passage} {i}") for i in range(1, 300)], (300, "z" * 2_000_000)]
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert got == {0: (400_012, 12), 300: (1, 0), **{i: (14, 12) for i in range(1, 300)}}
