import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from evalscale.llm import op13_phrases as op

DOCS = "doc_id long, text string, lang string, n string, word int"


def plain(rows, least, longest, top, inside):
    """The definition, phrase by phrase."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            score, _, left, right = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            inner = any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items())
            if not inner:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "The", "de", "ä", "Äß", "日本", "co-op", "x", "&", "end", " ", *[f"w{i}" for i in range(12)]]
    ends = [" ", " ", " ", " ", "\t", "  ", ". ", ", ", "!", "?\n", "\r\n", "\x0b", "\x0c"]
    text = lambda: "".join(rng.choice(words[: rng.choice([3, 8, 23])]) + rng.choice(ends) for _ in range(rng.randint(0, 40)))
    rows = [(rng.choice([None, "", " . ", text(), text(), text()]), rng.choice([None, "und", "en", "en", "en", ""])) for _ in range(n)]
    return rows + rows[:20]


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed, least, longest, top, inside, options", [(1, 10, 3, 2000, 50, {}), (2, 3, 3, 7, 50, {"bin_words": 40}), (3, 2, 4, 2000, 60, {"bin_words": 60, "filter_bits": 8}), (4, 5, 2, 2000, 50, {"bin_words": 20})])
def test_against_the_definition(spark, seed, least, longest, top, inside, options):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, *r, "clash", 1) for i, r in enumerate(rows)], DOCS).repartition(3)
    assert got(op.mine_phrases(docs, least, longest, top, inside, **options)) == plain(rows, least, longest, top, inside)


def test_a_prefix_with_most_occurrences_is_dealt_to_bins(spark):
    rows = [("hot pair " + " ".join(f"hot t{i % 13} u{i % 3}" for i in range(j, j + 20)), "en") for j in range(60)]
    docs = spark.createDataFrame([(i, *r, "clash", 1) for i, r in enumerate(rows)], DOCS)
    words = op.count_words(docs).cache()
    known, _ = op.filter_of(words.where("n >= 10").selectExpr("code as h", "0 as k"), 16)
    hot = np.array([r.code & (1 << 64) - 1 for r in words.where("word = 'hot'").collect()], np.uint64)
    bins = [len({r.bin for r in op.project(docs, known, h, 50, 3, "lang").collect()}) for h in (np.zeros(0, np.uint64), hot)]
    assert bins[1] > bins[0]
    assert got(op.mine_phrases(docs, bin_words=100)) == plain(rows, 10, 3, 2000, 50) == got(op.mine_phrases(docs))


def test_occurrences_sent_in_small_batches_count_alike(spark):
    rows = corpus(5, 60)
    docs = spark.createDataFrame([(i, *r, "clash", 1) for i, r in enumerate(rows)], DOCS)
    known, _ = op.filter_of(op.count_words(docs).selectExpr("code as h", "0 as k"), 16)
    totals = []
    for flush in (1, 10**6):
        sums = Counter()
        for r in op.project(docs, known, np.zeros(0, np.uint64), 5, 3, "lang", flush).collect():
            for *key, n in zip(*[c.tolist() for c in op.unpack(r.rows, r.data, 3)], strict=True):
                sums[tuple(key)] += n
        totals.append(sums)
    assert totals[0] == totals[1] and totals[0]


def test_nothing_and_a_very_long_text(spark):
    none = spark.createDataFrame([], DOCS)
    assert got(op.mine_phrases(none)) == set()
    assert got(op.mine_phrases(spark.createDataFrame([(1, None, None, "", 1), (2, " .,; ", "en", "", 1)], DOCS))) == set()
    rows = [("a b c d. " * 300_000 + "x" * 2_000_000, "en")]
    assert got(op.mine_phrases(spark.createDataFrame([(1, *rows[0], "", 1)], DOCS))) == plain(rows, 10, 3, 2000, 50)


def test_counts_beyond_64_bits_of_product(spark):
    codes = spark.createDataFrame([([1, 2], 3 * 10**9)], "path array<long>, n long")
    words = spark.createDataFrame([(1, "en", "a", 4 * 10**9), (2, "en", "b", 5 * 10**9)], "code long, lang string, word string, n long")
    assert [tuple(r)[2:] for r in op.weakest_cuts(codes, words).collect()] == [(3 * 10**9, 4 * 10**9, 5 * 10**9, 10**6 * 9 // 20)]
