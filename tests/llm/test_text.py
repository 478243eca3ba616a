import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from evalscale.llm import text as T

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
column = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB9 .\n\tçÉ'Z_漢\x0b\x1c"), max_size=14)), min_size=1, max_size=8)


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


@settings(deadline=None)
@given(column)
def test_words_are_those_of_the_patterns(texts):
    for table, pattern in ((T.ALNUM, ALNUM), (T.SPACED, SPACED)):
        w = T.Words(pa.array(texts, pa.string()), table)
        for i, t in enumerate(texts):
            want = [x.encode() for x in pattern.findall(lower(t))]
            assert w.words(int(w.first[i]), int(w.first[i + 1])) == want
            assert [T.gram_of([x]) for x in want] == T.grams(w.hashes[w.first[i] : w.first[i + 1]], 1).tolist()


def test_hashes_do_not_depend_on_slices_and_keep_to_rows():
    texts = ["alpha beta gamma delta", "beta gamma", None, "", "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    whole = T.Words(batch.column(0), T.ALNUM)
    parts = [T.Words(p.column(0), T.ALNUM) for p in T.slices(batch, "text", limit=1)]
    assert np.array_equal(np.concatenate([p.hashes for p in parts]), whole.hashes) and len(parts) >= 3
    g = T.grams(whole.hashes, 2)
    keep = T.gram_rows(whole.first, whole.counts, 2, len(g))
    assert keep.tolist() == [True, True, True, False, True, False]
    assert int(g[1]) == T.gram_of([b"beta", b"gamma"]) == int(g[4])


def test_long_spans_have_the_same_hash(monkeypatch):
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 123, 5000).astype(np.uint8)
    starts, ends = np.array([0, 10, 3000]), np.array([9, 2990, 5000])
    whole = T.hash_spans(raw, starts, ends)
    monkeypatch.setattr(T, "SLICE_BYTES", 64)
    assert np.array_equal(T.hash_spans(raw, starts, ends), whole)


def test_lookup():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    look = T.Lookup(values)
    at, index = look.find(np.concatenate([values[:10], rng.integers(0, 1 << 63, 50).astype(np.uint64)]))
    assert at.tolist() == list(range(10)) and np.array_equal(look.values[index], values[:10])
    assert len(T.Lookup(np.zeros(0, np.uint64)).find(values)[0]) == 0


def test_empty_batches():
    assert list(T.slices(pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["text"]), "text")) == []
    w = T.Words(pa.array([], pa.string()), T.ALNUM)
    assert len(w.hashes) == 0 and len(w.counts) == 0
