"""Texts of megabytes in one row, and rows without an id."""

import hashlib

from evalscale.llm import op5_jaccard, op6_media, op7_license

WORDS = [f"w{i * 7919 % 100_003}" for i in range(150_000)]
LONG = " ".join(WORDS)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_near_copies_of_long_texts(spark):
    edited = " ".join("changed" if i % 500 == 7 else w for i, w in enumerate(WORDS))  # 5 of 500 shingles go, 5 come: 0.98
    apart = " ".join("changed" if i % 20 == 7 else w for i, w in enumerate(WORDS))  # 1 of 4 goes, 1 comes: 0.6
    rows = table(spark, [(7, LONG), (3, edited), (5, apart), (None, LONG), (9, "x" * 2_000_000)])
    got = {(r.doc_id, r.n_shingles > 1): r.component_id for r in op5_jaccard.jaccard_components(rows).collect()}
    assert got == {(7, True): 3, (3, True): 3, (5, True): 5, (None, True): 3, (9, False): 9}


def test_media_of_long_texts(spark):
    texts = {1: LONG, 2: LONG[1:], 3: "é" * 1_000_000}
    store = op6_media.write_store(table(spark, [*texts.items(), (None, LONG)]))
    got = {r.doc_id: r for r in op6_media.read_store(store).collect()}
    for i, text in [*texts.items(), (None, LONG)]:
        raw = text.encode()
        padded = raw + b"\xff" * (-len(raw) % 576)
        assert (got[i].n_bytes, got[i].payload_sha256) == (len(raw), hashlib.sha256(padded).hexdigest())


def test_licenses_at_the_end_of_long_texts(spark):
    text = LONG + " released under the mit license"
    got = {r.doc_id: r for r in op7_license.scan_licenses(table(spark, [(1, text), (None, text), (2, LONG)])).collect()}
    for i in (1, None):
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].labels, got[i].score) == (150_005, 1, 150_003, "mit", 1.0)
    assert (got[2].n_base, got[2].labels, got[2].score) == (0, "", 0.0)
