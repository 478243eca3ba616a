import hashlib
import random
import zlib

import numpy as np
import pytest

from evalscale.llm import op6_media as M


def plain_gear(data, i):
    return sum(int(M._GEAR[b]) << k for k, b in enumerate(data[max(0, i - 31) : i + 1][::-1])) & 0xFFFFFFFF


def test_gear_is_a_rolling_hash_of_32_bytes():
    data = np.frombuffer(random.Random(0).randbytes(200), np.uint8)
    h = M.gear(data)
    assert [int(x) for x in h] == [plain_gear(data.tolist(), i) for i in range(200)]


def test_cuts_shift_with_the_content():
    rng = random.Random(1)
    body = rng.randbytes(60_000)
    ends = M.cuts(np.frombuffer(body, np.uint8))
    assert ends[-1] == len(body) and all(0 < b - a <= M.MAX_CHUNK for a, b in zip([0, *ends], ends, strict=False))
    moved = M.cuts(np.frombuffer(b"inserted" + body, np.uint8))
    assert len({e + 8 for e in ends} & set(moved)) >= len(ends) - 2
    assert M.cuts(np.zeros(0, np.uint8)) == [] and M.cuts(np.zeros(10, np.uint8)) == [10]


def test_payload_and_container():
    assert M.payload_of(b"") == b"\xff" * 576 and M.payload_of(b"x" * 576) == b"x" * 576 and len(M.payload_of(b"x" * 577)) == 1152
    media = M.header(576) + M.payload_of(b"")
    assert M.samples_of(media) == b"\xff" * 576 and len(M.header(5)) == 44
    for bad in (media[:-1], media.replace(b"WAVE", b"WAVX")):
        with pytest.raises(ValueError):
            M.samples_of(bad)
    with pytest.raises(ValueError):
        M.assemble([{"digest": b"x" * 32, "length": 3, "shared": False}], b"abc", {})


def expected(d, text):
    payload = M.payload_of((text or "").encode())
    media = M.header(len(payload)) + payload
    return d, len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), M.feature(payload)


def test_round_trip_through_the_store(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdé ") for _ in range(30_000))
    texts = [None, "", "short", long, long, "x" + long, long[:9000] + "!" + long[9000:], "é" * 40_000, "y" * 576]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, long, "clash"), (None, "short", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    store = M.write_store(docs)
    got = sorted((tuple(r)[2:] for r in M.read_store(store).collect()), key=str)
    assert got == sorted((expected(d, t) for d, t, _ in rows), key=str)
    held = sum(len(r.inline or b"") + len(r.bytes or b"") for r in store.collect())
    assert held < 0.6 * sum(expected(d, t)[2] for d, t, _ in rows)  # copies and near copies are stored about once
    assert M.read_store(M.write_store(docs.limit(0))).count() == 0
