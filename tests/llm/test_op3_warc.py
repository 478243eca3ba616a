import random

import pytest

from evalscale.llm import op3_warc as W
from evalscale.llm.common import scratch


def record(i, payload=b"payload", refers=None):
    return W.encode_record(i, f"http://x/{i}\r\n", payload, W.sha1_base32(payload), refers)


def found(data):
    out = list(W.salvage(data))
    return [int(x.headers["x-page-id"]) for x in out if isinstance(x, W.Record)], [(x.start, x.end) for x in out if isinstance(x, W.Gap)]


@pytest.mark.parametrize("gz", [True, False])
def test_salvage_after_damage(gz):
    pack = W.member if gz else (lambda x: x)
    rng = random.Random(1)
    parts = [pack(record(i, bytes(rng.randrange(256) for _ in range(300)))) for i in range(5)]
    starts = [sum(map(len, parts[:i])) for i in range(6)]
    whole = b"".join(parts)
    assert found(whole) == ([0, 1, 2, 3, 4], [])
    hit = bytearray(whole)
    hit[starts[2] + len(parts[2]) // 2] ^= 0x55
    assert found(bytes(hit)) == ([0, 1, 3, 4], [(starts[2], starts[3])])
    assert found(whole[: starts[4] + 20]) == ([0, 1, 2, 3], [(starts[4], starts[4] + 20)])
    assert found(b"junk\n" + whole) == ([0, 1, 2, 3, 4], [(0, 5)])
    cut = whole[: starts[1] + 30] + whole[starts[2] :]
    assert found(cut) == ([0, 2, 3, 4], [(starts[1], starts[1] + 30)])
    assert found(b"") == ([], []) and found(b"nothing here") == ([], [(0, 12)])


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_inside_members(level):
    rng = random.Random(2)
    parts = [record(i, bytes(rng.randrange(256) for _ in range(30_000))) for i in range(5)]
    whole = W.member(b"".join(parts), level)
    assert found(whole) == ([0, 1, 2, 3, 4], [])
    bad = bytearray(parts[2])
    bad[-100] ^= 0x55
    wrong = W.member(b"".join([*parts[:2], bytes(bad), *parts[3:]]), level)
    gaps = [(0, len(wrong))]
    assert found(wrong) == ([0, 1, 3, 4], gaps)
    assert found(wrong + whole) == ([0, 1, 3, 4, 0, 1, 2, 3, 4], gaps)
    cut = whole[: len(whole) * 7 // 10]
    assert found(cut) == ([0, 1, 2], [(0, len(cut))])
    assert found(b"junk" + cut + wrong) == ([0, 1, 2, 0, 1, 3, 4], [(0, 4), (4, 4 + len(cut)), (4 + len(cut), 4 + len(cut) + len(wrong))])
    for spoilt in (whole[:-8] + bytes(4) + whole[-4:], whole[:-4] + bytes(4)):
        assert found(spoilt) == ([0, 1, 2, 3, 4], [(0, len(spoilt))])
    unsigned = W.member(b"".join(x.replace(b"WARC-Block-Digest: sha1:", b"X-Other: ") for x in parts), level)
    assert found(unsigned) == ([0, 1, 2, 3, 4], [])
    assert level == 0 or found(unsigned[:-4] + bytes(4))[0] == []  # stored bytes are plain records too


def test_checks_of_a_record():
    good = record(1)
    for bad, reason in (
        (good.replace(b"payload\r\n\r\n", b"paylOad\r\n\r\n"), "digest"), (good.replace(b"WARC/1.1", b"WARK/1.1"), "version"), (good[:-4], "length"), (good[:60], "header"),
        (good.replace(b"Content-Length: ", b"Content-Length: x", 1), "content length|digest|length"), (good.replace(b"WARC-Date: ", b"WARC-Date  "), "malformed"),
    ):
        with pytest.raises(W.Bad, match=reason):
            W.parse(bad)
    with pytest.raises(W.Bad):
        W.unit(W.member(b""), 0)


def test_a_version_line_inside_a_payload_is_no_record():
    data = record(1, b"x\nWARC/1.1\r\nnope") + record(2)
    assert found(data) == ([1, 2], [])


PAGES = "page_id long, url string, html string, kind string"


@pytest.mark.parametrize("archive_bytes", [1, 1 << 20])
def test_round_trip(spark, archive_bytes):
    rows = [(5, "u", "same", "c"), (3, "u", "same", "c"), (9, None, "same", "c"), (1, "u é", "ünlike", "c"), (2, "u", None, "c"), (7, "u", "", "c"), (3, "u", "same", "c"), (None, "u", "same", "c"), (4, "u", "x" * 100_000, "c")]
    got = sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in W.round_trip(spark.createDataFrame(rows, PAGES), archive_bytes).collect())
    assert got == [
        (-1, 4, "revisit", 3), (1, 7, "response", None), (2, 0, "response", None), (3, 4, "response", None), (3, 4, "response", None), (4, 100_000, "response", None),
        (5, 4, "revisit", 3), (7, 0, "revisit", 2), (9, 4, "revisit", 3),
    ]
    assert W.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_small_payloads_and_gaps(spark):
    rows = [(i, "u", t, "c") for i, t in enumerate(["", "", "long one", "long one"])]
    manifest = W.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), scratch(spark, "warc-test"), 1 << 20, 5)
    assert sorted((r.page_id, r.record_type) for r in W.read_archives(manifest).collect()) == [(0, "response"), (1, "response"), (2, "response"), (3, "revisit")]
    path = manifest.first().path
    local = path.removeprefix("file://")
    data = open(local, "rb").read()
    with open(local, "wb") as f:
        f.write(data[:40] + b"\0" * 5 + data[45:])
    rows = W.read_archives(manifest).collect()
    gap = [(r.gap_start, r.gap_end) for r in rows if r.kind == "gap"]
    assert len(gap) == 1 and gap[0][0] == 0 and sorted(r.page_id for r in rows if r.kind == "record") == [1, 2, 3]
    assert {r.payload for r in rows if r.page_id == 2} == {b"long one"}
