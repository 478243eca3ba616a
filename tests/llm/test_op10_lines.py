import random
from pathlib import Path

import pyarrow as pa
import pytest

from evalscale.llm import op10_lines as L


def test_lines_and_chunks_put_the_text_together():
    rng = random.Random(0)
    for _ in range(300):
        texts = ["".join(rng.choice("ab\n") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 6))]
        chunks = L.Chunks(pa.array(texts))
        data = chunks.raw.tobytes()
        for row, text in enumerate(texts):
            lines = [data[chunks.starts[i] : chunks.stops[i]].decode() for i in range(chunks.first[row], chunks.first[row + 1])]
            assert lines == (text.split("\n") if text else [])
            assert all("\n".join(data[slice(*chunks.span(*c))].decode() for c in chunks.of_row(row, f)) == text for f in range(L.FAMILIES))


def test_chunk_ends_are_shift_resistant():
    rng = random.Random(1)
    body = [f"line {rng.random()}" for _ in range(200)]
    for f in range(L.FAMILIES):
        ends = {c[1] for c in L.Chunks(pa.array(["\n".join(body)])).of_row(0, f)}
        moved = {c[1] - 1 for c in L.Chunks(pa.array(["\n".join(["new", *body])])).of_row(0, f)}
        assert len(ends & moved) > 0.9 * len(ends)


def shortest_runs(lines):
    """(first, end) of the shortest runs of two lines and 32 bytes that begin or end at each line."""
    size = lambda a, b: len("\n".join(lines[a:b]).encode())
    out = set()
    for i in range(len(lines)):
        out.update([(i, b) for b in range(i + 2, len(lines) + 1) if size(i, b) >= 32][:1])
        out.update([(a, i + 1) for a in range(i - 1, -1, -1) if size(a, i + 1) >= 32][:1])
    return out


def brute_force(rows):
    """The kept texts, by what the module promises: a line goes if a run that holds it has occurred before."""
    texts = {d: t.split("\n") if t else [] for d, t in rows}
    first, gone = {}, {}
    for d in sorted(texts):
        for a, b in sorted(shortest_runs(texts[d])):
            first.setdefault(tuple(texts[d][a:b]), (d, a))
    for d, lines in texts.items():
        gone[d] = {i for a, b in shortest_runs(lines) if first[tuple(lines[a:b])] != (d, a) for i in range(a, b)}
    return {d: "\n".join(x for i, x in enumerate(lines) if i not in gone[d]) for d, lines in texts.items()}


def corpus(seed):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "é"]) for _ in range(rng.randint(1, 12)))
    passages = [[line() for _ in range(n)] for n in (2, 2, 3, 8, 40)]
    docs = []
    for i in range(50):
        own = [line() for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(own))
            own[at:at] = rng.choice(passages)
        docs.append((i, "\n".join(own)))
    short = "\n".join(["a", "b", "c d"] * 9)  # repeats within one text, of lines that are short
    return [*docs, (100, docs[3][1]), (101, "\n\n\n\n"), (102, "\n\n\n\n"), (103, "one line"), (104, "one line"), (105, short), (106, f"x\n{short}\ny"), (107, "\n" * 40)]


@pytest.mark.parametrize("seed, small", [(1, True), (2, True), (3, False)])
def test_against_brute_force(spark, monkeypatch, seed, small):
    if not small:  # nothing is small enough to broadcast: all by shuffles
        monkeypatch.setattr(L, "small", lambda *a: False)
        monkeypatch.setattr(L, "join_small", lambda left, right, on, how, *size: left.join(right, on, how))
        monkeypatch.setattr(L, "join_measured", lambda left, right, on, how, size: left.join(right, on, how))
    docs = corpus(seed)
    frame = spark.createDataFrame([(d, t, d, "s") for d, t in docs], "doc_id long, text string, place long, hash string")
    done = L.dedup_lines(frame)
    assert done.columns == ["doc_id", "text", "place", "hash", "line_dedup"]
    assert {r.doc_id: r.text for r in done.collect()} == brute_force(docs)
    counts = [r.line_dedup for r in done.collect()]
    assert sum(c.removed_chunks for c in counts) > 10 and sum(c.removed_windows for c in counts) > 10


def test_repeated_runs_of_a_whole_table_go(spark):
    """Of the runs of lines that occur earlier in real tables, at least nine in ten lose their lines, and nothing else goes."""
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no tables here")
    frame = spark.read.parquet(str(path)).select("doc_id", "text")
    before = {r.doc_id: r.text or "" for r in frame.collect()}
    after = {r.doc_id: r.text or "" for r in L.dedup_lines(frame).collect()}
    seen, runs, lost, unique = set(), 0, 0, 0
    for d in sorted(before):
        lines = before[d].split("\n")
        again = [i for i in range(len(lines) - 1) if (lines[i], lines[i + 1]) in seen]
        seen.update(zip(lines, lines[1:], strict=False))
        covered = {i for a in again for i in (a, a + 1)}
        for i in sorted(covered):
            if i - 1 in covered:
                continue
            end = i
            while end in covered:
                end += 1
            if len("\n".join(lines[i:end]).encode()) >= 32:
                runs += 1
                lost += not any("\n".join(lines[a : a + 2]) in after[d] for a in range(i, end - 1))
        own = [x for i, x in enumerate(lines) if i not in covered and len(x) > 32]
        unique += sum(x not in after[d] for x in own)
    assert runs > 50 and lost >= 0.9 * runs and unique == 0


def test_nulls_repeated_rows_and_ties(spark):
    text = "\n".join(f"a rather long line number {i}" for i in range(12))
    rows = [(2, text), (2, text), (None, text), (5, None), (6, ""), (1, text)]
    got = [(r.doc_id, r.text, r.line_dedup.n_lines) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert (1, text, 12) in got and (5, None, 0) in got and (6, "", 0) in got
    assert [t for d, t, _ in got if d in (2, None)] == ["", "", ""]
    assert L.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        L.dedup_lines(spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, line_dedup int"))


def test_a_very_long_text(spark):
    rng = random.Random(4)
    body = [f"line {i} {rng.random()}" for i in range(60_000)]
    rows = [(1, "\n".join(body)), (2, "\n".join(["own", *body[30_000:], "end"])), (3, "x" * 3_000_000), (4, "x" * 3_000_000)]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "own\nend", 3: rows[2][1], 4: rows[3][1]}
