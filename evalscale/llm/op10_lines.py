"""Removal of globally repeated multi-line chunks.

A rolling hash over the hashes of neighbouring lines chooses where chunks end, so
an inserted line moves ends only next to it.  A text is chunked twice: one family
ends where the hash is even, the other where it is odd, so that a passage of few
lines is more likely to hold a whole chunk of one of them.  Chunks of two lines or
more whose hash occurs again are candidates; only their bytes are gathered, and the
groups of equal hash and digest are kept if all their bytes are equal.  Of each
group the first occurrence (smallest doc_id, then place) stays, and the lines of
the others go.

A repeated passage seldom begins and ends where chunks do.  What chunks leave of
one, and passages too short to hold a chunk, are found by the hash's windows: the
shortest runs of two lines or more and `MIN_BYTES` bytes that begin, or end, at each
line and lie in no chunk that goes.  They are counted, compared and removed like
chunks.  Together that is exact: a line goes if, and only if, it is in a run of two
lines or more and `MIN_BYTES` or more bytes that occurs earlier too.  What goes has
an earlier copy, and so on to the first, which stays.

Cases: a null text stays null and has no lines; an empty one has no chunks; a lone
line is never removed, nor is a run of fewer than `MIN_BYTES` bytes; rows equal in
id and text are one document; a null doc_id comes last; all columns of the input
are kept, whatever their names; an empty table gives no rows.

Scale: a row is known by 128 bits of hash.  Hashes of chunks and of windows are
shuffled once each, bytes only of repeated ones.  Lists of hashes and of removals
are broadcast only if measured small; else they are joined by shuffles that split
skewed keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalscale.llm.common import BROADCAST_BYTES, FEW_BYTES, ROW_KEY, cut, join_measured, join_small, packed_longs, row_key, small
from evalscale.llm.text import Lookup, buffers, grams, hash_spans, slices

WINDOW = 2
MIN_LINES, MAX_LINES = 2, 16
MIN_BYTES = 32
#: A family's chunks end where the rolling hash modulo this is the family's number.
FAMILIES = 2
#: A span's place is its first line and, in the last bits, its number of lines.
COUNT_BITS = 24


class Lines:
    """Lines of a column's texts as byte spans; an empty text has none."""

    def __init__(self, column: pa.Array):
        self.raw, self.offsets = buffers(column)
        ends = np.flatnonzero(self.raw == 10)
        full = np.flatnonzero(np.diff(self.offsets) > 0)
        starts = np.concatenate([self.offsets[full], ends + 1])
        stops = np.concatenate([ends, self.offsets[full + 1]])
        starts.sort(kind="stable")
        stops.sort(kind="stable")
        # a newline that closes a text leaves an empty line at the text's end: it begins where the next text does
        self.starts, self.stops = starts, stops
        row_of = np.searchsorted(self.offsets[1:], ends, side="right")
        self.n_lines = np.bincount(row_of, minlength=len(self.offsets) - 1)
        self.n_lines[full] += 1
        self.first = np.concatenate([[0], np.cumsum(self.n_lines)])

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_lines)), self.n_lines)

    def span(self, first: int, end: int) -> tuple[int, int]:
        """Bytes of the lines from `first` up to `end`, counted over the column."""
        return int(self.starts[first]), int(self.stops[end - 1])

    def places(self, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Places in their texts of spans of n lines."""
        return first - self.first[self.rows[first]] << COUNT_BITS | n


class Chunks(Lines):
    """Lines with the ends of their content-defined chunks."""

    def __init__(self, column: pa.Array, window: int = WINDOW):
        super().__init__(column)
        hashes = hash_spans(self.raw, self.starts, self.stops, lower=False)
        rolled = grams(hashes, window)
        self.marks = np.full(len(hashes), -1)
        self.marks[window - 1 :] = rolled % np.uint64(FAMILIES)

    def of_row(self, row: int, family: int) -> list[tuple[int, int]]:
        """A family's chunks of a row, as first and past-last line (counted over the column)."""
        a, b = int(self.first[row]), int(self.first[row + 1])
        out, at = [], a
        for i, mark in enumerate((self.marks[a:b] == family).tolist(), a + 1):
            n = i - at
            if n >= MIN_LINES and (mark or n >= MAX_LINES):
                out.append((at, i))
                at = i
        if at < b:
            out.append((at, b))
        return out

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First and past-last line of every chunk of either family that may be removed, once each, in order."""
        found = sorted({c for row in np.flatnonzero(self.n_lines >= MIN_LINES).tolist() for f in range(FAMILIES) for c in self.of_row(row, f)})
        return self.large(np.array(found, np.int64).reshape(-1, 2))

    def large(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, end = found[:, 0], found[:, 1]
        keep = (end - first >= MIN_LINES) & (self.stops[end - 1] - self.starts[first] >= MIN_BYTES)
        return first[keep], end[keep]


def windows(lines: Lines, gone: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last line of the windows that lie in no span that goes (places of each row), once each, in order."""
    n = len(lines.starts)
    at, rows = np.arange(n), lines.rows
    ahead = np.maximum(at + MIN_LINES, np.searchsorted(lines.stops, lines.starts + MIN_BYTES) + 1)
    back = np.minimum(at + 1 - MIN_LINES, np.searchsorted(lines.starts, lines.stops - MIN_BYTES, side="right") - 1)
    ahead_in, back_in = ahead <= lines.first[1:][rows], back >= lines.first[:-1][rows]
    found = np.concatenate([np.stack([at, ahead], 1)[ahead_in], np.stack([back, at + 1], 1)[back_in]])
    found = np.unique(found, axis=0)
    # the furthest end of the spans that go and begin at a line or before it
    values, counts = gone.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(gone.value_lengths().fill_null(0)).astype(np.int64)
    first = np.repeat(lines.first[:-1], counts) + (values >> COUNT_BITS)
    reach = np.zeros(n, np.int64)
    np.maximum.at(reach, first, first + (values & (1 << COUNT_BITS) - 1))
    reach = np.maximum.accumulate(reach)
    found = found[found[:, 1] > reach[found[:, 0]]]
    return found[:, 0], found[:, 1]


def chunk_spans(part: pa.RecordBatch) -> tuple[Lines, np.ndarray, np.ndarray]:
    chunks = Chunks(part.column(0))
    return chunks, *chunks.spans()


def window_spans(part: pa.RecordBatch) -> tuple[Lines, np.ndarray, np.ndarray]:
    lines = Lines(part.column(0))
    return lines, *windows(lines, part.column(part.num_columns - 1))


Spans = Callable[[pa.RecordBatch], tuple[Lines, np.ndarray, np.ndarray]]


def span_hashes(rows: DataFrame, spans: Spans) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                lines, first, end = spans(part)
                h = hash_spans(lines.raw, lines.starts[first], lines.stops[end - 1], lower=False)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["hash"])

    return rows.select("text", *[c for c in rows.columns if c == "gone"]).mapInArrow(run, "hash long")


def span_bytes(rows: DataFrame, spans: Spans, wanted: Lookup | None) -> DataFrame:
    """Bytes of the spans whose hash is wanted (all, if None)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                lines, first, end = spans(part)
                a, b = lines.starts[first], lines.stops[end - 1]
                h = hash_spans(lines.raw, a, b, lower=False)
                at = np.arange(len(h)) if wanted is None else wanted.find(h)[0]
                row, place = pa.array(lines.rows[first[at]]), lines.places(first[at], (end - first)[at])
                own = [lines.raw[i:j].tobytes() for i, j in zip(a[at].tolist(), b[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(row) for i in (1, 2, 3)], pa.array(place), pa.array(h[at].view(np.int64)), pa.array(own, pa.binary())], names=["key", "key2", "id", "place", "hash", "bytes"])

    return rows.select("text", "key", "key2", "id", *[c for c in rows.columns if c == "gone"]).mapInArrow(run, "key long, key2 long, id long, place long, hash long, bytes binary")


def repeated(rows: DataFrame, spans: Spans, name: str) -> DataFrame:
    """Places of the spans that have an earlier copy, per row key."""
    again = cut(span_hashes(rows, spans).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), name)
    if small(again, 8, BROADCAST_BYTES):
        found = span_bytes(rows, spans, Lookup(packed_longs(again, "hash")))
    else:
        found = span_bytes(rows, spans, None).join(again, "hash", "left_semi")
    found = cut(found.withColumn("digest", F.sha2("bytes", 256)), f"{name}-bytes")
    at = F.struct("id", *ROW_KEY, "place")
    groups = found.groupBy("hash", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    # written, so that the join has an exchange of its own on either side and a common span's rows can be split
    groups = cut(groups.where("n > 1 and least = most").select("hash", "digest", "first"), f"{name}-groups")
    later = join_small(found.drop("bytes"), groups, ["hash", "digest"], "inner", 160, FEW_BYTES).where(at != F.col("first"))
    return cut(later.groupBy(*ROW_KEY).agg(F.collect_set("place").alias("places")), f"{name}-places")


def with_places(rows: DataFrame, places: DataFrame, name: str) -> DataFrame:
    return join_measured(rows, places.withColumnRenamed("places", name), ROW_KEY, "left", 48 + 8 * F.size(name))


def removals(rows: DataFrame) -> DataFrame:
    """The rows with the places of their spans to remove: `gone` (chunks) and `more` (windows), null if there are none."""
    marked = with_places(rows, repeated(rows, chunk_spans, "lines"), "gone")
    return with_places(marked, repeated(marked, window_spans, "windows"), "more")


def dedup_lines(documents: DataFrame, stats: str = "line_dedup") -> DataFrame:
    """The documents with `text` rid of repeated lines; counts in a struct column `stats` (of a name still free)."""
    if stats in documents.columns:
        raise ValueError(f"the documents have a column {stats!r} already")
    rest = [c for c in documents.columns if c != "text"]
    inside = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    rows = documents.select("text", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), inside.alias("rest"), *row_key())
    marked = removals(rows)
    struct = marked.schema["rest"].dataType.simpleString()
    names = ("n_lines", "removed_chunks", "removed_windows", "removed_lines", "removed_bytes")

    def run(batches):
        kind = pa.struct([(n, pa.int64()) for n in names])
        for batch in batches:
            for part in slices(batch, "text"):
                text, gone, more = part.column(0), part.column(2).to_pylist(), part.column(3).to_pylist()
                lines = Lines(text)
                texts, counts = text.to_pylist(), np.zeros((len(names), part.num_rows), np.int64)
                counts[0] = lines.n_lines
                for row in range(part.num_rows):
                    if not gone[row] and not more[row]:
                        continue
                    a, b = int(lines.first[row]), int(lines.first[row + 1])
                    go = np.zeros(b - a, bool)
                    for place in [*(gone[row] or ()), *(more[row] or ())]:
                        first = place >> COUNT_BITS
                        go[first : first + (place & (1 << COUNT_BITS) - 1)] = True
                    texts[row] = b"\n".join(lines.raw[slice(*lines.span(i, i + 1))].tobytes() for i in (a + np.flatnonzero(~go)).tolist()).decode()
                    counts[1:, row] = len(gone[row] or ()), len(more[row] or ()), go.sum(), (lines.stops[a:b] - lines.starts[a:b])[go].sum()
                stats = pa.StructArray.from_arrays([pa.array(c) for c in counts], fields=list(kind))
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), part.column(1), stats], names=["text", "rest", "line_dedup"])

    counted = ", ".join(f"{n}:long" for n in names)
    done = marked.select("text", "rest", "gone", "more").mapInArrow(run, f"text string, rest {struct}, line_dedup struct<{counted.replace(' ', '')}>")
    columns = [F.col("text") if c == "text" else F.col(f"rest.c{rest.index(c)}").alias(c) for c in documents.columns]
    return done.select(*columns, F.col("line_dedup").alias(stats))


def report(documents: DataFrame) -> DataFrame:
    """Digest columns of the result, per document."""
    done = dedup_lines(documents.select("doc_id", "text"))
    return done.select("doc_id", "line_dedup.*", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
