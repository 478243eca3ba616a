"""Media payloads in a store of content-defined chunks.

A text's UTF-8 bytes, padded, are the 8-bit samples of a WAV file.  A rolling
gear hash over 32 bytes cuts the samples where its top bits are zero, so that an
insertion moves cuts only near it.  Spark finds equal chunk digests; a chunk that
occurs once stays in its own media row, and a chunk that occurs again, anywhere,
is written once and joined back by digest.  Reading goes by the ordered chunk
list: lengths and digests are verified, the file is put together, and its samples
are read out of it.

What moves between machines is digests (some dozens of bytes a chunk) and the
bytes of repeated chunks with the rows that hold them; all other bytes are stored
and read where they are.  The list of rows with repeated chunks is broadcast only
if measured small, else joined by a shuffle.

Cases: a null text is empty; every payload has at least one frame of padding;
repeated rows share all chunks and each get their row; a table without rows gives
none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalscale.llm.common import FEW_BYTES, ROW_KEY, cut, join_measured, join_small, row_key
from evalscale.llm.text import _splitmix, buffers, slices

FRAME = 576
PAD = 255
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 256, 8192, 11
RATE = 8000
_GEAR = (_splitmix(256, 23) >> np.uint64(32)).astype(np.uint32)


def payload_of(text: bytes, frame: int = FRAME) -> bytes:
    return text + bytes([PAD]) * (-len(text) % frame or (0 if text else frame))


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the last 32 bytes at every place, in five doubling steps."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cuts(data: np.ndarray, low: int = MIN_CHUNK, high: int = MAX_CHUNK, bits: int = CUT_BITS) -> list[int]:
    """Ends of the chunks of one payload."""
    return _cuts(np.flatnonzero(gear(data) >> np.uint32(32 - bits) == 0) + 1, 0, len(data), low, high)


def _cuts(marks: np.ndarray, start: int, end: int, low: int, high: int) -> list[int]:
    out, at = [], start
    while end - at > low:
        i = int(np.searchsorted(marks, at + low))
        to = min(int(marks[i]) if i < len(marks) else end, at + high, end)
        out.append(to - start)
        at = to
    if at < end:
        out.append(end - start)
    return out


def chunked(part: pa.RecordBatch, column: int):
    """(row, payload, chunk ends) of each row; the hash runs over the whole slice at once."""
    raw, offsets = buffers(part.column(column))
    data = raw.tobytes()
    payloads = [payload_of(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    every = np.frombuffer(b"".join(payloads), np.uint8)
    marks = np.flatnonzero(gear(every) >> np.uint32(32 - CUT_BITS) == 0) + 1  # a chunk is longer than the window: no mark depends on a neighbour
    at = 0
    for row, p in enumerate(payloads):
        yield row, p, _cuts(marks, at, at + len(p), MIN_CHUNK, MAX_CHUNK)
        at += len(p)


def header(samples: int, rate: int = RATE) -> bytes:
    """The 44 bytes before the samples of a mono 8-bit WAV file."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + samples, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", samples)


def samples_of(media: bytes) -> bytes:
    riff, size, wave, _, _, kind, channels, _, _, _, width, tag, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, kind, channels, width, tag) != (b"RIFF", b"WAVE", 1, 1, 8, b"data") or size != 36 + n or len(media) != 44 + n:
        raise ValueError("not a mono 8-bit WAV file")
    return media[44:]


def feature(samples: bytes) -> str:
    x = np.frombuffer(samples, np.uint8)
    wide = x.astype(np.int64)
    above = x >= 128
    return f"n={len(x)};sum={int(wide.sum())};power={int((wide * wide).sum())};min={int(x.min())};max={int(x.max())};crossings={int((above[1:] != above[:-1]).sum())}"


STORE = "kind string, key long, key2 long, doc_id long, n_bytes long, recipe array<struct<digest:binary,length:int,shared:boolean>>, inline binary, digest binary, bytes binary"
_RECIPE = pa.list_(pa.struct([("digest", pa.binary()), ("length", pa.int32()), ("shared", pa.bool_())]))
_STORE = pa.schema(
    [("kind", pa.string()), ("key", pa.int64()), ("key2", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("recipe", _RECIPE), ("inline", pa.binary()), ("digest", pa.binary()), ("bytes", pa.binary())]
)


def occurrences(documents: DataFrame) -> DataFrame:
    """One row per chunk: the row's key, the chunk's place in it and its digest."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                own, place, digests = [], [], []
                for row, p, ends in chunked(part, 0):
                    at = 0
                    for i, end in enumerate(ends):
                        own.append(row)
                        place.append(i)
                        digests.append(hashlib.sha256(p[at:end]).digest())
                        at = end
                rows = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(1).take(rows), part.column(2).take(rows), pa.array(place, pa.int32()), pa.array(digests, pa.binary())], names=[*ROW_KEY, "place", "digest"])

    return documents.select("text", *ROW_KEY).mapInArrow(run, "key long, key2 long, place int, digest binary")


def write_store(documents: DataFrame) -> DataFrame:
    """The chunk store: rows of kind `media` (ordered chunk list, own bytes) and of kind `chunk` (repeated ones, once)."""
    rows = documents.select(F.col("doc_id").cast("long"), "text", *row_key())
    found = cut(occurrences(rows), "chunks")
    at = F.struct(*ROW_KEY, "place")
    # written, so that the join has an exchange of its own on either side and a common chunk's rows can be split
    repeated = cut(found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("owner")).where("n > 1").drop("n"), "repeated-chunks")
    marks = join_small(found, repeated, "digest", "inner", 80, FEW_BYTES).select(*ROW_KEY, "place", (at == F.col("owner")).alias("writes"))
    places = cut(marks.groupBy(*ROW_KEY).agg(F.collect_set("place").alias("shared"), F.collect_set(F.when(F.col("writes"), F.col("place"))).alias("writes")), "repeated")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, keys, keys2, shared, writes = (part.column(i).to_pylist() for i in (0, 2, 3, 4, 5))
                sizes = np.diff(buffers(part.column(1))[1]).tolist()
                out = []
                for row, p, ends in chunked(part, 1):
                    again, recipe, inline, at = set(shared[row] or ()), [], [], 0
                    own = set(writes[row] or ())
                    for i, end in enumerate(ends):
                        chunk = p[at:end]
                        digest = hashlib.sha256(chunk).digest()
                        recipe.append({"digest": digest, "length": end - at, "shared": i in again})
                        if i not in again:
                            inline.append(chunk)
                        elif i in own:
                            out.append({"kind": "chunk", "digest": digest, "bytes": chunk})
                        at = end
                    out.append({"kind": "media", "key": keys[row], "key2": keys2[row], "doc_id": ids[row], "n_bytes": sizes[row], "recipe": recipe, "inline": b"".join(inline)})
                yield pa.RecordBatch.from_pylist(out, schema=_STORE)

    size = 48 + 4 * (F.size("shared") + F.size("writes"))
    marked = join_measured(rows, places, ROW_KEY, "left", size).select("doc_id", "text", *ROW_KEY, "shared", "writes")
    return cut(marked.mapInArrow(run, STORE), "media")


RESULT = "key long, key2 long, doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def assemble(recipe: list[dict], inline: bytes, foreign: dict[int, bytes]) -> bytes:
    """The media file by its ordered chunk list; every chunk is verified."""
    out, at = [], 0
    for i, c in enumerate(recipe):
        if c["shared"]:
            chunk = foreign[i]
        else:
            chunk, at = inline[at : at + c["length"]], at + c["length"]
        if len(chunk) != c["length"] or hashlib.sha256(chunk).digest() != c["digest"]:
            raise ValueError("a chunk is not what its digest says")
        out.append(chunk)
    samples = b"".join(out)
    return header(len(samples)) + samples


def describe(media: DataFrame) -> DataFrame:
    """Rebuilds the media of rows (row key, doc_id, n_bytes, recipe, inline, foreign) and computes what they hold."""

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                key, key2, doc_id, n_bytes, recipe, inline, foreign = (c[i].as_py() for c in batch.columns)
                file = assemble(recipe, inline, {f["place"]: f["bytes"] for f in foreign or ()})
                samples = samples_of(file)
                out.append(
                    (key, key2, doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature(samples))
                )
            kinds = [pa.string() if f.endswith("string") else pa.int64() for f in RESULT.split(", ")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])

    return media.select(*ROW_KEY, "doc_id", "n_bytes", "recipe", "inline", "foreign").mapInArrow(run, RESULT)


def read_store(store: DataFrame) -> DataFrame:
    """Every media rebuilt from the store, verified and described: one row per document."""
    media = store.where("kind = 'media'").select(*ROW_KEY, "doc_id", "n_bytes", "recipe", "inline")
    lone = ~F.exists("recipe", lambda c: c["shared"])
    nothing = F.lit(None).cast("array<struct<place:int,bytes:binary>>")
    plain = describe(media.where(lone).withColumn("foreign", nothing))
    chunks = store.where("kind = 'chunk'").select("digest", "bytes").dropDuplicates(["digest"])
    rest = media.where(~lone)
    asked = rest.select(*ROW_KEY, F.posexplode("recipe").alias("place", "c")).where("c.shared").select(*ROW_KEY, "place", "c.digest").distinct()
    fetched = asked.join(chunks, "digest").groupBy(*ROW_KEY).agg(F.collect_list(F.struct("place", "bytes")).alias("foreign"))
    done = describe(rest.dropDuplicates(ROW_KEY).join(fetched, ROW_KEY))
    again = rest.select(*ROW_KEY).join(done, ROW_KEY)  # repeated rows have one key
    columns = [f.split()[0] for f in RESULT.split(", ")]
    return plain.unionByName(again.select(*columns))
