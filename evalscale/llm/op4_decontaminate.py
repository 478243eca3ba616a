"""Benchmark decontamination: a prefix-filtered set join with exact verification.

Every window of a benchmark item (10 consecutive words, or the whole item if it
has fewer) is a set of word shingles.  A document can contain a window only if
it contains all of them, so one necessary prefix token does: the window's rarest
shingle over the whole corpus, by which its shingles are ordered.  Documents are
joined with these tokens alone; a match fixes where the window would have to lie
(positional bound), the document must be long enough on both sides (length bound),
and the words around the match are compared with the window's.

Cases: a null or empty text has no words; a null item id or a repeated item row
counts once by id (rows without an id are ignored); repeated documents each get
their row; columns beyond doc_id, text, item_id are ignored.  An empty benchmark
leaves every document clean, and an empty table of documents gives no rows.

Scale: documents are read twice, once to count shingles and once to match,
whatever the benchmark's size, and never shuffled whole.  What executors get of
the benchmark is a bit filter of at most 2 x 2 ** `bits` bits; what passes it (counts of
shingles, summed in each slice first, and matches with the words around them) meets
the windows in Spark joins, whose benchmark side is broadcast only if its measured
bytes allow.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalscale.llm.common import ROW_KEY, cut, join_measured, row_key
from evalscale.llm.text import ALNUM, Words, gram_rows, grams, slices

WINDOW = 10
SHINGLE = 3
#: Each half of the filter has at most 2 ** BITS bits, and 64 for each token up to that.
BITS = 26
PAGE_BITS = 15  # of one bitmap row
LOW = 9  # where the second half's bits begin in a hash

HIT = "array<struct<k:int,h:long,start:long,lead:int,words:string>>"
_HIT = pa.list_(pa.struct([("k", pa.int32()), ("h", pa.int64()), ("start", pa.int64()), ("lead", pa.int32()), ("words", pa.string())]))


class Filter:
    """Two bitmaps over different bits of a hash: a token has its bit in both."""

    def __init__(self, bits: int):
        self.bits = bits
        self.halves = [np.zeros(max(1 << bits, 1 << PAGE_BITS) // 8, np.uint8) for _ in range(2)]

    def put(self, half: int, page: int, data: bytes) -> None:
        size = 1 << PAGE_BITS - 3
        self.halves[half][page * size : (page + 1) * size] = np.frombuffer(data, np.uint8)

    def passing(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes that have both bits."""
        at = np.arange(len(hashes))
        for half, shift in zip(self.halves, (64 - self.bits, LOW), strict=True):
            place = (hashes[at] >> np.uint64(shift)).astype(np.int64) & (1 << self.bits) - 1
            at = at[half[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1]
        return at


def filter_of(tokens: DataFrame, most_bits: int) -> tuple[Filter, list[int]]:
    """The filter of a (written) table's hashes `h`, and the distinct `k`: at most 2 ** most_bits bits a half come to the driver."""
    bits = min(most_bits, max(8, int(tokens.count() * 64).bit_length()))
    out = Filter(bits)
    for half, shift in enumerate((64 - bits, LOW)):
        place = F.shiftrightunsigned(F.col("h"), shift).bitwiseAND((1 << bits) - 1)
        pages = tokens.select(F.shiftright(place, PAGE_BITS).alias("page"), place.bitwiseAND((1 << PAGE_BITS) - 1).alias("at"))
        for r in pages.groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
            out.put(half, r.page, bytes(r.bits))
    return out, sorted(r.k for r in tokens.select("k").distinct().collect())


def passing(words: Words, k: int, known: Filter) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams inside one text that the filter lets pass."""
    hashes = grams(words.hashes, k)
    at = known.passing(hashes)
    if len(at):
        at = at[gram_rows(words.first, words.counts, k, len(hashes))[at]]
    return at, hashes[at].view(np.int64)


def windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """Distinct windows: words, how many, the items that have them, and the hashes of their shingles of k words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(1), ALNUM)
                out = {"item": [], "words": [], "n": [], "k": [], "shingles": []}
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
                for item, a, count in zip(part.column(0).to_pylist(), words.first[:-1].tolist(), words.counts.tolist(), strict=True):
                    n = min(window, count)
                    k = min(shingle, n)
                    own = [w.decode() for w in words.words(a, a + count)]
                    hashes = grams(words.hashes[a : a + count], k).view(np.int64).tolist() if n else []
                    for i in range(count - n + 1 if n else 0):
                        for key, value in zip(out, (item, " ".join(own[i : i + n]), n, k, hashes[i : i + n - k + 1]), strict=True):
                            out[key].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item"), "text").distinct()
    found = items.mapInArrow(run, "item long, words string, n int, k int, shingles array<long>")
    return cut(found.groupBy("words", "n", "k", "shingles").agg(F.collect_set("item").alias("items")), "windows")


def shingle_counts(documents: DataFrame, tokens: DataFrame, most_bits: int) -> DataFrame:
    """(k, h, count) of the tokens that documents have; and of others that the filter lets pass."""
    known, ks = filter_of(tokens, most_bits)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(0), ALNUM)
                for k in ks:
                    values, counts = np.unique(passing(words, k, known)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(values), pa.array(counts.astype(np.int64))], names=["k", "h", "count"])

    return documents.select("text").mapInArrow(run, "k int, h long, count long").groupBy("k", "h").agg(F.sum("count").alias("count"))


def prefix_tokens(documents: DataFrame, found: DataFrame, most_bits: int) -> DataFrame:
    """One necessary token per window: its shingle with the smallest corpus count, ties by hash; none if the corpus lacks one."""
    places = found.select("words", "n", "k", "items", F.posexplode("shingles").alias("offset", "h"))
    tokens = cut(places.select("k", "h").distinct(), "shingles")
    counts = cut(shingle_counts(documents, tokens, most_bits).join(tokens, ["k", "h"], "left_semi"), "counts")
    rated = places.join(counts, ["k", "h"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    best = rated.groupBy("words", "n", "k").agg(F.min(F.struct("count", "h", "offset")).alias("best"))
    best = best.where("best.count > 0").select("words", "n", "k", "best.h", "best.offset")
    return cut(best.join(found.select("words", "items"), "words"), "prefixes")


def scan(documents: DataFrame, chosen: DataFrame, window: int, most_bits: int) -> DataFrame:
    """Per document: its words, and the places where the filter lets a token pass, with the words that a window there could have."""
    known, ks = filter_of(chosen, most_bits)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(0), ALNUM)
                first, hits = words.first.tolist(), [[] for _ in range(part.num_rows)]
                for k in ks:
                    at, hashes = passing(words, k, known)
                    rows = np.searchsorted(words.first, at, side="right") - 1
                    for i, r, h in zip(at.tolist(), rows.tolist(), hashes.tolist(), strict=True):
                        a, b = max(first[r], i - window + k), min(first[r + 1], i + window)
                        around = b" ".join(words.words(a, b)).decode()
                        hits[r].append({"k": k, "h": h, "start": a - first[r], "lead": i - a, "words": around})
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(words.counts.astype(np.int64)), pa.array(hits, _HIT)], names=["doc_id", *ROW_KEY, "n_words", "hits"])

    rows = documents.select("text", F.col("doc_id").cast("long").alias("doc_id"), *row_key())
    return cut(rows.mapInArrow(run, f"doc_id long, key long, key2 long, n_words long, hits {HIT}"), "scanned")


def verified(scanned: DataFrame, chosen: DataFrame) -> DataFrame:
    """Places of windows, and their items, of the documents that have any."""
    hits = scanned.where(F.size("hits") > 0).select(*ROW_KEY, F.explode("hits").alias("hit"))
    hits = hits.select(*ROW_KEY, "hit.k", "hit.h", "hit.start", "hit.lead", F.split("hit.words", " ").alias("around"))
    sides = chosen.select("k", "h", "offset", "n", F.col("words").alias("window"), "items")
    both = join_measured(hits, sides, ["k", "h"], "inner", 64 + F.length("window") + 8 * F.size("items"))
    begin = F.col("lead") - F.col("offset")
    fits = (begin >= 0) & (begin + F.col("n") <= F.size("around"))  # positional and length bounds
    same = F.array_join(F.slice("around", F.greatest(begin, F.lit(0)) + 1, F.col("n")), " ") == F.col("window")
    place = F.struct((F.col("start") + begin).alias("start"), F.col("n").cast("long").alias("length"))
    # of one document: as long as its text allows
    return both.where(fits & same).groupBy(*ROW_KEY).agg(F.collect_set(place).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


SPANS = "array<struct<start:long,length:long>>"
_FOUND = pa.schema(
    [
        *[(k, pa.int64()) for k in ROW_KEY], ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("items", pa.list_(pa.int64())),
    ]
)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, n in sorted(set(spans)):
        if out and s <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s + n - out[-1][0]))
        else:
            out.append((s, n))
    return out


def digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def summed(found: DataFrame) -> DataFrame:
    """Merged spans, words hit and the items' digest of each document with findings."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                spans, items = merge([(s["start"], s["length"]) for s in r["spans"]]), sorted(r["items"])
                out.append(
                    {
                        **{k: r[k] for k in ROW_KEY}, "n_hit": sum(n for _, n in spans), "n_items": len(items), "items_sha256": digest(items),
                        "spans": [{"start": a, "length": n} for a, n in spans], "items": items,
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=_FOUND)

    return found.mapInArrow(run, f"key long, key2 long, n_hit long, n_items long, items_sha256 string, spans {SPANS}, items array<long>")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per document: words, words hit, items, merged hit spans (in words), and the row's key."""
    chosen = prefix_tokens(documents, windows(benchmark, window, shingle), bits)
    scanned = scan(documents, chosen, window, bits)
    found = cut(summed(verified(scanned, chosen)), "found")
    joined = join_measured(scanned.drop("hits"), found, ROW_KEY, "left", 160 + 16 * F.size("spans") + 8 * F.size("items"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    counted = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        "doc_id", "n_words", counted.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (counted > 0).alias("contaminated"), none("spans", SPANS), none("items", "array<long>"), *ROW_KEY,
    )
