"""Phrase collocations by pattern growth over projected occurrences, one task a prefix.

Words are counted first, per language; those with at least `least` occurrences are
the frequent prefixes.  Every occurrence of one is then projected: a pointer to
the words that follow it in its piece, as far as they are frequent too.  A prefix's
pointers meet in one task, which grows it to the right depth-first: it sorts the
pointers by the next word, keeps the extensions that are frequent, and goes on with
each one's own pointers.  So all phrases are found with their exact counts.

A phrase is scored at its weakest cut; a phrase that mostly occurs inside a longer
one is dropped.

Cases: a null text has no words, a null language is `und`; a piece without words
and an empty table give nothing; repeated rows count each; ties are ranked by the
phrase's bytes; columns but text and language are not read.

Scale: words with their language, and phrases, are known by 64 bits of hash; words
are told frequent by a bit filter of at most 2 * 2 ** `filter_bits` bits, and what
it lets pass wrongly fails the exact count.  Occurrences with the same words are
pooled where they are read and travel packed, in bins of about `bin_words`.  A
prefix with more than a bin's quarter of occurrences (there are at most 4096 such,
as larger corpora raise that bound) is dealt to all bins by its first extension, and
where that is such a word too, by its second as well: phrases of three words and more
stay whole there, and only the counts of pairs of such words are summed afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalscale.llm.common import cut, fewer_parts
from evalscale.llm.op4_decontaminate import Filter, filter_of
from evalscale.llm.text import LOWER, Words, hash_spans, mix, slices

LEAST = 10
LONGEST = 3
TOP = 2000
FILTER_BITS = 26
BIN_WORDS = 1_000_000
LEAST_BINS = 48
HOT_PREFIXES = 4096
#: Occurrences that a worker pools before it sends them on.
FLUSH_WORDS = 1_000_000

PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
IN_WORD = ~PIECE_ENDS
IN_WORD[list(b" \t")] = False
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def language_hashes(column: pa.Array) -> np.ndarray:
    values = column.dictionary_encode()
    raw = [x.encode() for x in values.dictionary.to_pylist()]
    ends = np.cumsum([len(x) for x in raw]).astype(np.int64)
    hashes = hash_spans(np.frombuffer(b"".join(raw), np.uint8), ends - np.array([len(x) for x in raw], np.int64), ends, lower=False)
    return hashes[values.indices.to_numpy(zero_copy_only=False)]


class Coded:
    """Words of a column's texts, a code for each (word and language; never 0), and whether the next word is in the same piece."""

    def __init__(self, texts: pa.Array, languages: pa.Array):
        self.words = w = Words(texts, IN_WORD)
        self.rows = w.rows
        self.code = np.maximum(mix(w.hashes + language_hashes(languages)[self.rows] * _STEP[0]), np.uint64(1))
        ends = np.cumsum(PIECE_ENDS[w.raw])
        piece = ends[w.starts]
        self.same = np.zeros(len(w.starts), bool)
        self.same[:-1] = (piece[1:] == piece[:-1]) & (self.rows[1:] == self.rows[:-1])

    def strings(self, at: np.ndarray) -> pa.Array:
        """Lower-cased words, gathered from the bytes at once."""
        starts, ends = self.words.starts[at], self.words.ends[at]
        to = np.cumsum(ends - starts)
        offsets = np.concatenate([[0], to]).astype(np.int32)
        data = LOWER[self.words.raw[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)]]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))


def texts_of(documents: DataFrame, language: str) -> DataFrame:
    return documents.select("text", F.coalesce(F.col(language).cast("string"), F.lit("und")).alias("language"))


def count_words(documents: DataFrame, language: str = "lang") -> DataFrame:
    """(code, lang, word, n) of all words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                own = Coded(part.column(0), part.column(1))
                code, at, n = np.unique(own.code, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), part.column(1).take(pa.array(own.rows[at])), own.strings(at), pa.array(n)], names=["code", "lang", "word", "n"])

    found = texts_of(documents, language).mapInArrow(run, "code long, lang string, word string, n long")
    return found.groupBy("code", "lang", "word").agg(F.sum("n").alias("n"))


def suffixes(own: Coded, frequent: Filter, longest: int) -> list[np.ndarray]:
    """The codes of each frequent word that has a frequent successor, and of the words after it; 0 where a phrase can't go on."""
    n = len(own.code)
    known = np.zeros(n, bool)
    known[frequent.passing(own.code)] = True
    at = np.flatnonzero(known[:-1] & known[1:] & own.same[:-1]) if n else np.zeros(0, np.int64)
    out, alive = [own.code[at], own.code[at + 1]], np.ones(len(at), bool)
    for j in range(2, longest):
        to = np.minimum(at + j, n - 1)
        alive = alive & (at + j < n) & own.same[to - 1] & known[to]
        out.append(np.where(alive, own.code[to], np.uint64(0)))
    return out


def among(known: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which codes are in a sorted array."""
    return known[np.searchsorted(known, codes).clip(max=len(known) - 1)] == codes if len(known) else np.zeros(len(codes), bool)


def pooled(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct rows of the columns, how often each occurs (or the sums of n), and a hash of each row."""
    key = columns[0].copy()
    for i, c in enumerate(columns[1:]):
        key = mix(key * _STEP[1] + c * _STEP[2] + np.uint64(i))
    hashes, at, inverse = np.unique(key, return_index=True, return_inverse=True)
    return [c[at] for c in columns], np.bincount(inverse, n, len(at)).astype(np.int64), hashes


def pack(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    return pa.compress(b"".join([c.tobytes() for c in columns] + [n.tobytes()]), codec="zstd", asbytes=True)


def unpack(rows: int, data: bytes, columns: int) -> list[np.ndarray]:
    raw = pa.decompress(data, decompressed_size=rows * 8 * (columns + 1), codec="zstd", asbytes=True)
    return [np.frombuffer(raw, np.uint64, rows, rows * 8 * i) for i in range(columns + 1)]


def project(documents: DataFrame, frequent: Filter, hot: np.ndarray, bins: int, longest: int, language: str, flush: int = FLUSH_WORDS) -> DataFrame:
    """(bin, rows, data): packed occurrences of the frequent prefixes with what follows them."""

    def sent(parts):
        columns, n, key = pooled([np.concatenate(c) for c in zip(*parts, strict=True)])
        spread = mix(columns[0])
        first, second = among(hot, columns[0]), among(hot, columns[1])
        pair = mix(columns[0] + columns[1] * _STEP[1])
        longer = mix(pair + (columns[2] if longest > 2 else key) * _STEP[3])
        spread = np.where(first, np.where(second, longer, pair), spread)
        to = ((spread >> np.uint64(32)) % np.uint64(bins)).astype(np.int64)
        order = np.lexsort((columns[0], to))
        to = to[order]
        starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))[: len(to)]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(to)], strict=True):
            own = order[a:b]
            yield int(to[a]), b - a, pack([c[own] for c in columns], n[own])

    def run(batches):
        parts, size = [], 0

        def out():
            rows = list(zip(*sent(parts), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bin", "rows", "data"])

        for batch in batches:
            for part in slices(batch, "text"):
                found = suffixes(Coded(part.column(0), part.column(1)), frequent, longest)
                if len(found[0]):
                    parts.append(found)
                    size += len(found[0])
                if size >= flush:
                    yield out()
                    parts, size = [], 0
        if parts:
            yield out()

    return texts_of(documents, language).mapInArrow(run, "bin int, rows long, data binary")


def grow(columns: list[np.ndarray], n: np.ndarray, hot: np.ndarray, least: int) -> tuple[list[list[int]], list[int]]:
    """Phrases that start with each prefix (the first column) and their counts; those of a pair of hot words are parts of a sum."""
    paths: list[list[int]] = []
    totals: list[int] = []

    def extend(pointers: np.ndarray, depth: int, path: list[int], hot_prefix: bool) -> None:
        following = columns[depth][pointers]
        order = np.argsort(following, kind="stable")
        pointers, following = pointers[order], following[order]
        starts = np.flatnonzero(np.concatenate([[True], following[1:] != following[:-1]]))
        sums = np.add.reduceat(n[pointers], starts)
        ends = np.append(starts[1:], len(pointers))
        wanted = sums >= least
        if hot_prefix:
            wanted |= among(hot, following[starts])
        for i in np.flatnonzero(wanted & (following[starts] != 0)).tolist():
            longer = [*path, int(following[starts[i]])]
            paths.append(longer)
            totals.append(int(sums[i]))
            if sums[i] >= least and depth + 1 < len(columns):
                extend(pointers[starts[i] : ends[i]], depth + 1, longer, False)

    order = np.argsort(columns[0], kind="stable")
    prefix = columns[0][order]
    starts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))[: len(prefix)]
    sums = np.add.reduceat(n[order], starts) if len(starts) else starts
    ends = np.append(starts[1:], len(prefix))
    is_hot = among(hot, prefix[starts])
    for i in np.flatnonzero(is_hot | (sums >= least)).tolist():
        extend(order[starts[i] : ends[i]], 1, [int(prefix[starts[i]])], bool(is_hot[i]))
    return paths, totals


def count_phrases(documents: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST, language: str = "lang", filter_bits: int = FILTER_BITS, bin_words: int = BIN_WORDS) -> DataFrame:
    """(path, n) of all phrases of 2 to `longest` words with at least `least` occurrences; a path is an array of word codes."""
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    frequent = words.where(F.col("n") >= least)
    known, _ = filter_of(frequent.select(F.col("code").alias("h"), F.lit(0).alias("k")), filter_bits)
    total = frequent.agg(F.sum("n")).first()[0] or 0
    bins = max(LEAST_BINS, -(-total // bin_words))
    # no more than HOT_PREFIXES words can have so many of all occurrences
    bound = max(bin_words // 4, -(-total // HOT_PREFIXES))
    hot = np.array(sorted(r.code & (1 << 64) - 1 for r in frequent.where(F.col("n") >= bound).select("code").collect()), np.uint64)

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(r, d, longest) for r, d in zip(table["rows"].to_pylist(), table["data"].to_pylist(), strict=True)]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        columns, n, _ = pooled(columns[:-1], columns[-1])
        paths, totals = grow(columns, n, hot, least)
        flat = np.array([c for p in paths for c in p], np.uint64).view(np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
        return pa.table({"path": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), "n": pa.array(totals, pa.int64())})

    packed = project(documents, known, hot, bins, longest, language)
    return packed.groupBy("bin").applyInArrow(run, "path array<long>, n long").groupBy("path").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def weakest_cuts(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Each phrase with its language and the cut of the lowest score (then the smallest k): path, lang, a, l, r, score."""
    known = phrases.select(F.xxhash64("path").alias("id"), "n", F.lit(None).cast("string").alias("lang"))
    known = known.unionByName(words.select(F.xxhash64(F.array("code")).alias("id"), "n", "lang"))
    cuts = phrases.select("path", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("k"))
    cuts = cuts.select("path", "a", "k", F.xxhash64(F.slice("path", 1, F.col("k"))).alias("first"), F.xxhash64(F.slice("path", F.col("k") + 1, F.size("path"))).alias("rest"))
    both = cuts.join(known.select(F.col("id").alias("first"), F.col("n").alias("l"), "lang"), "first").join(known.select(F.col("id").alias("rest"), F.col("n").alias("r")), "rest")
    wide = {c: F.col(c).cast("decimal(20,0)") for c in "alr"}
    exact = both.withColumns({f"{c}_": v for c, v in wide.items()}).withColumn("score", F.expr("a_ * a_ * 1000000 div (l_ * r_)").cast("long"))
    best = exact.groupBy("path", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"), F.max("lang").alias("lang"))
    return best.select("path", "lang", "a", "best.l", "best.r", "best.score")


def inner_counts(phrases: DataFrame) -> DataFrame:
    """(path, longer): of each shorter phrase inside a longer one, the largest count of those."""
    spans = F.expr("flatten(transform(sequence(2, size(path) - 1), n -> transform(sequence(1, size(path) - n + 1), i -> slice(path, i, n))))")
    return phrases.where(F.size("path") > 2).select(F.explode(spans).alias("path"), "n").groupBy("path").agg(F.max("n").alias("longer"))


def mine_phrases(
    documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = 50, language: str = "lang", filter_bits: int = FILTER_BITS, bin_words: int = BIN_WORDS
) -> DataFrame:
    """Each language's first `top` phrases by score, count and bytes; a phrase goes if a longer one holds `inside` percent of its occurrences."""
    words = cut(fewer_parts(count_words(documents, language)), "words")
    phrases = cut(fewer_parts(count_phrases(documents, words, least, longest, language, filter_bits, bin_words)), "phrases")
    frequent = words.where(F.col("n") >= least)
    kept = weakest_cuts(phrases, frequent).join(inner_counts(phrases), "path", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))).drop("longer")
    spelled = kept.select("*", F.posexplode("path").alias("at", "code")).join(frequent.select("code", "word"), "code")
    listed = spelled.groupBy("path", "lang", "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = listed.withColumn("phrase", F.array_join("words.word", " ")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
