"""Best-fit-decreasing packing of tokenised documents into fixed-size sequences.

Best fit decreasing places documents by falling length, each into the open bin
with the least room that still holds it; a segment tree over the remaining
capacities finds that bin in logarithmic time.  What it does depends only on how
many documents have each length, and lengths lie between 1 and the capacity.  So
the driver packs runs of equal lengths (at most `capacity` counts, whatever the
corpus), exactly as document by document, and gets a plan of segments: the
documents number a to b of length L go to bins from c on, k in each, at offset o.
The plan's size is bounded by the capacity too.  Executors number the documents
of each length and look their segment up; the texts are never shuffled.

Cases: a null text is an empty one, whose ids are the closing 0 alone; only a
document beyond the capacity is cut, into full pieces and a last shorter one;
repeated rows are packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalscale.llm.common import cut, join_small
from evalscale.llm.text import LOWER, buffers, cache_of, release, slices

CAPACITY = 2048
#: A worker forgets all words beyond this many (about 65 MB) and starts anew.
CACHE_WORDS = 300_000
#: Nor does it remember more characters of words.
CACHE_CHARS = 24 << 20
#: Words encoded in one call; what the tokenizer returns for a word takes much more memory than its ids.
ENCODE_WORDS = 2_000
#: Words of letters that are joined to one text for it; a text of its own for each word takes twice the time.
JOINED_WORDS = 200
CLOSING = ".,!?;:*$%&#|()\""
_CLOSING = np.isin(np.arange(256), list(CLOSING.encode()))
#: Below this, characters are lower-cased one for one.
PLAIN = 0x130
_ALNUM = np.array([chr(c).isalnum() for c in range(PLAIN)] + [False])
#: Larger slices than elsewhere, so that more words repeat within one.
TEXT_BYTES = 3 << 20


def folds_words(path: str) -> bool:
    """Whether a tokenizer file works as `Encoder` needs to look words up: it parts texts at white space and punctuation, and lower-cases."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    steps = (made.get("normalizer") or {}).get("normalizers") or [made.get("normalizer") or {}]
    splits = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [made.get("pre_tokenizer") or {}]
    pattern = next((s["pattern"].get("Regex", "") for s in splits if s.get("type") == "Split"), "")
    return "Lowercase" in [s.get("type") for s in steps] and bool(made["model"].get("end_of_word_suffix")) and r"[^\s\p{L}\p{N}]+" in pattern


class Encoder:
    """Ids of whole texts, by remembered words; of another kind of tokenizer (see `folds_words`) text by text.

    No token spans white space, so texts are cut there.  Closing ASCII punctuation
    after a letter or digit is a token run of its own, and the tokenizer folds case,
    so what is looked up is the lower-cased rest and the punctuation, each encoded once.
    Added tokens are found before case is folded, so a word keeps its case if folding
    would make one of them.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.folds = cache_words, folds_words(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in added if not t.normalized]
        #: Ids that end a run of letters; none if a text of letters and spaces could hold an added token, so that words are not joined.
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        if self.folds and not any(all(c.isalpha() or c.isspace() for c in t.content) for t in added):
            suffix = self.tokenizer.model.end_of_word_suffix
            self.closes[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self._reset()

    def _reset(self) -> None:
        self.cache = {"": 0}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used, self.known, self.held = 0, 1, 0

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        total = len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(words) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + total] = ids
        self.starts[self.known : self.known + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.lengths[self.known : self.known + len(words)] = sizes
        self.cache.update(zip(words, range(self.known, self.known + len(words)), strict=True))
        self.used, self.known, self.held = self.used + total, self.known + len(words), self.held + sum(map(len, words))

    def _tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _learn(self, words: list[str]) -> None:
        """A word of letters is one run and has one closing id, so joined words are parted at these; where their number is another, each is encoded by itself."""
        letters = [w for w in words if w.isalpha()]
        groups = [letters[a : a + JOINED_WORDS] for a in range(0, len(letters), JOINED_WORDS)]
        single = [w for w in words if not w.isalpha()]
        if groups:
            ids, sizes = self._tokens([" ".join(g) for g in groups])
            for group, own in zip(groups, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                closing = np.flatnonzero(self.closes[own])
                if len(closing) == len(group) and closing[-1] == len(own) - 1:
                    self._add(group, own, np.diff(closing, prepend=-1))
                else:
                    single += group
        if single:
            self._add(single, *self._tokens(single))

    def _pairs(self, chunks: pa.StringArray) -> pa.LargeStringArray:
        """Two words for each chunk: its lower-cased rest, and the closing punctuation or nothing; a rest with characters beyond `PLAIN` is left as it is."""
        raw, offsets = buffers(chunks)
        begin, end = offsets[:-1], offsets[1:]
        low = LOWER[raw]
        for lead, first, last, step, other in ((0xC3, 0x80, 0x9E, 1, 0x97), (0xC4, 0x80, 0xAE, 2, 0)):  # U+00C0 to U+00DE but the sign at U+00D7, and U+0100 to U+012E
            at = np.flatnonzero(raw[:-1] == lead) + 1
            at = at[np.isin(raw[at], [c for c in range(first, last + 1, step) if c != other])]
            low[at] += 0x20 if step == 1 else 1
        rest = end.copy()
        at = np.flatnonzero(end > begin)
        at = at[_CLOSING[raw[end[at] - 1]]]
        shut = _CLOSING[raw]
        runs = np.flatnonzero(shut & ~np.concatenate([[False], shut[:-1]]))
        to = runs[np.searchsorted(runs, end[at] - 1, side="right") - 1]
        at, to = at[to > begin[at]], to[to > begin[at]]
        point, before = raw[to - 1].astype(np.int64), raw[to - 2].astype(np.int64)
        point = np.where(point < 0x80, point, np.where((before >= 0xC2) & (before <= 0xC4), (before & 0x1F) << 6 | point & 0x3F, PLAIN))
        closed = _ALNUM[np.minimum(point, PLAIN)]
        rest[at[closed]] = to[closed]
        bounds = np.zeros(2 * len(chunks) + 1, np.int64)
        bounds[1::2], bounds[2::2] = rest, end

        def holders(at: np.ndarray) -> np.ndarray:
            return np.unique(np.searchsorted(bounds, at, side="right") - 1)

        far = raw >= 0xC5
        far[:-1] |= (raw[:-1] == 0xC4) & (raw[1:] >= 0xB0)
        if far.any():
            own = np.zeros(2 * len(chunks), bool)
            own[holders(np.flatnonzero(far))] = True
            low = np.where(np.repeat(own, np.diff(bounds)), raw, low)
        text = low.tobytes()
        for t in self.added:
            for i in holders(np.array([m.start() for m in re.finditer(re.escape(t.lower()), text)], np.int64)).tolist():
                a, b = bounds[i], bounds[i + 1]
                if any(text.count(x, a, b) != raw[a:b].tobytes().count(x) for x in self.added):
                    low[a:b] = raw[a:b]
        return pa.LargeStringArray.from_buffers(2 * len(chunks), pa.py_buffer(bounds), pa.py_buffer(low))

    def _parted(self, chunks: pa.StringArray) -> tuple[list[str], np.ndarray, list[str]]:
        """`_pairs` as lists: the rest of each chunk, which chunks have closing punctuation, and theirs."""
        words = self._pairs(chunks).to_pylist()
        at = np.flatnonzero([w != "" for w in words[1::2]])
        return words[::2], at, [words[2 * i + 1] for i in at.tolist()]

    def _entries(self, chunks: pa.StringArray) -> np.ndarray:
        """Two entries (rest, closing punctuation) for each chunk."""
        pairs = self._pairs(chunks).dictionary_encode()
        words = pairs.dictionary.to_numpy(zero_copy_only=False).tolist()
        entry = np.fromiter(map(self.cache.get, words, repeat(-1)), np.int64, len(words))
        new = [words[i] for i in np.flatnonzero(entry < 0).tolist()]
        if self.known + len(new) > self.limit or self.held + sum(map(len, new)) > CACHE_CHARS:
            at = np.flatnonzero(entry > 0)
            kept = [words[i] for i in at.tolist()], self._gather(entry[at]), self.lengths[entry[at]]
            self._reset()
            self._add(*kept)
            at = np.flatnonzero(entry)  # entry 0 is the empty word
        else:
            at = np.flatnonzero(entry < 0)
        for a in range(0, len(new), ENCODE_WORDS):
            self._learn(new[a : a + ENCODE_WORDS])
        get = self.cache.__getitem__
        entry[at] = np.fromiter((get(words[i]) for i in at.tolist()), np.int64, len(at))
        return entry[pairs.indices.to_numpy(zero_copy_only=False)].reshape(-1, 2)

    def _gather(self, entry: np.ndarray) -> np.ndarray:
        """Ids of remembered words, one after another."""
        sizes = self.lengths[entry]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[entry] - (ends - sizes), sizes) + np.arange(total)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column's texts, and where each text's begin."""
        if not self.folds:
            flat, sizes = self._tokens(column.fill_null("").to_pylist())
            return flat, np.concatenate([[0], np.cumsum(sizes)])
        parts = pc.ascii_split_whitespace(column.fill_null(""))
        values = parts.flatten().dictionary_encode()
        entry = self._entries(values.dictionary)[values.indices.to_numpy(zero_copy_only=False)].ravel()
        counts = np.asarray(parts.value_lengths()).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(self.lengths[entry])])[2 * np.concatenate([[0], np.cumsum(counts)])]
        return self._gather(entry), bounds


@lru_cache(maxsize=1)
def encoder(path: str, cache_words: int) -> Encoder:
    """One per worker process, kept from task to task."""
    return Encoder(path, cache_words)


cache_of("encoder", encoder.cache_clear)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, number long"


def tokenise(documents: DataFrame, path: str, capacity: int = CAPACITY, cache_words: int = CACHE_WORDS, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Pieces of every document, each numbered among those of its length in its partition."""

    def run(batches):
        words, pid = encoder(path, cache_words), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text", text_bytes, "encoder"):
                flat, bounds = words.encode(part.column(1))
                docs, ids = [], part.column(0).to_pylist()
                for doc_id, a, b in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    data = np.append(flat[a:b], np.uint32(0)).astype("<u4", copy=False)
                    for piece, start in enumerate(range(0, len(data), capacity)):
                        own = data[start : start + capacity]
                        docs.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes())))
                cols = list(zip(*docs, strict=True))
                lengths = np.array(cols[3], np.int64)
                order = np.argsort(lengths, kind="stable")
                ranked = lengths[order]
                begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                runs = np.diff(np.concatenate([begins, [len(ranked)]]))
                number = np.empty(len(lengths), np.int64)
                number[order] = np.arange(len(ranked)) - np.repeat(begins, runs) + seen[ranked]
                seen[ranked[begins]] += runs
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(lengths), pa.array(cols[4], pa.int64()),
                        pa.array(np.full(len(lengths), pid, np.int32)), pa.array(number),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "pid", "number"],
                )
                release()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


class Tree:
    """A segment tree over the remaining capacities 0 to n: which have open bins, and the least one from a value on."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.any = [False] * (2 * self.leaves)

    def put(self, i: int, is_open: bool) -> None:
        i += self.leaves
        self.any[i] = is_open
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def least_from(self, i: int) -> int | None:
        i += self.leaves
        while not self.any[i]:
            while i & 1:  # a right child: climb until there is something to the right
                i //= 2
            if i <= 0:
                return None
            i += 1
            if i & (i - 1) == 0:
                return None
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Segments (length, first number, documents in a bin, first bin, offset in the bin) of best fit decreasing."""
    tree, groups, bins = Tree(capacity), {}, 0
    segments = []

    def open_group(room: int, first: int, n: int) -> None:
        if n and room:
            groups.setdefault(room, []).append((first, n))
            tree.put(room, True)

    for length in sorted(counts, reverse=True):
        at, left = 0, counts[length]
        while left:
            room = tree.least_from(length)
            if room is None:
                each = capacity // length
                room, first, n = capacity, bins, -(-left // each)
                bins += n
            else:
                first, n = groups[room].pop()
                if not groups[room]:
                    tree.put(room, False)
                each = room // length
            used = min(n, -(-left // each))
            placed = min(left, used * each)
            segments.append((length, at, each, first, capacity - room))
            full = placed // each
            open_group(room - each * length, first, full)
            if placed % each:
                open_group(room - placed % each * length, first + full, 1)
            open_group(room, first + used, n - used)
            at, left = at + placed, left - placed
    return segments


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, cache_words: int = CACHE_WORDS, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """One row per piece: where it starts in its document, its length, checksum, sequence and offset there.

    Fewer remembered words and smaller slices of text take less memory and more time.
    """
    pieces = cut(tokenise(documents, path, capacity, cache_words, text_bytes), "pack")
    per = pieces.groupBy("length", "pid").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    segments = sorted(plan(counts, capacity))
    keys = np.array([length << 48 | at for length, at, *_ in segments], np.int64)
    each, first, offset = (np.array([s[i] for s in segments], np.int64) for i in (2, 3, 4))

    def place(batches):
        for batch in batches:
            length, number = (np.asarray(batch.column(i)).astype(np.int64) for i in (3, 5))
            s = np.searchsorted(keys, length << 48 | number, side="right") - 1
            nth = number - (keys[s] & ((1 << 48) - 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(first[s] + nth // each[s]), pa.array(offset[s] + nth % each[s] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    before = F.sum("n").over(Window.partitionBy("length").orderBy("pid")) - F.col("n")
    numbered = join_small(pieces, cut(per.withColumn("before", before).drop("n"), "before"), ["length", "pid"], "inner", 32)
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("number")).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
