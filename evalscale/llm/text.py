"""Vectorised byte-level word splitting and hashing over Arrow string columns.

Texts are handled as UTF-8 bytes.  The word classes of the operators are unions
of ASCII ranges plus every byte from 0x80 up, so splitting bytes and splitting
code points give the same words.  Nulls behave as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: A slice of a batch is handled at a time, so that a worker's memory follows this and the longest text.
SLICE_BYTES = 1 << 20

_U64 = np.uint64
MULTIPLIER = _U64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=_U64) * MULTIPLIER + _U64(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (finaliser of splitmix64)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _class(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = False
    return table


#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, letters, all beyond ASCII.
ALNUM = _class(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: `[^\x20\x09-\x0D]+`: whatever ASCII white space parts.
SPACED = _class(b"\x20\x09\x0a\x0b\x0c\x0d")

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BYTE_HASH = _splitmix(256, 7)
_BYTE_HASH_LOWER = _BYTE_HASH[LOWER]
_ORDER = _splitmix(64, 11) | _U64(1)

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, _U64), np.ones(0, _U64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        up, down = np.full(m, _BASE, _U64), np.full(m, _INVERSE, _U64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (into them) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, dtype=kind, count=column.offset + n + 1)[column.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_caches: dict[str, Callable[[], None]] = {}
_user: str | None = None


def release() -> None:
    """Gives freed memory back: worker processes outlive their tasks, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def cache_of(user: str, clear: Callable[[], None]) -> None:
    """Names what a worker keeps between tasks of one operator; it is dropped when another operator's task comes."""
    _caches[user] = clear


def claim(user: str | None) -> None:
    global _user
    if user != _user:
        for name, clear in _caches.items():
            if name != user:
                clear()
        _user = user


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, user: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts take about `limit` bytes, one row at least."""
    claim(user)
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


class Words:
    """Words of a column's texts: byte starts and ends, first word of each row, and 64-bit hashes."""

    def __init__(self, column: pa.Array, table: np.ndarray, hashes: bool = True):
        self.raw, self.offsets = buffers(column)
        raw, n = self.raw, len(self.raw)
        inside = table[raw]
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            first = self.offsets[:-1][self.offsets[:-1] < n]
            begins[first] = inside[first]
            last = self.offsets[1:][self.offsets[1:] > 0] - 1
            ends[last] = inside[last]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        if hashes:
            self.hashes = hash_spans(raw, self.starts, self.ends)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def words(self, a: int, b: int) -> list[bytes]:
        """Lower-cased words a to b."""
        return [LOWER[self.raw[s:e]].tobytes() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the byte spans (by start; they may overlap), A-Z read as a-z if `lower`; block by block, for bounded memory."""
    out, at = np.empty(len(starts), _U64), 0
    reach = np.maximum.accumulate(ends)
    table = _BYTE_HASH_LOWER if lower else _BYTE_HASH
    while at < len(starts):
        base = starts[at]
        if ends[at] - base > SLICE_BYTES:
            out[at] = _long_span(table, raw[base : ends[at]])
            at += 1
            continue
        to = max(at + 1, int(np.searchsorted(reach, base + SLICE_BYTES, side="right")))
        size = int(reach[to - 1] - base)
        up, down = _power(size + 1)
        total = np.zeros(size + 1, _U64)
        np.cumsum(table[raw[base : base + size]] * up[:size], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U64) * MULTIPLIER)
        at = to
    return out


def _long_span(table: np.ndarray, span: np.ndarray) -> np.uint64:
    """The same hash of one long span, a piece at a time."""
    up, _ = _power(SLICE_BYTES)
    total = 0
    for a in range(0, len(span), SLICE_BYTES):
        piece = span[a : a + SLICE_BYTES]
        total += int((table[piece] * up[: len(piece)]).sum(dtype=_U64)) * pow(_BASE, a, 1 << 64)
    return mix(np.array([total + len(span) * int(MULTIPLIER) & (1 << 64) - 1], _U64))[0]


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words; those that cross rows are for the caller to drop."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U64)
    total = hashes[:n] * _ORDER[0]
    for j in range(1, k):
        total += hashes[j : j + n] * _ORDER[j]
    return mix(total + _U64(k))


def gram_rows(first: np.ndarray, counts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n runs of `grams` stay inside one row."""
    keep = np.ones(n + k - 1, bool)
    for j in range(1, k):
        at = first[1:][counts >= j] - j
        keep[at] = False
    return keep[:n]


def gram_of(words: list[bytes]) -> int:
    """The hash that `grams` gives a run of these (lower-cased) words."""
    joined = b" ".join(words)
    raw = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - np.array([len(w) for w in words])
    return int(grams(hash_spans(raw, starts, ends), len(words))[0])


class Lookup:
    """Membership of 64-bit values in a fixed set: a bit filter first, then a binary search."""

    def __init__(self, values: np.ndarray):
        own = np.sort(np.asarray(values, dtype=_U64))
        fresh = own[1:] != own[:-1]
        self._hold(own if fresh.all() else own[np.concatenate([[True], fresh])])

    def _hold(self, values: np.ndarray) -> None:
        self.values = values
        bits = min(24, max(16, int(np.ceil(np.log2(len(self.values) * 16 + 1)))))
        self.shift = _U64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        for a in range(0, len(values), 1 << 18):
            self.filter[(values[a : a + (1 << 18)] >> self.shift).astype(np.int64)] = True

    def __getstate__(self) -> np.ndarray:
        return self.values

    def __setstate__(self, values: np.ndarray) -> None:  # the filter is made anew, not sent along
        self._hold(values)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `hashes` that are members, and their indices in `values`."""
        if not len(self.values) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.filter[(hashes >> self.shift).astype(np.int64)])
        index = np.searchsorted(self.values, hashes[at])
        index[index == len(self.values)] = 0
        good = self.values[index] == hashes[at]
        return at[good], index[good]
