"""Secret scan: fixed patterns, and a character convolutional network over every candidate with its surroundings.

A candidate is a run of 12 or more characters of `[A-Za-z0-9+/_.-]`, bare of outer
dots, with up to two closing `=`.  The network reads the candidate and the
characters around it: filters over five characters, the largest value of each in
front of, inside and behind the candidate and its mean inside, then a hidden layer.
Candidates of any length are read whole, as pooling goes on block by block.

It is trained on labelled findings: those that the fixed patterns label in all
documents (numbers alone are left out), and made ones in forms that patterns miss, set
into the contexts of a batch's own.  Tasks fit their share of the findings with numpy,
from the network of the round before, and their networks are averaged.  A quarter of the
findings, dealt by the value, is kept from the fit; on all of it the scores are
calibrated (isotonically), and for each shape of candidate the highest
threshold is taken that still finds `recall` of the labelled secrets, but no less than
`floor`, and `SURE` where they are too few to tell.  Candidates over it that touch no span of the patterns are added.

Cases: a null or empty text has no spans; one that is a single candidate of any
length is scored whole; repeated rows get equal spans, ties of start are ordered by
kind; without documents the network learns from made findings alone; columns beyond
doc_id and text are not read; no documents, no rows.

Scale: documents are scored where they are read and not shuffled; one more pass takes
the findings, values of up to 512 characters, into a table that the rounds read.  The
driver gets a network a round and the held-out counts by shape, label and margin, in steps of 1 / `STEPS`.
"""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalscale.llm.common import cut
from evalscale.llm.learn import apply_isotonic, isotonic
from evalscale.llm.text import buffers, claim, slices

#: Fixed patterns, kinds in their order, and the least length of what counts.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "learned")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX, LEAST_CANDIDATE = 12, 18, 16, 12

BEFORE, AFTER = 24, 16
REACH = 2  # characters to each side that a filter sees
FIT_VALUE = 512
#: Made findings: this share of a corpus's harmless ones, but as many as `MADE_FINDINGS` at least.
MADE_SHARE, MADE_FINDINGS = 1 / 8, 6_000
#: Findings that are seen in the fit, at least, as long as `MOST_ROUNDS` allow; and findings of a task.
SHOWN, ROUNDS, MOST_ROUNDS, TASK_FINDINGS = 60_000, 3, 12, 20_000
#: Margins are counted up to `REACHED`, in steps of 1 / `STEPS`.
STEPS, REACHED = 64, 32
RECALL = 0.98
FLOOR = 0.5
#: Asked for of shapes with fewer labelled secrets than `ENOUGH`, whose recall cannot be told.
SURE, ENOUGH = 0.99, 20
BLOCK = 1 << 17

SPAN = "struct<kind:string,start:long,end:long,score:double>"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_ALNUM = (string.ascii_letters + string.digits).encode()
_RUN, _HEX, _DIGITS, _LETTERS, _UPPER = (_table(x) for x in (_ALNUM + b"+/_.-", b"0123456789abcdef", string.digits.encode(), string.ascii_letters.encode(), string.ascii_uppercase.encode()))

#: Character classes that the network sees: 0 none, 1 other, then every letter, digit and sign of ASCII, blanks as one.
CLASS = np.ones(256, np.int64)
for _i, _c in enumerate(sorted({*range(33, 127)}), 2):
    CLASS[_c] = _i
CLASS[[9, 10, 11, 12, 13, 32]] = 96
CLASSES = 97


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a flag that stay inside one row."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def candidates(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the candidates in the texts' bytes."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = runs(_RUN[raw], offsets)
    long = ends - starts >= LEAST_CANDIDATE
    starts, ends = starts[long], ends[long]
    solid = raw != ord(".")
    at = np.arange(len(raw))
    following = np.minimum.accumulate(np.where(solid, at, len(raw))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(solid, at, -1))
    starts, ends = following[starts], before[ends - 1] + 1
    row_end = offsets[np.searchsorted(offsets, starts, side="right").clip(max=len(offsets) - 1)]
    for _ in range(2):
        more = (ends < row_end) & (raw[np.minimum(ends, len(raw) - 1)] == ord("="))
        ends = ends + more
    padded = raw[np.maximum(ends - 1, 0)] == ord("=")
    value_follows = padded & (ends < row_end) & (_RUN[raw[np.minimum(ends, len(raw) - 1)]] | (raw[np.minimum(ends, len(raw) - 1)] == ord("=")))
    ends = np.where(value_follows, before_equals(raw, ends), ends)
    long = ends - starts >= LEAST_CANDIDATE
    return starts[long], ends[long]


def before_equals(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    for _ in range(2):
        ends = ends - (raw[np.maximum(ends - 1, 0)] == ord("="))
    return ends


def base_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, start, end) of the fixed patterns, in the texts' bytes; leftmost and apart within each kind."""
    found: list[tuple[int, int, int]] = []
    data = raw.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(data, a, b) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(data, a, b) if m.end() - m.start() >= LEAST_ACCESS]
    kind, start, end = np.array(found, np.int64).reshape(-1, 3).T
    if not len(raw):
        return kind, start, end
    s, e = runs(_HEX[raw], offsets)
    long = e - s >= LEAST_HEX
    return np.concatenate([kind, np.full(long.sum(), 2)]), np.concatenate([start, s[long]]), np.concatenate([end, e[long]])


def touched(starts: np.ndarray, ends: np.ndarray, spans: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of the spans overlap any of the other ones."""
    opened, closed = np.sort(spans[0]), np.sort(spans[1])
    return np.searchsorted(opened, ends, side="left") > np.searchsorted(closed, starts, side="right")


def shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """0: letters of one case, but for a capital in front, and signs; 1: digits and signs; 2: letters of both cases; 3: letters and digits."""
    counted = lambda flag: np.concatenate([[0], np.cumsum(flag[raw])])
    digits, letters, upper = (c[ends] - c[starts] for c in map(counted, (_DIGITS, _LETTERS, _UPPER)))
    upper = upper - (_UPPER[raw[starts]] & (upper < letters))
    return np.where(digits > 0, np.where(letters > 0, 3, 1), np.where((upper > 0) & (upper < letters - 1), 2, 0))


class Windows:
    """Candidates with their surroundings as one run of character classes, each with `REACH` blanks around."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        row = np.searchsorted(offsets, starts, side="right") - 1
        low, high = np.maximum(offsets[row], starts - BEFORE), np.minimum(offsets[row + 1], ends + AFTER)
        self.size = ends - starts
        length = high - low + 2 * REACH
        first = np.concatenate([[0], np.cumsum(length)])
        inner = np.arange(first[-1]) - np.repeat(first[:-1], length) - REACH
        source = inner + np.repeat(low, length)
        real = (inner >= 0) & (source < np.repeat(high, length))
        self.ids = np.zeros(first[-1] + 2 * REACH, np.int64)
        self.ids[REACH:-REACH] = np.where(real, CLASS[raw[source.clip(0, max(len(raw) - 1, 0))]] if len(raw) else 0, 0)
        #: bounds of the parts in front, inside and behind, of each candidate in turn
        self.bounds = np.concatenate([np.stack([first[:-1], first[:-1] + REACH + starts - low, first[:-1] + REACH + ends - low], 1).ravel(), first[-1:]])

    def take(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes, bounds and sizes of the candidates a to b."""
        bounds = self.bounds[3 * a : 3 * b + 1]
        return self.ids[bounds[0] : bounds[-1] + 2 * REACH], bounds - bounds[0], self.size[a:b]


@dataclass
class Network:
    filters: np.ndarray  # (2 * REACH + 1, CLASSES, n): the value that a class at each place adds to each filter
    offset: np.ndarray
    hidden: np.ndarray
    hidden_offset: np.ndarray
    out: np.ndarray
    out_offset: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator, n: int = 24, hidden: int = 24) -> Network:
        draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
        return cls(draw(2 * REACH + 1, CLASSES, n, scale=0.3), np.zeros(n, np.float32), draw(4 * n + 1, hidden, scale=(2 / (4 * n)) ** 0.5), np.zeros(hidden, np.float32), draw(hidden, scale=0.3), np.zeros(1, np.float32))

    def fields(self) -> list[np.ndarray]:
        return [self.filters, self.offset, self.hidden, self.hidden_offset, self.out, self.out_offset]

    def flat(self) -> np.ndarray:
        return np.concatenate([f.ravel() for f in self.fields()]).astype(float)

    def like(self, flat: np.ndarray) -> Network:
        """Another network of these shapes."""
        ends = np.cumsum([f.size for f in self.fields()])
        return Network(*[p.reshape(f.shape).astype(np.float32) for p, f in zip(np.split(flat, ends[:-1]), self.fields(), strict=True)])

    def convolved(self, ids: np.ndarray) -> np.ndarray:
        """Filter values at each place but the first and last `REACH`."""
        n = len(ids) - 2 * REACH
        total = np.repeat(self.offset[None], n, 0)
        for j, table in enumerate(self.filters):
            total += table[ids[j : j + n]]
        return np.maximum(total, 0)

    def pooled(self, ids: np.ndarray, bounds: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The hidden layer's input: for each candidate three maxima, a mean, and its length; block by block."""
        parts, n = len(bounds) - 1, len(self.offset)
        most, total = np.zeros((parts, n), np.float32), np.zeros((parts, n), np.float32)
        for a in range(0, int(bounds[-1]), BLOCK):
            b = min(a + BLOCK, int(bounds[-1]))
            values = self.convolved(ids[a : b + 2 * REACH])
            p, q = np.searchsorted(bounds, a, side="right") - 1, np.searchsorted(bounds, b, side="left")
            starts = np.maximum(bounds[p:q] - a, 0)
            most[p:q] = np.maximum(most[p:q], np.maximum.reduceat(values, starts))
            total[p:q] += np.add.reduceat(values, starts)
        return np.concatenate([most.reshape(-1, 3 * n), total[1::3] / size[:, None], np.log2(size)[:, None] / 8], 1, dtype=np.float32)

    def margins(self, windows: Windows) -> np.ndarray:
        out, a, count = np.zeros(len(windows.size)), 0, len(windows.size)
        while a < count:
            b = min(count, max(a + 1, int(np.searchsorted(windows.bounds[3::3], windows.bounds[3 * a] + BLOCK, side="right"))))
            x = self.pooled(*windows.take(a, b))
            out[a:b] = np.maximum(x @ self.hidden + self.hidden_offset, 0) @ self.out + self.out_offset
            a = b
        return out

    def gradients(self, ids: np.ndarray, bounds: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted logistic loss, for a batch in one block, in the order of the fields."""
        n, batch = len(self.offset), len(size)
        values, starts = self.convolved(ids), bounds[:-1]
        most = np.maximum.reduceat(values, starts)
        part = np.repeat(np.arange(3 * batch), np.diff(bounds))
        x = np.concatenate([most.reshape(-1, 3 * n), np.add.reduceat(values, starts)[1::3] / size[:, None], np.log2(size)[:, None] / 8], 1, dtype=np.float32)
        h = np.maximum(x @ self.hidden + self.hidden_offset, 0)
        d = ((1 / (1 + np.exp(-(h @ self.out + self.out_offset))) - y) * weight / batch).astype(np.float32)
        dh = d[:, None] * self.out * (h > 0)
        dx = dh @ self.hidden.T
        top = (values == most[part]) & (values > 0)
        ties = np.maximum(np.add.reduceat(top, starts, dtype=np.float32), 1)
        dv = top * (dx[:, : 3 * n].reshape(-1, n) / ties)[part]
        inside = part % 3 == 1
        dv[inside] += ((dx[:, 3 * n : 4 * n] / size[:, None])[part[inside] // 3]) * (values[inside] > 0)
        d_filters = np.zeros_like(self.filters)
        for j in range(2 * REACH + 1):
            order = np.argsort(ids[j : j + len(dv)], kind="stable")
            own = ids[j : j + len(dv)][order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            d_filters[j, own[first]] = np.add.reduceat(dv[order], first)
        return [d_filters, dv.sum(0), x.T @ dh, dh.sum(0), h.T @ d, d.sum(keepdims=True)]


class Adam:
    """Steps of a network on batches of findings."""

    def __init__(self, net: Network):
        self.net, self.fields, self.step = net, net.fields(), 0
        self.first, self.second = [np.zeros_like(f) for f in self.fields], [np.zeros_like(f) for f in self.fields]

    def pass_over(self, windows: Windows, y: np.ndarray, weight: np.ndarray, order: np.ndarray, rate: float, batch: int = 64) -> None:
        for a in range(0, len(y), batch):
            own = order[a : a + batch]
            pieces = [windows.take(i, i + 1) for i in own.tolist()]
            ids = np.concatenate([*(p[0][: -2 * REACH] for p in pieces), np.zeros(2 * REACH, np.int64)])
            sizes = np.concatenate([np.diff(p[1]) for p in pieces])
            grads = self.net.gradients(ids, np.concatenate([[0], np.cumsum(sizes)]), windows.size[own], y[own], weight[own])
            self.step += 1
            for f, g, m, v in zip(self.fields, grads, self.first, self.second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                f -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-7)


def fit(windows: Windows, y: np.ndarray, least_epochs: int = 8, shown: int = SHOWN, batch: int = 64, rate: float = 0.004, seed: int = 5) -> Network:
    """Adam on batches of findings in an order drawn from the seed, about `shown` in all; both classes weigh the same."""
    epochs = max(least_epochs, -(-shown // max(len(y), 1)))
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    adam = Adam(net)
    weight = np.where(y == 1, len(y) / max(2 * y.sum(), 1), len(y) / max(2 * (len(y) - y.sum()), 1))
    for epoch in range(epochs):
        adam.pass_over(windows, y, weight, rng.permutation(len(y)), rate * (1 - epoch / epochs), batch)
    return net


@dataclass
class Model:
    network: Network
    points: tuple[np.ndarray, np.ndarray]
    thresholds: np.ndarray  # by shape

    def scores(self, raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return apply_isotonic(self.points, self.network.margins(Windows(raw, offsets, starts, ends)))


def labelled_findings(documents: DataFrame, rows: int | None = None) -> DataFrame:
    """(front, value, back, label) of the candidates in all documents: 1 where a fixed pattern is met; if `rows` is named, at most half as many of each label."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = buffers(part.column(0))
                starts, ends = candidates(raw, offsets)
                kind, s, e = base_spans(raw, offsets)
                label, numbers = touched(starts, ends, (s, e)), shapes(raw, starts, ends) == 1
                out = []
                row = np.searchsorted(offsets, starts, side="right") - 1
                for a, b, y, low, high in zip(*(x.tolist() for x in (starts, ends, label, offsets[row], offsets[row + 1])), strict=True):
                    if b - a <= FIT_VALUE:
                        around = raw[max(low, a - BEFORE) : a], raw[a:b], raw[b : min(high, b + AFTER)]
                        out.append([x.tobytes().decode("latin-1") for x in around] + [int(y)])
                out = [r for r, n in zip(out, numbers[ends - starts <= FIT_VALUE].tolist(), strict=True) if not (n and r[3])]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(),) * 3 + (pa.int32(),))], names=["front", "value", "back", "label"])

    found = cut(documents.select("text").mapInArrow(run, "front string, value string, back string, label int").distinct(), "findings")
    if rows is None:
        return found
    first = lambda y: found.where(F.col("label") == y).orderBy(F.xxhash64("value", "front", "back"), "value", "front", "back").limit(rows // 2)
    return first(1).unionByName(first(0))


_B64 = string.ascii_letters + string.digits
_SYLLABLES = "ba de ki lo mu ren ta vor sin get set use max item list node page view code data path file line test main load".split()


def made_findings(contexts: list[tuple[str, str]], n: int, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """Findings of forms that the patterns miss, and harmless ones that look like them, in given contexts (front, back)."""
    rng = random.Random(seed)
    pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    word = lambda k: "".join(rng.choice(_SYLLABLES) for _ in range(k))
    joined = lambda sep, a, b: sep.join(word(rng.randint(1, 3)) for _ in range(rng.randint(a, b)))
    secrets = [
        lambda: pick(_B64, 20, 44), lambda: pick(_B64 + "+/", 24, 64) + rng.choice(["", "=", "=="]), lambda: pick(_B64 + "_-", 22, 48), lambda: pick(string.digits + "ABCDEF", 24, 64),
        lambda: rng.choice(["ghp_", "gho_", "sk_live_", "rk_live_", "pk_", "glpat-", "npm_", "hf_", "AIza", "xoxb-"]) + pick(_B64, 20, 40),
        lambda: f"eyJ{pick(_B64, 16, 40)}.eyJ{pick(_B64, 20, 60)}.{pick(_B64 + '_-', 20, 43)}", lambda: pick(string.ascii_lowercase + string.digits, 20, 40), lambda: pick("0123456789abcdef", 32, 64),
    ]
    harmless = [
        lambda: joined("", 3, 5).upper(), lambda: joined("", 2, 4) + pick(string.ascii_lowercase, 3, 8), lambda: joined("_", 2, 5), lambda: joined("-", 2, 5), lambda: joined("/", 2, 5) + rng.choice([".html", ".py", "/", ".json"]),
        lambda: "".join(w.capitalize() for w in joined(" ", 2, 4).split()) + rng.choice(["", "2", "Test"]), lambda: "www." + joined(".", 2, 3) + rng.choice([".com", ".org/", ".net/index.html"]),
        lambda: pick(string.digits, 12, 20), lambda: f"20{pick(string.digits, 2, 2)}-{pick('01', 2, 2)}-{pick('012', 2, 2)}T{pick(string.digits, 2, 2)}", lambda: "-".join(pick(string.digits, 3, 4) for _ in range(4)),
        lambda: ".".join(pick(string.digits, 1, 3) for _ in range(5)), lambda: "=-_/+."[rng.randrange(6)] * rng.randint(12, 40), lambda: f"{pick(string.digits, 4, 4)}/{word(2)}-{word(3)}-{pick(string.digits, 1, 4)}",
        lambda: "-".join(pick("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)), lambda: joined("", 1, 2).upper() + "_" + joined("_", 1, 3).upper(), lambda: joined(".", 3, 5),
    ]
    fronts = ['key = "', "Authorization: Bearer ", "pwd: ", "access=", "credential: '", "auth_key=", '"private": "', "login ", "id ", "value: ", "name = '", "see ", "(", " "]
    out = []
    for i in range(n):
        front, back = rng.choice(contexts) if contexts else ("", "")
        if rng.random() < 0.5:
            front = (front + " " + rng.choice(fronts))[-BEFORE:]
        value = rng.choice(harmless if i % 2 else secrets)()
        closing = {'"': '"', "'": "'", "(": ")"}.get(front[-1:], rng.choice([" ", "\n", ".", ","]))
        if len(value) >= LEAST_CANDIDATE:
            out.append((front, value, (closing + " " + back)[:AFTER], 1 - i % 2))
    return out


def arranged(fronts: list[str], values: list[str], backs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, starts and ends of findings."""
    joined = [(f + v + b).encode("latin-1", "replace") for f, v, b in zip(fronts, values, backs, strict=True)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in joined])]).astype(np.int64)
    starts = offsets[:-1] + np.array([len(f) for f in fronts], np.int64)
    return np.frombuffer(b"".join(joined), np.uint8), offsets, starts, starts + np.array([len(v) for v in values], np.int64)


def is_held(value: str) -> bool:
    return sum(map(ord, value)) % 4 == 0


def decided_by(network: Network, margins: np.ndarray, shape: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float, floor: float) -> Model:
    """Calibration and thresholds on the findings held out: margin, shape and label of each, and how many there are."""
    points = isotonic(margins, y, n)
    p = apply_isotonic(points, margins)

    def threshold(k: int) -> float:
        own = np.flatnonzero((shape == k) & (y == 1))
        if n[own].sum() < ENOUGH:
            return max(floor, SURE)
        own = own[np.argsort(p[own], kind="stable")]
        up_to = np.cumsum(n[own])
        return max(floor, float(p[own[np.searchsorted(up_to, int((1 - recall) * up_to[-1]), side="right")]]))

    return Model(network, points, np.array([threshold(k) for k in range(4)]))


def train(findings: list[tuple[str, str, str, int]], recall: float = RECALL, floor: float = FLOOR) -> Model:
    """Fits, calibrates and sets thresholds; findings are (front, value, back, label)."""
    raw, offsets, starts, ends = arranged(*([r[i] for r in findings] for i in range(3)))
    y = np.array([r[3] for r in findings], float)
    held = np.array([is_held(v) for _, v, *_ in findings], bool)
    part = lambda own: Windows(raw, offsets, starts[own], ends[own])
    network = fit(part(~held), y[~held])
    return decided_by(network, network.margins(part(held)), shapes(raw, starts[held], ends[held]), y[held], np.ones(held.sum()), recall, floor)


FINDING = "front string, value string, back string, label int"


def with_made(findings: DataFrame, made: int, share: float = MADE_SHARE) -> DataFrame:
    """The findings and made ones, in the contexts of harmless ones of the same batch; `held` tells those kept from the fit.  Written, as it is read again and again."""
    harmless = findings.where("label = 0").count()
    share = max(share, made / max(harmless, 1))
    if not harmless:
        findings = findings.unionByName(findings.sparkSession.createDataFrame(made_findings([], made), FINDING))

    def run(batches):
        for at, batch in enumerate(batches):
            claim(None)
            cols = batch.to_pydict()
            contexts = [(f, b) for f, b, y in zip(cols["front"], cols["back"], cols["label"], strict=True) if not y] if harmless else []
            out = [*zip(*cols.values(), strict=True), *made_findings(contexts, -(-int(share * len(contexts) * 1000) // 1000), seed=len(contexts) + 1_000_003 * at + sum(map(len, cols["value"])))]
            kinds = (pa.string(),) * 3 + (pa.int32(),)
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)), pa.array([is_held(r[1]) for r in out], pa.bool_())], names=["front", "value", "back", "label", "held"])

    return cut(findings.mapInArrow(run, f"{FINDING}, held boolean"), "fit")


def averaged_round(rows: DataFrame, net: Network, weights: tuple[float, float], rate: float, seed: int) -> Network:
    """Each task's network after a pass over its findings, averaged by how many they are."""

    def run(batches):
        own, seen = net.like(net.flat()), 0
        adam, rng = Adam(own), np.random.default_rng(seed)
        for batch in batches:
            claim(None)
            cols = batch.to_pydict()
            raw, offsets, starts, ends = arranged(cols["front"], cols["value"], cols["back"])
            y = np.array(cols["label"], float)
            adam.pass_over(Windows(raw, offsets, starts, ends), y, np.where(y == 1, weights[1], weights[0]), rng.permutation(len(y)), rate)
            seen += len(y)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([own.flat().tolist()], pa.list_(pa.float64())), pa.array([float(seen)])], names=["net", "seen"])

    found = rows.mapInArrow(run, "net array<double>, seen double").select(F.posexplode("net").alias("at", "v"), "seen")
    means = found.groupBy("at").agg((F.sum(F.col("v") * F.col("seen")) / F.sum("seen")).alias("v")).collect()  # a row for each number of the network
    return net.like(np.array([r.v for r in sorted(means, key=lambda r: r.at)])) if means else net


def held_counts(rows: DataFrame, net: Network) -> np.ndarray:
    """(margin, shape, label, how many) of the findings."""

    def run(batches):
        for batch in batches:
            claim(None)
            cols = batch.to_pydict()
            raw, offsets, starts, ends = arranged(cols["front"], cols["value"], cols["back"])
            step = np.rint(np.clip(net.margins(Windows(raw, offsets, starts, ends)), -REACHED, REACHED) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(shapes(raw, starts, ends).astype(np.int32)), batch.column(3)], names=["step", "shape", "label"])

    counts = rows.mapInArrow(run, "step int, shape int, label int").groupBy("step", "shape", "label").count().orderBy("step", "shape", "label").collect()
    return np.array([(r[0] / STEPS, *r[1:]) for r in counts], float).reshape(-1, 4)


def train_on(documents: DataFrame, made: int = MADE_FINDINGS, recall: float = RECALL, floor: float = FLOOR, rate: float = 0.004) -> Model:
    """The model that all of a corpus's own findings and made ones give."""
    rows = with_made(labelled_findings(documents), made)
    counts = {r.label: r["count"] for r in rows.where("not held").groupBy("label").count().collect()}
    n = sum(counts.values())
    weights = tuple(n / max(2 * counts.get(k, 0), 1) for k in (0, 1))
    rounds = min(MOST_ROUNDS, max(ROUNDS, -(-SHOWN // max(n, 1))))
    shares = rows.where("not held").select("front", "value", "back", "label").coalesce(max(1, n // TASK_FINDINGS))
    net = Network.fresh(np.random.default_rng(5))
    for k in range(rounds):
        net = averaged_round(shares, net, weights, rate * (1 - k / rounds), k)
    margins, shape, y, held = held_counts(rows.where("held").select("front", "value", "back", "label"), net).T
    return decided_by(net, margins, shape, y, held, recall, floor)


def find_secrets(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and the spans of every document, by start, then kind; in code points."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = buffers(part.column(1))
                k, s, e = base_spans(raw, offsets)
                starts, ends = candidates(raw, offsets)
                free = ~touched(starts, ends, (s, e))
                starts, ends = starts[free], ends[free]
                p = model.scores(raw, offsets, starts, ends)
                good = p >= model.thresholds[shapes(raw, starts, ends)]
                k, s, e = np.concatenate([k, np.full(good.sum(), 3)]), np.concatenate([s, starts[good]]), np.concatenate([e, ends[good]])
                score = np.concatenate([np.ones(len(k) - good.sum()), p[good]])
                order = np.lexsort((k, s))
                k, s, e, score = k[order], s[order], e[order], score[order]
                first = np.searchsorted(s, offsets).astype(np.int32)
                chars = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])
                row = np.searchsorted(offsets, s, side="right") - 1
                line = chars[offsets[row]]
                flat = pa.StructArray.from_arrays([pa.array([KINDS[x] for x in k.tolist()], pa.string()), pa.array(chars[s] - line), pa.array(chars[e] - line), pa.array(score)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(first), flat)], names=["doc_id", "spans"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


def digest(found: DataFrame) -> DataFrame:
    """The counts and span lists of what `find_secrets` gives."""
    listed = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    base = "filter(spans, x -> x.kind != 'learned')"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(F.expr(listed.format(base)), 256).alias("base_sha256"), F.expr(listed.format("spans")).alias("spans"), counts[3])
