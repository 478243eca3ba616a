"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad.  Its features are its own shape (length, capitals,
signs, digits, cell bars, repeated words, closing marks, words seen before) and
the same of the lines before and after it; neighbouring labels are tied by
transition weights.  The field is trained by gradient ascent on the likelihood of
line labels taken from their document's label, over a sample of at most `rows`
labelled documents (in hash order up to `lines` lines, whatever their lengths; while
it is fitted, a text is several chains of at most `chain` lines), then once more with the lines that the first field finds good
in bad documents left to it.  A document's score is the share of its text, by
length, that the forward-backward marginals call good, through a logistic scale
fitted on a fifth of the sample, dealt by a hash of the text, that the field is not.

Cases: null and empty texts have one empty line; without labels or with one class
every score is the smoothed share of good labels; repeated rows score equally;
other columns are not read; no documents, no rows.  Lines of a text are handled
in one pass, so a task's memory follows its longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalscale.llm.learn import SAMPLE_ROWS, labelled_sample, platt
from evalscale.llm.op10_lines import Lines as TextLines
from evalscale.llm.text import SPACED, Words, slices

STEPS, RATE, RIDGE = 120, 0.12, 1e-3
#: Lines that the field is fitted on, at most (the driver holds their features, about 1 KB each), and those of one chain.
LINES, CHAIN = 200_000, 400
#: One document in so many of the sample calibrates the scores instead.
CALIBRATION = 5
SIGNS = b"#$%&*+<=>@[\\]^_`{}~"


def _flags(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


_UPPER, _LOWER = _flags(lambda b: 65 <= b <= 90), _flags(lambda b: 97 <= b <= 122 or b >= 128)
_DIGIT, _SIGN, _BAR = _flags(lambda b: 48 <= b <= 57), _flags(lambda b: b in SIGNS), _flags(lambda b: b == 124)
_LOUD, _END, _POINT = _flags(lambda b: b in b"!?"), _flags(lambda b: b in b".!?:;\"'"), _flags(lambda b: b in b".,;:()-'\"")


class Lines:
    """Lines of a column's texts with their features; an empty text has one empty line."""

    def __init__(self, column: pa.Array):
        chunks = TextLines(column)
        raw = chunks.raw
        empty = chunks.n_lines == 0
        counts = np.where(empty, 1, chunks.n_lines)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        n = int(self.first[-1])
        starts, stops = np.zeros(n, np.int64), np.zeros(n, np.int64)
        real = np.ones(n, bool)
        real[self.first[:-1][empty]] = False
        starts[real], stops[real] = chunks.starts, chunks.stops
        self.length = (stops - starts).astype(float)
        rows = np.repeat(np.arange(len(counts)), counts)

        def total(flags: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(raw) + 1, np.int64)
            np.cumsum(flags, out=sums[1:])
            return (sums[stops] - sums[starts]).astype(float)

        words = Words(column, SPACED)
        order = np.argsort(starts[real], kind="stable")
        line_of = np.flatnonzero(real)[order][np.searchsorted(starts[real][order], words.starts, side="right") - 1] if len(words.starts) else np.zeros(0, np.int64)
        n_words = np.bincount(line_of, minlength=n).astype(float)
        # words that the line, and that the text, has had before
        by = np.lexsort((words.starts, words.hashes, words.rows))
        h, r = words.hashes[by], words.rows[by]
        again = np.zeros(len(by))
        again[by[1:]] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
        by = np.lexsort((words.starts, words.hashes, line_of))
        h, r = words.hashes[by], line_of[by]
        inside = np.zeros(len(by))
        inside[by[1:]] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
        long = (words.ends - words.starts).astype(float)
        size, many = self.length + 1, n_words + 1
        closing = np.zeros(n)
        full = stops > starts
        closing[full] = _END[raw[stops[full] - 1]]
        opening = np.zeros(n)
        opening[full] = _UPPER[raw[starts[full]]] | (raw[starts[full]] >= 0xC3)
        upper = total(_UPPER[raw])
        own = np.stack(
            [
                np.log1p(self.length), np.log1p(n_words), upper / (upper + total(_LOWER[raw]) + 1), total(_DIGIT[raw]) / size, total(_SIGN[raw]) / size, total(_BAR[raw]) / many, total(_LOUD[raw]) / many,
                total(_POINT[raw]) / many, np.bincount(line_of, inside, n) / many, np.bincount(line_of, again, n) / many, np.bincount(line_of, long, n) / many,
                np.bincount(line_of, (long > 20), n) / many, closing, opening, (n_words <= 2).astype(float), np.minimum(total(_SIGN[raw]), 3), np.log1p(np.bincount(line_of, inside, n)),
            ],
            axis=1,
        )
        same = rows[1:] == rows[:-1]
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
        edge = np.stack([np.concatenate([[1.0], ~same]), np.concatenate([~same, [1.0]])], 1) if n else np.zeros((0, 2))
        self.x = np.concatenate([own, own * own, before, after, edge], axis=1)


def steps_of(first: np.ndarray) -> list[np.ndarray]:
    """Line numbers by place in their document: step t has the t-th lines of all documents that long."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    starts, sizes = first[:-1][order], counts[order]
    return [starts[: int(np.searchsorted(-sizes, -t, side="left"))] + t for t in range(int(counts.max(initial=0)))]


def forward_backward(unary: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the two labels of each line, and summed marginals of label pairs (in log space)."""
    steps = steps_of(first)
    alpha, beta = unary.copy(), np.zeros_like(unary)
    for prev, now in zip(steps, steps[1:], strict=False):
        a = alpha[prev[: len(now)]]
        alpha[now] += np.logaddexp(a[:, :1] + pair[0], a[:, 1:] + pair[1])
    for now, prev in zip(steps[::-1], steps[-2::-1], strict=False):
        b = (beta[now] + unary[now])[:, None, :] + pair[None]
        beta[prev[: len(now)]] = np.logaddexp(b[:, :, 0], b[:, :, 1])
    both = alpha + beta
    norm = np.logaddexp(both[:, 0], both[:, 1])
    pairs = np.zeros((2, 2))
    for prev, now in zip(steps, steps[1:], strict=False):
        p = prev[: len(now)]
        joint = alpha[p][:, :, None] + pair[None] + (beta[now] + unary[now])[:, None, :] - norm[p][:, None, None]
        pairs += np.exp(joint).sum(0)
    return np.exp(both - norm[:, None]), pairs


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    pair: np.ndarray
    logistic: tuple[float, float]
    prior: float
    fitted: bool = True

    def unary(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        good = z @ self.weights[:-1] + self.weights[-1]
        return np.stack([np.zeros(len(z)), good], 1)

    def raw_score(self, lines: Lines) -> np.ndarray:
        """Share of each text, by length, that is good."""
        marginal, _ = forward_backward(self.unary(lines.x), self.pair, lines.first)
        weight = lines.length + 1
        return np.add.reduceat(marginal[:, 1] * weight, lines.first[:-1]) / np.add.reduceat(weight, lines.first[:-1])

    def score(self, lines: Lines) -> np.ndarray:
        if not self.fitted:
            return np.full(len(lines.first) - 1, self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logistic[0] * logit(self.raw_score(lines)) + self.logistic[1], -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_lines(field: Field, x: np.ndarray, first: np.ndarray, y: np.ndarray, known: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> None:
    """Adam on the likelihood of line labels y where known; the other lines are summed over (their label is free)."""
    z = np.ones((len(x), x.shape[1] + 1))
    own = z[:, :-1]
    np.subtract(x, field.mean, out=own)
    np.divide(own, field.scale, out=own)
    np.clip(own, -6, 6, out=own)
    clamp = np.zeros((len(z), 2))
    clamp[known, 1 - y[known].astype(int)] = -30.0
    theta = np.concatenate([field.weights, field.pair.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = weight.sum()
    for t in range(1, steps + 1):
        good = z @ theta[:-4]
        unary, pair = np.stack([np.zeros(len(z)), good], 1), theta[-4:].reshape(2, 2)
        free, free_pairs = forward_backward(unary, pair, first)
        held, held_pairs = forward_backward(unary + clamp, pair, first)
        grad = np.concatenate([z.T @ ((held[:, 1] - free[:, 1]) * weight) / total, ((held_pairs - free_pairs) / len(z)).ravel()]) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    field.weights, field.pair = theta[:-4], theta[-4:].reshape(2, 2)


def within(sample: DataFrame, rows: int, lines: int) -> DataFrame:
    """The sample's first rows in hash order, whatever their lengths, up to `lines` lines in all; `most` are those that a row may give."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    sizes = sample.select(order[0].alias("h"), "doc_id", n_lines.alias("n")).orderBy("h", "doc_id", "n").limit(rows).collect()
    used, last = 0, None
    for k, r in enumerate(sizes, 1):
        last, left, used = r, lines - used, used + r.n
        if used >= lines:
            break
    if last is None:
        return sample.withColumn("most", F.lit(lines).cast("long"))
    same = sum(r.doc_id == last.doc_id for r in sizes[:k])
    before = sample.where((order[0] < last.h) | (order[0] == last.h) & (F.col("doc_id") < last.doc_id)).withColumn("most", F.lit(lines).cast("long"))
    final = sample.where((order[0] == last.h) & (F.col("doc_id") == last.doc_id)).orderBy(n_lines).limit(same)
    return before.unionByName(final.withColumn("most", F.lit(left).cast("long")))


def chains(first: np.ndarray, most: int) -> np.ndarray:
    """The same bounds with texts of more than `most` lines cut into several chains."""
    return np.unique(np.concatenate([first, *(np.arange(a, b, most) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) if b - a > most)]))


def train(documents: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int = SAMPLE_ROWS, lines: int = LINES, chain: int = CHAIN) -> Field:
    """A field fitted on at most `rows` labelled documents and `lines` lines of them, in chains of at most `chain` lines."""
    sample = within(labelled_sample(documents, labels, label, keep, rows).select("doc_id", "text", "label"), rows, lines)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = Lines(part.column(1))
                bounds = [(a, min(b, a + most)) for a, b, most in zip(found.first[:-1], found.first[1:], part.column(3).to_pylist(), strict=True)]
                own = [found.x[a:b].astype(np.float32).tobytes() for a, b in bounds]
                size = [found.length[a:b].astype(np.float32).tobytes() for a, b in bounds]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(own, pa.binary()), pa.array(size, pa.binary()), part.column(4)], names=["doc_id", "label", "x", "size", "apart"])

    # features of at most `lines` lines: what is sent to the driver is bounded
    apart = F.pmod(F.xxhash64("text"), F.lit(CALIBRATION)) == 0
    held = sample.select("doc_id", "text", "label", "most", apart.alias("apart")).mapInArrow(run, "doc_id long, label int, x binary, size binary, apart boolean").collect()
    held.sort(key=lambda r: r.doc_id)
    y = np.array([r.label for r in held], float)
    prior = float((y.sum() + 1) / (len(y) + 2))
    if len(set(y.tolist())) < 2:
        return Field(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros((2, 2)), (1.0, 0.0), prior, False)
    both = [[r for r in held if r.apart], [r for r in held if not r.apart]]
    if any(len({r.label for r in part}) < 2 for part in both):  # too few to set some apart
        both = [held, held]
    del held
    field = fit(*lines_of(both[1]), prior, chain)
    x, first, length, y = lines_of(both[0])
    field.logistic = platt(logit(document_scores(field, x, first, length)), y)
    return field


def lines_of(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, bounds of the documents, line lengths and document labels."""
    sizes = [np.frombuffer(r.size, np.float32).astype(float) for r in held]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
    length = np.concatenate(sizes)
    return np.concatenate([np.frombuffer(r.x, np.float32) for r in held]).reshape(len(length), -1), first, length, np.array([r.label for r in held], float)


def fit(x: np.ndarray, first: np.ndarray, length: np.ndarray, y: np.ndarray, prior: float, chain: int) -> Field:
    field = Field(x.mean(0, dtype=float), x.std(0, dtype=float) + 1e-6, np.zeros(x.shape[1] + 1), np.zeros((2, 2)), (1.0, 0.0), prior)
    line_y = np.repeat(y, np.diff(first))
    share = np.array([y.mean(), 1 - y.mean()])
    weight = np.log1p(length) * np.where(line_y == 1, 0.5 / share[0], 0.5 / share[1])
    linked = chains(first, chain)
    fit_lines(field, x, linked, line_y, np.ones(len(x), bool), weight)
    marginal, _ = forward_backward(field.unary(x), field.pair, first)
    worst = np.minimum.reduceat(marginal[:, 1], first[:-1])
    doubtful = (line_y == 0) & (marginal[:, 1] > 0.8) & (np.repeat(worst, np.diff(first)) < 0.5)
    fit_lines(field, x, linked, line_y, ~doubtful, weight, STEPS // 2)
    return field


def document_scores(field: Field, x: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    marginal, _ = forward_backward(field.unary(x), field.pair, first)
    return np.add.reduceat(marginal[:, 1] * (length + 1), first[:-1]) / np.add.reduceat(length + 1, first[:-1])


def score_documents(documents: DataFrame, field: Field) -> DataFrame:
    """doc_id and score of every document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(field.score(Lines(part.column(1))))], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
