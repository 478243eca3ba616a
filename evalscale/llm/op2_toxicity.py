"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically.

Features of a whole text: densities of a fixed lexicon and of one learned from
the training labels (whole words, and openings of longer words, which catches
inflected and compound forms), hits near second-person words, capitals,
punctuation, digits, and signs of obfuscation (letters written as digits or
signs, masked and spaced-out words).  The trees are fitted on a sample of at most
`rows` labelled documents (see `labelled_sample`); the calibration on scores that
each third of it, dealt by a hash of the text so that copies stay together, gets
from a lexicon and trees learned on the rest.

Cases: a null text is empty and gets the score that the features of nothing get;
without labels, or with one class only, every score is the smoothed share of
toxic labels; repeated rows get equal scores; columns beyond doc_id, text and
the label are not read; no documents, no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalscale.llm.learn import SAMPLE_ROWS, Boosted, apply_isotonic, isotonic, labelled_sample
from evalscale.llm.text import ALNUM, LOWER, Lookup, Words, hash_spans, mix, slices

#: Fixed word lists.
INSULTS = (
    "idiot idiots idiotic moron morons stupid dumb fool loser losers trash garbage scum scumbag clown clowns pathetic worthless disgusting jerk creep imbecile dimwit "
    "bastard bitch asshole shit fuck fucking crap damn hate kill ugly vermin filth retard pig rat dummkopf arschloch scheisse idiota imbecil estupido basura mierda "
    "connard salaud merde abruti"
).split()
SECOND_PERSON = "you your yours youre yourself u ur ya du dich dir dein deine ihr euch tu te toi vous votre vos ti tus usted ustedes vosotros".split()

#: Openings of words that the learned lexicon looks at, in bytes; 0 is the whole word.
OPENINGS = (0, 4, 5, 6, 7, 8, 9, 10)
LEAST_DOCS = 5
FOLDS = 3
NEAR = 6

_LEET = LOWER.copy()
for _a, _b in zip(b"013457@$", b"oieastas", strict=True):
    _LEET[_a] = _b
_MASKED = ALNUM.copy()
_MASKED[np.frombuffer(b"@$", np.uint8)] = True


def _table(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


_UPPER, _DIGIT = _table(lambda b: 65 <= b <= 90), _table(lambda b: 48 <= b <= 57)
_LETTER = _table(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_PUNCT = _table(lambda b: 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126)


def opened(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with more than n bytes, and hashes of their first n; for 0 all words' own."""
    if not n:
        return np.arange(len(words.starts)), words.hashes
    at = np.flatnonzero(words.ends - words.starts > n)
    s = words.starts[at]
    return at, mix(hash_spans(words.raw, s, s + n) + np.uint64(n))


@dataclass
class Lexicon:
    """Learned entries with, for each, the toxic and clean training documents that hold it."""

    hashes: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    n_toxic: int
    n_clean: int

    def __post_init__(self):
        order = np.argsort(self.hashes)
        self.hashes, self.toxic, self.clean = self.hashes[order], self.toxic[order], self.clean[order]
        self.lookup = Lookup(self.hashes)

    def weights(self, label: int = -1) -> np.ndarray:
        """Log odds of each entry; for a training document (of label 0 or 1), without its own part in them."""
        t = self.toxic - (label == 1)
        c = self.clean - (label == 0)
        out = np.log((np.maximum(t, 0) + 0.3) / (self.n_toxic + 1)) - np.log((np.maximum(c, 0) + 0.3) / (self.n_clean + 1))
        return np.where(t >= 2, np.maximum(out, 0), 0)


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a flag or number over each row's range."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(part: pa.RecordBatch, column: int, lexicon: Lexicon, labels: np.ndarray | None = None) -> np.ndarray:
    """A row of features for each text; `labels` of those that the lexicon was learned from, -1 for others (None: all)."""
    w = Words(part.column(column), ALNUM)
    n = len(w.counts)
    raw, bytes_off, word_off = w.raw, w.offsets, w.first
    size, count = np.diff(bytes_off).astype(float), w.counts.astype(float)
    fixed, second = (Lookup(np.array([gram1(x) for x in words], np.uint64)) for words in (INSULTS, SECOND_PERSON))
    hit, you = np.zeros(len(w.starts)), np.zeros(len(w.starts), bool)
    hit[fixed.find(w.hashes)[0]] = 1
    you[second.find(w.hashes)[0]] = True
    weight = np.zeros(len(w.starts))
    rows = w.rows
    tables = np.stack([lexicon.weights(k) for k in ((-1,) if labels is None else (-1, 0, 1))])
    own = np.zeros(n, np.int64) if labels is None else labels + 1
    for length in OPENINGS:
        at, hashes = opened(w, length)
        found, index = lexicon.lookup.find(hashes)
        at = at[found]
        np.maximum.at(weight, at, tables[own[rows[at]], index])
    strong = (weight >= 2) | (hit > 0)
    top = np.zeros(n)
    np.maximum.at(top, rows, weight)
    # distance of each strong word to the nearest second-person word of its row
    spots, asked = np.flatnonzero(you), np.flatnonzero(strong)
    gap = np.full(len(asked), 50.0)
    for shift in (-1, 0):
        i = np.searchsorted(spots, asked) + shift
        good = (i >= 0) & (i < len(spots))
        other = spots[np.clip(i, 0, max(len(spots) - 1, 0))] if len(spots) else np.zeros(len(asked), int)
        good &= rows[other] == rows[asked] if len(asked) and len(rows) else good
        gap = np.where(good, np.minimum(gap, np.abs(other - asked)), gap)
    nearest = np.full(n, 50.0)
    np.minimum.at(nearest, rows[asked], gap)
    near = np.bincount(rows[asked][gap <= NEAR], minlength=n) if len(asked) else np.zeros(n)
    # obfuscation: signs for letters, masks inside words, single letters in a row
    o = Words(part.column(column), _MASKED, hashes=False)
    plain = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_LETTER[raw], out=plain[1:])
    letters = plain[o.ends] - plain[o.starts]
    odd = np.flatnonzero((letters > 0) & (letters < o.ends - o.starts))
    disguised = np.zeros(len(o.starts))
    if len(odd):
        hashes = hash_spans(_LEET[raw], o.starts[odd], o.ends[odd])
        known = np.zeros(len(odd), bool)
        known[fixed.find(hashes)[0]] = True
        found, index = lexicon.lookup.find(hashes)
        known[found[tables[0][index] >= 2]] = True
        disguised[odd[known]] = 1
    star = raw == 42
    masked = np.zeros(len(raw))
    if len(raw) > 2:
        inner = _LETTER[raw]
        masked[1:-1] = star[1:-1] & inner[:-2] & (inner[2:] | star[2:])
    single = w.ends - w.starts == 1
    spaced = np.zeros(len(single))
    if len(single) > 2:
        spaced[1:-1] = single[1:-1] & single[:-2] & single[2:]
    upper = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_UPPER[raw], out=upper[1:])
    capital = (upper[w.ends] - upper[w.starts] == w.ends - w.starts) & (w.ends - w.starts >= 3)
    bang = (raw == 33) | (raw == 63)
    doubled = np.zeros(len(raw))
    if len(raw) > 1:
        doubled[1:] = bang[1:] & bang[:-1]
    w_sum = lambda v: per_row(v, word_off)
    b_sum = lambda v: per_row(v, bytes_off)
    per_word, per_byte = count + 1, size + 1
    hits, two, three = w_sum(hit), w_sum(weight >= 2), w_sum(weight >= 3)
    return np.stack(
        [
            np.log1p(count), np.log1p(size), hits / per_word, np.log1p(hits), w_sum(weight) / (count + 5), top, np.log1p(two), two / per_word, np.log1p(three), three / per_word,
            w_sum(you) / per_word, near / per_word, np.log1p(near), nearest, b_sum(_UPPER[raw]) / per_byte, w_sum(capital) / per_word, b_sum(raw == 33) / per_byte, b_sum(raw == 63) / per_byte,
            b_sum(doubled) / per_byte, b_sum(_PUNCT[raw]) / per_byte, b_sum(_DIGIT[raw]) / per_byte, per_row(disguised, o.first) / per_word, np.log1p(per_row(disguised, o.first)),
            b_sum(masked) / per_word, w_sum(spaced) / per_word, b_sum(raw >= 128) / per_byte, size / per_word,
        ],
        axis=1,
    )


def gram1(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hash_spans(raw, np.array([0]), np.array([len(raw)]))[0])


def entry_counts(sample: DataFrame, label: int, wanted: Lookup | None, least: int) -> dict[int, list[int]]:
    """Documents of a class that hold each entry, by fold; of the wanted entries, or of all with at least `least`."""

    def run(batches):
        total_h, total_n = np.zeros(0, np.uint64), np.zeros((0, FOLDS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(0), ALNUM)
                rows, held, fold = w.rows, [], part.column(1).to_numpy(zero_copy_only=False)
                for n in OPENINGS:
                    at, hashes = opened(w, n)
                    if wanted is not None:
                        keep, _ = wanted.find(hashes)
                        at, hashes = at[keep], hashes[keep]
                    held.append((rows[at], hashes))
                own, every = (np.concatenate([x[i] for x in held]) for i in (0, 1))
                order = np.lexsort((every, own))
                own, every = own[order], every[order]
                fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (every[1:] != every[:-1])])[: len(every)]
                before = len(total_h)
                total_h, inverse = np.unique(np.concatenate([total_h, every[fresh]]), return_inverse=True)
                counts = np.zeros((len(total_h), FOLDS), np.int64)
                counts[inverse[:before]] = total_n
                np.add.at(counts, (inverse[before:], fold[own[fresh]]), 1)
                total_n = counts
        yield pa.RecordBatch.from_arrays([pa.array(total_h.view(np.int64)), *[pa.array(total_n[:, k]) for k in range(FOLDS)]], names=["h", *folds])

    folds = [f"n{k}" for k in range(FOLDS)]
    rows = sample.where(F.col("label") == label).select("text", "fold").mapInArrow(run, "h long, " + ", ".join(f"{n} long" for n in folds)).groupBy("h").agg(*[F.sum(n).alias(n) for n in folds])
    total = sum(F.col(n) for n in folds)
    rows = rows.where(total >= least)
    if wanted is None:
        rows = rows.orderBy(total.desc(), "h").limit(50_000)  # of a bounded sample
    return {r.h & (1 << 64) - 1: [r[n] for n in folds] for r in rows.collect()}


def learn_lexicons(sample: DataFrame, least: int = LEAST_DOCS) -> list[Lexicon]:
    """The lexicon of the whole sample (with columns text, label, fold), and those of all but each fold."""
    sizes = np.zeros((2, FOLDS), np.int64)
    for r in sample.where("label in (0, 1)").groupBy("label", "fold").count().collect():
        sizes[r.label, r.fold] = r["count"]
    toxic = entry_counts(sample, 1, None, least)
    hashes = np.array(list(toxic), np.uint64)
    clean = entry_counts(sample, 0, Lookup(hashes), 1) if len(hashes) else {}
    t = np.array(list(toxic.values()), np.int64).reshape(-1, FOLDS)
    c = np.array([clean.get(h, [0] * FOLDS) for h in toxic], np.int64).reshape(-1, FOLDS)

    def without(fold: int | None) -> Lexicon:
        own = np.arange(FOLDS) != (FOLDS if fold is None else fold)
        n_toxic, n_clean = (int(x) for x in sizes[::-1][:, own].sum(1))
        every = Lexicon(hashes, t[:, own].sum(1), c[:, own].sum(1), n_toxic, n_clean)
        keep = (every.weights() >= 1.5) & (every.toxic >= least)
        return Lexicon(every.hashes[keep], every.toxic[keep], every.clean[keep], n_toxic, n_clean)

    return [without(None), *[without(k) for k in range(FOLDS)]]


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted | None
    points: tuple[np.ndarray, np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.prior) if self.trees is None else apply_isotonic(self.points, self.trees.margin(x))


def train(documents: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int = SAMPLE_ROWS) -> Model:
    sample = labelled_sample(documents, labels, label, keep, rows).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    lexicons = learn_lexicons(sample)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                own, fold = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                known = [own, *[np.where(fold == k, -1, own) for k in range(FOLDS)]]
                x = np.concatenate([features(part, 1, lexicon, y) for lexicon, y in zip(lexicons, known, strict=True)], axis=1)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in (0, 2, 3)], pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "fold", "x"])

    # at most `rows`: the sample has one row per doc_id
    held = sample.select("doc_id", "text", "label", "fold").mapInArrow(run, "doc_id long, label int, fold int, x array<double>").collect()
    held.sort(key=lambda r: r.doc_id)
    y, fold = np.array([r.label for r in held], float), np.array([r.fold for r in held])
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return Model(lexicons[0], None, (np.zeros(1), np.zeros(1)), float(prior))
    views = np.split(np.array([r.x for r in held]), FOLDS + 1, axis=1)
    out = np.zeros(len(y))
    for k, x in enumerate(views[1:]):
        if len(set(y[fold != k].tolist())) == 2 and (fold == k).any():
            out[fold == k] = Boosted().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(lexicons[0], Boosted().fit(views[0], y), isotonic(out, y), float(prior))


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(features(part, 1, model.lexicon)))], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(documents: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                yield part.filter(pa.array(model.score(features(part, at, model.lexicon)) < threshold))

    return documents.mapInArrow(run, documents.schema)
