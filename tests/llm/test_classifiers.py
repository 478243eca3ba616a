import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalscale.llm import learn, op2_toxicity, op8_quality


def test_isotonic_and_platt():
    rng = np.random.default_rng(0)
    x = rng.normal(size=2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * x))).astype(float)
    points = learn.isotonic(x, y)
    out = learn.apply_isotonic(points, np.sort(x))
    assert np.all(np.diff(out) >= 0) and 0 <= out.min() and out.max() <= 1
    assert np.abs(out - 1 / (1 + np.exp(-2 * np.sort(x)))).mean() < 0.06
    a, b = learn.platt(x, y)
    assert abs(a - 2) < 0.3 and abs(b) < 0.2


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 5))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = learn.Boosted(trees=40).fit(x[:2000], y[:2000])
    assert ((model.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    assert np.isfinite(learn.Boosted(trees=3).fit(np.zeros((4, 2)), np.array([0, 1, 0, 1.0])).margin(np.zeros((1, 2)))).all()


def chain(unary, pair):
    """Marginals by listing all label sequences."""
    import itertools

    n, total, out, pairs = len(unary), 0.0, np.zeros((len(unary), 2)), np.zeros((2, 2))
    for labels in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(unary[i, y] for i, y in enumerate(labels)) + sum(pair[a, b] for a, b in itertools.pairwise(labels)))
        total += w
        for i, y in enumerate(labels):
            out[i, y] += w
        for a, b in itertools.pairwise(labels):
            pairs[a, b] += w
    return out / total, pairs / total


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    sizes = [1, 5, 3, 1, 7]
    first = np.concatenate([[0], np.cumsum(sizes)])
    unary, pair = rng.normal(size=(first[-1], 2)), rng.normal(size=(2, 2))
    marginal, pairs = op8_quality.forward_backward(unary, pair, first)
    want = [chain(unary[a:b], pair) for a, b in zip(first, first[1:], strict=False)]
    assert np.allclose(marginal, np.concatenate([w[0] for w in want])) and np.allclose(pairs, sum(w[1] for w in want))


def corpus(seed=0, n=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic, good = rng.random() < 0.25, rng.random() < 0.6
        lines = []
        for _ in range(rng.randint(2, 6)):
            words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 15))]
            if toxic:
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "worthless", "scum", "zorgfull"]))
            lines.append(" ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words))
        docs.append((i, "\n".join(lines), "clash"))
        labels.append((i, int(toxic), int(good)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame([*docs, (9000, None, "c"), (9001, "", "c"), docs[0]], "doc_id long, text string, score string"), spark.createDataFrame([*labels, labels[0], (None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")


@pytest.mark.parametrize("module, label, least", [(op2_toxicity, "toxic", 0.93), (op8_quality, "quality", 0.95)])
def test_held_out_accuracy(spark, tables, module, label, least):
    docs, labels = tables
    model = module.train(docs, labels, label, F.col("doc_id") % 4 != 0)
    scores = {}
    for r in module.score_documents(docs, model).collect():
        scores.setdefault(r.doc_id, []).append(r.score)
    assert len(scores) == 402 and len(scores[0]) == 2 and len(set(scores[0])) == 1 and all(0 <= s <= 1 for own in scores.values() for s in own)
    held = {r.doc_id: r[label] for r in labels.where("doc_id % 4 = 0").dropna().collect()}
    assert np.mean([(scores[d][0] > 0.5) == bool(y) for d, y in held.items()]) >= least


@pytest.mark.parametrize("module", [op2_toxicity, op8_quality])
def test_one_class_no_labels_no_documents(spark, tables, module):
    docs, labels = tables[0].dropDuplicates(["doc_id"]), tables[1]
    for few, score in ((labels.where("quality = 1 and doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(3), 4 / 5), (labels.limit(0), 0.5)):
        model = module.train(docs, few, "quality", F.lit(True))
        assert {round(r.score, 9) for r in module.score_documents(docs, model).collect()} == {score}
    assert module.score_documents(docs.limit(0), model).count() == 0


def test_quality_is_fitted_on_long_documents(spark):
    docs = [(i, "\n".join(["A line of plain words."] * 1000 if i % 2 else ["AAA $$$ AAA!!"] * 1000), "c") for i in range(12)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    field = op8_quality.train(docs, labels, "quality", F.lit(True))
    assert field.fitted and field.prior == 7 / 14
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in op8_quality.score_documents(docs, field).collect())


def test_lines_of_the_sample_are_bounded_in_hash_order(spark):
    sample = spark.createDataFrame([(i, "x\n" * (i * i), i % 2) for i in range(20)], "doc_id long, text string, label int")
    order = [r.doc_id for r in sample.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    for rows, lines in ((20, 10**6), (7, 10**6), (20, 300), (20, 1)):
        got = {r.doc_id: min(r.most, r.doc_id**2 + 1) for r in op8_quality.within(sample, rows, lines).collect()}
        assert set(got) == set(order[: len(got)]) and sum(got.values()) <= lines
        assert len(got) == rows or sum(got.values()) == lines
    assert op8_quality.within(sample.limit(0), 5, 5).count() == 0
    assert op8_quality.chains(np.array([0, 3, 10, 12]), 3).tolist() == [0, 3, 6, 9, 10, 12]


def test_the_sample_has_one_text_per_id_and_no_more_rows_than_asked(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(5000)] + [(i, None if i == 3 else f"own {i}") for i in range(2, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] * 2 + [(1, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    for rows in (2, 8, 100):
        got = learn.labelled_sample(docs, labels, "toxic", F.lit(True), rows).collect()
        assert len(got) == len({r.doc_id for r in got}) == min(rows, 8)
    assert {r.doc_id: (r.text, r.label) for r in got} == {1: ("text 0", 1), 3: ("", 1), **{i: (f"own {i}", i % 2) for i in (2, 4, 5, 6, 7, 8)}}


def test_lexicons_leave_their_fold_out(spark):
    """Counts by fold against plain sets of words; copies of a text are in one fold."""
    docs, labels = corpus(3, 300)
    known = {d: t for d, t, _ in labels}
    rows = spark.createDataFrame([(t, known[d]) for d, t, _ in docs] + [(docs[0][1], known[0])] * 3, "text string, label int").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(op2_toxicity.FOLDS)).cast("int"))
    held = rows.collect()
    for fold, lexicon in zip([None, 0, 1, 2], op2_toxicity.learn_lexicons(rows), strict=True):
        own = [r for r in held if r.fold != fold]
        assert (lexicon.n_toxic, lexicon.n_clean) == (sum(r.label == 1 for r in own), sum(r.label == 0 for r in own))
        index = int(np.flatnonzero(lexicon.hashes == np.uint64(op2_toxicity.gram1("idiot")))[0])
        counts = [sum("idiot" in r.text.lower().replace("!", "").replace(".", "").split() for r in own if r.label == y) for y in (1, 0)]
        assert [lexicon.toxic[index], lexicon.clean[index]] == counts


def test_toxicity_signs():
    lexicon = op2_toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 1)
    texts = ["you idiot", "some idiot far away from any of those who might be meant by you", "1d1ot", "i d i o t", "id*ot", "FINE DAY!!", "", None]
    part = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    x = op2_toxicity.features(part, 0, lexicon)
    assert x.shape == (8, 27) and np.isfinite(x).all() and np.array_equal(x[6], x[7])
    assert x[0, 3] > 0 and x[0, 12] > 0 and x[1, 12] == 0 and x[1, 13] > 6  # nearness to second persons
    assert x[2, 22] > 0 and x[3, 24] > 0 and x[4, 23] > 0 and x[5, 15] > 0 and x[5, 18] > 0
