import hashlib
import random
import re

import numpy as np
import pytest

from evalscale.llm import op12_secrets as op

DOCS = "doc_id long, text string, spans string, score int"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return [(op.KINDS[k], a, b) for a, k, b in sorted(found)]


def cut_out(text):
    """Candidates, by regular expressions."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_.-]{12,}", text or ""):
        a, b = m.start() + len(m[0]) - len(m[0].lstrip(".")), m.end() - len(m[0]) + len(m[0].rstrip("."))
        signs = len(re.match("=*", text[b:])[0])
        if b > a and signs <= 2 and not re.match("=+[A-Za-z0-9+/_.-]", text[b:]):
            b += signs
        if b - a >= 12:
            out.append((a, b))
    return out


PIECES = [
    "password", "Passwd", "ſecret", "secret", "TOKEN", "api_key", "apikey", "apiKey", '"', "'", " ", "   ", ":", "=", "==", ".", "....", "\n", "é", "日本語", "AKIA", "AKIAAKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef",
    "AbC-12_34.56", "longlowercaseword", "x", "/path/to/some/where.html", "aGVsbG8gd29ybGQ", "K", "_", "+",
]


def texts(seed, n=300):
    rng = random.Random(seed)
    return [None, "", "=", "." * 40, "a" * 12 + "=", "a" * 12 + "===", *["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(n)]]


def sliced(rows):
    raw = [(t or "").encode() for t in rows]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


@pytest.mark.parametrize("seed", range(3))
def test_candidates_and_base_spans_against_expressions(seed):
    rows = texts(seed)
    raw, offsets = sliced(rows)
    want = [(a, b) for o, t in zip(offsets, rows, strict=False) for a, b in [(o + len(t[:x].encode()), o + len(t[:y].encode())) for x, y in cut_out(t)]]
    assert list(zip(*(x.tolist() for x in op.candidates(raw, offsets)), strict=True)) == want
    kind, s, e = op.base_spans(raw, offsets)
    want = sorted((k, int(o) + len(t[:a].encode()), int(o) + len(t[:b].encode())) for o, t in zip(offsets, rows, strict=False) for k, a, b in base(t))
    assert sorted((op.KINDS[k], a, b) for k, a, b in zip(kind.tolist(), s.tolist(), e.tolist(), strict=True)) == want
    spans = np.array([3, 9, 9]), np.array([5, 9, 12])
    assert op.touched(np.array([0, 4, 5, 11, 12]), np.array([3, 6, 9, 12, 20]), spans).tolist() == [False, True, False, True, False]


def test_gradients_against_differences():
    raw, offsets = sliced(["key = Ab12Cd34Ef56 end", "plainwordsonly", "x 123456789012345"])
    starts, ends = op.candidates(raw, offsets)
    windows, y, weight = op.Windows(raw, offsets, starts, ends), np.array([1.0, 0, 0]), np.array([2.0, 0.5, 1])
    net = op.Network.fresh(np.random.default_rng(1), 6, 5)
    for name in ("filters", "offset", "hidden", "hidden_offset", "out", "out_offset"):
        setattr(net, name, getattr(net, name).astype(np.float64))

    def loss():
        m = net.margins(windows)
        return float((weight * (np.log1p(np.exp(m)) - y * m)).mean())

    batch = windows.take(0, 3)
    net.pooled = lambda *x: pooled64(net, *x)
    grads = net.gradients(*batch, y, weight)
    rng = np.random.default_rng(2)
    for field, grad in zip((net.filters, net.offset, net.hidden, net.hidden_offset, net.out, net.out_offset), grads, strict=True):
        some = np.flatnonzero(np.abs(grad.ravel()) > 1e-4)
        for i in rng.choice(some, min(8, len(some)), replace=False):
            keep, flat = field.ravel()[i], field.reshape(-1)
            flat[i] = keep + 1e-5
            up = loss()
            flat[i] = keep - 1e-5
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-5 - grad.ravel()[i]) < 2e-3 * max(1, abs(grad.ravel()[i]))


def pooled64(net, ids, bounds, size):
    values = net.convolved(ids)
    parts = [values[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    return np.array([np.concatenate([parts[3 * i].max(0), parts[3 * i + 1].max(0), parts[3 * i + 2].max(0), parts[3 * i + 1].sum(0) / size[i], [np.log2(size[i]) / 8]]) for i in range(len(size))])


def test_pooling_in_blocks_is_pooling_at_once(monkeypatch):
    rows = [t for t in texts(7) if t] + ["A1b2" * 500]
    raw, offsets = sliced(rows)
    starts, ends = op.candidates(raw, offsets)
    windows, net = op.Windows(raw, offsets, starts, ends), op.Network.fresh(np.random.default_rng(3))
    want = pooled64(net, *windows.take(0, len(starts)))
    once = net.margins(windows)
    assert np.allclose(net.pooled(*windows.take(0, len(starts))), want, atol=1e-4)
    for block in (37, 400):
        monkeypatch.setattr(op, "BLOCK", block)
        assert np.allclose(net.pooled(*windows.take(0, len(starts))), want, atol=1e-4) and np.allclose(net.margins(windows), once, atol=1e-3)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    words = lambda: " ".join("".join(rng.choice("abdeinorst") for _ in range(rng.randint(2, 14))) for _ in range(4))
    contexts = [(words()[-op.BEFORE :], words()[: op.AFTER]) for _ in range(300)]
    return op.train(op.made_findings(contexts, 3000)), contexts


def test_unseen_secrets_are_found_and_lookalikes_left(model):
    net, contexts = model
    made = op.made_findings(contexts, 2000, seed=77)
    joined = [(f + v + b).encode("latin-1", "replace") for f, v, b, _ in made]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in joined])]).astype(np.int64)
    starts = offsets[:-1] + np.array([len(f) for f, *_ in made])
    ends = starts + np.array([len(v) for _, v, *_ in made])
    raw, y = np.frombuffer(b"".join(joined), np.uint8), np.array([r[3] for r in made])
    hit = net.scores(raw, offsets, starts, ends) >= net.thresholds[op.shapes(raw, starts, ends)]
    assert hit[y == 1].mean() >= 0.93 and hit[y == 0].mean() <= 0.03


def test_a_threshold_keeps_the_recall_it_is_asked_for(model):
    made = op.made_findings(model[1], 1500, seed=5)
    strict, loose = op.train(made, recall=0.5, floor=0.0), op.train(made, recall=1.0, floor=0.0)
    assert (strict.thresholds[1:] >= loose.thresholds[1:]).all() and (strict.thresholds > loose.thresholds).any()


def test_documents(spark, model):
    hidden = "ghp_9fKq2LmX7vTzR4bYw8NcJp3sDe6HuA1g"
    rows = [*texts(9, 80), f"first line\nuse {hidden} to log in, é {hidden}.", "nothing but quiet words, internationalisation included", "Zq9" * 1_000_000, "word " * 600_000]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(rows)] + [(None, rows[-4], "c", 2), (3, rows[5], "c", 2)], DOCS)
    found = op.find_secrets(docs, model[0])
    held = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans], [s.score for s in r.spans]) for r in found.collect()]
    assert len(held) == len(rows) + 2
    for i, spans, scores in held:
        text = rows[-4] if i is None else rows[i] if (i, spans) != (3, base(rows[5])) else rows[5]
        assert [s for s in spans if s[0] != "learned"] == base(text) and spans == sorted(spans, key=lambda s: (s[1], op.KINDS.index(s[0]))) and all(0 <= x <= 1 for x in scores)
        added = [s for s in spans if s[0] == "learned"]
        assert {s[1:] for s in added} <= set(cut_out(text)) and not any(a < e and s < b for _, a, b in added for _, s, e in base(text))
    spans = {i: s for i, s, _ in held}
    at = rows[-4].index(hidden)
    assert ("learned", at, at + len(hidden)) in spans[len(rows) - 4] == spans[None] and not spans[len(rows) - 3]
    got = {r.doc_id: r for r in op.digest(found).collect()}[len(rows) - 4]
    assert (got.n_assign, got.n_access, got.n_hex, got.n_learned) == (0, 0, 0, 2) and got.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans[None])


def test_findings_of_a_corpus(spark):
    rows = ['set token = "f0ddae3b09ae356cbefecdd3232fa5489bb400d6" here', "internationalisation of 4994226020900891 things", None] * 5
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(rows)], DOCS)
    got = sorted(tuple(r) for r in op.labelled_findings(docs).collect())
    assert got == [("", "internationalisation", " of 499422602090", 0), ('set token = "', "f0ddae3b09ae356cbefecdd3232fa5489bb400d6", '" here', 1)]
    assert op.labelled_findings(docs, rows=2).count() == 2
    none = spark.createDataFrame([], DOCS)
    model = op.train_on(none, made=400)
    assert op.digest(op.find_secrets(none, model)).count() == 0


def test_every_document_counts_in_training(spark):
    rows = [f'token = "aB3dE5fG7hJ9k{i:04d}" and documentation_of_part_{i:04d} here' for i in range(700)]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(rows)], DOCS)
    own = op.labelled_findings(docs)
    assert own.count() == 1400
    fitted = op.with_made(own, 800)
    kept = {r.label: r["count"] for r in fitted.join(own, ["front", "value", "back", "label"], "left_semi").groupBy("label").count().collect()}
    assert kept == {0: 700, 1: 700} and fitted.count() > 2100
    held = op.held_counts(fitted.where("held").select("front", "value", "back", "label"), op.Network.fresh(np.random.default_rng(1)))
    assert held[:, 3].sum() == fitted.where("held").count()


def test_networks_averaged_over_tasks_find_secrets(spark, model):
    made = op.made_findings(model[1], 6000, seed=3)
    rows = spark.createDataFrame(made, op.FINDING).repartition(3)
    net = op.Network.fresh(np.random.default_rng(5))
    for k in range(6):
        net = op.averaged_round(rows, net, (1.0, 1.0), 0.004 * (1 - k / 6), k)
    margin, _, label, n = op.held_counts(spark.createDataFrame(op.made_findings(model[1], 1500, seed=78), op.FINDING), net).T
    assert n[(margin > 0) == (label == 1)].sum() >= 0.95 * n.sum()
