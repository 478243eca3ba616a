"""The scores of the trained operators against plain Python that walks texts word by word."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalscale.llm import op2_toxicity, op8_quality

TEXTS = [
    None, "", "\n", "One plain line of words, and more words.", "AAA $$$ !!\n| a | b |\n\n12 34 12 x\n", "Ünï çödé\twords  here.\nthe the THE the\nÉcole", "x" * 60 + " tail\n" + "SHOUT!! NOW!!", "\n\n a \n\n",
    "you are an idiot", "IDIOT!! you 1d1ot, ur id*ot and i d i o t ... worthless scum? yes??", "no harm done 2024 here; the quick brown fox (jumps).", "zorgfull zorg zorgfully you zorgfull, vous zorgfull",
]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---- op8 -------------------------------------------------------------------------------------------------------------


def line_features(text):
    """Features of each line of a text, by its bytes."""
    seen, rows, sizes = set(), [], []
    for line in (text or "").split("\n"):
        raw = line.encode()
        words = [lower(w) for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
        count = lambda test: sum(map(test, raw))  # noqa: E731, B023
        here, inside, again = set(), 0, 0
        for w in words:
            inside, again = inside + (w in here), again + (w in seen)
            here.add(w)
            seen.add(w)
        up, low = count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122 or b >= 128)
        sign, bar, loud, point = (count(lambda b, own=own: b in own) for own in (b"#$%&*+<=>@[\\]^_`{}~", b"|", b"!?", b".,;:()-'\""))
        size, many = len(raw) + 1, len(words) + 1
        lengths = [len(w.encode()) for w in words]
        rows.append([
            math.log1p(len(raw)), math.log1p(len(words)), up / (up + low + 1), count(lambda b: 48 <= b <= 57) / size, sign / size, bar / many, loud / many, point / many, inside / many, again / many, sum(lengths) / many,
            sum(n > 20 for n in lengths) / many, float(raw[-1:] != b"" and raw[-1] in b".!?:;\"'"), float(raw[:1] != b"" and (65 <= raw[0] <= 90 or raw[0] >= 0xC3)), float(len(words) <= 2), min(sign, 3), math.log1p(inside),
        ])
        sizes.append(len(raw))
    none = [0.0] * len(rows[0])
    out = []
    for i, own in enumerate(rows):
        near = (rows[i - 1] if i else none) + (rows[i + 1] if i + 1 < len(rows) else none)
        out.append(own + [v * v for v in own] + near + [float(i == 0), float(i + 1 == len(rows))])
    return out, sizes


def quality(field, text):
    """The field walked line by line, with probabilities of label sequences summed forwards and backwards."""
    x, sizes = line_features(text)
    good = [sum(w * max(-6.0, min(6.0, (v - m) / s)) for v, m, s, w in zip(row, field.mean, field.scale, field.weights, strict=False)) + field.weights[-1] for row in x]
    unary, pair, n = [[0.0, g] for g in good], field.pair, len(x)
    log_sum = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    ahead, behind = [unary[0]], [[0.0, 0.0]]
    for u in unary[1:]:
        a = ahead[-1]
        ahead.append([u[k] + log_sum(a[0] + pair[0][k], a[1] + pair[1][k]) for k in (0, 1)])
    for u in unary[:0:-1]:
        b = behind[-1]
        behind.append([log_sum(pair[k][0] + u[0] + b[0], pair[k][1] + u[1] + b[1]) for k in (0, 1)])
    behind.reverse()
    top = 0.0
    for i in range(n):
        one, zero = ahead[i][1] + behind[i][1], ahead[i][0] + behind[i][0]
        top += (sizes[i] + 1) * math.exp(one - log_sum(one, zero))
    share = min(max(top / sum(s + 1 for s in sizes), 1e-4), 1 - 1e-4)
    a, b = field.logistic
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * math.log(share / (1 - share)) + b))))


# ---- op2 -------------------------------------------------------------------------------------------------------------

LEET = str.maketrans("013457@$", "oieastas")
INSULTS, SECOND = set(op2_toxicity.INSULTS), set(op2_toxicity.SECOND_PERSON)


def entries(word):
    """What the learned lexicon looks up: the word, and the openings of longer ones, by their bytes."""
    raw = word.encode()
    return [("", raw)] + [(n, raw[:n]) for n in op2_toxicity.OPENINGS if n and len(raw) > n]


def toxicity_features(text, known):
    """`known`: weights by entry."""
    text = text or ""
    raw, words = text.encode(), re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
    plain = [lower(w) for w in words]
    weight = [max([0.0, *(known.get(e, 0.0) for e in entries(w))]) for w in plain]
    hit, you = [w in INSULTS for w in plain], [i for i, w in enumerate(plain) if w in SECOND]
    strong = [i for i in range(len(plain)) if weight[i] >= 2 or hit[i]]
    gaps = [min([50, *(abs(i - j) for j in near(you, i))]) for i in strong]
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    odd = 0
    for w in re.findall(r"[^\x00-\x23\x25-\x2F\x3A-\x3F\x5B-\x60\x7B-\x7F]+", text):
        own = w.encode()
        if any(map(letter, own)) and not all(map(letter, own)):
            open_ = lower(w).translate(LEET)
            odd += open_ in INSULTS or known.get(("", open_.encode()), 0.0) >= 2
    star = lambda i: raw[i] == 42
    masked = sum(star(i) and letter(raw[i - 1]) and (letter(raw[i + 1]) or star(i + 1)) for i in range(1, len(raw) - 1))
    single = [len(w.encode()) == 1 for w in plain]
    spaced = sum(single[i - 1] and single[i] and single[i + 1] for i in range(1, len(single) - 1))
    capital = sum(len(w.encode()) >= 3 and all("A" <= c <= "Z" for c in w) for w in words)
    count = lambda test: sum(map(test, raw))
    doubled = sum(raw[i] in b"!?" and raw[i - 1] in b"!?" for i in range(1, len(raw)))
    n, per_word, per_byte = len(words), len(words) + 1, len(raw) + 1
    hits, two, three, close = sum(hit), sum(w >= 2 for w in weight), sum(w >= 3 for w in weight), sum(g <= 6 for g in gaps)
    return [
        math.log1p(n), math.log1p(len(raw)), hits / per_word, math.log1p(hits), sum(weight) / (n + 5), max([0.0, *weight]), math.log1p(two), two / per_word, math.log1p(three), three / per_word, len(you) / per_word, close / per_word,
        math.log1p(close), min([50, *gaps]), count(lambda b: 65 <= b <= 90) / per_byte, capital / per_word, count(lambda b: b == 33) / per_byte, count(lambda b: b == 63) / per_byte, doubled / per_byte,
        count(lambda b: 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126) / per_byte, count(lambda b: 48 <= b <= 57) / per_byte, odd / per_word, math.log1p(odd), masked / per_word, spaced / per_word,
        count(lambda b: b >= 128) / per_byte, len(raw) / per_word,
    ]


def near(you, i):
    """Of the second-person words the nearest one on either side."""
    before, after = [j for j in you if j < i], [j for j in you if j >= i]
    return before[-1:] + after[:1]


def toxicity(model, known, text):
    """Trees walked node by node, then the line through the calibration points."""
    x, t = toxicity_features(text, known), model.trees
    total = t.base
    for k in range(t.n):
        node = 1
        for _ in range(t.depth):
            node = 2 * node + (x[t.feature[k, node]] > t.cut[k, node])
        total += t.leaf[k, node - (1 << t.depth)]
    xs, ys = model.points
    if total <= xs[0] or total >= xs[-1]:
        p = ys[0] if total <= xs[0] else ys[-1]
    else:
        i = next(i for i in range(1, len(xs)) if xs[i] >= total)
        p = ys[i - 1] + (ys[i] - ys[i - 1]) * (total - xs[i - 1]) / (xs[i] - xs[i - 1])
    return min(1.0, max(0.0, p + 1e-4 * (1 / (1 + math.exp(-total)) - 0.5)))


def learned(model, texts):
    """Weights by entry as text, of the entries that the texts can meet."""
    from evalscale.llm.text import hash_spans, mix

    held, weights = dict(zip(model.lexicon.hashes.tolist(), range(len(model.lexicon.hashes)), strict=True)), model.lexicon.weights()
    out = {}
    for text in texts:
        found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "") + [lower(w).translate(LEET) for w in re.findall(r"[^\x00-\x23\x25-\x2F\x3A-\x3F\x5B-\x60\x7B-\x7F]+", text or "")]
        for w in found:
            for n, raw in entries(lower(w)):
                h = hash_spans(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))
                h = int((mix(h + np.uint64(n)) if n else h)[0])
                if h in held:
                    out[n, raw] = float(weights[held[h]])
    return out


@pytest.fixture(scope="module")
def tables(spark):
    from test_classifiers import corpus

    docs, labels = corpus(5, 300)
    return spark.createDataFrame([(d, t) for d, t, _ in docs], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), [t for _, t, _ in docs[:25]]


@pytest.mark.parametrize("module, label", [(op2_toxicity, "toxic"), (op8_quality, "quality")])
def test_scores(spark, tables, module, label):
    docs, labels, some = tables
    texts = [*TEXTS, *some, TEXTS[4], TEXTS[9]]
    model = module.train(docs, labels, label, F.lit(True))
    # the same id on different texts, and none: each row is scored by its own text
    rows = spark.createDataFrame([(None if i % 7 == 3 else i % 5, t, i) for i, t in enumerate(texts)], "doc_id long, text string, score long").coalesce(1)
    got = defaultdict(list)
    for r in module.score_documents(rows, model).collect():
        got[r.doc_id].append(r.score)
    if module is op2_toxicity:
        known = learned(model, texts)
        assert any(w >= 2 for w in known.values())
    want = defaultdict(list)
    for i, t in enumerate(texts):
        want[None if i % 7 == 3 else i % 5].append(toxicity(model, known, t) if module is op2_toxicity else quality(model, t))
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-9), k
    assert max(map(max, want.values())) - min(map(min, want.values())) > 0.3


LONG = ["plain words " * 250_000, "x" * 3_000_000, "short line\n" * 100_000, "You idiot! " * 200_000]


@pytest.mark.parametrize("module, label", [(op2_toxicity, "toxic"), (op8_quality, "quality")])
def test_texts_of_megabytes(spark, tables, module, label):
    docs, labels, _ = tables
    model = module.train(docs, labels, label, F.lit(True))
    rows = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in module.score_documents(rows, model).collect()}
    assert len(got) == 4 and all(0 <= s <= 1 for s in got.values())
    if module is op2_toxicity:
        assert got[3] > got[0]
