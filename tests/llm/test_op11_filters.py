import random
import re
from collections import defaultdict
from fractions import Fraction
from itertools import permutations

import pytest

from evalscale.llm import op11_filters as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text, first):
    """The letters of the filters that a text fails, step by step."""
    words, capitals = WORD.findall(text), sum("A" <= c <= "Z" for c in text)
    out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * capitals > 3 * len(text))
    return out + "D" * any(c in "#$%&*|" for c in text) + "E" * first


def brute(docs, labels):
    """Every order walked document by document."""
    seen, own = defaultdict(list), defaultdict(list)
    for i, t, _ in docs:
        seen[t or ""].append(i)
    for i, t, lang in docs:
        again = i is not None and any(j is not None and j < i for j in seen[t or ""])
        marks = [(q, x) for d, q, x in labels if d == i and i is not None]
        own[lang or ""].append((fails(t or "", again), any(q == 1 for q, _ in marks), any(x == 1 for _, x in marks)))
    out = {}
    for part, rows in own.items():
        total = defaultdict(int)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                redundant = sum(f in r[0] for r in rows) - len(here)
                out[part, "".join(order), step] = [len(left), len(here), redundant, sum(r[0] == f for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)]
                total[f] += len(here)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def as_dict(df):
    rows = df.collect()
    assert len(rows) == len({tuple(r[:3]) for r in rows})
    return {tuple(r[:3]): list(r[3:]) for r in rows}


DOCS = "doc_id long, text string, lang string, mask int, quality string"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(seed, n=120):
    rng = random.Random(seed)
    pieces = ["plain words here ", "AAA BBB ", "ünïcödé ", "x ", "\x0b\x0c\r\n\t", "# sign ", " no break ", "long " * 150, " ".join(f"w{i}" for i in range(210)) + " "]
    texts = [None, "", "   ", *["".join(rng.choice(pieces) for _ in range(rng.randint(0, 5))) for _ in range(25)]]
    docs = [(rng.choice([None, *range(60)]) if rng.random() < 0.2 else i, rng.choice(texts), rng.choice([None, "", "en", "de"])) for i in range(n)]
    labels = [(rng.choice([None, *range(n)]), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(n)]
    return docs + docs[:3], labels + labels[:3]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_order_walked(spark, seed):
    docs, labels = corpus(seed)
    got = op.audit_documents(spark.createDataFrame([(*d, 7, "q") for d in docs], DOCS), spark.createDataFrame([(*x, "t") for x in labels], LABELS))
    assert got.columns == ["part", "filter_order", "step", *op.COUNTS]
    assert as_dict(got) == brute(docs, labels)


def test_empty_tables_and_no_labels(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert op.audit_documents(none, labels).count() == 0
    got = as_dict(op.audit_documents(spark.createDataFrame([(1, None, None, 1, "")], DOCS), labels))
    assert len(got) == 600 and got["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120] and got["", "EABCD", 1] == [1, 0, 0, 0, 0, 0, 0]


def test_a_very_long_text(spark):
    long = "word " * 1_000_000
    got = as_dict(op.audit_documents(spark.createDataFrame([(1, long, "a", 1, ""), (2, long, "b", 1, "")], DOCS), spark.createDataFrame([(2, 1, 1, "")], LABELS)))
    assert got["a", "BACDE", 1][:2] == [0, 1] and got["b", "EBACD", 1] == [0, 1, 0, 0, 1, 1, 60]


@pytest.mark.parametrize("seed", range(4))
def test_polynomial_against_its_definition(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 5)
    counts = {m: rng.randint(0, 10**12) for m in range(1 << n)}
    p = op.RemovalPolynomial(counts, n)
    for s in range(1 << n):
        assert p.corner(s) == sum(c for m, c in counts.items() if m & s)
    # at inner points too: the products of the definition against the terms
    for _ in range(5):
        x = [Fraction(rng.randint(0, 7), 7) for _ in range(n)]
        product = lambda m, f: __import__("math").prod(f(x[i]) for i in range(n) if m >> i & 1)  # noqa: E731, B023
        want = sum(c * (1 - product(m, lambda v: 1 - v)) for m, c in counts.items())
        assert sum(a * product(m, lambda v: v) for m, a in p.terms.items()) == want
    for i in range(n):
        walks = [p.corner(sum(1 << j for j in order[: order.index(i) + 1])) - p.corner(sum(1 << j for j in order[: order.index(i)])) for order in permutations(range(n))]
        assert p.shapley(i) == Fraction(sum(walks), len(walks))
