"""Filter interaction audit: what each filter removes in every order, and its Shapley share.

A document fails some of the filters; that set is its mask.  Of a part's mask
counts c the removal polynomial is made, the multilinear extension of the number
of documents that a set of filters removes:

    f(x) = sum over masks m of c(m) (1 - product over i in m of (1 - x_i))

At a corner, where each x_i is 0 or 1, it is the number that those filters
remove, so differences of corners give every step of every order.  A filter's
Shapley value is the integral of its partial derivative along the diagonal; it
is taken with exact rationals and scaled by the number of orders, which makes it
the sum of its removals over all of them.

Cases: a null text is empty, a null part the empty string (both are pooled with
the real ones); a null doc_id comes after no other, so its row is no repetition
and no row is one of it; rows equal in id and text both stay, as none has a
smaller id; of several labels of an id the largest counts, ids without labels
have neither; other columns are not read; no documents, no rows.

Scale: the texts are read once, by built-in functions, and leave the scan as a
mask and a digest.  Copies are counted before they travel, so that a group of any
size meets as a row per part and labels; a part's polynomial has at most 32 mask
counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalscale.llm.common import cut

SPACE = " \t\n\x0b\x0c\r"
LETTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_filters(text: Column, words: Column) -> list[Column]:
    """Failure conditions A to D of a text, given its words."""
    n = F.size(words)
    return [
        n < 200,
        100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]


def mask_of(conditions: list[Column]) -> Column:
    """One bit for each condition that holds, the first lowest."""
    out = F.lit(0)
    for i, c in enumerate(conditions):
        out = out.bitwiseOR(F.when(c, 1 << i).otherwise(0))
    return out


def masks(documents: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, digest of the text, mask, n) of equal rows together; the mask has the filters A to D."""
    text = documents.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    bare = F.btrim("text", F.lit(SPACE))
    words = F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    rows = text.withColumn("words", words).select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask_of(text_filters(F.col("text"), F.col("words"))).alias("mask"))
    return rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows as `masks` gives them with booleans good and toxic."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # rows without an id match nothing: they are spread by what else they have, not sent to one task
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).otherwise(F.lit(0))
    joined = rows.withColumn("spread", spread).join(marks.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    marked = lambda label: F.coalesce(F.col(label) == 1, F.lit(False))
    return joined.select("doc_id", "part", "digest", "mask", "n", marked("quality").alias("good"), marked("toxic").alias("toxic"))


def mask_counts(rows: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of rows as `labelled` gives them; the mask has all five filters.

    Copies of a text meet as one row per part and labels, with the smallest id and
    its rows: of these the smallest id is the only one that is no repetition.
    """
    known = F.col("doc_id").isNotNull()
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("unnumbered")
    )
    groups = cut(groups, "masks")
    least = groups.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    once = F.col("unnumbered") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = groups.join(least, "digest", "left").select(
        "part", "good", "toxic", F.explode(F.array(F.struct("mask", once.alias("n")), F.struct(F.col("mask").bitwiseOR(16).alias("mask"), (F.col("n") - once).alias("n")))).alias("x")
    )
    marked = lambda label: F.sum(F.when(F.col(label), F.col("x.n")).otherwise(0)).alias(label)
    return both.where("x.n > 0").groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), marked("good"), marked("toxic"))


class RemovalPolynomial:
    """The multilinear extension of removed(filters), from counts by mask over `n` filters."""

    def __init__(self, counts: dict[int, int], n: int):
        self.n = n
        above = [counts.get(m, 0) for m in range(1 << n)]  # becomes the sum of the counts of all masks that hold these filters
        for i in range(n):
            for m in range(1 << n):
                if not m >> i & 1:
                    above[m] += above[m | 1 << i]
        #: coefficient of the product of each set's variables
        self.terms = {m: above[m] if m.bit_count() % 2 else -above[m] for m in range(1, 1 << n) if above[m]}

    def corner(self, filters: int) -> int:
        """Its value where the variables of these filters are 1 and the others 0: the documents that they remove."""
        return sum(a for m, a in self.terms.items() if m & filters == m)

    def diagonal_derivative(self, i: int) -> list[int]:
        """Coefficients in t of the partial derivative by variable i where all variables are t."""
        out = [0] * self.n
        for m, a in self.terms.items():
            if m >> i & 1:
                out[m.bit_count() - 1] += a
        return out

    def shapley(self, i: int) -> Fraction:
        """The integral of that derivative from 0 to 1."""
        return sum((Fraction(a, power + 1) for power, a in enumerate(self.diagonal_derivative(i))), Fraction(0))


def orders(counts: dict[int, tuple[int, int, int]], letters: str = LETTERS) -> Iterator[tuple]:
    """(order, step, *COUNTS) of every order of the filters, from (all, good, toxic) documents by mask."""
    n = len(letters)
    every, good, toxic = (RemovalPolynomial({m: c[k] for m, c in counts.items()}, n) for k in range(3))
    total = sum(c[0] for c in counts.values())
    gone = [[p.corner(s) for s in range(1 << n)] for p in (every, good, toxic)]
    shares = [every.shapley(i) * factorial(n) for i in range(n)]
    if any(s.denominator != 1 for s in shares):
        raise ArithmeticError("a sum over all orders is a whole number")
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, good_lost, toxic_lost = (g[after] - g[before] for g in gone)
            alone = counts.get(1 << i, (0, 0, 0))[0]
            yield "".join(letters[j] for j in order), step, total - gone[0][after], removed, gone[0][1 << i] - removed, alone, good_lost, toxic_lost, int(shares[i])
            before = after


def audit(counted: DataFrame) -> DataFrame:
    """Of rows as `mask_counts` gives them, one row per part, order and step."""
    kinds = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in COUNTS]])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a part at a time: 600 rows
                part, own = (batch.column(k)[i].as_py() for k in range(2))
                rows = list(orders({c["mask"]: (c["n"], c["good"], c["toxic"]) for c in own}))
                columns = [[part] * len(rows), *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts")).mapInArrow(run, AUDIT)


def audit_documents(documents: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    return audit(mask_counts(labelled(masks(documents, part), labels)))
