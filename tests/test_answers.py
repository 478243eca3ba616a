import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalscale.functions import text as X

# Scanners over characters, written from the stated semantics, for property tests.  Each walks a text once with a
# position instead of matching patterns.
QUOTES = "`*_ \t\r\n"


def skip(text, at, test):
    """The first position from `at` on whose character fails the test."""
    while at < len(text) and test(text[at]):
        at += 1
    return at


def edges(text, test):
    """The text without the characters that pass the test at either end."""
    low = skip(text, 0, test)
    high = len(text)
    while high > low and test(text[high - 1]):
        high -= 1
    return text[low:high]


def bare(text):
    return edges(edges(text, str.isspace), QUOTES.__contains__)


def shown(text):
    """What is outside think blocks; each block, and one that never ends, leaves a line end."""
    low, out, at = text.lower(), [], 0
    while (begin := low.find("<think>", at)) >= 0:
        out += [text[at:begin], "\n"]
        end = low.find("</think>", begin)
        if end < 0:
            return "".join(out)
        at = end + len("</think>")
    return "".join([*out, text[at:]])


def past_words(text, at, words):
    """The position after words that follow each other with white space between them, or -1."""
    for k, word in enumerate(words):
        after = skip(text, at, str.isspace) if k else at
        if k and after == at or text[after : after + len(word)].lower() != word:
            return -1
        at = after + len(word)
    return at


def marked_values(text):
    """Values behind markers that stand first on a line, in order."""
    out, at = [], 0
    while at <= len(text):
        begin = skip(text, at, str.isspace)
        after = max(past_words(text, begin, m) for m in (["final", "answer"], ["answer"], ["idahun", "ikeyin"]))
        sign = skip(text, after, str.isspace) if after >= 0 else len(text)
        if sign < len(text) and text[sign] in ":-":
            value = skip(text, sign + 1, str.isspace)
            if value < len(text):
                at = skip(text, value, lambda c: c != "\n")
                out.append(text[value:at])
            elif any(c != "\n" for c in text[sign + 1 :]):  # white space alone is an empty value
                out.append("")
                break
        line = text.find("\n", at)
        if line < 0:
            break
        at = line + 1
    return out


def last_answer(text):
    for seen in (shown(text), text):
        if values := marked_values(seen):
            return bare(values[-1])
    for seen in (shown(text), text):
        for row in reversed(seen.splitlines()):
            if not all(c.isspace() for c in row):
                return bare(row)
    return ""


def unlabelled(text):
    text = edges(text, str.isspace)
    labelled = len(text) > 1 and text[0].isalpha() and text[1] in ".)"
    return edges(text[2:], str.isspace) if labelled else text


def words_of(text):
    """Lower-cased words without ASCII punctuation, one space between them."""
    out = [""]
    for c in unlabelled(text).lower():
        if c.isspace():
            out.append("")
        elif c not in string.punctuation:
            out[-1] += c
    return " ".join(w for w in out if w)


def first_number(text):
    """The first number's sign, digits and decimals; the bare text if there is none."""
    digit = string.digits.__contains__
    for at in range(len(text)):
        if digit(text[at]):
            end = skip(text, at, digit)
            while text[end : end + 1] == "," and len(text[end + 1 : end + 4]) == 3 and all(map(digit, text[end + 1 : end + 4])):
                end += 4
            if text[end : end + 1] == "." and text[end + 1 : end + 2] and digit(text[end + 1]):
                end = skip(text, end + 1, digit)
            return "-" * (text[at - 1 : at] == "-") + text[at:end].replace(",", "")
    return bare(text)


def number_value(text):
    found = first_number(text)
    return float(found) if any(c in string.digits for c in found) else None


def pooled_by(text):
    """The vote key, but for decimals far from integers (None: not held against the column)."""
    value = number_value(text)
    if value is None:
        return words_of(text)
    return f"num:{round(value)}" if abs(value - round(value)) <= 1e-6 else None


def chosen_letter(text, choices):
    offered = string.ascii_uppercase[: len(choices) or 5]
    in_word = lambda c: c.isalnum() or c == "_"
    large = text.upper()
    for at, c in enumerate(large):
        alone = not (at and in_word(large[at - 1])) and not (at + 1 < len(large) and in_word(large[at + 1]))
        if c in string.ascii_uppercase and alone:
            if c in offered:
                return c
            break
    same = [letter for letter, choice in zip(string.ascii_uppercase, choices, strict=False) if words_of(choice) == words_of(text)]
    return same[0] if same else bare(text)


PIECES = ["Final answer:", "answer -", "ANSWER:", "Idahun ikeyin:", "<think>", "</think>", "\n", "\r\n", " ", "\t", "**", "`", "A", "B.", "c)", "É", "é", "ọ", "1,050", "-3.50", "11.0", "7", ",", ".", "x y", "_", "\u0085", " ", "\xa0", "Z", "\x1c", "3.14159265", "nan", "inf", "١٢"]
texts = st.lists(st.sampled_from(PIECES), max_size=9).map("".join)


def run(spark, column, rows, schema):
    return [r.out for r in spark.createDataFrame(rows, schema).select(column.alias("out")).collect()]


@settings(max_examples=12, deadline=None)
@given(st.lists(texts, min_size=40, max_size=80))
def test_native_columns_equal_the_scanners(spark, cases):
    rows = [(c,) for c in cases]
    t = F.col("t")
    assert run(spark, X.final_answer(t), rows, "t string") == [last_answer(c) for c in cases]
    assert run(spark, X.strip_thinking(t), rows, "t string") == [shown(c) for c in cases]
    assert run(spark, X.normalize(t), rows, "t string") == [words_of(c) for c in cases]
    assert run(spark, X.clean_answer(t), rows, "t string") == [bare(c) for c in cases]
    ascii_only = [c for c in cases if "١" not in c]
    plain = [(c,) for c in ascii_only]
    assert run(spark, X.extract_number(t), plain, "t string") == [first_number(c) for c in ascii_only]
    assert run(spark, X.parse_number(t), plain, "t string") == [number_value(c) for c in ascii_only]
    keys = run(spark, X.numeric_key(t), plain, "t string")
    assert all(pooled_by(c) in (None, k) for c, k in zip(ascii_only, keys, strict=True))
    choices = ["A. x y", "B) 7", "Z"]
    offered = F.array(*[F.lit(c) for c in choices])
    assert run(spark, X.extract_choice(t, offered), rows, "t string") == [chosen_letter(c, choices) for c in cases]
    assert run(spark, X.extract_choice(t), rows, "t string") == [chosen_letter(c, []) for c in cases]


@pytest.mark.parametrize("a, b, same", [("105.0", "105", True), ("1,050", "1050", True), ("-5.0", "-5", True), ("10", "11", False), ("abc", "abc", True), ("nan", "nan", True), ("nan", "5", False)])
def test_numbers_equal(spark, a, b, same):
    assert run(spark, X.numbers_equal(F.col("a"), F.col("b")), [(a, b)], "a string, b string") == [same]


@pytest.mark.parametrize(
    "p, g, kind, same", [("Hello!", "hello", "text", True), ("", "11", "number", False), ("A", "B", "choice", False), ("5", "", "number", False), ("11.0", "11", "number", True), ("A.", "B.", "text", True), ("Ọba", "ọba", "text", True), ("oba", "ọba", "text", False)]
)
def test_exact_match(spark, p, g, kind, same):
    columns = F.col("p"), F.col("g"), F.col("k")
    assert run(spark, X.exact_match(*columns), [(p, g, kind)], "p string, g string, k string") == [same]
    if (p, g) == ("A.", "B."):
        assert run(spark, X.exact_match(*columns, strict=True), [(p, g, kind)], "p string, g string, k string") == [False]


@pytest.mark.parametrize("v, key", [("11.0", "num:11"), ("11", "num:11"), ("1234567890.5", "num:1234567890"), ("0.5", "num:0.5"), ("Two!", "two")])
def test_numeric_key(spark, v, key):
    got = run(spark, X.numeric_key(F.col("v")), [(v,)], "v string")[0]
    assert got == key
    assert run(spark, X.normalize(F.col("v")), [("11.0",)], "v string") == ["110"]


def test_three_line_pivot_response(spark):
    text = "English translation: two times three\nReasoning: 2 * 3 = 6\nFinal answer: 6"
    assert run(spark, X.extract_answer(F.col("t"), F.lit("number")), [(text,), (None,)], "t string") == ["6", ""]


def test_token_fallback(spark):
    rows = [(5, 9, "a b"), (0, 9, "a b"), (None, None, "a b  c"), (0, 0, "")]
    assert run(spark, X.words_or_usage(F.col("c"), F.col("t"), F.col("r")), rows, "c int, t int, r string") == [5, 9, 3, 1]
