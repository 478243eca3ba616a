"""Answer extraction and matching as native column expressions (no UDF).

White space, line ends and word characters are those of Python's `str` methods,
spelled out, because Java's defaults differ.  Every function takes and returns
columns; null texts behave as empty ones.  A "number" that is not finite counts
as no number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space, line ends, ASCII punctuation and the marker words of a final answer.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MARKERS = ("final answer", "answer", "idahun ikeyin")
_NUMBER = r"-?\p{Nd}+(?:,\p{Nd}{3})*(?:\.\p{Nd}+)?"
TOLERANCE = 1e-6
RELATIVE = 1e-9

_MARKED_LINE = rf"(?imdu)^{_SPACE}*(?:{'|'.join(m.replace(' ', _SPACE + '+') for m in _MARKERS)}){_SPACE}*[:\-]{_SPACE}*(.+?){_SPACE}*$"
_CAPITAL = r"(?<![\p{L}\p{N}_])([A-Z])(?![\p{L}\p{N}_])"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip_space(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def strip_thinking(response: Column) -> Column:
    """closed think blocks, then an unclosed one up to the end, become a newline."""
    closed = F.regexp_replace(_text(response), r"(?isu)<think>.*?</think>", "\n")
    return F.regexp_replace(closed, r"(?isu)<think>.*\z", "\n")


def clean_answer(c: Column) -> Column:
    """white space off, then quoting marks and white space off."""
    return F.btrim(strip_space(_text(c)), F.lit("`*_ \t\r\n"))


def _last_marked(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(_MARKED_LINE), F.lit(1)), F.lit(-1))


def _last_line(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, _LINE_END), strip_space), lambda line: line != "")
    return F.try_element_at(lines, F.lit(-1))


def final_answer(response: Column) -> Column:
    """the last marked line of the visible text, or of all; else the last line that is not blank."""
    whole = _text(response)
    visible = strip_thinking(response)
    return clean_answer(F.coalesce(_last_marked(visible), _last_marked(whole), _last_line(visible), _last_line(whole), F.lit("")))


def strip_choice_label(c: Column) -> Column:
    """one leading letter with a dot or bracket off."""
    return strip_space(F.regexp_replace(strip_space(_text(c)), r"^\p{L}[.)]", ""))


def normalize(c: Column) -> Column:
    """label off, lower case, ASCII punctuation deleted, white space single."""
    bare = F.translate(F.lower(strip_choice_label(c)), WHITE + _PUNCTUATION, " " * len(WHITE))  # what has no counterpart is deleted
    return F.btrim(F.regexp_replace(bare, " {2,}", " "))


def extract_number(c: Column) -> Column:
    """the first number, its commas removed; else the cleaned text."""
    found = F.regexp_extract(_text(c), _NUMBER, 0)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit(""))).otherwise(clean_answer(c))


def finite(number_text: Column) -> Column:
    """A number text as a double; null if it is none, or not finite."""
    value = number_text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def parse_number(c: Column) -> Column:
    """the number as a double, or null."""
    return finite(extract_number(c))


def extract_choice(c: Column, choices: Column | None = None) -> Column:
    """the first capital that stands alone, if it is a valid label; else the choice with the same text; else the text."""
    text = _text(c)
    capital = F.regexp_extract(F.upper(text), _CAPITAL, 1)
    none = F.array().cast("array<string>")
    offered = F.coalesce(choices, none) if choices is not None else none
    count = F.size(offered)
    valid = (capital != "") & (F.ascii(capital) - 65 < F.when(count > 0, count).otherwise(5))
    place = F.array_position(F.transform(offered, normalize), normalize(text))
    return F.when(valid, capital).when(place > 0, F.char(64 + place)).otherwise(clean_answer(text))


def extract_answer(response: Column, answer_type: Column, choices: Column | None = None) -> Column:
    """the answer of a response, by answer type."""
    found = final_answer(response)
    return F.when(answer_type == "choice", extract_choice(found, choices)).when(answer_type == "number", extract_number(found)).otherwise(clean_answer(found))


def _equal(x: Column, y: Column, x_text: Column, y_text: Column, tolerance: float) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance).otherwise(x_text == y_text)


def numbers_equal(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """equal within an absolute tolerance; if one is no number, as extracted texts."""
    return _equal(parse_number(a), parse_number(b), extract_number(a), extract_number(b), tolerance)


def _key(x: Column, tolerance: float) -> Column:
    whole = F.rint(x)
    near = F.abs(x - whole) <= F.greatest(F.lit(tolerance), F.lit(RELATIVE) * F.greatest(F.abs(x), F.abs(whole)))
    integer = F.coalesce(whole.try_cast("decimal(38,0)").cast("string"), whole.cast("string"))
    return F.concat(F.lit("num:"), F.when(near, integer).otherwise(F.bround(x, 6).cast("string")))


def numeric_key(c: Column, tolerance: float = TOLERANCE) -> Column:
    """F8: one key for 11, 11.0 and 11.00."""
    x = parse_number(c)
    return F.when(x.isNull(), normalize(c)).otherwise(_key(x, tolerance))


def _same_text(prediction: Column, gold: Column, strict: bool) -> Column:
    p, g = normalize(prediction), normalize(gold)
    if not strict:
        return p == g
    return F.when((p == "") & (g == ""), strip_space(_text(prediction)) == strip_space(_text(gold))).otherwise(p == g)


def exact_match(prediction: Column, gold: Column, answer_type: Column, strict: bool = False) -> Column:
    """whether a prediction is the gold answer; an empty gold matches nothing.

    Answers that are nothing but a label or punctuation normalise to an empty text
    and match each other; `strict` compares those as they stand.
    """
    return (_text(gold) != "") & F.when(answer_type == "number", numbers_equal(prediction, gold)).otherwise(_same_text(prediction, gold, strict))


def vote_key(answer: Column, answer_type: Column, position: Column) -> Column:
    """what votes are pooled by; an empty answer votes for itself alone."""
    text = _text(answer)
    return F.when(text == "", F.concat(F.lit("__empty_"), position.cast("string"))).when(answer_type == "number", numeric_key(text)).otherwise(normalize(text))


def with_match(rows: DataFrame, name: str, prediction: str, gold: str, answer_type: str) -> DataFrame:
    """`exact_match` as a column, in steps: each number is extracted and parsed once a row, and the plan stays small."""
    number = F.col(answer_type) == "number"
    texts = {f"__{side}_text": F.when(number, extract_number(F.col(c))) for side, c in (("p", prediction), ("g", gold))}
    values = {f"__{side}": finite(F.col(f"__{side}_text")) for side in "pg"}
    same = F.when(number, _equal(F.col("__p"), F.col("__g"), F.col("__p_text"), F.col("__g_text"), TOLERANCE)).otherwise(_same_text(F.col(prediction), F.col(gold), False))
    return rows.withColumns(texts).withColumns(values).withColumn(name, (_text(F.col(gold)) != "") & same).drop(*texts, *values)


def with_vote_key(rows: DataFrame, name: str, answer: str, answer_type: str, position: str) -> DataFrame:
    """`vote_key` as a column, in steps like `with_match`."""
    text = _text(F.col(answer))
    step = rows.withColumn("__x", F.when(F.col(answer_type) == "number", parse_number(text)))
    key = F.when(text == "", F.concat(F.lit("__empty_"), F.col(position).cast("string"))).when(F.col("__x").isNotNull(), _key(F.col("__x"), TOLERANCE)).otherwise(normalize(text))
    return step.withColumn(name, key).drop("__x")


def words_or_usage(completion: Column, total: Column, response: Column) -> Column:
    """reported completion tokens, else total tokens, else words, one at least."""
    words = F.size(F.filter(F.split(_text(response), f"{_SPACE}+"), lambda w: w != ""))
    return F.coalesce(F.nullif(completion, F.lit(0)), F.nullif(total, F.lit(0)), F.greatest(F.lit(1), words)).cast("long")
