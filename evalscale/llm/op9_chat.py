"""Chat formatting by a compiled template, with a loss mask, and its reader.

Conversations are dealt by id, sorted by turn and rendered as a stream, so one
with a very large share of all rows takes time but no memory.  The operator's
output is the formatted text in parts of whole turns, each with the character
spans under generation markers; `read_back` parses those parts again.

Control strings inside texts get a backslash after their first character, and a
string that already looks so gets one more; removing one restores the text.

Cases: a null text or role is empty; turns that tie are ordered by role and text
and all kept; rows without an id form one conversation without an id; an empty
table gives no rows beyond what the caller adds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalscale.llm.template import Template

START, END = "<|im_start|>", "<|im_end|>"
#: Fixed control strings of common chat formats.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{% for message in messages %}<|im_start|>{{ message.role|line|escape }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text|escape }}{% endgeneration %}{% else %}{{ message.text|escape }}{% endif %}"
    "<|im_end|>\n{% endfor %}"
)
PART_CHARS = 1 << 16

_CONTROL = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS))
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROLS))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def line(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def unline(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS = {"escape": escape, "line": line}
PARTS = "conv_id long, part long, text string, spans array<struct<start:int,end:int>>, n_turns long, last boolean"
_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_turns", pa.int64()), ("last", pa.bool_())]
)


def rows_of(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The formatted text of each conversation in parts, in order within a partition."""

    def run(batches):
        compiled = Template(template, FILTERS)
        held, size = [], 0
        for conv_id, rows in groupby(rows_of(batches), key=lambda r: r[0]):
            turns = 0

            def messages(rows=rows):
                nonlocal turns
                for _, _, role, text in rows:
                    turns += 1
                    yield {"role": role, "text": text}

            texts, spans, chars, part = [], [], 0, 0
            for text, masked in compiled.render(messages=messages()):
                if chars >= PART_CHARS and text.startswith(START):  # parts end between turns
                    held.append({"conv_id": conv_id, "part": part, "text": "".join(texts), "spans": spans, "n_turns": None, "last": False})
                    texts, spans, size, chars, part = [], [], size + chars, 0, part + 1
                if masked:
                    spans.append({"start": chars, "end": chars + len(text)})
                texts.append(text)
                chars += len(text)
                if size > 8 * PART_CHARS:
                    yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)
                    held, size = [], 0
            held.append({"conv_id": conv_id, "part": part, "text": "".join(texts), "spans": spans, "n_turns": turns, "last": True})
            size += chars
            if size > 8 * PART_CHARS:
                yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, PARTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TURN = re.compile(rf"{re.escape(START)}([^\n]*)\n(.*?){re.escape(END)}\n", re.S)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, from the formatted parts alone.

    A conversation's parts must come one after another, as they were made; parts that
    were dealt out since have to be brought together again by (conv_id, part).
    """

    def run(batches):
        out = []
        for conv_id, rows in groupby(rows_of(batches), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n, loss_chars, chars = 0, 0, 0
            expected, ended = 0, False
            for _, part, text, spans, _, last in rows:
                if part != expected or ended:
                    raise ValueError(f"conversation {conv_id}: part {part} where {expected} was due")
                expected, ended, at = part + 1, last, 0
                for m in _TURN.finditer(text):
                    if m.start() != at:
                        raise ValueError(f"conversation {conv_id}: text between turns")
                    turns.update(f"{unline(unescape(m[1]))}\n{unescape(m[2])}\n".encode())
                    n, at = n + 1, m.end()
                if at != len(text):
                    raise ValueError(f"conversation {conv_id}: a turn without end")
                for s in spans:
                    own = unescape(text[s["start"] : s["end"]])
                    loss.update(own.encode())
                    loss_chars += len(own)
                chars += len(text)
            if not ended:
                raise ValueError(f"conversation {conv_id}: its last part is missing")
            out.append((conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 5000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in DIGESTS.split(", ")])

    return parts.mapInArrow(run, DIGESTS)


def extra(spark: SparkSession) -> DataFrame:
    """The conversation of control strings that the query adds."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
