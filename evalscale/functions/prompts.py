"""Prompt rendering as column expressions.

Worked examples are data: a mapping from task to `Exemplar` rows, loaded from
JSON or given; their blocks are literals made once per task and language, so
rendering is string concatenation inside code generation.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalscale.functions.text import strip_space

# Fixed texts and names.
STYLES = ("english_cot", "yoruba_cot", "translate_pivot", "best_of_n_cot")
ENGLISH_TASKS = {"afrimgsm_translate": "math_en", "afrimmlu_translate": "qa_en"}
RULE = "\n\n---\n\n"
SYSTEM = "You are a careful reasoning assistant.\n\nRead the {0}problem carefully, preserve the quantities and relationships, and solve only from the information given."
GUIDE = "- Use the examples only as formatting guides, not as source facts."
QUANTITIES = "- First identify the {0}quantities and whether they mean add, subtract, multiply, or divide."
STEPS = "- Reason step by step in {0}."
PIVOT = "- Translate the Yoruba question into English.\n- Solve the translated question by reasoning step by step in English."
FINISH = "- Finish with exactly one line:\nFinal answer: <answer>"
ANSWER_FORMATS = {"choice": "<option letter>", "number": "<number>"}
OTHER_FORMAT = "<concise Yoruba answer>"


@dataclass(frozen=True)
class Exemplar:
    question: str
    reasoning_en: str
    reasoning_yo: str
    answer: str
    translated_question: str
    choices: tuple[str, ...] = ()


def load_exemplars(path: str | Path) -> dict[str, list[Exemplar]]:
    """{task: [exemplar, ...]} from a JSON file."""
    rows = json.loads(Path(path).read_text(encoding="utf-8"))
    return {task: [Exemplar(**{**r, "choices": tuple(r.get("choices") or ())}) for r in own] for task, own in rows.items()}


def lettered(choices: Sequence[str]) -> list[str]:
    out = []
    for i, choice in enumerate(choices):
        text, label = choice.strip(), chr(65 + i)
        has = text[:1].upper() == label and text[1:2] in (".", ")") and len(text) > 1
        out.append(text if has else f"{label}. {text}")
    return out


def exemplar_block(exemplars: Sequence[Exemplar], mode: str) -> str:
    """the worked examples of a task, in mode en, yo or translate."""
    if not exemplars:
        return ""
    blocks = ["Examples:"]
    for x in exemplars:
        sections = [("Question", x.question)]
        if x.choices:
            sections.append(("Choices", "\n".join(lettered(x.choices))))
        if mode == "translate":
            sections.append(("English translation", x.translated_question))
        sections.append(("Reasoning", x.reasoning_yo if mode == "yo" else x.reasoning_en))
        blocks.append("\n\n".join([*(f"{title}:\n{text}" for title, text in sections), f"Final answer: {x.answer}"]))
    return RULE.join([*blocks, "Now answer the following question using the same format."]) + "\n\n"


def format_choices(choices: Column) -> Column:
    """each choice behind its letter, unless it has that already."""

    def one(choice: Column, i: Column) -> Column:
        text, label = strip_space(choice), F.char(65 + i.cast("long"))
        has = (F.upper(F.substring(text, 1, 1)) == label) & F.substring(text, 2, 1).isin(".", ")")
        return F.when(has, text).otherwise(F.concat(label, F.lit(". "), text))

    return F.transform(choices, one)


def problem_block(question: Column, choices: Column, label: Column) -> Column:
    """F30"""
    listed = F.when(F.size(F.coalesce(choices, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Choices:\n"), F.array_join(format_choices(choices), "\n")))
    return F.concat_ws("\n\n", F.concat(label, F.lit(":\n"), question), listed)


def answer_format(answer_type: Column) -> Column:
    wanted = F.lit(OTHER_FORMAT)
    for kind, text in ANSWER_FORMATS.items():
        wanted = F.when(answer_type == kind, text).otherwise(wanted)
    return F.concat(F.lit("Answer format:\nFinal answer: "), wanted)


def is_english_input(source: Column) -> Column:
    """F28"""
    return F.endswith(source, F.lit("_translate"))


def _by_task(task: Column, exemplars: Mapping[str, Sequence[Exemplar]], mode: str) -> Column:
    out = F.lit("")
    for name, own in sorted(exemplars.items()):
        out = F.when(task == name, exemplar_block(own, mode)).otherwise(out)
    return out


def render(style: str, exemplars: Mapping[str, Sequence[Exemplar]], task: Column, source: Column, question: Column, choices: Column, answer_type: Column) -> Column:
    """a struct of system and user text."""
    if style not in STYLES:
        raise ValueError(f"prompt style {style!r} is none of {', '.join(STYLES)}")
    english = is_english_input(source)
    both = lambda text, english_word, other: F.when(english, text.format(english_word)).otherwise(text.format(other))
    label = F.when(english, "Question").otherwise("Question (Yoruba)")
    system = F.lit(SYSTEM.format("Yoruba "))
    quantities = both(QUANTITIES, "", "Yoruba ")
    if style == "yoruba_cot":
        block, steps = _by_task(task, exemplars, "yo"), F.concat_ws("\n", quantities, F.lit(STEPS.format("Yoruba")))
    elif style == "translate_pivot":
        block, steps, label = _by_task(task, exemplars, "translate"), F.lit(PIVOT), F.lit("Question (Yoruba)")
    else:
        own = task
        for name, other in ENGLISH_TASKS.items():
            own = F.when(source == name, other).otherwise(own)
        block, steps = _by_task(own, exemplars, "en"), F.concat_ws("\n", quantities, F.lit(STEPS.format("English")))
        system = both(SYSTEM, "", "Yoruba ")
    instructions = F.concat_ws("\n", F.lit("Instructions:"), F.lit(GUIDE), steps, F.lit(FINISH))
    user = F.concat_ws("\n\n", F.concat(block, problem_block(question, choices, label)), answer_format(answer_type), instructions)
    return F.struct(system.alias("system"), user.alias("user"))


def as_text(prompt: Column) -> Column:
    """F32"""
    return F.concat(F.lit("System:\n"), prompt["system"], F.lit("\n\nUser:\n"), prompt["user"])
