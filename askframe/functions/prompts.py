"""Prompt texts as column expressions, filled in one pass."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from askframe.fixed_values import LETTERS, NUMBERED_FAMILIES, PREFIX_TEXT, PROMPT_TEXTS, SUFFIX_TEXT
from askframe.functions.letters import answer_text, letter_to_number


def prompt_kind(family: str, prompt_id: int) -> dict[str, bool]:
    """Answer style of a template, read off its placeholders; unknown templates raise."""
    if (family, prompt_id) not in PROMPT_TEXTS:
        raise NotImplementedError(f"{family} {prompt_id}")
    names = {name for _, name, _, _ in Formatter().parse(PROMPT_TEXTS[family, prompt_id]) if name}
    return {
        "letter_answer": "answer" in names,
        "text_answer": "answer_text" in names and "yes_or_no" not in names,
        "yes_no_answer": "yes_or_no" in names,
        "with_context": "context" in names,
    }


def fill(template: str, values: dict[str, Column]) -> Column:
    """Concatenate a template's literal pieces with columns.

    Filled texts are never scanned again, so a ``{placeholder}`` inside a
    question stays as written.
    """
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(values[name])
    return F.concat(*parts)


def prompt_column(family: str, prompt_id: int, with_answer: bool, letter: str | None = None) -> Column:
    """Prompt of one template over question columns.

    Yes/no kinds ask about one option: that of ``letter``, or of unpivoted columns.
    """
    kind = prompt_kind(family, prompt_id)
    blank = F.lit("")
    values = {"prompt": F.col("prompt")}
    if kind["with_context"]:
        values["context"] = F.col("context")
    if kind["yes_no_answer"]:
        values["answer_text"] = F.col(letter or "answer_text")
        if not with_answer:
            values["yes_or_no"] = blank
        elif letter:
            values["yes_or_no"] = F.when(F.col("answer") == letter, "yes").otherwise("no")
        else:
            values["yes_or_no"] = F.col("yes_or_no")
    elif kind["text_answer"]:
        values["answer_text"] = answer_text() if with_answer else blank
    else:
        values.update({letter.lower(): F.col(letter) for letter in LETTERS})
        if not with_answer:
            values["answer"] = blank
        elif family in NUMBERED_FAMILIES:
            values["answer"] = letter_to_number(F.col("answer")).cast("string")
        else:
            values["answer"] = F.col("answer")
    return fill(PROMPT_TEXTS[family, prompt_id], values)


def prompt_rows(family: str, prompt_id: int, with_answer: bool) -> Column:
    """All prompts of one template for a question, ``(letter, text)``: one without letter, or one per option."""
    letters = LETTERS if prompt_kind(family, prompt_id)["yes_no_answer"] else [None]
    rows = [F.struct(F.lit(c).cast("string").alias("letter"), prompt_column(family, prompt_id, with_answer, c).alias("text")) for c in letters]
    return F.array(*rows)


def shared_prefix() -> Column:
    return fill(PREFIX_TEXT, {"context": F.col("context"), "prompt": F.col("prompt")})


def option_suffixes() -> Column:
    """Five endings, one per option, to follow the shared prefix."""
    return F.array(*[fill(SUFFIX_TEXT, {"answer_text": F.col(c)}) for c in LETTERS])
