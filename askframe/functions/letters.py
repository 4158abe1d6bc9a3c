"""Answer letters: texts, positions, one-hot targets, rankings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askframe.fixed_values import LETTERS

ALPHABET = "".join(LETTERS)


def answer_text(answer: str = "answer") -> Column:
    """Text of the option that the answer letter names; null for any other letter."""
    chosen = F.when(F.col(answer) == LETTERS[0], F.col(LETTERS[0]))
    for letter in LETTERS[1:]:
        chosen = chosen.when(F.col(answer) == letter, F.col(letter))
    return chosen


def letter_to_index(letter: Column) -> Column:
    """A..E to 0..4."""
    return F.position(letter, F.lit(ALPHABET)) - 1


def index_to_letter(index: Column) -> Column:
    return F.substring(F.lit(ALPHABET), index.cast("int") + 1, F.lit(1))


def letter_to_number(letter: Column) -> Column:
    """A..E to 1..5."""
    return F.position(letter, F.lit(ALPHABET))


def one_hot(letter: Column, answer: Column) -> Column:
    return (letter == answer).cast("int")
