"""Prompts, shared prefixes, sentence pairs and their truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.fixed_values import (
    LETTERS,
    PAIR_CONTEXT_MARK,
    PAIR_QUESTION_MARK,
    PAIR_SEPARATOR,
    PROMPT_TEXTS,
)
from askframe.functions.letters import letter_to_index
from askframe.functions.prompts import option_suffixes, prompt_column, prompt_kind, prompt_rows, shared_prefix
from askframe.functions.text import word_count, words
from askframe.operators.questions import drop_incomplete, unpivot_options
from askframe.operators.sentences import context_word_budget


def render_prompt(
    df: DataFrame, family: str, prompt_id: int, with_answer: bool, word_limit: int = 0, name: str = "text"
) -> DataFrame:
    """Questions to prompts: word budget, unpivot for yes/no kinds, drop incomplete rows, fill."""
    kind = prompt_kind(family, prompt_id)
    df = context_word_budget(df, word_limit, use_all_answers=kind["letter_answer"])
    if kind["yes_no_answer"]:
        df = unpivot_options(df, with_context=kind["with_context"])
    return drop_incomplete(df).withColumn(name, prompt_column(family, prompt_id, with_answer))


def prompt_dimension(spark: SparkSession) -> DataFrame:
    """One row per template: its key and its answer style."""
    rows = [(family, prompt_id, *prompt_kind(family, prompt_id).values()) for family, prompt_id in PROMPT_TEXTS]
    return spark.createDataFrame(
        rows,
        "family string, prompt_id int, letter_answer boolean, text_answer boolean, "
        "yes_no_answer boolean, with_context boolean",
    )


def with_prompt_kind(df: DataFrame) -> DataFrame:
    """Add the answer style to rows naming ``(family, prompt_id)``; unknown templates fail the job."""
    joined = df.join(F.broadcast(prompt_dimension(df.sparkSession)), ["family", "prompt_id"], "left")
    unknown = F.raise_error(F.concat_ws(" ", F.lit("unknown template"), "family", F.col("prompt_id").cast("string")))
    return joined.withColumn(
        "letter_answer", F.coalesce(F.col("letter_answer"), unknown.cast("boolean"))
    )


def render_by_template(df: DataFrame, with_answer: bool) -> DataFrame:
    """Fill the template each row names; a yes/no kind gives a row per option, with its ``letter``.

    An unknown template fails the job.  The template is a choice among constant
    texts, so the join to the template table is folded into one expression.
    """
    chosen = None
    for family, prompt_id in PROMPT_TEXTS:
        match = (F.col("family") == family) & (F.col("prompt_id") == prompt_id)
        rows = prompt_rows(family, prompt_id, with_answer)
        chosen = F.when(match, rows) if chosen is None else chosen.when(match, rows)
    other = F.raise_error(F.concat_ws(" ", F.lit("unknown template"), "family", F.col("prompt_id").cast("string")))
    found = df.withColumn("_rows", chosen.otherwise(other.cast("array<struct<letter: string, text: string>>")))
    return found.withColumn("_row", F.explode("_rows")).withColumns({"letter": F.col("_row.letter"), "text": F.col("_row.text")}).drop("_rows", "_row")


def render_all(df: DataFrame, with_answer: bool, templates=PROMPT_TEXTS) -> DataFrame:
    """Every template for every complete question, ``(family, prompt_id, id, letter, text)``, in one look at the questions."""

    def named(family: str, prompt_id: int) -> Column:
        def row(r: Column) -> Column:
            return F.struct(F.lit(family).alias("family"), F.lit(prompt_id).alias("prompt_id"), r["letter"].alias("letter"), r["text"].alias("text"))

        return F.transform(prompt_rows(family, prompt_id, with_answer), row)

    each = [named(*key) for key in templates]
    return drop_incomplete(df).select("id", F.inline(F.concat(*each))).select("family", "prompt_id", "id", "letter", "text")


def prefix_suffixes(df: DataFrame) -> DataFrame:
    """Shared prompt beginning and the five option endings."""
    return df.withColumn("prefix", shared_prefix()).withColumn("suffixes", option_suffixes())


def pair_text(df: DataFrame) -> DataFrame:
    """One ``(first, second)`` text pair per option, and the label index."""
    def second(letter: str) -> Column:
        return F.concat(
            F.lit(PAIR_QUESTION_MARK), F.col("prompt"), F.lit(PAIR_SEPARATOR + " "), F.col(letter), F.lit(PAIR_SEPARATOR)
        )

    options = F.array(*[F.struct(F.lit(c).alias("letter"), second(c).alias("second")) for c in LETTERS])
    label = [letter_to_index(F.col("answer")).alias("label")] if "answer" in df.columns else []
    return df.select(
        "id", F.concat(F.lit(PAIR_CONTEXT_MARK), F.col("context")).alias("first"), *label, F.explode(options).alias("o")
    ).select("id", "first", *(["label"] if label else []), "o.letter", "o.second")


def truncate_first_only(df: DataFrame, max_len: int) -> DataFrame:
    """Shorten only ``first`` until both halves have at most ``max_len`` words; ``cut`` says where.

    Where ``second`` alone leaves no room, nothing is cut and ``no_room`` is true:
    the pair is longer than asked for, and the caller decides about it.
    """
    room = F.lit(max_len) - word_count(F.col("second"))
    no_room = F.coalesce(room <= 0, F.lit(False))
    too_long = F.coalesce(~no_room & (word_count(F.col("first")) > room), F.lit(False))
    shorter = F.array_join(F.slice(words(F.col("first")), F.lit(1), F.greatest(room, F.lit(0))), " ")
    return df.withColumns({"cut": too_long, "no_room": no_room}).withColumn("first", F.when(F.col("cut"), shorter).otherwise(F.col("first")))
