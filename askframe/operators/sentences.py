"""Documents to sections and sentences, and the word budget of a context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe.fixed_values import LETTERS
from askframe.functions.letters import answer_text
from askframe.functions.text import budget_sentences, sentence_spans, word_count


def sectionize(documents: DataFrame) -> DataFrame:
    """The whole text as one section, ``(document_id, text, start, end)``."""
    return documents.select(
        "document_id", "text", F.lit(0).alias("start"), F.length("text").alias("end")
    )


def sentencize(sections: DataFrame, filter_len: int = 3) -> DataFrame:
    """Sentences longer than ``filter_len`` with their place in the original document.

    A generator per row: no shuffle.  A null text yields no sentence.
    """
    spans = sections.select(
        "document_id",
        F.col("start").alias("section_start"),
        F.explode(sentence_spans(F.col("text"))).alias("s"),
    )
    return spans.filter(F.length("s.text") > filter_len).select(
        "document_id",
        F.col("s.text").alias("text"),
        (F.col("section_start") + F.col("s.start")).alias("start"),
        (F.col("section_start") + F.col("s.end")).alias("end"),
    )


def process_documents(documents: DataFrame, split_sentences: bool = True, filter_len: int = 3) -> DataFrame:
    sections = sectionize(documents)
    return sentencize(sections, filter_len) if split_sentences else sections


def context_word_budget(df: DataFrame, limit: int, use_all_answers: bool) -> DataFrame:
    """Cut ``context`` before the first sentence whose running word total reaches ``limit``.

    The total starts with the prompt's words and those of all options, or of the
    right option only.  A limit of zero or less leaves the context alone.
    """
    if limit <= 0:
        return df
    base = word_count(F.col("prompt"))
    if use_all_answers:
        for letter in LETTERS:
            base = base + word_count(F.col(letter))
    else:
        base = base + word_count(answer_text())

    sentences = F.col("_sentences")
    start = F.struct(base.alias("total"), F.lit(0).alias("kept"))
    kept = F.aggregate(
        sentences,
        start,
        lambda acc, s: F.struct(
            (acc["total"] + word_count(s)).alias("total"),
            # Totals only grow, so the first one at the limit ends the count.
            (acc["kept"] + (acc["total"] + word_count(s) < limit).cast("int")).alias("kept"),
        ),
        lambda acc: acc["kept"],
    )
    return (
        df.withColumn("_sentences", budget_sentences(F.col("context")))
        .withColumn("context", F.array_join(F.slice(sentences, F.lit(1), kept), " "))
        .drop("_sentences")
    )
