"""Text expressions: tokens, n-grams, words, sentences, bullets, query texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from askframe.fixed_values import LETTERS, SEARCH_INSTRUCTION, STOP_WORDS
from askframe.functions.vectors import bind

# Fixed value: same tokens as the classic word pattern, written so that Java,
# RE2 and Python agree on letters and combining marks.
TOKEN_PATTERN = r"""[\p{L}\p{N}_](?:[\p{L}\p{N}_/.\-]*[\p{L}\p{N}_])?|[!/?"']"""

# A word is a run free of whitespace, with Unicode separators counted as whitespace.
WORD_PATTERN = r"[^\s\p{Z}\x0B\x85\x1C-\x1F]+"

# Pieces of this pattern re-join to the exact text.
SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*|[.!?]+|\n"


def tokenize(text: Column) -> Column:
    """Lower-case tokens in text order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def remove_stop_words(tokens: Column, stop_words=STOP_WORDS) -> Column:
    words = list(stop_words)
    return F.filter(tokens, lambda t: ~t.isin(words))


def ngrams(tokens: Column) -> Column:
    """Single tokens followed by neighbouring pairs joined with a space."""

    def both(t: Column) -> Column:
        pairs = F.greatest(F.size(t) - 1, F.lit(0))
        return F.concat(
            t, F.zip_with(F.slice(t, F.lit(1), pairs), F.slice(t, F.lit(2), pairs), lambda a, b: F.concat(a, F.lit(" "), b))
        )

    return bind(tokens, both)


def terms(text: Column) -> Column:
    """Stop-word-free uni- and bigrams of a text."""
    return ngrams(remove_stop_words(tokenize(text)))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def sentence_pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE_PATTERN), F.lit(0))


def sentence_spans(text: Column) -> Column:
    """Array of ``struct<text, start, end>``: trimmed pieces with their place in the text."""
    return bind(sentence_pieces(text), _spans)


def _spans(pieces: Column) -> Column:
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(
        pieces,
        zero,
        lambda acc, p: F.struct(
            (acc["pos"] + F.length(p)).alias("pos"),
            F.array_append(acc["starts"], acc["pos"]).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )

    def span(piece: Column, start: Column) -> Column:
        lead = F.length(piece) - F.length(F.ltrim(piece))
        body = F.trim(piece)
        return F.struct(
            body.alias("text"),
            (start + lead).alias("start"),
            (start + lead + F.length(body)).alias("end"),
        )

    return F.zip_with(pieces, starts, span)


def budget_sentences(context: Column) -> Column:
    """Sentences for the word budget: cut at ``". "`` and at bullets, each ending in a full stop."""
    parts = F.flatten(F.transform(F.split(context, r"\. "), lambda s: F.split(s, "\n-")))
    filled = F.filter(parts, lambda s: s.rlike(WORD_PATTERN))
    return F.transform(filled, lambda s: F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit("."))))


def context_bullets(contexts: Column, max_chars: int | None = None) -> Column:
    """Array of contexts to ``- c`` lines; nulls are skipped."""
    def line(c: Column) -> Column:
        return F.concat(F.lit("- "), c if max_chars is None else F.substring(c, 1, max_chars))

    return F.array_join(F.transform(F.array_compact(contexts), line), "\n")


def bullets_from_columns(n: int, prefix: str = "context_top") -> Column:
    return context_bullets(F.array(*[F.col(f"{prefix}{i}") for i in range(1, n + 1)]))


def _joined(parts: list[Column], separator: str) -> Column:
    # concat, not concat_ws: a question with a missing part has no query text.
    out: list[Column] = []
    for part in parts:
        out += [F.lit(separator), part]
    return F.concat(*out[1:])


def query_text_weighted(prompt: str = "prompt") -> Column:
    """Prompt three times, then the options, on lines of their own."""
    return _joined([F.col(prompt)] * 3 + [F.col(c) for c in LETTERS], "\n")


def query_text_all(prompt: str = "prompt") -> Column:
    return _joined([F.col(prompt)] + [F.col(c) for c in LETTERS], " ")


def query_text_answer(prompt: str = "prompt", answer: str = "answer") -> Column:
    from askframe.functions.letters import answer_text

    return _joined([F.col(prompt), answer_text(answer)], " ")


def instruction_prefix(text: Column) -> Column:
    return F.concat(F.lit(SEARCH_INSTRUCTION), text)


def corpus_text_v1(title: Column, section: Column, text: Column) -> Column:
    """Search text of a sectioned corpus: one line, no apostrophes."""
    joined = _joined([title, section, text], " ")
    return F.replace(F.replace(joined, F.lit("\n"), F.lit(" ")), F.lit("'"), F.lit(""))


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Compatibility decomposition; Spark has no built-in for it."""
    return text.map(lambda s: unicodedata.normalize("NFKD", s), na_action="ignore")


def normalize_context(text: Column) -> Column:
    """NFKD on returned paragraphs."""
    return nfkd(text)


def corpus_text_v0(title: Column, text: Column) -> Column:
    """Search text of an unsectioned corpus: NFKD, no double quotes."""
    return F.replace(nfkd(_joined([title, text], " ")), F.lit('"'), F.lit(""))
