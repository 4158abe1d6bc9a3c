"""Option scoring by a caller's model, softmaxes and ranked letters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from askframe.fixed_values import LETTERS


def word_overlap_scorer() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A deterministic stand-in model: yes-logit = distinct words the option shares with the text."""

    def score(texts: np.ndarray, options: np.ndarray) -> np.ndarray:
        out = np.ones((len(texts), 2), dtype=np.float64)
        for i, (text, option) in enumerate(zip(texts, options)):
            out[i, 0] = len(set(str(text).split()) & set(str(option).split())) / 10
        return out

    return score


def score_options(
    df: DataFrame,
    make_scorer: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]] = word_overlap_scorer,
    text: str = "text",
    option: str = "answer_text",
    batch_size: int = 8,
) -> DataFrame:
    """Add ``yes_logit`` and ``no_logit`` from batches of ``(text, option)``.

    The model is built once per Python worker, and only the two texts cross over.
    """
    udf = predict_batch_udf(make_scorer, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    scored = df.withColumn("_logits", udf(F.col(text), F.col(option)))
    return (
        scored.withColumn("yes_logit", F.element_at("_logits", 1))
        .withColumn("no_logit", F.element_at("_logits", 2))
        .drop("_logits")
    )


def yes_probability(yes: Column, no: Column) -> Column:
    """Softmax over the two logits, yes part."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(no - yes))


def softmax_over_options(df: DataFrame, value: str, keys: list[str], name: str = "prob") -> DataFrame:
    """Softmax of ``value`` within a question's options."""
    w = Window.partitionBy(*keys)
    raised = df.withColumn("_e", F.exp(F.col(value) - F.max(value).over(w)))
    return raised.withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def option_probabilities(df: DataFrame, keys: list[str]) -> DataFrame:
    """Yes-probability per option, then softmax over the options: ``(keys, letter, prob)``."""
    yes = df.withColumn("_yes", yes_probability(F.col("yes_logit"), F.col("no_logit")))
    return softmax_over_options(yes, "_yes", keys).select(*keys, "letter", "prob")


def rank_letters(probs: DataFrame, keys: list[str], tie: str = "first") -> DataFrame:
    """Add ``rank`` by descending probability; equal ones put the first or the last letter ahead."""
    if tie not in ("first", "last"):
        raise ValueError(f"unknown tie rule: {tie}")
    letter = F.asc("letter") if tie == "first" else F.desc("letter")
    return probs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("prob"), letter)))


def predictions(probs: DataFrame, keys: list[str], tie: str = "first") -> DataFrame:
    """Letters best first as array ``predicted``; a question has one row per option."""
    code = F.ascii("letter") if tie == "first" else -F.ascii("letter")
    entries = F.array_sort(F.collect_list(F.struct((-F.col("prob")).alias("p"), code.alias("c"), "letter")))
    return probs.groupBy(*keys).agg(F.transform(entries, lambda e: e["letter"]).alias("predicted"))


def prediction_string(probs: DataFrame, keys: list[str], tie: str = "first") -> DataFrame:
    return predictions(probs, keys, tie).select(*keys, F.array_join("predicted", " ").alias("prediction"))


def wide_options(probs: DataFrame, keys: list[str]) -> DataFrame:
    """Option columns A..E from ``(keys, letter, prob)``."""
    return probs.groupBy(*keys).pivot("letter", list(LETTERS)).agg(F.first("prob"))
