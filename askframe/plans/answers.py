"""Score questions with a model and judge the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from askframe.functions.prompts import prompt_column
from askframe.operators.metrics import hits_report
from askframe.operators.questions import drop_incomplete, unpivot_options
from askframe.operators.scoring import option_probabilities, rank_letters, score_options, word_overlap_scorer
from askframe.operators.sentences import context_word_budget


def answer_probabilities(
    questions: DataFrame,
    family: str = "Llama2",
    prompt_id: int = 9,
    word_limit: int = 0,
    make_scorer=word_overlap_scorer,
) -> DataFrame:
    """``(id, letter, prob)`` by asking the model yes or no for each option."""
    df = context_word_budget(questions, word_limit, use_all_answers=False)
    options = drop_incomplete(unpivot_options(df, with_context=True))
    prompts = options.withColumn("text", prompt_column(family, prompt_id, with_answer=False))
    return option_probabilities(score_options(prompts, make_scorer), ["id"])


def answer_report(probs: DataFrame, answers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Hits, accuracy and MAP@3 of probabilities against the right answers."""
    keys = keys or []
    return hits_report(rank_letters(probs, [*keys, "id"]), answers, keys)
