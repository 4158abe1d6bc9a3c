"""MAP@k, hit reports, losses and model correlation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROB_FLOOR = 1e-15


def ap_at_k(actual: Column, predicted: Column, k: int = 10) -> Column:
    """Average precision at ``k`` of two arrays in one row.

    A repeated prediction counts at its first place only; no actual items give 0.
    """
    top = F.slice(predicted, 1, k)

    def step(acc: Column, item: Column, place: Column) -> Column:
        hit = F.array_contains(actual, item) & (F.array_position(top, item) == place)
        hits = acc["hits"] + hit.cast("int")
        gain = F.when(hit, hits / place).otherwise(F.lit(0.0))
        return F.struct(hits.alias("hits"), (acc["score"] + gain).alias("score"))

    placed = F.transform(top, lambda item, i: F.struct(item.alias("item"), (i + 1).alias("place")))
    score = F.aggregate(
        placed,
        F.struct(F.lit(0).alias("hits"), F.lit(0.0).alias("score")),
        lambda acc, x: step(acc, x["item"], x["place"]),
        lambda acc: acc["score"],
    )
    possible = F.least(F.size(actual), F.lit(k))
    return F.when(possible > 0, score / F.greatest(possible, F.lit(1))).otherwise(F.lit(0.0))


def map_at_k(df: DataFrame, keys: list[str], k: int = 10, reduction: str | None = "average") -> DataFrame:
    """Mean AP@k per ``keys`` over rows of ``(actual, predicted)`` arrays; ``None`` keeps the rows."""
    scored = df.withColumn("ap", ap_at_k(F.col("actual"), F.col("predicted"), k))
    if reduction is None:
        return scored
    return scored.groupBy(*keys).agg(F.avg("ap").alias("map_at_k"))


def _with_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Every row with ``right``: whether its letter is the answer; false where the question has none."""
    asked = answers.select("id", F.col("answer").alias("_answer"))
    right = F.coalesce(F.col("letter") == F.col("_answer"), F.lit(False))
    return rows.join(asked, "id", "left").withColumn("right", right).drop("_answer")


def hits_report(ranked: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Hits at ranks 1 to 3, accuracy and MAP@3 in percent, per ``keys``; one row in all without keys.

    ``ranked`` is ``(keys, id, letter, rank)``.  One pass counts hits inside each
    task.  Every answered question counts in the total of every key, as a miss
    where its right letter has no row.  Without answers the shares are null.
    """
    total = answers.agg(F.count("*")).scalar()
    hit = [F.count_if(F.col("right") & (F.col("rank") == r)).alias(f"top{r}") for r in (1, 2, 3)]
    report = _with_answers(ranked, answers).groupBy(*keys).agg(*hit).withColumn("total", total)
    hits = F.col("top1") + F.col("top2") / 2 + F.col("top3") / 3
    return report.withColumn("accuracy_pct", F.round(F.try_divide(100.0 * F.col("top1"), "total"), 6)).withColumn(
        "map3_pct", F.round(F.try_divide(100.0 * hits, F.col("total")), 6)
    )


def report_first_and_all(ranked_flagged: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Hit reports for the rows flagged ``in_first_n`` and for all rows, each over its own questions."""
    first = ranked_flagged.filter("in_first_n")
    asked = answers.join(first.select("id").distinct(), "id", "left_semi")
    parts = [("first_n", first, asked), ("all", ranked_flagged, answers)]
    reports = [hits_report(rows.withColumn("subset", F.lit(name)), some, [*keys, "subset"]) for name, rows, some in parts]
    return reports[0].unionByName(reports[1])


def log_loss(probs: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of ``-ln p`` of the right letter, with p kept off 0 and 1; one row in all without keys.

    A question whose right letter has no row counts with the smallest p.
    Without answers the loss is null.
    """
    total = answers.agg(F.count("*")).scalar()
    p = F.least(F.greatest(F.col("prob"), F.lit(PROB_FLOOR)), F.lit(1 - PROB_FLOOR))
    found = _with_answers(probs, answers).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("right"), -F.log(p))), F.lit(0.0)).alias("loss"), F.count_if("right").alias("n")
    )
    missed = (total - F.col("n")) * -math.log(PROB_FLOOR)
    return found.select(*keys, F.try_divide(F.col("loss") + missed, total).alias("log_loss"))


def wide_models(probs: DataFrame, models: list) -> DataFrame:
    """One row per ``(id, letter)`` with columns ``p0..`` in the order of ``models``."""
    picks = [F.max(F.when(F.col("model_id") == m, F.col("prob"))).alias(f"p{i}") for i, m in enumerate(models)]
    return probs.groupBy("id", "letter").agg(*picks)


def model_correlation(probs: DataFrame, models: list) -> DataFrame:
    """Pearson correlation of every pair of models over all ``(id, letter)`` cells.

    One pivot puts a cell's models side by side, so pairs are columns, not
    joined rows.
    """
    pairs = [(i, j) for i in range(len(models)) for j in range(len(models))]
    entries = F.array(
        *[
            F.struct(
                F.lit(models[i]).alias("model_a"), F.lit(models[j]).alias("model_b"), F.col(f"c_{i}_{j}").alias("corr")
            )
            for i, j in pairs
        ]
    )
    one_row = wide_models(probs, models).agg(*[F.corr(f"p{i}", f"p{j}").alias(f"c_{i}_{j}") for i, j in pairs])
    return one_row.select(F.inline(entries))


def mean_nll(sequences: DataFrame, ignore: int = -100) -> DataFrame:
    """Mean over sequences of the mean next-token loss.

    A row holds arrays ``labels`` and ``logprobs``; ``logprobs[i]`` belongs to
    ``labels[i + 1]``.  Ignored labels are skipped.  All per-sequence work is in
    the row.
    """
    n = F.greatest(F.size("labels") - 1, F.lit(0))
    pairs = F.arrays_zip(
        F.slice("labels", F.lit(2), n).alias("label"), F.slice("logprobs", F.lit(1), n).alias("logprob")
    )
    kept = F.filter(pairs, lambda p: p["label"] != ignore)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, p: acc - p["logprob"])
    per_sequence = F.when(F.size(kept) > 0, total / F.greatest(F.size(kept), F.lit(1)))
    return sequences.select(per_sequence.alias("nll")).agg(F.avg("nll").alias("mean_nll"))


def best_context_variant(probs: DataFrame) -> DataFrame:
    """Per question keep the context run with the highest top probability; ties to the smaller run.

    ``probs`` is ``(variant, id, letter, prob)``.
    """
    peak = probs.groupBy("id", "variant").agg(F.max("prob").alias("peak"))
    chosen = peak.groupBy("id").agg(
        F.max_by("variant", F.struct("peak", (-F.col("variant")).alias("v"))).alias("variant")
    )
    return probs.join(chosen, ["id", "variant"])
