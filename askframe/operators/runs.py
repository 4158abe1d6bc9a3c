"""Tables behind learning curves and saved points of training runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.fixed_values import NON_METRIC_COLUMNS


def metric_columns(logs: DataFrame) -> list[str]:
    """Evaluation columns other than loss and timings."""
    return [c for c in logs.columns if c.startswith("eval_") and c not in NON_METRIC_COLUMNS]


def unpivot_metrics(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Log rows to ``(keys, type, value)``; a step without a value keeps a null row."""
    if "eval_loss" not in logs.columns:
        logs = logs.withColumn("eval_loss", F.lit(None).cast("double"))
    return logs.unpivot(keys, ["loss", "eval_loss", *metric_columns(logs)], "type", "value")


def _epoch(step: Column, epoch: Column, global_step: Column) -> Column:
    """``step * epoch / global_step``; by IEEE rules where a state was saved at step 0, as a division of doubles there is an error in Spark."""
    reached = step * epoch
    return F.when(global_step == 0, reached * float("inf")).otherwise(reached / global_step)


def learning_curve(logs: DataFrame) -> DataFrame:
    """``(run_id, epoch, step, type, value, facet)`` of logs holding ``epoch`` and ``global_step``."""
    scaled = logs.withColumn("epoch", _epoch(F.col("step"), F.col("epoch"), F.col("global_step")))
    long = unpivot_metrics(scaled, ["run_id", "epoch", "step"])
    name = F.replace(F.col("type"), F.lit("eval_"), F.lit(""))
    facet = (
        F.when(F.col("type").isin("loss", "eval_loss"), "loss")
        .when(name.endswith("MAP@3"), "MAP@3")
        .otherwise(name)
    )
    return long.withColumn("facet", facet)


def _best_step(logs: DataFrame) -> Column:
    """The run's own best step where its state tells one, else the step with the lowest evaluation loss (earliest on ties)."""
    lowest = F.min_by("step", F.when(F.col("eval_loss").isNotNull(), F.struct("eval_loss", "step")))
    # The latest state of a run is the one that counts.
    return F.coalesce(F.max_by("best_step", F.struct("global_step", "step")), lowest) if "best_step" in logs.columns else lowest


def best_and_latest(logs: DataFrame) -> DataFrame:
    """Per run: the last step, and the best one."""
    return logs.groupBy("run_id").agg(F.max("step").alias("latest_step"), _best_step(logs).alias("best_step"))


def saved_points(logs: DataFrame) -> DataFrame:
    """Epoch and evaluation loss at each run's best and latest step; no loss where that step was not evaluated."""
    points = best_and_latest(logs).select(
        "run_id",
        F.inline(F.array(*[F.struct(F.lit(n).alias("save_point"), F.col(f"{n}_step").alias("step")) for n in ("best", "latest")])),
    )
    facts = logs.groupBy("run_id").agg(
        F.max_by(F.struct("epoch", "global_step"), F.struct("global_step", "step")).alias("state")
    )
    losses = logs.groupBy("run_id", "step").agg(F.min("eval_loss").alias("value"))
    at = _epoch(F.col("step"), F.col("state.epoch"), F.col("state.global_step"))
    found = points.filter(F.col("step").isNotNull()).join(losses, ["run_id", "step"], "left").join(facts, "run_id")
    return found.select("run_id", "save_point", "step", at.alias("epoch"), "value")
