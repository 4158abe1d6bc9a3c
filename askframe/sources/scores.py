"""Model probabilities and training logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.cluster import with_row_index
from askframe.fixed_values import LETTERS
from askframe.sources.questions import PLACE, read_in_place

# Facts of a run's state, and what every logged step has; evaluation metrics are found in the logs.
STATE_FACTS = {"best_model_checkpoint": "string", "best_metric": "double", "epoch": "double", "global_step": "long"}
STEP_FACTS = {"step": "long", "loss": "double"}


def read_model_probs(
    spark: SparkSession,
    paths: str | list[str],
    model_pattern: str = r"model_id=([^/]+)/",
    columns: Sequence[str] = LETTERS,
) -> DataFrame:
    """Five-column CSVs of many models as one ``(model_id, id, letter, prob)`` table.

    The model's name is taken from each file's path.  ``columns`` names the
    options' columns in order.  A file without ``id`` gets each row's 0-based
    position in the file.
    """
    raw = read_in_place(spark, paths, recursiveFileLookup="true")
    if "id" not in raw.columns:
        placed = with_row_index(raw, [F.col(c) for c in PLACE], "_position")
        first = placed.groupBy("_file").agg(F.min("_position").alias("_first"))
        raw = placed.join(first, "_file").withColumn("id", F.col("_position") - F.col("_first"))
    raw = raw.select(
        F.regexp_extract("_file", model_pattern, 1).alias("model_id"),
        F.col("id").cast("long").alias("id"),
        *[F.col(f"`{c}`").cast("double").alias(letter) for c, letter in zip(columns, LETTERS, strict=True)],
    )
    return raw.unpivot(["model_id", "id"], list(LETTERS), "letter", "prob")


def _states(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """One row per logged step: the state's facts, and the step as ``log``, a map of variants by name."""
    raw = spark.read.option("multiLine", str(multi_line).lower()).option("singleVariantColumn", "state").json(path)
    facts = [F.try_variant_get("state", f"$.{name}", kind).alias(name) for name, kind in STATE_FACTS.items()]
    history = F.try_variant_get("state", "$.log_history", "array<variant>")
    return raw.select(*facts, F.explode(history).alias("log")).withColumn("log", F.col("log").cast("map<string, variant>"))


def logged_metrics(spark: SparkSession, path: str, multi_line: bool = True) -> list[str]:
    """Names of all evaluation values in any step of any state; one name a task and metric is shuffled."""
    names = _states(spark, path, multi_line).select(F.explode(F.map_keys("log")).alias("name")).filter(F.col("name").startswith("eval_"))
    return sorted(r["name"] for r in names.distinct().collect())


def read_run_logs(spark: SparkSession, path: str, multi_line: bool = True, metrics: list[str] | None = None) -> DataFrame:
    """One row per logged step of every run state, with the state's own facts and every metric alongside.

    Without ``metrics`` a first pass finds the names, so a metric that only one
    step of one run has becomes a column.  Values that are no numbers are null.
    """
    found = logged_metrics(spark, path, multi_line) if metrics is None else metrics
    names = {**STEP_FACTS, "eval_loss": "double", **{name: "double" for name in found}}
    checkpoint = F.col("best_model_checkpoint")

    def value(name: str, kind: str) -> Column:
        return F.try_variant_get(F.try_element_at("log", F.lit(name)), F.lit("$"), kind).alias(name)

    return _states(spark, path, multi_line).select(
        F.regexp_extract(checkpoint, r"([^/]+)/checkpoint-\d+$", 1).alias("run_id"),
        F.regexp_extract(checkpoint, r"checkpoint-(\d+)$", 1).try_cast("long").alias("best_step"),
        "best_metric",
        "epoch",
        "global_step",
        *[value(name, kind) for name, kind in names.items()],
    )
