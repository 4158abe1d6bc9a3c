"""Question sets from CSV files and context versions from partitioned tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.cluster import with_row_index
from askframe.fixed_values import CONTEXT_VERSIONS, EXTRA_SETS, LETTERS
from askframe.functions.text import bullets_from_columns
from askframe.operators.questions import canonical_columns, checked_rows, head_per_group

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV with quoted line breaks; columns are strings by header name unless ``schema`` is given."""
    reader = spark.read.options(**CSV_OPTIONS)
    if schema:
        reader = reader.schema(schema)
    return reader.csv(path)


def _with_context(df: DataFrame, with_context: bool, top_n: int) -> DataFrame:
    if with_context and "context" not in df.columns:
        return df.withColumn("context", bullets_from_columns(top_n))
    return df


def read_questions(
    spark: SparkSession, path: str, mode: str, with_context: bool = False, top_n: int = 3
) -> DataFrame:
    """Canonical question columns; ``answer`` for train and valid, ``context`` only when asked.

    A file with ``context_top1..n`` instead of ``context`` gets bullets of the first ``top_n``.
    """
    df = _with_context(read_csv(spark, path), with_context, top_n)
    return canonical_columns(df.withColumn("id", F.col("id").cast("long")), mode, with_context)


def read_in_place(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """CSV rows with their place: ``_file``, ``_block`` and ``_row`` order them as they stand in the files."""
    rows = spark.read.options(**CSV_OPTIONS, **options).csv(path)
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


PLACE = ["_file", "_block", "_row"]


def read_extra_questions(
    spark: SparkSession,
    path: str,
    expected_rows: int | None = None,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    with_context: bool = False,
    top_n: int = 3,
    order: str = "file",
) -> DataFrame:
    """An extra set with new 0-based ids; a wrong row count fails the job.

    The id is the row's position in the file, or with ``order="content"`` its
    position by the question's own text, which does not depend on how the rows
    lie in files.  ``transform`` sees the new ids.
    """
    if order not in ("file", "content"):
        raise ValueError(f"unknown order: {order}")
    df = read_in_place(spark, path).drop("id")
    content = ["prompt", *LETTERS, "answer"] if order == "content" else []
    df = with_row_index(df, [F.col(c) for c in (*content, *PLACE)], "id").drop(*PLACE)
    df = _with_context(df, with_context, top_n)
    if transform is not None:
        df = df.transform(transform)
    df = canonical_columns(df, "train", with_context)
    return df if expected_rows is None else checked_rows(df, expected_rows)


def read_named_set(spark: SparkSession, root: str, name: str, registry=EXTRA_SETS, **kwargs) -> DataFrame:
    """One registered extra set below ``root``, checked against its expected size."""
    path, rows, one_per_page = registry[name]
    transform = first_of_page if one_per_page else None
    return read_extra_questions(spark, f"{root}/{path}", rows, transform, **kwargs)


def first_of_page(df: DataFrame) -> DataFrame:
    """The first question of each page."""
    return head_per_group(df, ["page_title"], [F.col("id")], 1)


def registry_frame(spark: SparkSession, registry=EXTRA_SETS) -> DataFrame:
    """The registry as a table ``(set_name, path, expected_rows, one_per_page)``."""
    rows = [(name, *entry) for name, entry in registry.items()]
    return spark.createDataFrame(rows, "set_name string, path string, expected_rows long, one_per_page boolean")


def registry_check(registry: DataFrame, found: DataFrame) -> DataFrame:
    """Expected and found rows of every registered or found set; ``found`` has ``set_name`` per row."""
    counts = found.groupBy("set_name").agg(F.count("*").alias("found_rows"))
    joined = registry.select("set_name", "expected_rows").join(counts, "set_name", "full")
    return joined.select(
        "set_name",
        "expected_rows",
        F.coalesce("found_rows", F.lit(0)).alias("found_rows"),
        F.coalesce(F.col("expected_rows") == F.col("found_rows"), F.lit(False)).alias("matches"),
    )


def select_context_version(df: DataFrame, version: int) -> DataFrame:
    """Questions of one context version; ``context_version`` is the table's partition column."""
    if version not in CONTEXT_VERSIONS:
        raise ValueError(f"unknown context version: {version}")
    return df.filter(F.col("context_version") == version).drop("context_version")
