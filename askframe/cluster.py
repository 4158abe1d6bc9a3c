"""Helpers that keep plans safe at scale: size checks, spreading, shared scratch, row numbers."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000


def session(app: str = "askframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC time, for scripts and tests."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_when(df: DataFrame, small: bool) -> DataFrame:
    """Hint a broadcast only for a side already proven small; else leave the choice to Catalyst."""
    return F.broadcast(df) if small else df


def task_count(spark: SparkSession) -> int:
    """Number of shuffle tasks to spread heavy per-row work over."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all tasks, so one big file or few row groups cannot serialise the work."""
    return df.repartition(task_count(df.sparkSession), *keys)


@contextlib.contextmanager
def _at_most(spark: SparkSession, name: str, most: int) -> Iterator[None]:
    own = spark.conf.get(name)
    # A size may be written with its unit; without one, or in bytes, it is compared.
    plain = own.removesuffix("b")
    if not (plain.isdigit() and 0 < int(plain) <= most):
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def arrow_rows(spark: SparkSession, rows: int) -> contextlib.AbstractContextManager[None]:
    """Tasks of jobs that run meanwhile get at most ``rows`` rows at a time in Python, so whole long texts do not pile up there."""
    return _at_most(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def arrow_bytes(spark: SparkSession, most: int) -> contextlib.AbstractContextManager[None]:
    """Batches between tasks of jobs that run meanwhile and Python end where they have about ``most`` bytes; their buffers grow by doubling."""
    return _at_most(spark, "spark.sql.execution.arrow.maxBytesPerBatch", most)


def reader_rows(spark: SparkSession, rows: int) -> contextlib.AbstractContextManager[None]:
    """Jobs that run meanwhile decode at most ``rows`` rows of a stored table at a time, so long lists do not pile up in the executor."""
    return _at_most(spark, "spark.sql.parquet.columnarReaderBatchSize", rows)


@contextlib.contextmanager
def small_row_groups(spark: SparkSession) -> Iterator[None]:
    """Tables written meanwhile have row groups of about 8 MB, looked at after every few rows and not after a hundred: for rows of several MB each."""
    wanted = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 2, "parquet.page.size.row.check.max": 16}
    own = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in own.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="askframe-")


def parallel_scan(scan: DataFrame, *keys: str) -> DataFrame:
    """Spread a scanned table only when its files make fewer splits than there are tasks.

    A big table has splits enough and is left where it is; ``scan`` must be a
    plain read, whose splits are known without running anything.
    """
    return spread(scan, *keys) if scan.rdd.getNumPartitions() < task_count(scan.sparkSession) else scan


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_scratch()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back.

    Cuts the lineage of a costly result that later steps use several times:
    they, and any retry after a lost executor, read it instead of computing it
    again, and its true size is known to the planner.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _in_order(df: DataFrame, order: list[Column]) -> tuple[DataFrame, Column, Column]:
    """``df`` sorted over range partitions and stored; a row's partition, and its place there.

    Partition and place are written with the row, so every later look, and any
    retry after a lost executor, sees the same ones.
    """
    ranged = df.repartitionByRange(task_count(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("_place", F.monotonically_increasing_id()), "in-order")
    return placed, F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))


def _before(placed: DataFrame, part: Column, value: Column) -> Column:
    """Sum of ``value`` over all partitions before the row's own: one number a partition, whatever the rows."""
    totals = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.sum(value).alias("n")).collect()}
    offsets, total = [], 0
    for i in range(max(totals, default=-1) + 1):
        offsets.append(total)
        total += totals.get(i) or 0
    return F.element_at(F.lit(offsets or [0]), part.cast("int") + 1)


def with_row_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add a 0-based position in the total order given by ``order``.

    Rows are sorted over range partitions; each counts its own rows, and the
    counts of those before it are added.  No task ever holds the whole table.
    ``order`` must be unique for a reproducible result.
    """
    placed, part, place = _in_order(df, order)
    return placed.withColumn(name, _before(placed, part, F.lit(1)) + place).drop("_place")


def with_running_total(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows up to and with this one, in the total order given by ``order``."""
    placed, part, _ = _in_order(df, order)
    upto = Window.partitionBy(part).orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn(name, _before(placed, part, value) + F.sum(value).over(upto)).drop("_place")
