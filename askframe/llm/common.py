"""What the operators share: the scratch folder, deterministic shards, and connected components."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ids looked at for shard bounds: the driver holds about so many, whatever the input.
BOUND_SAMPLE = 50_000
# Rows of whole texts that travel to Python in one batch.
TEXTS_AT_ONCE = 1_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that driver and executors share.

    Only a local master without that setting gets a folder of its own, which is then the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="askframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside send at most ``rows`` rows at a time to Python; the session's own setting holds where it is smaller, and again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, str(min(rows, before) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, str(before))


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, and the size is known to the planner.

    With ``batch_rows`` Python inside the plan meets at most so many rows at a time.
    """
    path = scratch(df.sparkSession, name)
    with batches_of(df.sparkSession, batch_rows) if batch_rows else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shard_bounds(rows: DataFrame, key: str, size: str, shard_bytes: int, max_shards: int) -> list[int]:
    """Ascending cuts of ``key`` into shards of about equal bytes; the same rows give the same cuts.

    The number of shards follows from the total size.  Cuts are weighted
    quantiles over the ids whose hash falls into a fixed class, about
    ``BOUND_SAMPLE`` distinct ids however many rows there are; every row is
    sharded, only the cuts are estimated.
    """
    n, total = rows.agg(F.count("*"), F.sum(size)).first()
    shards = min(max_shards, math.ceil((total or 0) / shard_bytes))
    if shards < 2:
        return []
    every = max(1, n // BOUND_SAMPLE)
    sample = rows.filter((F.pmod(F.xxhash64(key), F.lit(every)) == 0) & F.col(key).isNotNull())
    # The ids, not their rows, are collected: a repeated id counts once, with the size of all its rows.
    table = sample.groupBy(key).agg(F.sum(size).cast("double").alias("w")).toPandas().sort_values(key)
    if table.empty:
        return []
    share = np.cumsum(table["w"].to_numpy()) / max(table["w"].sum(), 1.0)
    at = np.searchsorted(share, np.arange(1, shards) / shards)
    return sorted({int(x) for x in table[key].to_numpy()[np.minimum(at, len(table) - 1)]})


def shard_of(key: Column, bounds: list[int], width: int = 64) -> Column:
    """Number of bounds at or below ``key`` in two short scans; a null key goes to shard 0."""
    if not bounds:
        return F.lit(0)
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= key))

    head = below(F.lit([g[0] for g in groups]))
    inner = below(F.element_at(F.array(*[F.lit(g) for g in groups]), head))
    return F.when(key.isNull() | (head == 0), 0).otherwise((head - 1) * width + inner)


def union_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the sets of ``a[i]`` and ``b[i]``; ``labels`` maps each place to the smallest place of its set."""
    while len(a):
        a, b = labels[a], labels[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := labels[labels], labels):
            labels = up
    return labels


def _star(edges: DataFrame, name: str, small: bool) -> DataFrame:
    """One star step over edges ``(hi, lo)``: link what a node sees to the smallest of it.

    The minima are stored before the join: both sides of it then come from
    plain shuffles, which adaptive execution splits at a hot node.
    """
    down = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
    seen = down if small else down.union(edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
    least = stored(seen.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m")), name)
    joined = seen.join(least, "node")
    if small:
        pairs = joined.select(F.explode(F.array(F.struct(F.col("node").alias("x"), "m"), F.struct(F.col("other").alias("x"), "m"))).alias("p")).select("p.x", "p.m")
    else:
        pairs = joined.filter(F.col("other") > F.col("node")).select(F.col("other").alias("x"), "m")
    return stored(pairs.filter(F.col("x") != F.col("m")).distinct().select(F.col("x").alias("hi"), F.col("m").alias("lo")), name)


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of an edge ``(a, b)`` that is not itself the smallest of its component.

    Alternating large and small stars; each round is stored in the shared
    folder, so a lost executor repeats at most one step.  Rounds grow with the
    logarithm of a component's diameter.
    """
    edges = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = stored(edges.distinct(), name)
    state = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        state = now
        edges = _star(_star(edges, name, small=False), name, small=True)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
