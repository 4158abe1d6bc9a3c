"""Paragraph corpora, article indexes, sharded full texts and embeddings."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.cluster import stored, with_row_index
from askframe.operators.questions import next_id


def scan_corpus(parts: list[DataFrame], id_col: str = "article_id") -> DataFrame:
    """Concatenate paragraph sets into one id range.

    A set's ids are shifted past the largest id of the sets before it, so the
    new id depends only on the data, not on files or partitions.
    """
    offset = F.lit(0).cast("long")
    out = None
    for part in parts:
        shifted = part.withColumn(id_col, F.col(id_col) + offset)
        out = shifted if out is None else out.unionByName(shifted)
        offset = offset + next_id(part, id_col)
    return out


def read_corpus(spark: SparkSession, paths: list[str], id_col: str = "article_id") -> DataFrame:
    return scan_corpus([spark.read.parquet(p) for p in paths], id_col)


def scan_index(spark: SparkSession, path: str, id_col: str = "id", file_col: str = "file") -> DataFrame:
    return spark.read.parquet(path).select(F.col(id_col).alias("id"), F.col(file_col).alias("file"))


# Bytes of text of one data file.
FILE_BYTES = 128 << 20
MANIFEST = "_manifest"


def write_fulltext(df: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Store ``id, text`` sorted by id in one folder per shard ``file``, in data files of about ``file_bytes``.

    Ranges of (shard, id) are written by a task each, so a shard holding a third of
    the corpus is many files with ranges of their own.  A manifest beside them
    names each file's first and last id.
    """
    rows = df.select("id", "text", "file")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / file_bytes))
    rows.repartitionByRange(n, "file", "id").sortWithinPartitions("file", "id").write.partitionBy("file").parquet(path)
    named = df.sparkSession.read.schema(_schema(df)).parquet(path).select("file", "id", F.col("_metadata.file_path").alias("data_file"))
    held = named.groupBy("file", "data_file").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    held.coalesce(1).write.parquet(f"{path}/{MANIFEST}")


def _schema(df: DataFrame) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in ("id", "text", "file"))


def ids_per_file(hits: DataFrame, chunk_rows: int = 10_000) -> DataFrame:
    """Sorted id lists per shard, ``(file, chunk, ids)``, each list of at most ``chunk_rows`` ids.

    Rows are numbered in (file, id) order first, so a shard with very many hits
    becomes many lists instead of one.
    """
    placed = with_row_index(hits.select("file", "id"), [F.col("file"), F.col("id")], "_row")
    chunk = F.floor(F.col("_row") / chunk_rows).alias("chunk")
    return placed.groupBy("file", chunk).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def files_holding(spark: SparkSession, path: str, wanted: DataFrame) -> list[str]:
    """Data files whose range of ids has one of ``(file, id)``; the manifest, one row a data file, is all that is read."""
    manifest = spark.read.parquet(f"{path}/{MANIFEST}").orderBy("file", "low", "high").toArrow()
    ranges: dict = {}
    for file, name, low, high in zip(*(manifest.column(c).to_pylist() for c in ("file", "data_file", "low", "high"))):
        ranges.setdefault(file, []).append((low, high, name))
    shared = spark.sparkContext.broadcast(ranges)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for batch in batches:
            for file, ident in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = shared.value.get(file, [])
                # Ranges are in order and meet at most in an id that one file ends and the next begins with.
                at = bisect_left(own, ident, key=lambda r: r[1])
                while at < len(own) and own[at][0] <= ident:
                    found.add(own[at][2])
                    at += 1
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["data_file"])

    names = wanted.select("file", "id").filter("file is not null and id is not null").mapInArrow(find, "data_file string")
    return sorted(r["data_file"] for r in names.distinct().collect())


def scan_fulltext(spark: SparkSession, path: str, hits: DataFrame) -> DataFrame:
    """Texts of the wanted articles only; no data file is opened that cannot hold one.

    ``hits`` names ``(id, file)``.  It is stored first: its files are looked up in
    the manifest, and a short list is broadcast by its known size.
    """
    wanted = stored(hits.select("id", "file").distinct(), "wanted")
    paths = files_holding(spark, path, wanted)
    manifest = spark.read.parquet(f"{path}/{MANIFEST}").schema
    schema = f"id {manifest['low'].dataType.simpleString()}, text string, file {manifest['file'].dataType.simpleString()}"
    if not paths:
        return spark.createDataFrame([], schema).select("id", "text")
    texts = spark.read.schema(schema).option("basePath", path).parquet(*paths)
    return texts.join(wanted, ["file", "id"], "left_semi").select("id", "text")


def scan_embeddings(df: DataFrame, paragraph_id: int = 0) -> DataFrame:
    """Titles and vectors of one paragraph position (the first by default)."""
    return df.filter(F.col("paragraph_id") == paragraph_id).select("title", "emb")
