"""CSV and parquet sinks, and reuse of stored results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from askframe.operators.scoring import prediction_string

# Write options that read back exactly: quotes doubled, outer spaces kept.
CSV_WRITE = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.options(**CSV_WRITE)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_submission(probs: DataFrame, path: str) -> None:
    """``id, prediction`` with the letters best first."""
    write_csv(prediction_string(probs, ["id"]), path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a write to ``path`` was committed, told by its success marker."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def _files(spark: SparkSession, paths: Iterable[str]) -> list[tuple[str, int, int]]:
    """Name, size and time of every file at or below ``paths``."""
    found = []
    for path in paths:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(root):
            found.append((path, -1, -1))
            continue
        listed = store.listFiles(root, True)
        while listed.hasNext():
            status = listed.next()
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(found)


def _code(fn: Callable) -> list[str]:
    """What a function does, by its compiled code and that of the functions inside it."""
    code = getattr(fn, "__code__", None)
    if code is None:
        return [repr(fn)]
    found, todo = [], [code]
    while todo:
        one = todo.pop()
        todo += [c for c in one.co_consts if hasattr(c, "co_code")]
        found.append(f"{one.co_code.hex()} {one.co_names} {[c for c in one.co_consts if not hasattr(c, 'co_code')]}")
    return found


def fingerprint(spark: SparkSession, build: Callable, inputs: Iterable[str | DataFrame] = (), params: dict | None = None) -> str:
    """A name for what ``build`` makes of ``inputs``: their files with sizes and times, the parameters, and the code.

    An input is a path, or a frame, which stands for its plan and the files it reads.
    """
    paths, plans = [], []
    for one in inputs:
        if isinstance(one, str):
            paths.append(one)
        else:
            plans.append(one._jdf.queryExecution().analyzed().canonicalized().toString())
            paths += one.inputFiles()
    facts = {"files": _files(spark, paths), "plans": plans, "params": params or {}, "code": _code(build)}
    return hashlib.sha256(json.dumps(facts, sort_keys=True, default=repr).encode()).hexdigest()[:32]


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], inputs: Iterable[str | DataFrame] = (), params: dict | None = None) -> DataFrame:
    """The result stored below ``path`` for just these inputs, parameters and code; else build, store and read it.

    Each fingerprint has a folder of its own beside a note of what it stands
    for, so a changed input or parameter never returns the old result.  A folder
    left by a failed write has no marker and is overwritten.
    """
    own = f"{path}/{fingerprint(spark, build, inputs, params)}"
    if not is_complete(spark, own):
        build().write.mode("overwrite").parquet(own)
    return spark.read.parquet(own)


def materialize_parts(
    spark: SparkSession, path: str, parts: dict[str, list[str | DataFrame]], build: Callable[[str], DataFrame], params: dict | None = None
) -> DataFrame:
    """The union of ``build(name)`` over all parts, each stored by its own inputs: only changed parts are built again."""
    found = None
    for name in sorted(parts):
        part = partial(build, name)
        own = f"{path}/{name}/{fingerprint(spark, build, parts[name], {**(params or {}), 'part': name})}"
        if not is_complete(spark, own):
            part().write.mode("overwrite").parquet(own)
        df = spark.read.parquet(own)
        found = df if found is None else found.unionByName(df)
    return found
