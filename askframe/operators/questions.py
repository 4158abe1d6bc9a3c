"""Question-set curation and reshaping."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askframe.cluster import broadcast_when, is_small, with_row_index
from askframe.fixed_values import LETTERS
from askframe.functions.text import word_count
from askframe.operators.selection import hash_key, nth_smallest


def canonical_columns(df: DataFrame, mode: str, with_context: bool = False) -> DataFrame:
    if mode not in ("train", "valid", "test"):
        raise ValueError(f"unexpected mode: {mode}")
    columns = ["id", "prompt"] + (["context"] if with_context else []) + list(LETTERS)
    return df.select(*columns, *([] if mode == "test" else ["answer"]))


def row_count(df: DataFrame) -> Column:
    """Row count as a scalar subquery: no action, no join."""
    return df.agg(F.count("*")).scalar()


def checked_rows(df: DataFrame, expected: int) -> DataFrame:
    """Pass rows through; fail the job when there are not exactly ``expected``.

    The check runs with the rows, and once more on a row of its own so that an
    empty table fails too.
    """
    found = row_count(df)
    message = F.concat(F.lit(f"expected {expected} rows, found "), found.cast("string"))

    def holds(outcome: bool) -> Column:
        return F.when(found == expected, F.lit(outcome)).otherwise(F.raise_error(message).cast("boolean"))

    no_row = df.sparkSession.range(1).filter(holds(False))
    empty = no_row.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.filter(holds(True)).unionByName(empty)


def non_empty(df: DataFrame, what: str) -> DataFrame:
    """Pass rows through; fail the job when there are none."""
    found = row_count(df)
    fails = F.when(found > 0, F.lit(False)).otherwise(F.raise_error(F.lit(f"no rows in {what}")).cast("boolean"))
    no_row = df.sparkSession.range(1).filter(fails)
    return df.unionByName(no_row.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))


def keep_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is listed; a short list of checked size is broadcast, so the table is not shuffled for it."""
    listed = ids.select(id_col).distinct()
    return df.join(broadcast_when(listed, is_small(listed)), id_col, "left_semi")


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def fill_missing(df: DataFrame) -> DataFrame:
    return df.na.fill("")


def duplicate_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids that occur more than once, with their count; empty when ids are unique."""
    return df.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1")


def unique_ids(df: DataFrame) -> DataFrame:
    """Pass rows through; fail the job when an id occurs twice."""
    total, distinct = row_count(df), df.agg(F.count_distinct("id")).scalar()
    message = F.concat(F.lit("duplicate id among rows: "), total.cast("string"), F.lit(", ids: "), distinct.cast("string"))
    return df.filter(F.when(total == distinct, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def attach_by_id(df: DataFrame, values: DataFrame) -> DataFrame:
    """Put ``values`` next to the rows of the same ``id``, strictly one to one.

    The job fails when an id is missing on either side or occurs twice.
    """
    left = unique_ids(df).withColumn("_left", F.lit(True))
    right = unique_ids(values).withColumn("_right", F.lit(True))
    message = F.concat(F.lit("no partner for id "), F.col("id").cast("string"))
    paired = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    joined = left.join(right, "id", "full")
    return joined.filter(F.when(paired, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("_left", "_right")


def next_id(df: DataFrame, id_col: str = "id") -> Column:
    """Largest id plus one, 0 for an empty table, as a scalar subquery."""
    return df.agg(F.coalesce(F.max(id_col) + 1, F.lit(0))).scalar()


def shift_ids(base: DataFrame, extra: DataFrame, id_col: str = "id") -> DataFrame:
    """Move ``extra``'s ids past the largest id of ``base``; an empty base shifts nothing."""
    return extra.withColumn(id_col, F.col(id_col) + next_id(base, id_col))


def merge_question_sets(base: DataFrame, extras: list[DataFrame]) -> DataFrame:
    """Union of a base set and extra sets with ids of their own, each shifted past the ones before."""
    out, offset = base, next_id(base)
    for extra in extras:
        out = out.unionByName(extra.withColumn("id", F.col("id") + offset))
        offset = offset + next_id(extra)
    return out


def _shuffle_key(seed: int, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def seeded_shuffle(df: DataFrame, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Whole-table shuffle: order by a hash of seed and id, the same on any partitioning.

    The place in the shuffled order is kept as ``position``.
    """
    return with_row_index(df, [_shuffle_key(seed, id_col), F.col(id_col)], "position")


def seeded_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Add ``split``: exactly ``ceil(n * test_size)`` rows are ``valid``, the rest ``train``.

    Those are the first rows of the seeded shuffle.  The last of them is found
    by counting, so the table is neither sorted nor shuffled, and a row's part
    follows from its own id.  Rows that repeat an id go the same way.
    """
    if test_size in (0, 1):
        return df.withColumn("split", F.lit("valid" if test_size == 1 else "train"))
    cut = math.ceil(df.count() * float(test_size))
    key = _shuffle_key(seed, id_col)
    last = nth_smallest(df, hash_key(key), [key, F.col(id_col)], cut - 1) if cut else None
    if last is None:
        return df.withColumn("split", F.lit("train"))
    first = (key < last[0]) | ((key == last[0]) & (F.col(id_col) <= last[1]))
    return df.withColumn("split", F.when(first, "valid").otherwise("train"))


def head_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows of each group.

    Every task drops all but its own first ``n`` before the shuffle, so a hot
    group moves only a few rows.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def split_n(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """``share`` 1..n: near-equal consecutive shares by id, the larger ones first."""
    total = row_count(df)
    small = F.floor(total / n)
    large_rows = F.pmod(total, F.lit(n)) * (small + 1)
    row = F.col("_row")
    share = F.when(row < large_rows, F.floor(row / (small + 1))).otherwise(
        F.pmod(total, F.lit(n)) + F.floor((row - large_rows) / F.greatest(small, F.lit(1)))
    )
    indexed = with_row_index(df, [F.col(id_col)], "_row")
    return indexed.withColumn("share", (share + 1).cast("int")).drop("_row")


def first_n_flag(df: DataFrame, n: int = 200, id_col: str = "id") -> DataFrame:
    """``in_first_n``: whether the row's id is among the ``n`` smallest ids."""
    last = df.select(id_col).distinct().orderBy(id_col).limit(n).agg(F.max(id_col)).scalar()
    return df.withColumn("in_first_n", F.col(id_col) <= last)


def incomplete_groups(df: DataFrame, id_col: str = "id", size: int = len(LETTERS)) -> DataFrame:
    """Questions without exactly five option rows; empty when batches of five are safe."""
    return df.groupBy(id_col).agg(F.count("*").alias("n_options")).filter(F.col("n_options") != size)


def unpivot_options(df: DataFrame, with_context: bool = False) -> DataFrame:
    """One row per option; with answers present, ``yes_or_no`` says whether it is the right one."""
    keys = ["id", "prompt"] + (["context"] if with_context else [])
    has_answer = "answer" in df.columns
    long = df.unpivot(keys + (["answer"] if has_answer else []), list(LETTERS), "letter", "answer_text")
    if has_answer:
        long = long.withColumn("yes_or_no", F.when(F.col("letter") == F.col("answer"), "yes").otherwise("no"))
    return long.drop("answer")


def pivot_contexts(df: DataFrame, n: int) -> DataFrame:
    """Ranked ``(id, rank, text)`` rows to columns ``context_top1..n``."""
    wide = df.groupBy("id").pivot("rank", list(range(1, n + 1))).agg(F.first("text"))
    return wide.select("id", *[F.col(str(i)).alias(f"context_top{i}") for i in range(1, n + 1)])


def filter_long_examples(df: DataFrame, max_len: int, text: str = "text") -> DataFrame:
    """Keep rows of at most ``max_len`` words; a limit of zero or less keeps all."""
    return df if max_len <= 0 else df.filter(word_count(F.col(text)) <= max_len)


def length_quantiles(df: DataFrame, length: Column, probs=(0, 0.5, 0.75, 0.9, 0.95, 1)) -> DataFrame:
    """Exact quantiles; lengths repeat, so each task ships one count per distinct length."""
    values = df.agg(F.percentile(length, F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
    return values.select(F.posexplode("q").alias("pos", "value")).select(
        F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("pos") + 1).alias("quantile"), "value"
    )


def batch_plan(df: DataFrame, prefix: Column, suffix: Column, cap: int | None = None, step: int = 512) -> DataFrame:
    """Longest prefix + suffix length, and the number of batches for it; ``cap`` limits both where asked for."""
    longest = F.max(prefix + suffix)
    longest = longest if cap is None else F.least(longest, F.lit(cap))
    return df.agg(longest.cast("long").alias("max_length")).withColumn(
        "n_batches", F.ceil(F.col("max_length") / step)
    )
