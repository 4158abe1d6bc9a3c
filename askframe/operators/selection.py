"""The row at a given rank, without sorting the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, STEP = 60, 12
# So many distinct rows may come to the driver at the end.
LEFT = 10_000


def hash_key(text: Column) -> Column:
    """The first 60 bits of a lower-case hexadecimal digest, in the digest's own order."""
    return F.conv(F.substring(text, 1, BITS // 4), 16, 10).cast("long")


def nth_smallest(df: DataFrame, key: Column, order: list[Column], rank: int) -> tuple | None:
    """Values of ``order`` in the row at 0-based ``rank``; ``key`` is a number of 60 bits that sorts as ``order`` begins.

    Each pass counts the rows by the next 12 bits of ``key`` inside the range
    that holds the rank, so tasks hand on at most 4,096 counts; after a few
    passes the range is small enough to be looked at.  ``None`` past the end.
    """
    names = [f"o{i}" for i in range(len(order))]
    rows = df.select(key.alias("key"), *[c.alias(n) for c, n in zip(order, names)])
    bits, prefix = BITS, 0
    while bits:
        bits -= STEP
        bucket = F.shiftright("key", bits)
        inside = rows.filter(F.shiftright("key", bits + STEP) == prefix)
        for r in inside.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect():
            if rank < r["n"]:
                prefix, found = r["b"], r["n"]
                break
            rank -= r["n"]
        else:
            return None
        if found <= LEFT:
            break
    # Equal rows count as one with a number, so copies of an id do not add up here.
    left = rows.filter(F.shiftright("key", bits) == prefix).groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names)
    for r in left.toLocalIterator():
        if rank < r["n"]:
            return tuple(r[n] for n in names)
        rank -= r["n"]
    return None
