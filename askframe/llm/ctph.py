"""Context-triggered piecewise hashing: rolling-hash cuts, chunk signatures, edit-distance likeness.

A null text is an empty one.  Documents are ordered by descending id, nulls
last, then by the text's hash, so repeated rows stand side by side.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import shard_bounds, shard_of

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SHORTEST, LONGEST, COMMON = 8, 64, 7
PIECE = 4 << 20
_TABLE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)


def _cuts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of chunks at the shortest block size, and by how many doublings each also ends a longer one."""
    ends, power = [], []
    for at in range(0, len(data), PIECE):
        back = min(at, 7)
        h = _TABLE[np.frombuffer(data, np.uint8, min(PIECE, len(data) - at) + back, at - back)]
        for s in (1, 2, 4):
            rolled = h.copy()
            rolled[s:] += h[:-s] << np.uint32(s)
            h = rolled
        h = (h * np.uint32(0x85EBCA6B) >> np.uint32(3))[back:]
        hit = np.flatnonzero((h & np.uint32(SHORTEST - 1)) == SHORTEST - 1)
        ends.append(hit + at + 1)
        top = h[hit] >> np.uint32(3)
        power.append(np.bitwise_count(top & ~(top + np.uint32(1))).astype(np.int64))
    return (np.concatenate(ends), np.concatenate(power)) if ends else (np.empty(0, np.int64),) * 2


def fingerprint(text: str) -> str:
    """``block:signature:signature at twice the block``; the block is the least that needs at most 64 chunks."""
    data = text.encode()
    ends, power = _cuts(data)
    k = 0
    while (power >= k).sum() >= LONGEST:
        k += 1

    def signature(level: int) -> str:
        at = [0, *ends[power >= level].tolist()]
        at += [len(data)] * (at[-1] < len(data))
        return "".join([LETTERS[zlib.crc32(data[a:b]) & 63] for a, b in zip(at, at[1:])])

    return f"{SHORTEST << k}:{signature(k)}:{signature(k + 1)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, all places of ``b`` at once as bits of a number."""
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    row = full = (1 << len(b)) - 1
    for c in a:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def _alike(a: str, b: str) -> float:
    """One less the edit distance (insertions and deletions) over both lengths; 0 without a common run."""
    if a == b:
        return 1.0
    n = min(COMMON, len(a), len(b))
    runs = {a[i : i + n] for i in range(len(a) - n + 1)}
    if not n or not any(b[i : i + n] in runs for i in range(len(b) - n + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; fingerprints compare at equal block sizes, or where one is twice the other."""
    if x == y:
        return 1.0
    (p, a, a2), (q, b, b2) = x.split(":"), y.split(":")
    p, q = int(p), int(q)
    if p == q:
        return max(_alike(a, b), _alike(a2, b2) if a2 and b2 else 0.0)
    return _alike(a2, b) if q == 2 * p else _alike(a, b2) if p == 2 * q else 0.0


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(shard, ahead, doc_id, text)`` in order; the first row of what follows stands ahead of its shard."""
    held, out, size = None, [], 0
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    for batch in batches:
        for i in range(batch.num_rows):
            ahead, doc_id, text = (batch.column(k)[i].as_py() for k in (1, 2, 3))
            print_ = fingerprint(text)
            if held is not None and not held[0]:
                _, ident, own, own_print = held
                half = len(own) // 2
                edited = own[: len(own) - half] + text[:half]
                other = fingerprint(edited)
                out.append((ident, len(own), hashlib.sha256(edited.encode()).hexdigest(), own_print, other, likeness(own_print, other), likeness(own_print, print_)))
            held = (ahead, doc_id, text, print_)
            if len(out) >= 5000:
                yield flush()
                out = []
    if out:
        yield flush()


def fingerprint_neighbours(docs: DataFrame, shard_bytes: int = 8 << 20, max_shards: int = 4096) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and likeness to that and to the next document.

    Texts move once, into ranges of ids.  The document that heads a range is
    also sent to the range before it, the first one to the last.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("turned", -F.col("doc_id"))
    sizes = rows.select("turned", F.octet_length("text").alias("size"))
    bounds = shard_bounds(sizes, "turned", "size", shard_bytes, max_shards)
    last = len(bounds) + 1
    shard = F.when(F.col("turned").isNull(), last).otherwise(shard_of(F.col("turned"), bounds))
    # One head a shard: at most max_shards rows.
    found = sizes.groupBy(shard.alias("shard")).agg(F.min("turned").alias("head")).orderBy("shard").collect()
    first = {r["shard"]: r["head"] for r in found}
    order = sorted(first)
    before = {s: order[i - 1] for i, s in enumerate(order)}
    rows = rows.withColumn("own", shard)
    target = F.create_map(*[F.lit(x) for s in order or [0] for x in (s, before.get(s, 0))])
    heads = F.create_map(*[F.lit(x) for s in order or [0] for x in (s, first.get(s) if first.get(s) is not None else 0)])
    leads = F.col("turned").isNull() | (F.col("turned") == heads[F.col("own")])
    copies = F.array(F.struct(F.col("own").alias("shard"), F.lit(False).alias("ahead")), F.struct(F.when(leads, target[F.col("own")]).alias("shard"), F.lit(True).alias("ahead")))
    dealt = rows.select("turned", "doc_id", "text", F.inline(copies)).filter(F.col("shard").isNotNull())
    dealt = dealt.repartitionById(last + 1, F.col("shard")).sortWithinPartitions("shard", "ahead", F.col("turned").asc_nulls_last(), F.xxhash64("text"))
    return dealt.select("shard", "ahead", "doc_id", "text").mapInArrow(_pairs, SCHEMA)
