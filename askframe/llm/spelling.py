"""Spelling variants: edits of every word are probed in broadcast Bloom filters, and only positives meet the vocabulary.

A null text holds no run, a null id counts as the empty text.  Rows that
repeat an id are counted once each.  Words near no other word have no form
and are their own root.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import stored

LEAST = 5
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST)
ODD = 97
# A block is eight 64-bit words; a filter word sets one bit in each of them.
BLOCK_WORDS, BITS_A_WORD = 8, 24
FILTER_BYTES = 64 << 20
COUNTER = 400_000
ROWS_AT_ONCE = 2_000_000
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of every run as it stands after the contract's deletions, in all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = Counter(RUN.findall((text.as_py() or b"").lower().decode()))
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word in [w for w in own if not zlib.crc32(w.encode(), seed) % ODD]:
                    at = zlib.crc32(word.encode(), seed) % len(word)
                    n = own.pop(word)
                    if len(word) > LEAST:
                        total[word[:at] + word[at + 1 :]] += n
                total.update(own)
                if len(total) > COUNTER:
                    yield flush()
        yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def _symbol(code: np.ndarray) -> np.ndarray:
    return _mix(code.astype(U64) + U64(1))


def _powers(n: int) -> np.ndarray:
    return np.array([pow(BASE, i, 1 << 64) for i in range(n)], U64)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def _hash(codes: np.ndarray) -> np.ndarray:
    """Sum of symbol times power of the place: an edit changes it by a term, or shifts its tail."""
    return (_symbol(codes) * _powers(codes.shape[1])).sum(axis=1, dtype=U64)


def _spot(hashed: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block number, and the mask of each of its words."""
    h = _mix(hashed)
    block = ((h >> U64(32)) * blocks.astype(U64)) >> U64(32)
    low = _mix(h + U64(BASE))
    return block.astype(np.int64), U64(1) << (low[:, None] >> np.arange(0, 6 * BLOCK_WORDS, 6, dtype=U64) & U64(63))


def _share(hashed: np.ndarray, passes: int) -> np.ndarray:
    """Which pass looks for a word."""
    return (_mix(hashed ^ U64(BASE)) % U64(passes)).astype(np.int64)


def _by_length(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    yield from groups.items()


def _filters(vocabulary: DataFrame, sizes: dict[int, int], passes: int, turn: int) -> dict[int, np.ndarray]:
    """For each length the blocked Bloom filter of this pass's words; tasks set bits, Spark merges blocks."""
    schema = "length int, block long, " + ", ".join(f"w{i} long" for i in range(BLOCK_WORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, words in _by_length(batch.column(0).to_pylist()):
                h = _hash(_codes(words))
                h = h[_share(h, passes) == turn]
                block, mask = _spot(h, np.full(len(h), sizes[length]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), length, np.int32)), pa.array(block), *[pa.array(mask[:, i].view(np.int64)) for i in range(BLOCK_WORDS)]], names=["length", "block", *[f"w{i}" for i in range(BLOCK_WORDS)]])

    merged = vocabulary.select("word").mapInArrow(run, schema).groupBy("length", "block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)])
    # At most FILTER_BYTES in blocks, by the choice of ``passes``.
    table = merged.toArrow()
    length, block = table.column("length").to_numpy(), table.column("block").to_numpy()
    words = np.stack([table.column(f"w{i}").to_numpy() for i in range(BLOCK_WORDS)], axis=1).view(U64)
    found = {n: np.zeros((k, BLOCK_WORDS), U64) for n, k in sizes.items()}
    for n in found:
        found[n][block[length == n]] = words[length == n]
    return found


def _probe(words: list[str], alphabet: np.ndarray, filters: dict[int, np.ndarray], passes: int, turn: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(word, place, old code or 0, new code or 0)`` of the edits in the filters, for words of one length.

    Of a pair that differs by a replacement the word with the smaller code
    point asks, of one that differs by an insertion the longer word.
    """
    length, codes = len(words[0]), _codes(words)
    whole, power = _hash(codes), _powers(length)
    terms = _symbol(codes) * power

    def ask(h: np.ndarray, target: int, row: np.ndarray, place: np.ndarray, new: np.ndarray):
        filt = filters.get(target)
        if filt is None or not len(h):
            return
        mine = np.flatnonzero(_share(h, passes) == turn) if passes > 1 else np.arange(len(h))
        block, mask = _spot(h[mine], np.full(len(mine), len(filt)))
        hit = mine[(filt[block] & mask == mask).all(axis=1)]
        yield row[hit], place[hit], new[hit]

    if length > LEAST:
        before = np.cumsum(terms, axis=1, dtype=U64) - terms
        after = (whole[:, None] - before - terms) * U64(UNBASE)
        row, place = np.divmod(np.arange(len(words) * length), length)
        # Within a stretch of one letter every deletion gives the same word: its first place asks.
        first = np.ones(codes.shape, bool)
        first[:, 1:] = codes[:, 1:] != codes[:, :-1]
        use = first.ravel()
        yield from ask((before + after).ravel()[use], length - 1, row[use], place[use], np.zeros(int(use.sum()), np.uint32))
    symbol = _symbol(alphabet)
    for new, s in zip(alphabet, symbol):
        row, place = np.nonzero(codes < new)
        h = whole[row] - terms[row, place] + s * power[place]
        yield from ask(h, length, row, place, np.full(len(row), new, np.uint32))


def _positives(vocabulary: DataFrame, alphabet: list[int], filters: dict[int, np.ndarray], passes: int, turn: int) -> DataFrame:
    """``(word, n, edited)`` of every edit that a filter holds."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(filters)
    points = np.array(alphabet, np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_of = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for length, group in _by_length(list(n_of)):
                each = max(1, ROWS_AT_ONCE // (length * 8))
                for at in range(0, len(group), each):
                    words = group[at : at + each]
                    for row, place, new in _probe(words, points, shared.value, passes, turn):
                        asked = [words[r] for r in row.tolist()]
                        edited = [w[:p] + (chr(c) if c else "") + w[p + 1 :] for w, p, c in zip(asked, place.tolist(), new.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(asked, pa.string()), pa.array([n_of[w] for w in asked], pa.int64()), pa.array(edited, pa.string())], names=["word", "n", "edited"])

    return vocabulary.mapInArrow(run, "word string, n long, edited string")


def near_words(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Both directions ``(word, n, other, m)`` of all pairs of distinct ``(word, n)`` that differ by one code point.

    Filters hold ``BITS_A_WORD`` bits a word.  A vocabulary whose filters would
    pass ``filter_bytes`` is probed in several passes, each with the words of
    one class of hashes; a broadcast never passes that size.
    """
    counts = {r["length"]: r["n"] for r in vocabulary.groupBy(F.char_length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return vocabulary.select("word", "n", F.col("word").alias("other"), F.col("n").alias("m"))
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    alphabet = sorted(ord(r["c"]) for r in letters.collect())
    passes = max(1, math.ceil(sum(counts.values()) * BITS_A_WORD / 8 / filter_bytes))
    sizes = {length: max(1, math.ceil(n * BITS_A_WORD / (64 * BLOCK_WORDS) / passes)) for length, n in counts.items()}
    found = None
    for turn in range(passes):
        part = _positives(vocabulary, alphabet, _filters(vocabulary, sizes, passes, turn), passes, turn)
        found = part if found is None else found.union(part)
    exact = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("m"))
    one = found.join(exact, F.col("edited") == F.col("other")).select("word", "n", "other", "m")
    pairs = F.array(F.struct("word", "n", "other", "m"), F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)`` by pointer doubling; along forms the count at least doubles, so chains are short and end."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        after = stored(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(docs: DataFrame, least: int = 3, ratio: int = 2, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word with at least ``least`` occurrences."""
    vocabulary = stored(word_counts(docs).filter(F.col("n") >= least), "spelling-words")
    near = near_words(vocabulary, filter_bytes)
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("form")))
    found = near.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    good = -F.col("best.m") >= ratio * F.col("n")
    found = stored(found.select("word", "n_near", F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")), "spelling-near")
    root = roots(found.filter(F.col("form").isNotNull()))
    whole = vocabulary.join(found, "word", "left").join(root, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
