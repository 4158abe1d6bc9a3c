"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

A null text is an empty one: a single end token.  Repeated rows are packed once each.
"""

from __future__ import annotations

import functools
import operator
import os
import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from askframe.llm.common import TEXTS_AT_ONCE, stored
from askframe.llm.words import Table, encode_words, joined, slices

# Words that a Python worker remembers at most, about 150 bytes each.
CACHE = 400_000
# Generations without a gain that end a search.
PATIENCE = 10
# Marks other than the apostrophe between a letter or digit and white space are a word of their own to the tokenizer.
_TAIL = r"([a-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([!-&(-/:-@\[-`{-~]+)([\t-\r ]|$)"
# Lower-case letters that normalising and splitting leave as they are.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
END = (0).to_bytes(4, "little")


class Pieces(Table):
    """Ids of whole texts as little-endian bytes; distinct words are remembered up to a bound.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words in turn.
    """

    def __init__(self, path: str):
        super().__init__(CACHE)
        # Spark's tasks already use the cores; the library's own threads cost more than twice the CPU here.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)

    def learn(self, words: list[str]) -> dict[str, bytes]:
        return encode_words(self.tokenizer, words, _LETTERS, "I")

    def many(self, texts: pa.StringArray) -> Iterator[bytes]:
        """Ids of each text, the end among them."""
        for some in slices(texts):
            plain = pc.replace_substring_regex(pc.ascii_lower(some), _TAIL, r"\1 \2\3")
            special = pc.match_substring(some, "<|")
            if pc.any(special).as_py():  # perhaps a special token, whose case and marks matter
                plain = pc.if_else(special, some, plain)
            for ids in joined(pc.ascii_split_whitespace(plain), " ", self.codes):
                yield ids + END

    def ids(self, text: bytes) -> bytes:
        return next(self.many(pa.array([text.decode()], pa.string())))


@functools.cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``; only longer documents are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(path)
        for batch in batches:
            rows = []
            for ident, ids in zip(batch.column(0).to_pylist(), p.many(batch.column(1))):
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((ident, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


Bin = list[int]


def _fit(bins: list[Bin], items: Bin, size: list[int], capacity: int) -> list[Bin]:
    """Put items, largest first, each where the least room is left over."""
    at = size.__getitem__
    room = sorted([(capacity - sum(map(at, b)), k) for k, b in enumerate(bins)])
    for i in sorted(items, key=at, reverse=True):
        k = bisect_left(room, (size[i], -1))
        if k == len(room):
            bins.append([i])
            insort(room, (capacity - size[i], len(bins) - 1))
        else:
            left, k = room.pop(k)
            bins[k].append(i)
            insort(room, (left - size[i], k))
    return bins


def _worth(bins: list[Bin], size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    at = size.__getitem__
    return -len(bins), sum([(sum(map(at, b)) / capacity) ** 2 for b in bins])


class Loose:
    """Documents by size; the sizes that occur are the bits of one number, and what they leave of the capacity those of another.

    Whether two documents make a sum is seen by one shift, whatever their number.
    """

    def __init__(self, items: Bin, size: list[int], capacity: int):
        self.size, self.capacity = size, capacity
        self.by: dict[int, Bin] = {}
        self.one = self.rest = 0
        for i in items:
            self.add(i)

    def add(self, item: int) -> None:
        n = self.size[item]
        some = self.by.setdefault(n, [])
        some.append(item)
        if len(some) == 1:
            self.one |= 1 << n
            self.rest |= 1 << (self.capacity - n)

    def take(self, n: int) -> int:
        some = self.by[n]
        item = some.pop()
        if not some:
            del self.by[n]
            self.one ^= 1 << n
            self.rest ^= 1 << (self.capacity - n)
        return item

    def two(self, total: int) -> int:
        """The larger size of two documents that make ``total``, or 0."""
        both = self.one & (self.rest >> (self.capacity - total))
        if not total & 1 and both >> (total >> 1) & 1 and len(self.by[total >> 1]) < 2:
            both ^= 1 << (total >> 1)
        return max(0, both.bit_length() - 1)

    def take_best(self, least: int, most: int) -> Bin:
        """One or two documents with the largest sum above ``least`` and up to ``most``, if there are any."""
        one = self.one
        single = (one & ((2 << most) - 1)).bit_length() - 1
        pairs = 2 * ((one & -one).bit_length() - 1), 2 * (one.bit_length() - 1)
        for total in range(min(most, pairs[1]), max(least, single, pairs[0] - 1), -1):
            if n := self.two(total):
                return [self.take(n), self.take(total - n)]
        return [self.take(single)] if single > least else []


def _swap(bins: list[Bin], loose: Bin, size: list[int], capacity: int) -> tuple[list[Bin], Bin]:
    """Give up to two documents of a bin for one or two displaced ones that fill it better; what comes out is smaller and fits more easily."""
    held, at = Loose(loose, size, capacity), size.__getitem__
    for b in bins:
        room = capacity - sum(map(at, b))
        while room and held.by:
            tried = set()
            for some in (*combinations(b, 1), *combinations(b, 2)):
                out = sum(map(at, some))
                if out in tried:
                    continue
                tried.add(out)
                if came := held.take_best(out, out + room):
                    break
            else:
                break
            for i in some:
                b.remove(i)
                held.add(i)
            b += came
            room += out - sum(map(at, came))
    return bins, [i for n in sorted(held.by) for i in held.by[n]]


def _cross(one: list[Bin], two: list[Bin], size: list[int], capacity: int, rng: random.Random) -> list[Bin]:
    """Inject a share of the fullest bins of ``two`` whole; bins of ``one`` that repeat a document dissolve, and a few more."""
    at = size.__getitem__
    ranked = sorted(two, key=lambda b: -sum(map(at, b)))
    taken = [b for b in ranked[: max(1, len(ranked) // 2)] if rng.random() < 0.5]
    have = {i for b in taken for i in b}
    kept = [b for b in one if have.isdisjoint(b)]
    loose = [i for b in one if not have.isdisjoint(b) for i in b if i not in have]
    # Some poorly filled bins dissolve too, so that their documents can fill gaps.
    kept.sort(key=lambda b: sum(map(at, b)))
    drop = set(range(min(len(kept), max(2, len(kept) // 20))))
    drop |= {k for k in range(len(kept)) if rng.random() < 0.05}
    loose += [i for k in drop for i in kept[k]]
    bins, loose = _swap([list(b) for b in taken] + [list(b) for k, b in enumerate(kept) if k not in drop], loose, size, capacity)
    return _fit(bins, loose, size, capacity)


def evolve(size: list[int], capacity: int, seed: int, immigrants: list[list[Bin]], population: int = 12, generations: int = 40) -> list[Bin]:
    """Best grouping after some generations from best-fit-decreasing and shuffled starts.

    No grouping has fewer bins than the sizes fill; evolution ends where that is
    reached, often at once.
    """
    rng, bound = random.Random(seed), -(-sum(size) // capacity)

    def rated(bins: list[Bin]) -> tuple[tuple[int, float], list[Bin]]:
        return _worth(bins, size, capacity), bins

    everyone = [rated(bins) for bins in (_fit([], list(range(len(size))), size, capacity), *immigrants)]
    rate = operator.itemgetter(0)
    if -max(everyone, key=rate)[0][0] <= bound:
        return max(everyone, key=rate)[1]
    while len(everyone) < population:
        order = list(range(len(size)))
        rng.shuffle(order)
        some = order[: len(order) // 2]
        start = [[i] for i in some if size[i] > capacity // 2]
        for i in some:  # half of the documents in any order, the rest where they fit best
            if size[i] <= capacity // 2:
                room = [b for b in start[-3:] if sum(size[j] for j in b) + size[i] <= capacity]
                room[0].append(i) if room else start.append([i])
        everyone.append(rated(_fit(start, order[len(order) // 2 :], size, capacity)))
    since, last = 0, None
    for _ in range(generations):
        everyone = sorted(everyone, key=rate, reverse=True)[:population]
        since, last = (since + 1, last) if last == everyone[0][0] else (0, everyone[0][0])
        if -last[0] <= bound or since >= PATIENCE:
            break
        for _ in range(max(1, population // 2)):
            one, two = (min(rng.sample(range(len(everyone)), 2)) for _ in range(2))
            everyone.append(rated(_cross(everyone[one][1], everyone[two][1], size, capacity, rng)))
    return max(everyone, key=rate)[1]


def _bins(frame: pd.DataFrame, column: str) -> list[Bin]:
    return [list(g) for g in pd.Series(range(len(frame))).groupby(frame[column].to_numpy()).groups.values()]


def pack(docs: DataFrame, path: str, capacity: int = 2048, region: int = 3000, islands: int = 2, rounds: int = 2) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.

    Pieces are dealt by hash into regions of a bounded number.  Each region
    evolves on several islands, a task each; elites migrate to the next island
    between epochs, and the best island's grouping stands.  Its full sequences
    are final; documents of poorly filled ones are dealt into new, fewer
    regions and packed again, over ``rounds``.
    """
    cut_pieces = stored(cut(docs, path, capacity), "pieces", TEXTS_AT_ONCE)
    full = cut_pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    # Stored with its number, so that every later step names a piece alike.
    rest = stored(cut_pieces.filter(F.col("length") < capacity).withColumn("item", F.monotonically_increasing_id()), "pieces-open")
    todo, placed = rest.select("item", "length"), []

    def island(epoch: int):
        def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            base = frame[frame["elite"] < 0].sort_values("item", ignore_index=True)
            size = base["length"].tolist()
            moved = frame[frame["elite"] >= 0]
            others = [_bins(m.sort_values("item", ignore_index=True), "bin") for _, m in moved.groupby("elite")]
            best = evolve(size, capacity, int(key[0]) * 1009 + int(key[1]) + epoch, others)
            bins, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for k, b in enumerate(best):
                at = 0
                for i in b:
                    bins[i], offset[i], at = k, at, at + size[i]
            filled = np.bincount(bins, weights=base["length"], minlength=len(best))[bins] if len(size) else []
            return base.assign(bin=bins, offset=offset, filled=np.asarray(filled, np.int64), n_bins=len(best), elite=int(key[1]))[["region", "island", "item", "length", "elite", "bin", "offset", "filled", "n_bins"]]

        return run

    schema = "region long, island int, item long, length long, elite int, bin long, offset long, filled long, n_bins long"
    for turn in range(rounds):
        n = todo.count()
        if not n:
            break
        regions = max(1, -(-n // region))
        dealt = todo.withColumn("region", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(regions)))
        base = dealt.select("region", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), "item", "length", F.lit(-1).alias("elite"), F.lit(0).cast("long").alias("bin"))
        first = stored(base.groupBy("region", "island").applyInPandas(island(0), schema), "islands")
        moved = first.select("region", ((F.col("island") + 1) % islands).alias("island"), "item", "length", "elite", "bin")
        second = stored(base.union(moved).groupBy("region", "island").applyInPandas(island(1), schema), "islands")
        best = second.groupBy("region").agg(F.min(F.struct("n_bins", "island")).alias("best")).select("region", F.col("best.island").alias("island"))
        chosen = stored(second.join(best, ["region", "island"]).withColumn("turn", F.lit(turn)), "packed")
        final = F.lit(turn == rounds - 1) | (F.col("filled") >= 0.99 * capacity)
        placed.append(chosen.filter(final).select("item", (F.col("region") * (1 << 24) * rounds + F.col("bin") * rounds + turn).alias("sequence_id"), "offset"))
        todo = chosen.filter(~final).select("item", "length")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if not placed:
        return full.select(columns)
    where = functools.reduce(DataFrame.union, placed)
    return rest.join(where, "item").select(columns).union(full.select(columns))
