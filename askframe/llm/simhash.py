"""SimHash fingerprints and their near-duplicate components by a binary-trie self-join.

Null or empty texts have fingerprint zero and link like any other; a null id
never becomes a component's id.  Repeated rows keep one output row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import TEXTS_AT_ONCE, components, stored, union_labels

BLOCK_WORDS = 100_000
GROUP_LIMIT = 50_000
PAIRS_AT_ONCE = 2_000_000
# MinHash bands of similar_documents: texts of similarity 0.8 share one of them with probability 0.9996.
BANDS, BAND_ROWS = 20, 5
SIMILAR_LIMIT = 500
# At similarity 0.8 two fingerprints differ in about 10 bits, with a standard deviation of 3.
SIMILAR_BUDGET = 24
# Bits of the table that tells which rows may be wanted: 8 MB.
SIEVE_BITS = 26


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Majority bits over the XXH64 hashes of all word shingles, as unsigned 64 bits."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    ones, total = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, total, BLOCK_WORDS):
        part = words[at : min(len(words), at + BLOCK_WORDS + shingle - 1)]
        joined = b" ".join(part)
        ends = list(accumulate(len(w) + 1 for w in part))
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed long; one pass over the texts, no shuffle."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def trie_pairs(keys: np.ndarray, a_lo, a_hi, b_lo, b_hi, start_bit: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of sorted keys within ``budget`` bits, found by walking node pairs of their binary trie.

    A node is a range of the sorted keys.  Both nodes of a pair step down
    together; a step into different halves costs one bit, and a pair beyond the
    budget is dropped with everything below it.
    """
    rank: dict[int, np.ndarray] = {}

    def ones(bit: int) -> np.ndarray:
        if bit not in rank:
            rank[bit] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int32)])
        return rank[bit]

    stack = [(start_bit, a_lo, a_hi, b_lo, b_hi, np.zeros(len(a_lo), np.int8))]
    while stack:
        bit, al, ah, bl, bh, used = stack.pop()
        if len(al) > PAIRS_AT_ONCE:
            half = len(al) // 2
            stack += [(bit, *(x[s] for x in (al, ah, bl, bh, used))) for s in (slice(half), slice(half, None))]
            continue
        size = (ah - al) * (bh - bl)
        leaf = (size <= 32) | (bit == 64)
        if leaf.any():
            n, width = size[leaf], (bh - bl)[leaf]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(width, n)
            i, j = np.repeat(al[leaf], n) + at // width, np.repeat(bl[leaf], n) + at % width
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            yield i[near], j[near]
        al, ah, bl, bh, used = (x[~leaf] for x in (al, ah, bl, bh, used))
        if not len(al):
            continue
        c = ones(bit)
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        same = al == bl
        down = []
        for x0, x1, y0, y1, cost, keep in ((al, am, bl, bm, 0, None), (am, ah, bm, bh, 0, None), (al, am, bm, bh, 1, None), (am, ah, bl, bm, 1, ~same)):
            ok = (x1 > x0) & (y1 > y0) & (used + cost <= budget)
            ok = ok if keep is None else ok & keep
            down.append((x0[ok], x1[ok], y0[ok], y1[ok], (used + cost)[ok].astype(np.int8)))
        stack.append((bit + 1, *(np.concatenate(x) for x in zip(*down))))


def _join_cells(budget: int):
    """Forest edges of sorted rows ``(cell, side, key, fp)``; whole cells are walked together."""

    def walk(cell: np.ndarray, side: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        keys = key.view(np.uint64)
        first = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (side[1:] != side[:-1])])
        last = np.r_[first[1:], len(cell)]
        kind = side[first]
        pair = np.flatnonzero(kind == 1)
        left = np.flatnonzero(kind == 0)
        # Side 0 is walked with itself, or, where the cell has a side 1, with that.
        crossed = pair[(pair > 0) & (cell[first[pair]] == cell[first[pair - 1]])]
        alone = left[side[first[left]] == 0]
        alone = np.setdiff1d(alone, crossed - 1)
        a = np.r_[alone, crossed - 1].astype(np.int64)
        b = np.r_[alone, crossed].astype(np.int64)
        labels = np.arange(len(cell))
        for i, j in trie_pairs(keys, first[a], last[a], first[b], last[b], 0, budget):
            labels = union_labels(labels, i, j)
        child = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[labels[child]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held.append(tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "side", "key", "fp")))
            if sum(len(h[0]) for h in held) >= GROUP_LIMIT:
                rows = tuple(map(np.concatenate, zip(*held)))
                cut = int(np.searchsorted(rows[0], rows[0][-1]))
                if cut:
                    yield walk(*(r[:cut] for r in rows))
                held = [tuple(r[cut:] for r in rows)]
        if held and sum(len(h[0]) for h in held):
            yield walk(*map(np.concatenate, zip(*held)))

    return run


def links(distinct: DataFrame, budget: int = 3, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct fingerprints ``fp`` within ``budget`` bits.

    Of ``budget + 1`` blocks of bits one must be equal in both, so each block's
    value names a cell in which the trie is walked, rotated so that the block
    comes first.  A cell beyond the limit is dealt into chunks, and every pair
    of chunks is a cell of its own: exact at any size, with bounded tasks.  A
    cell hands on a spanning forest, never all its pairs.
    """
    width = 64 // (budget + 1)
    turned = F.shiftleft("fp", 0)
    parts = []
    for b in range(budget + 1):
        shift = b * width
        turned = F.shiftleft("fp", shift).bitwiseOR(F.shiftrightunsigned("fp", 64 - shift)) if shift else F.col("fp")
        value = F.shiftrightunsigned(turned, 64 - width)
        parts.append(F.struct((value * 64 + b).alias("home"), turned.alias("key")))
    rows = distinct.select("fp", F.inline(F.array(*parts)))
    large = stored(rows.groupBy("home").count().filter(F.col("count") > group_limit).select("home", F.ceil(F.col("count") / group_limit).cast("int").alias("k")), "trie-large")
    rows = rows.join(large, "home", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.xxhash64("home", F.least(own, o), F.greatest(own, o)).alias("cell"), F.when(own > o, 1).otherwise(0).alias("side")))
    dealt = rows.select("fp", "key", F.inline(cells))
    n = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(n, "cell").sortWithinPartitions("cell", "side", F.col("key").bitwiseXOR(F.lit(-(2**63)))).mapInArrow(_join_cells(budget), "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = 3, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest id reachable over fingerprints within ``budget`` bits.

    Copies meet as one fingerprint before anything is joined.
    """
    prints = stored(fingerprints(docs), "simhash")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct, budget, group_limit), "simhash-links")
    rooted = stored(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = stored(rooted.join(least, "root").select("fp", "component_id"), "simhash-names")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of all word shingles; a shorter text is one shingle, an empty one has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingle = min(shingle, len(words))
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[shingle - 1 :])], np.uint64))


def _text_key(text: bytes | None) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join((text or b"").lower().split()))


def _sketches(shingle: int):
    rng = np.random.default_rng(5)
    factors = rng.integers(0, 2**63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    terms = rng.integers(0, 2**64, BANDS * BAND_ROWS, np.uint64)

    def bands(text: bytes | None) -> list[int]:
        h = shingle_set(text, shingle)
        if not len(h):
            return []
        least = np.array([(h * a + b).min() for a, b in zip(factors, terms)]).reshape(BANDS, BAND_ROWS)
        return np.array([xxhash.xxh64_intdigest(row.tobytes(), n) for n, row in enumerate(least)], np.uint64).view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, TEXTS_AT_ONCE) for b in batches for a in range(0, b.num_rows, TEXTS_AT_ONCE)):
            texts = [x.as_py() for x in batch.column(1)]
            prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            columns = [batch.column(0), pa.array([_text_key(t) for t in texts], pa.binary()), batch.column(2), pa.array(prints), pa.array([bands(t) for t in texts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "mark", "fp", "bands"])

    return run


def _mark(text: Column) -> Column:
    """128 bits that name a text as it stands, null as empty; Spark computes them where the text lies."""
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit("").cast("binary"))))


def _place(doc_id: Column, mark: Column) -> Column:
    """Where a row's id and text fall in a sieve."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, mark), 64 - SIEVE_BITS)


def _sieve(rows: DataFrame, name: str) -> DataFrame:
    """Which rows may be among ``rows`` of ``(doc_id, mark)``: a table of 2 ** SIEVE_BITS bits, whatever their number.

    It spares texts that no row names the way through a join; an exact join
    follows, so a full table costs time and loses nothing.
    """
    at = rows.select(_place(F.col("doc_id"), F.col("mark")).alias("at"))
    bits = F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767)))
    return stored(at.groupBy(F.shiftright("at", 15).alias("_part")).agg(bits.alias("_bits")), name)


def _passing(rows: DataFrame, sieve: DataFrame, doc_id: str = "doc_id", mark: str = "mark", others: bool = False) -> DataFrame:
    """The rows that the sieve lets pass, or the others; no text leaves its task, the table of bits goes to all."""
    at = _place(F.col(doc_id), F.col(mark))
    table = sieve.select(*[F.col(c).alias(f"{mark}{c}") for c in sieve.columns])
    joined = rows.join(F.broadcast(table), F.shiftright(at, 15) == F.col(f"{mark}_part"), "left" if others else "inner")
    byte = F.conv(F.hex(F.substring(f"{mark}_bits", F.shiftright(at, 3).bitwiseAND(F.lit(4095)) + 1, F.lit(1))), 16, 10).cast("int")
    passes = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")), F.lit(0)) == 1
    return joined.filter(~passes if others else passes).select(rows.columns)


def _verified(shingle: int, threshold: float):
    """Forest edges of rows ``(cell, side, key, known, text)`` sorted by cell, each pair of exact similarity at or above the threshold.

    Texts with the same ``known`` label are connected already; a cell with a
    side 1 is looked at across its sides only.  Pairs within the budget of bits
    come from the trie; a fingerprint counts a repeated shingle each time and a
    set once, so pairs beyond the budget are looked at besides.
    """

    def beyond(keys: np.ndarray, across: np.ndarray, sets: list[np.ndarray], part: np.ndarray) -> Iterator[tuple[int, int]]:
        """Similar pairs of different parts beyond the budget, by counts of shared shingles."""
        n, places = np.array([len(s) for s in sets]), np.arange(len(sets))
        code = np.unique(np.concatenate(sets), return_inverse=True)[1]
        holder = np.repeat(places, n)[np.argsort(code, kind="stable")]
        many = np.bincount(code)
        start, ends = np.cumsum(many) - many, np.cumsum(n)
        for i in range(len(sets)):
            able = (part != part[i]) & (places > i) & (np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i]))
            able &= (np.bitwise_count(keys ^ keys[i]) > SIMILAR_BUDGET) & ((across != across[i]) | (across[-1] == across[0]))
            others = np.flatnonzero(able)
            if len(others):
                own = code[ends[i] - n[i] : ends[i]]
                at = np.arange(many[own].sum()) + np.repeat(start[own] - np.cumsum(many[own]) + many[own], many[own])
                shared = np.bincount(holder[at], minlength=len(sets))[others]
                yield from ((i, j) for j in others[shared >= threshold * (n[i] + n[others] - shared)].tolist())

    def walk(side: list[int], key: list[bytes], known: list[bytes], sets: list[np.ndarray], fp: list[int]) -> pa.RecordBatch:
        prints = np.array(fp, np.uint64)
        order = np.lexsort((prints, np.array(side)))
        zeros = int(len(side) - sum(side))
        keys = prints[order]
        ranges = (0, zeros, 0, zeros) if zeros == len(side) else (0, zeros, zeros, len(side))
        first: dict[bytes, int] = {}
        label = [first.setdefault(known[i], n) for n, i in enumerate(order.tolist())]

        def root(i: int) -> int:
            while label[i] != i:
                label[i] = label[label[i]]
                i = label[i]
            return i

        for left, right in trie_pairs(keys, *(np.array([x]) for x in ranges), 0, SIMILAR_BUDGET):
            for i, j in zip(left.tolist(), right.tolist()):
                x, y = root(i), root(j)
                if x == y:
                    continue
                one, two = sets[order[i]], sets[order[j]]
                if min(len(one), len(two)) < threshold * max(len(one), len(two)):
                    continue
                shared = len(np.intersect1d(one, two, assume_unique=True))
                if shared >= threshold * (len(one) + len(two) - shared):
                    label[max(x, y)] = min(x, y)
        part = np.array([root(i) for i in range(len(label))])
        if (part != part[0]).any():
            for i, j in beyond(keys, np.array(side)[order], [sets[i] for i in order], part):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
        # Stars, not chains: components then settle in few rounds.
        child = [i for i in range(len(label)) if root(i) != i]
        a, b = ([key[order[i]] for i in some] for some in (child, map(root, child)))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [], [], [])
        for batch in batches:
            # Texts leave the batch one by one: only their hashes are held.
            for cell, side, key, known, text in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4)):
                text = text.as_py()
                if cell != now:
                    if held[0]:
                        yield walk(*held)
                    now, held = cell, ([], [], [], [], [])
                for column, value in zip(held, (side, key, known, shingle_set(text, shingle), fingerprint(text, shingle))):
                    column.append(value)
        if held[0]:
            yield walk(*held)

    return run


def _similar_edges(members: DataFrame, texts: DataFrame, shingle: int, threshold: float, group_limit: int) -> DataFrame:
    """Edges ``(a, b)`` that connect what is similar inside the candidate groups ``(key, home)``.

    A group beyond the limit is dealt into chunks.  First every chunk is looked
    at by itself, then one text of each component that this left, and only
    groups still in several parts are looked at by pairs of chunks: a large
    group of near copies becomes one component before its texts would be sent
    more than twice.
    """
    n = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def edges(cells: DataFrame, name: str) -> DataFrame:
        rows = cells.join(texts, "key").select("cell", "side", "key", "known", "text").repartition(n, "cell").sortWithinPartitions("cell")
        return stored(rows.mapInArrow(_verified(shingle, threshold), "a binary, b binary"), name, TEXTS_AT_ONCE)

    def chunked(rows: DataFrame) -> DataFrame:
        """With ``k`` chunks of the row's group, and its own."""
        sizes = stored(rows.groupBy("home").count().filter(F.col("count") > group_limit).select("home", F.ceil(F.col("count") / group_limit).cast("int").alias("k")), "similar-large")
        sized = rows.join(sizes, "home", "left").withColumn("k", F.coalesce("k", F.lit(1)))
        return sized.withColumn("own", F.pmod(F.xxhash64("key"), F.col("k")).cast("int"))

    def paired(rows: DataFrame) -> DataFrame:
        """Every pair of different chunks of a group as a cell of its own."""
        others = F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda o: o != F.col("own"))
        cells = F.transform(others, lambda o: F.struct(F.xxhash64("home", F.least("own", o), F.greatest("own", o)).alias("cell"), F.when(F.col("own") > o, 1).otherwise(0).alias("side")))
        return rows.select("key", "known", F.inline(cells))

    def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
        roots = components(found, "similar-parts")
        return rows.drop("known").join(roots, F.col("key") == roots.node, "left").withColumn("known", F.coalesce("root", "key")).drop("node", "root")

    dealt = stored(chunked(members), "similar-dealt")
    alone = dealt.select("key", F.col("key").alias("known"), F.xxhash64("home", "own").alias("cell"), F.lit(0).alias("side"))
    found = edges(alone, "similar-alone")
    wide = dealt.filter(F.col("k") > 1)
    if wide.isEmpty():
        return found
    parts = stored(labelled(wide, found), "similar-parts")
    chosen = parts.groupBy("home", "known").agg(F.min("key").alias("key"))
    chosen = stored(chunked(chosen), "similar-chosen")
    together = chosen.select("key", "known", F.xxhash64("home", "own", F.lit(1)).alias("cell"), F.lit(0).alias("side")).union(paired(chosen).select("key", "known", "cell", "side"))
    found = found.union(edges(together, "similar-together"))
    parts = stored(labelled(wide, found), "similar-parts")
    split = parts.groupBy("home").agg(F.min("known").alias("one"), F.max("known").alias("two")).filter("one <> two").select("home")
    return found.union(edges(paired(parts.join(stored(split, "similar-split"), "home", "left_semi")), "similar-across"))


def _print_edges(distinct: DataFrame, budget: int) -> DataFrame:
    """Edges ``(a, b)`` between texts ``(key, fp)`` that connect those whose fingerprints are within ``budget`` bits."""
    tops = stored(distinct.groupBy("fp").agg(F.min("key").alias("top")), "similar-prints")
    same = distinct.join(tops, "fp").filter(F.col("key") != F.col("top")).select(F.col("key").alias("a"), F.col("top").alias("b"))
    near = stored(links(tops.select("fp"), budget), "similar-print-links")
    one, two = (tops.select(F.col("fp").alias(x), F.col("top").alias(f"{x}_key")) for x in ("a", "b"))
    return same.union(near.join(one, "a").join(two, "b").select("a_key", "b_key"))


def _similar_keys(docs: DataFrame, shingle: int, threshold: float, group_limit: int, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, key, mark)`` of every row, and ``(key, root)`` of every different text; ``budget`` links fingerprints besides."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), _mark(F.col("text")).alias("mark"))
    sketches = stored(rows.mapInArrow(_sketches(shingle), "doc_id long, key binary, mark binary, fp long, bands array<long>"), "similar-sketches", TEXTS_AT_ONCE)
    one = F.min(F.struct("doc_id", "mark")).alias("one")
    distinct = stored(sketches.groupBy("key").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), one), "similar-distinct")
    bands = distinct.select("key", F.explode("bands").alias("band"))
    tops = stored(bands.groupBy("band").agg(F.min("key").alias("top"), F.count("*").alias("n")).filter("n > 1").select("band", "top"), "similar-tops")
    groups = components(bands.join(tops, "band").select(F.col("key").alias("a"), F.col("top").alias("b")).filter("a <> b"), "similar-groups")
    members = stored(groups.select(F.col("node").alias("key"), F.col("root").alias("home")).union(groups.select(F.col("root").alias("key"), F.col("root").alias("home")).distinct()), "similar-members")
    # Copies of a text differ in case and spaces at most, which the shingles do not see: one of them is sent.
    wanted = stored(members.select("key").join(distinct, "key").select("key", F.col("one.doc_id").alias("one_id"), F.col("one.mark").alias("one_mark")), "similar-wanted")
    sieve = _sieve(wanted.select(F.col("one_id").alias("doc_id"), F.col("one_mark").alias("mark")), "similar-sieve")
    sent = _passing(rows, sieve).join(wanted, F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("mark") == F.col("one_mark")))
    texts = stored(sent.select("key", "text").dropDuplicates(["key"]), "similar-texts")
    similar = _similar_edges(members, texts, shingle, threshold, group_limit)
    edges = similar if budget is None else similar.union(_print_edges(distinct.select("key", "fp"), budget))
    roots = components(edges, "similar-links")
    rooted = stored(distinct.join(roots, distinct.key == roots.node, "left").select("key", F.coalesce("root", "key").alias("root")), "similar-rooted")
    return sketches.select("doc_id", "key", "mark"), rooted


def similar_documents(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, group_limit: int = SIMILAR_LIMIT) -> DataFrame:
    """``(doc_id, component_id)``: the smallest id reachable over texts of word-shingle similarity at or above ``threshold``.

    Texts with the same words meet as one key.  Texts that share a MinHash band
    form candidate groups; inside a group every pair within the Hamming budget
    is found by the trie and verified on its whole shingle sets, and pairs
    beyond it by counts of shared shingles, unless both are already connected.
    """
    keys, rooted = _similar_keys(docs, shingle, threshold, group_limit)
    named = keys.join(rooted, "key")
    least = stored(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "similar-least")
    return named.join(least, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, group_limit: int = SIMILAR_LIMIT, budget: int = 3) -> DataFrame:
    """Rows of ``docs``, one of every component of near copies.

    Near copies are texts whose fingerprints differ in at most ``budget`` bits,
    linked by the trie join as in ``near_duplicates``, and those that
    ``similar_documents`` links, whose fingerprints may be farther apart.

    Rows are told apart by id and text together: the row with the smallest id
    stays, a row without an id only where no other has one, of equal ids the
    text with the smallest key, and of wholly equal rows one.  Texts meet no
    Python and no shuffle on their way out, but for the few that a sieve of
    what is dropped takes for one of those and rows that occur twice.
    """
    keys, rooted = _similar_keys(docs, shingle, threshold, group_limit, budget)
    counted = keys.join(rooted, "key").groupBy("root", "key", "doc_id", "mark").agg(F.count("*").alias("n"))
    counted = stored(counted, "similar-counted")
    first = counted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "mark")).alias("first"))
    first = stored(first.select(F.col("root"), F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark")), "similar-first")
    stays = (F.col("mark") == F.col("first_mark")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    marked = stored(counted.join(first, "root").select("doc_id", "mark", "n", stays.alias("stays")), "similar-marked")
    # Rows that are dropped, whole or but for one.
    dropped = _sieve(marked.filter("not stays or n > 1"), "similar-dropped")
    held = stored(_passing(marked.filter("stays"), dropped).select(F.col("doc_id").alias("held_id"), F.col("mark").alias("held_mark")), "similar-held")
    back = _sieve(held.select(F.col("held_id").alias("doc_id"), F.col("held_mark").alias("mark")), "similar-back")
    name = "_mark"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"
    ident = f"{name}_id"
    rows = docs.withColumns({name: _mark(F.col("text")), ident: F.col("doc_id").cast("long")})
    found = _passing(_passing(rows, dropped, ident, name), back, ident, name)
    found = found.join(held, (F.col(name) == held.held_mark) & F.col(ident).eqNullSafe(held.held_id), "left_semi").dropDuplicates([ident, name])
    return _passing(rows, dropped, ident, name, others=True).select(docs.columns).unionByName(found.select(docs.columns))
