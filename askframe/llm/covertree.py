"""Embedding near-duplicates: exact threshold links by a dual traversal of cover trees.

Vectors that are null, zero, or hold null or non-finite components link with
nothing, as do rows without an id.  Equal vectors meet as one class before
anything is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import components, stored, union_labels

PIVOT_SAMPLE = 4_000
CELL = 8_192
# Directions that the trees see, directions that two points are compared in first, and points of a leaf.
TREE_DIMS, FILTER_DIMS, LEAF = 8, 16, 64
# Candidates that are compared in full at a time.
VERIFY = 50_000
SLACK = 1e-9


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(rows), -1 if len(rows) else 0)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def shortened(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Unit vectors in some orthogonal directions, and the length of the rest as one more number.

    The result is a unit vector, and no two of them are further apart than the
    vectors themselves: what they exclude is excluded.
    """
    p = x @ directions
    return np.column_stack([p, np.sqrt(np.maximum(0.0, 1.0 - (p * p).sum(axis=1)))])


class CoverTree:
    """Nested levels of halving radii over points: a node's centre is the centre of one of its children.

    Node ``i`` holds the points ``lo[i]`` to ``hi[i]`` of the tree's order, all
    within ``radius[i]`` of the first of them; its children are the nodes
    ``first[i]`` to ``last[i]``, none for a leaf of at most ``leaf`` points.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order, self.leaf = np.arange(len(points)), leaf
        nodes = [[0, len(points), 0.0, 0, 0, 2.0]] if len(points) else []
        for node in nodes:  # children are added behind, level by level
            self._split(points, node, nodes)
        self.lo, self.hi, self.first, self.last = (np.array([n[i] for n in nodes], np.int64) for i in (0, 1, 3, 4))
        self.radius = np.array([n[2] for n in nodes])
        self.points = points[self.order]
        self.centre = self.points[self.lo] if nodes else self.points

    def _split(self, points: np.ndarray, node: list, nodes: list[list]) -> None:
        lo, hi, level = node[0], node[1], node[5]
        own = points[self.order[lo:hi]]
        away = _distance(own, own[:1])[:, 0]
        node[2] = float(away.max())
        if hi - lo <= self.leaf or node[2] <= 1e-7:
            return
        while level >= node[2]:
            level /= 2
        # The furthest uncovered point opens the next child; every point goes to its nearest centre.
        owner, nearest, centres = np.zeros(hi - lo, np.int64), away, 1
        while nearest.max() > level:
            new = int(nearest.argmax())
            away = _distance(own, own[new : new + 1])[:, 0]
            closer = away < nearest
            owner[closer], nearest = centres, np.where(closer, away, nearest)
            centres += 1
        order = np.lexsort((nearest, owner))
        self.order[lo:hi] = self.order[lo:hi][order]
        cuts = lo + np.searchsorted(owner[order], np.arange(centres + 1))
        node[3], node[4] = len(nodes), len(nodes) + centres
        nodes += [[int(a), int(b), 0.0, 0, 0, level] for a, b in zip(cuts, cuts[1:])]


def leaf_pairs(left: CoverTree, right: CoverTree | None, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that may hold points within ``reach``, each pair once.

    Node pairs go down together, all of a level at a time; a pair whose centres
    are further apart than both radii and ``reach`` is dropped with all below it.
    """
    same, right = right is None, left if right is None else right
    a, b, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    while len(a):
        apart = _row_distance(left.centre[a], right.centre[b])
        near = apart - left.radius[a] - right.radius[b] <= reach + SLACK
        a, b = a[near], b[near]
        n_a, n_b = left.last[a] - left.first[a], right.last[b] - right.first[b]
        done = (n_a == 0) & (n_b == 0)
        found.append((a[done], b[done]))
        a, b, n_a, n_b = a[~done], b[~done], n_a[~done], n_b[~done]
        # A leaf stays while its partner goes down.
        from_a, from_b = np.where(n_a > 0, left.first[a], a), np.where(n_b > 0, right.first[b], b)
        n_a, n_b = np.maximum(n_a, 1), np.maximum(n_b, 1)
        size = n_a * n_b
        pair = np.repeat(np.arange(len(a)), size)
        inside = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        i, j = np.divmod(inside, n_b[pair])
        own, x, y = (a == b)[pair], from_a[pair] + i, from_b[pair] + j
        keep = ~own | (x <= y) if same else slice(None)
        a, b = x[keep], y[keep]
    return tuple(np.concatenate([f[i] for f in found]) for i in (0, 1))


def _row_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def links(left: np.ndarray, right: np.ndarray | None, w_left: np.ndarray, w_right: np.ndarray, cosine: float, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted link counts of both sides' points, and labels that join what is linked (the right side's places follow the left's).

    The trees see a few directions; two leaves are compared first in some more
    of them by one product, and what that leaves in full.
    """
    same, right = right is None, left if right is None else right
    reach, shift = math.sqrt(2.0 - 2.0 * cosine), 0 if same else len(left)
    one = CoverTree(shortened(left, directions[:, :TREE_DIMS]))
    two = one if same else CoverTree(shortened(right, directions[:, :TREE_DIMS]))
    leaf_a, leaf_b = leaf_pairs(one, None if same else two, reach)
    x, y = left[one.order], right[two.order]
    short_x, short_y = shortened(x, directions), shortened(y, directions)
    w_x, w_y = w_left[one.order], w_right[two.order]
    counts = [np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)]
    labels = np.arange(len(x) + (0 if same else len(y)))
    order = np.lexsort((leaf_b, leaf_a))
    leaf_a, leaf_b = leaf_a[order], leaf_b[order]
    starts = np.flatnonzero(np.r_[True, leaf_a[1:] != leaf_a[:-1]][: len(leaf_a)])
    for s, e in zip(starts, np.r_[starts[1:], len(leaf_a)]):
        a = leaf_a[s]
        rows = slice(one.lo[a], one.hi[a])
        lo, hi = two.lo[leaf_b[s:e]], two.hi[leaf_b[s:e]]
        cols = np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange((hi - lo).sum())
        # A huge leaf, of points that the tree cannot tell apart, goes through in strips.
        for r in range(rows.start, rows.stop, 4 * LEAF):
            strip = slice(r, min(r + 4 * LEAF, rows.stop))
            hit_r, hit_c = np.nonzero(short_x[strip] @ short_y[cols].T >= cosine - SLACK)
            hit_r, hit_c = hit_r + r, cols[hit_c]
            if same:  # within a leaf every pair is met twice
                once = (hit_r < hit_c) | ((hit_c < one.lo[a]) | (hit_c >= one.hi[a]))
                hit_r, hit_c = hit_r[once], hit_c[once]
            good = [np.einsum("ij,ij->i", x[hit_r[k : k + VERIFY]], y[hit_c[k : k + VERIFY]]) >= cosine for k in range(0, len(hit_r), VERIFY)]
            if good:
                good = np.concatenate(good)
                hit_r, hit_c = hit_r[good], hit_c[good]
                counts[0] += np.bincount(hit_r, weights=w_y[hit_c], minlength=len(x)).astype(np.int64)
                counts[1] += np.bincount(hit_c, weights=w_x[hit_r], minlength=len(y)).astype(np.int64)
                labels = union_labels(labels, hit_r, hit_c + shift)
    # Back from the trees' order to the rows' own.
    back = np.concatenate([one.order] if same else [one.order, two.order + shift])
    own = np.empty(len(labels), np.int64)
    own[back] = back[labels]
    out = [np.empty(len(left), np.int64), np.empty(len(right), np.int64)]
    out[0][one.order] = counts[0] + (counts[1] if same else 0)
    out[1][two.order] = out[0][two.order] if same else counts[1]
    return out[0], out[1], own


OUT = "node long, other long, n long"


def _cell(cosine: float, directions: np.ndarray):
    """Counts per class, and a forest of edges, for two blocks of vectors or one with itself."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        x, rep, weight = _unit(table.column("embedding")), table.column("rep").to_numpy(), table.column("copies").to_numpy()
        groups = [np.flatnonzero(side == s) for s in (0, 1)]
        same = key[0].as_py() == key[1].as_py()
        if not len(groups[0]) or not (same or len(groups[1])):
            return pa.table({"node": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        first, second = groups[0], groups[0] if same else groups[1]
        one, two, labels = links(x[first], None if same else x[second], weight[first], weight[second], cosine, directions)
        every = rep[first] if same else np.concatenate([rep[first], rep[second]])
        nodes, others, ns = [], [], []
        for who, n in [(rep[first], one)] if same else [(rep[first], one), (rep[second], two)]:
            hit = n != 0
            nodes.append(who[hit]), others.append(who[hit]), ns.append(n[hit])
        child = np.flatnonzero(labels != np.arange(len(labels)))
        nodes.append(every[child]), others.append(every[labels[child]]), ns.append(np.zeros(len(child), np.int64))
        return pa.table({"node": pa.array(np.concatenate(nodes), pa.int64()), "other": pa.array(np.concatenate(others), pa.int64()), "n": pa.array(np.concatenate(ns), pa.int64())})

    return run


def _sample(classes: DataFrame) -> np.ndarray:
    """A bounded sample, the vectors with the smallest hash of their id."""
    return _unit(classes.orderBy(F.xxhash64("rep"), "rep").select("embedding").limit(PIVOT_SAMPLE).toArrow().column("embedding"))


def _pivots(x: np.ndarray, k: int) -> np.ndarray:
    """Centres of the trees' common top level: furthest-first among the sample."""
    chosen, nearest = [0], _distance(x, x[:1])[:, 0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distance(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def _directions(x: np.ndarray) -> np.ndarray:
    """Leading principal directions of the sample, as columns; any orthogonal ones give the same links."""
    return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :FILTER_DIMS]


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, cell: int = CELL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Every class goes to its nearest pivot's cell, cells into blocks of bounded
    size.  A vector meets a block of another cell only if its own distance from
    that cell's pivot is within the cell's covering radius and the threshold;
    each pair of blocks is a task of its own.
    """
    e = F.col("embedding")
    # Single precision stays as it is stored; tasks count in double.
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast(f"array<{kind}>").alias("embedding"))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    norm = F.aggregate(e, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.forall(e, fine) & (norm > 0) & (norm < float("inf")), F.lit(False))
    # 128 bits of hash name a vector.
    keyed = rows.select("vec_id", "embedding", F.when(usable, F.xxhash64("embedding")).alias("k1"), F.when(usable, F.xxhash64(F.reverse("embedding"), F.lit(1))).alias("k2"))
    classes = stored(keyed.filter(F.col("k1").isNotNull()).groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding")).withColumn("width", F.size("embedding")), "cover-classes")
    found = None
    for width, n in [(r["width"], r["n"]) for r in classes.groupBy("width").agg(F.count("*").alias("n")).collect()]:
        own = classes.filter(F.col("width") == width)
        part = _links(own, n, cosine, cell)
        found = part if found is None else found.union(part)
    if found is None:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = stored(found, "cover-links")
    n_links = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.filter(F.col("node") != F.col("other")).select(F.col("node").alias("a"), F.col("other").alias("b")), "cover-components")
    named = classes.select("k1", "k2", "rep", "copies").join(n_links, F.col("rep") == n_links.node, "left").drop("node")
    named = named.join(roots, F.col("rep") == roots.node, "left")
    named = stored(named.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "cover-named")
    whole = keyed.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, n: int, cosine: float, cell: int) -> DataFrame:
    sample = _sample(classes)
    pivots, directions = _pivots(sample, max(1, min(PIVOT_SAMPLE // 2, math.ceil(n / cell)))), _directions(sample)
    reach = math.sqrt(2.0 - 2.0 * cosine)
    kind = classes.schema["embedding"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = _distance(_unit(batch.column(2)), pivots)
            home = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(away[np.arange(len(home)), home])], names=["rep", "copies", "embedding", "home", "away"])

    placed = stored(classes.select("rep", "copies", "embedding").mapInArrow(assign, f"rep long, copies long, embedding {kind}, home int, away double"), "cover-placed")
    # One row a pivot: at most PIVOT_SAMPLE / 2.
    cells = {r["home"]: (max(1, math.ceil(r["n"] / cell)), r["r"]) for r in placed.groupBy("home").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()}
    base = dict(zip(cells, np.cumsum([0, *[k for k, _ in cells.values()]]).tolist()))
    chunk = F.pmod(F.xxhash64("rep"), F.element_at(F.lit([cells[h][0] if h in cells else 1 for h in range(len(pivots))]), F.col("home") + 1)).cast("int")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = _distance(_unit(batch.column(2)), pivots)
            home, chunk = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            mine = np.array([base[h] for h in home.tolist()], np.int32) + chunk
            for other, (n_chunks, radius) in cells.items():
                go = np.flatnonzero((away[:, other] <= radius + reach + SLACK) | (home == other))
                if len(go):
                    part = batch.take(pa.array(go))
                    for c in range(n_chunks):
                        block = np.full(len(go), base[other] + c, np.int32)
                        ends = np.minimum(mine[go], block), np.maximum(mine[go], block), (mine[go] > block).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([*[pa.array(v) for v in ends], *part.columns[:3]], names=["one", "two", "side", "rep", "copies", "embedding"])

    dealt = placed.select("rep", "copies", "embedding", "home", chunk.alias("chunk")).mapInArrow(deal, f"one int, two int, side int, rep long, copies long, embedding {kind}")
    return dealt.groupBy("one", "two").applyInArrow(_cell(cosine, directions), OUT)
