"""A stored cell index for exact vector search: whole cells are passed over by the triangle inequality.

Centres are fitted on at most ``FIT_ROWS`` vectors; every vector is indexed, in
the cell of its nearest centre.  A row of the index holds vectors of one cell
with about the same distance from its centre, so the distance of a query from
the centre bounds its distance from all of them, from below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askframe.cluster import stored
from askframe.operators.blocks import HIT_SCHEMA, Hits, best_of, first_k

FIT_ROWS, FIT_ROUNDS, ROW_VECTORS = 20_000, 8, 512
# Scores are compared after rounding to 9 places; distances near zero carry an error of about 1e-8.
SLACK = 1e-6
CELLS = "cell int, low double, high double, longest double, doc_ids array<long>, vectors array<double>"


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a column, a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1 if len(column) else 0)


def whole(batch: pa.RecordBatch | pa.Table, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that have both."""
    batch = batch.filter(pc.and_(batch.column(key).is_valid(), batch.column("embedding").is_valid()))
    ids = batch.column(key)
    return (ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids).to_numpy(zero_copy_only=False).astype(np.int64), matrix(batch.column("embedding"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


def fit_centres(corpus: DataFrame, n_cells: int) -> np.ndarray:
    """Centres of ``n_cells`` cells by a few k-means rounds over the vectors with the smallest hashes."""
    some = corpus.filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    x = matrix(some.select("embedding").toArrow().column("embedding"))
    centres = np.unique(x[: 4 * n_cells], axis=0)[:n_cells] if len(x) else x
    for _ in range(FIT_ROUNDS if len(centres) else 0):
        home = distances(x, centres).argmin(axis=1)
        count = np.bincount(home, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def build_cells(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """Index rows of ``(doc_id, embedding)``; each comes from one task's vectors, so nothing is shuffled."""

    def row(cell: int, away: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple:
        return cell, float(away[0]), float(away[-1]), float(np.sqrt((x * x).sum(axis=1).max())), ids, x.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def rows(cell: int, all_of: bool) -> list[tuple]:
            away, ids, x = (np.concatenate(part) for part in zip(*held.pop(cell)))
            order = np.argsort(away, kind="stable")
            cuts = list(range(0, len(order), ROW_VECTORS))
            if not all_of and len(order) % ROW_VECTORS:
                held[cell] = [(away[order[cuts[-1] :]], ids[order[cuts[-1] :]], x[order[cuts[-1] :]])]
                cuts.pop()
            return [row(cell, away[o], ids[o], x[o]) for o in (order[a : a + ROW_VECTORS] for a in cuts)]

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            types = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=["cell", "low", "high", "longest", "doc_ids", "vectors"])

        for batch in batches:
            ids, x = whole(batch, "doc_id")
            if not len(ids):
                continue
            away = distances(x, centres)
            home = away.argmin(axis=1)
            away = away[np.arange(len(home)), home]
            for cell in np.unique(home).tolist():
                mine = home == cell
                held.setdefault(cell, []).append((away[mine], ids[mine], x[mine]))
                if sum(len(h[1]) for h in held[cell]) >= 4 * ROW_VECTORS:
                    yield batch_of(rows(cell, False))
        for cell in list(held):
            yield batch_of(rows(cell, True))

    return corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "embedding").mapInArrow(run, CELLS)


class Nearest:
    """The best ``k`` hits of each query so far, and the score that another must reach."""

    def __init__(self, worst: np.ndarray, k: int):
        self.hits: Hits = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.worst, self.k = worst.copy(), k

    def add(self, hits: Hits) -> None:
        self.hits = first_k(*(np.concatenate(pair) for pair in zip(self.hits, hits)), self.k)
        query, _, score = self.hits
        last = np.arange(len(query)) - np.searchsorted(query, query) == self.k - 1
        self.worst[query[last]] = np.maximum(self.worst[query[last]], score[last])


def _scan(index: DataFrame, ids: np.ndarray, q: np.ndarray, centres: np.ndarray, worst: np.ndarray, k: int) -> DataFrame:
    """Each task's best hits that reach ``worst``, and a row without a document with the number of scores taken."""
    away = distances(q, centres) if len(centres) else np.zeros((len(q), 0))
    shared = index.sparkSession.sparkContext.broadcast((ids, q, (q * q).sum(axis=1), away, worst))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, squares, away, worst = shared.value
        best, taken = Nearest(worst, k), 0
        for batch in batches:
            for row in batch.to_pylist():
                d = away[:, row["cell"]]
                gap = np.maximum(np.maximum(d - row["high"], row["low"] - d), 0.0)
                # x.q = (|x|^2 + |q|^2 - |x - q|^2) / 2
                most = (row["longest"] ** 2 + squares - gap * gap) / 2
                asked = np.flatnonzero(most >= best.worst - SLACK)
                if not len(asked):
                    continue
                x = np.array(row["vectors"]).reshape(len(row["doc_ids"]), -1)
                taken += len(asked) * len(x)
                best.add(best_of(asked, np.array(row["doc_ids"]), q[asked] @ x.T, k))
        query, doc, score = best.hits
        n = len(query)
        columns = [pa.array(np.r_[ids[query], 0].astype(np.int64)), pa.array(np.r_[doc, 0], mask=np.arange(n + 1) == n), pa.array(np.r_[score, float(taken)])]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "doc_id", "score"])

    return index.mapInArrow(run, HIT_SCHEMA)


def search_cells(index: DataFrame, centres: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, probes: int = 2) -> DataFrame:
    """Hits of a block of queries: first in the cells nearest to each, then where their k-th score can still be reached.

    The first step gives every query a score that ``k`` vectors reach, or none;
    it comes to the driver as one number a query.  The second reads a row of
    the index for those queries only whose bound reaches it.
    """
    worst = np.full(len(ids), -np.inf)
    if len(ids) and len(centres):
        # Each query is asked in its own nearest cells.
        order = np.argsort(distances(q, centres), axis=1, kind="stable")[:, : min(probes, len(centres))]
        near = np.unique(order).tolist()
        some = stored(_scan(index.filter(F.col("cell").isin(near)), ids, q, centres, worst, k), "nearest-cells").filter(F.col("doc_id").isNotNull())
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        kth = some.withColumn("place", place).filter(F.col("place") == k).select("query_id", "score").toArrow()
        at = dict(zip(kth.column("query_id").to_pylist(), kth.column("score").to_pylist()))
        worst = np.array([at.get(i, -np.inf) for i in ids.tolist()])
    return _scan(index, ids, q, centres, worst, k)
