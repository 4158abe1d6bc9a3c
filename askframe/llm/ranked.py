"""Ranked lexical search: NRA over impact-sorted lists, a batch of documents at a time.

A task turns each batch of documents into one list of (document, impact) for
every query term, sorted by falling impact.  For an item its lists are read
from their heads in growing steps.  What a list still hides is at most the
impact at its next place, so each document met has a lower score (what was
read) and an upper one.  Reading goes on until no other document can pass or
tie with the best k, and then only candidates are followed until their two
bounds agree.  The best k so far go with the task, so that later batches stop
sooner; where the heads alone cannot reach them, nothing is read.

A null text holds no term.  Rows are documents of their own, as are rows of
items: repeated ids are ranked once each, equal scores by ascending id (null
last).  An item without terms finds nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askframe.llm.common import stored

# Outside ASCII every code point is part of a term, so bytes split like code points.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BATCH_POSTINGS = 2_000_000
ITEM_BYTES = 8 << 20
STEP = 64
NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes | None) -> list[bytes]:
    return TERM.findall((text or b"").lower())


class Lists:
    """The impact-sorted lists of a batch: places ``cut[t]`` to ``cut[t + 1]`` belong to term ``t``."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.cut = np.searchsorted(term[order], np.arange(n_terms + 1))


def nra(lists: Lists, terms: np.ndarray, n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents whose score is above zero, at least ``floor`` and among the best ``k`` or tied with the last of them; with scores."""
    lo, hi = lists.cut[terms], lists.cut[terms + 1]
    lo, hi = lo[lo < hi], hi[lo < hi]
    none = np.empty(0, np.int64)
    read, step = lo.copy(), STEP
    docs, gains, owner = none, none, none
    while True:
        frontier = np.where(read < hi, lists.impact[np.minimum(read, hi - 1)], 0) if len(lo) else none
        open_sum = int(frontier.sum())
        lower = np.bincount(docs, gains, n_docs)
        need = max(floor, 1)
        if k < n_docs:
            need = max(need, int(np.partition(lower, n_docs - k)[n_docs - k]))
        # A document not yet met scores at most the sum of all frontiers.
        if open_sum < need:
            break
        upto = np.minimum(read + step, hi)
        at = np.concatenate([np.arange(a, b) for a, b in zip(read, upto)])
        docs = np.concatenate([docs, lists.doc[at]])
        gains = np.concatenate([gains, lists.impact[at]])
        owner = np.concatenate([owner, np.repeat(np.arange(len(lo)), upto - read)])
        read, step = upto, step * 2
    # Membership: upper bounds of the documents met, by what their unread lists may still hold.
    upper = lower + open_sum - np.bincount(docs, frontier[owner] if len(docs) else gains, n_docs)
    met = np.zeros(n_docs, bool)
    met[docs] = True
    keep = met & (upper >= need)
    # Reading on, for candidates only, makes their bounds agree.
    while (read < hi).any() and (upper[keep] > lower[keep]).any():
        upto = np.minimum(read + step, hi)
        at = np.concatenate([np.arange(a, b) for a, b in zip(read, upto)])
        kind = np.repeat(np.arange(len(lo)), upto - read)
        use = keep[lists.doc[at]]
        docs, gains, owner = np.concatenate([docs, lists.doc[at][use]]), np.concatenate([gains, lists.impact[at][use]]), np.concatenate([owner, kind[use]])
        read, step = upto, step * 2
        frontier = np.where(read < hi, lists.impact[np.minimum(read, hi - 1)], 0)
        lower = np.bincount(docs, gains, n_docs)
        upper = lower + int(frontier.sum()) - np.bincount(docs, frontier[owner], n_docs)
        if k < n_docs:
            need = max(need, int(np.partition(np.where(keep, lower, 0), n_docs - k)[n_docs - k]))
        keep &= upper >= need
    found = np.flatnonzero(keep & (lower > 0) & (lower >= need))
    return found, lower[found].astype(np.int64)


def _forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, terms, tfs)``: the length of each text in terms, and its counts of query terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, terms, tfs = [], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                count = Counter(words)
                own = [(t, c) for w, c in count.items() if (t := vocabulary.get(w)) is not None]
                ns.append(len(words)), terms.append([t for t, _ in own]), tfs.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def _search(forward: DataFrame, items: list[tuple[int, np.ndarray]], weight: np.ndarray, n_docs: int, total: int, k: int, postings: int) -> DataFrame:
    """The best ``k`` of each task for every item: ``(item, doc_id, score)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in _rebatch(batches, postings):
            ids = batch.column(0)
            doc_id = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
            # 90 * n * N may pass 64 bits for no table that fits a disk.
            m = 10 + 90 * batch.column(1).to_numpy() * n_docs // max(total, 1)
            column = batch.column(2)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(ids)), sizes)
            term, tf = column.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
            lists = Lists(doc, term, impact, len(weight))
            for item, terms in items:
                had_ids, had = best.get(item, (np.empty(0, np.int64), np.empty(0, np.int64)))
                floor = int(had[k - 1]) if len(had) >= k else 0
                found, score = nra(lists, terms, len(ids), k, floor)
                if len(found):
                    all_ids, scores = np.concatenate([had_ids, doc_id[found]]), np.concatenate([had, score])
                    order = np.lexsort((all_ids, -scores))[:k]
                    best[item] = all_ids[order], scores[order]
        item = np.concatenate([np.full(len(v[0]), i, np.int64) for i, v in best.items()]) if best else np.empty(0, np.int64)
        ids, score = (np.concatenate([v[j] for v in best.values()]) if best else np.empty(0, np.int64) for j in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == NO_ID), pa.array(score)], names=["item", "doc_id", "score"])

    return forward.mapInArrow(run, "item long, doc_id long, score long")


def _rebatch(batches: Iterator[pa.RecordBatch], postings: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold about ``postings`` postings, so that an item's lists are read once for many documents."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column(2).flatten())
        if size >= postings:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size or held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()
        yield from whole[:1]


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES, postings: int = BATCH_POSTINGS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents with a score above zero of every item.

    Items are the query set: their terms go to the tasks in blocks of about
    ``item_bytes``, and every block is searched over all documents.  The texts are
    never shuffled; a task hands on ``k`` rows an item.
    """
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    blocks = max(1, math.ceil((size[0] + 8 * size[1]) / item_bytes))
    found = None
    for b in range(blocks):
        table = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow().to_pylist()
        part = _block(docs, [(r["item_id"], r["text"]) for r in table], k, postings)
        found = part if found is None else found.union(part)
    return found


def _block(docs: DataFrame, rows: list[tuple[int | None, bytes | None]], k: int, postings: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    queries = [(i, np.array(sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text)}), np.int64)) for i, (_, text) in enumerate(rows)]
    forward = stored(_forward(docs, vocabulary), "ranked-forward")
    n_docs, total = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row a term of the block.
    df = np.zeros(len(vocabulary), np.int64)
    for r in forward.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
        df[r["t"]] = r["n"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    best = stored(_search(forward, [q for q in queries if len(q[1])], weight, n_docs, total, k, postings), "ranked-best")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(rows)), pa.int64()), "item_id": pa.array([r[0] for r in rows], pa.int64())}))
    return top.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
