"""Language-model scores by subword lattices: all segmentations of a word into vocabulary pieces count.

Pieces are all those of an existing vocabulary that hold no inner space, and all
single bytes; their probabilities start from the vocabulary's own scores and are
re-estimated on the training words.  A whole word seen in training is an edge of
its own beside its pieces.  A null text is an empty one: a single end
token.  Repeated rows are scored once each.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import split_of, stored

CHUNK_WORDS = 300_000
# Counts of a word in a document that a chunk holds at most, about 64 MB; a longer document is a chunk of its own.
CHUNK_COUNTS = 8_000_000
BATCH_CELLS = 2_000_000
BATCH_WORDS = 60_000
END = b"\n"  # white space, so never a word
_STEP = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a leading mark as a space, and starting probabilities from their scores."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    best: dict[bytes, float] = {bytes([b]): -1e5 for b in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            data = sp.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in data[1:]:  # words never hold one
                best[data] = max(best.get(data, -math.inf), sp.get_score(i))
    best[END] = 0.0
    pieces = sorted(best)
    # Scores are negative merge ranks; their order is read as a power law.
    weight = np.array([1.0 / (10.0 - best[p]) for p in pieces])
    return pieces, np.log(weight / weight.sum())


class Lattice:
    """Forward and backward recursions over batches of words of one length."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        h = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(h)
        self.keys, self.ids, self.logp = h[order], order, logp
        self.longest = max(map(len, pieces))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(h >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _hash(data: bytes) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for b in data:
            h = h * _STEP + np.uint64(b + 1)
        return h[0]

    def edges(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(start, end, rows, piece)`` for every piece that stands in a word; ``words`` is a matrix of bytes."""
        n = words.shape[1]
        codes = words.astype(np.uint64) + np.uint64(1)
        out = []
        for start in range(n):
            h = np.zeros(len(words), np.uint64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                h = h * _STEP + codes[:, end - 1]
                rows = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
                at = np.searchsorted(self.keys, h[rows])
                at[at == len(self.keys)] = 0
                same = self.keys[at] == h[rows]
                if same.any():
                    out.append((start, end, rows[same], self.ids[at[same]]))
        return out

    def forward(self, edges, count: int, n: int) -> np.ndarray:
        a = np.full((n + 1, count), -np.inf)
        a[0] = 0.0
        for start, end, rows, piece in sorted(edges, key=lambda e: e[1]):
            a[end, rows] = np.logaddexp(a[end, rows], a[start, rows] + self.logp[piece])
        return a

    def expected(self, words: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts over all segmentations."""
        count, n = words.shape
        edges = self.edges(words)
        a = self.forward(edges, count, n)
        b = np.full((n + 1, count), -np.inf)
        b[n] = 0.0
        for start, end, rows, piece in sorted(edges, key=lambda e: -e[0]):
            b[start, rows] = np.logaddexp(b[start, rows], self.logp[piece] + b[end, rows])
        total = np.zeros(len(self.logp))
        for start, end, rows, piece in edges:
            share = np.exp(a[start, rows] + self.logp[piece] + b[end, rows] - a[n, rows]) * weight[rows]
            total += np.bincount(piece, weights=share, minlength=len(total))
        return total

    def by_length(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and byte matrices of words of equal length, in bounded blocks."""
        lengths = np.array([len(w) for w in words])
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for part in np.split(order, cuts):
            n = int(lengths[part[0]])
            for at in range(0, len(part), step := max(1, BATCH_CELLS // (16 * n))):
                some = part[at : at + step]
                yield some, np.frombuffer(b"".join([words[i] for i in some]), np.uint8).reshape(len(some), n)

    def log_prob(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        for at, matrix in self.by_length(words) if words else ():
            out[at] = self.forward(self.edges(matrix), *matrix.shape)[-1]
        return out


def _marked(words: list[bytes]) -> list[bytes]:
    return [w if w == END else b" " + w for w in words]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to about ``BATCH_WORDS`` rows, so that words of one length come by the thousand."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BATCH_WORDS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


_ROWS = pa.schema([("chunk", pa.int64()), ("word", pa.binary()), ("local", pa.int32()), ("trained", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("locals", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])
ROWS = "chunk long, word binary, local int, trained long, doc_id long, held_out boolean, n_tokens long, locals array<int>, times array<int>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as counts over their chunk's own word list; a chunk ends when that list, or its documents' counts, are long."""
    from pyspark import TaskContext

    chunk, number, trained, counts = TaskContext.get().partitionId() << 24, {}, [], 0

    def words() -> Iterator[pa.RecordBatch]:
        names = list(number)
        for at in range(0, len(names), 50_000):
            n = len(part := names[at : at + 50_000])
            empty = [pa.nulls(n, f.type) for f in list(_ROWS)[4:]]
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.array(part, pa.binary()), pa.array(range(at, at + n), pa.int32()), pa.array(trained[at : at + n], pa.int64()), *empty], schema=_ROWS)

    for batch in batches:
        docs = []
        for ident, text, held in zip(*(batch.column(i) for i in range(3))):
            tokens = (text.as_py() or b"").lower().split()
            tokens.append(END)
            ids = np.array([number.setdefault(w, len(number)) for w in tokens], np.int32)
            trained += [0] * (len(number) - len(trained))
            local, times = np.unique(ids, return_counts=True)
            if not held.as_py():
                for i, c in zip(local.tolist(), times.tolist()):
                    trained[i] += c
            counts += len(local)
            docs.append((chunk, None, None, None, ident.as_py(), held.as_py(), len(tokens), local, times.astype(np.int32)))
            full = len(number) >= CHUNK_WORDS or counts >= CHUNK_COUNTS
            if len(docs) >= 500 or full:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*docs), _ROWS)], schema=_ROWS)
                docs = []
            if full:
                yield from words()
                chunk, number, trained, counts = chunk + 1, {}, [], 0
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*docs), _ROWS)], schema=_ROWS)
    yield from words()


def fit(counts: DataFrame, path: str, rounds: int = 2) -> np.ndarray:
    """Log probabilities of the pieces: expectation maximisation over all distinct training words.

    Each word counts once, as the new word it was when first seen.

    What comes to the driver is one number per piece of the vocabulary.
    """
    logp = vocabulary(path)[1]
    for _ in range(rounds):
        now = logp

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(vocabulary(path)[0], now)
            total = np.zeros(len(now))
            for batch in _gathered(batches):
                words = _marked(batch.column(0).to_pylist())
                for at, matrix in lattice.by_length(words) if words else ():
                    total += lattice.expected(matrix, np.ones(len(at)))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "n"])

        table = counts.filter("c > 0").select("word").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        n = np.full(len(logp), 1e-3)
        np.add.at(n, table["piece"].to_numpy(np.int64), table["n"].to_numpy())
        logp = np.log(n / n.sum())
    return logp


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, path: str, rounds: int = 2) -> DataFrame:
    """Base and lattice log10 probability of every whole text.

    Words are counted and scored once each.  A chunk of documents shares a word
    list, so the shuffles carry a row per chunk and word, not per document and
    word.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"), (split_of(F.col("doc_id")) == 1).alias("held"))
    rows = stored(texts.mapInArrow(_chunks, ROWS), "lattice-chunks")
    words = rows.filter(F.col("word").isNotNull()).select(F.col("chunk").alias("of"), "word", "local", "trained")
    counts = stored(words.groupBy("word").agg(F.sum("trained").alias("c")), "lattice-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    logp = fit(counts, path, rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(path)[0], logp)
        for batch in _gathered(batches):
            p = lattice.log_prob(_marked(batch.column(0).to_pylist()))
            if total:
                # A word seen in training is one more edge of the lattice; new words share the rest (Witten-Bell).
                with np.errstate(divide="ignore"):
                    whole = np.log(batch.column(1).to_numpy() / (total + distinct))
                p = np.logaddexp(whole, math.log(distinct / (total + distinct)) + p)
            p = p / math.log(10)
            yield from pa.table([batch.column(0), batch.column(1), pa.array(p)], names=["word", "c", "p"]).to_batches()

    scored = stored(counts.mapInArrow(score, "word binary, c long, p double"), "lattice-words")
    valued = words.join(scored, "word").select("of", "local", "c", "p")
    units = rows.filter(F.col("word").isNull()).select("chunk", "doc_id", "held_out", "n_tokens", "locals", "times")

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("local").to_numpy()
        c, p = np.zeros(len(at)), np.zeros(len(at))
        c[at], p[at] = right.column("c").to_numpy(), right.column("p").to_numpy()
        base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        out = []
        for ids, times in zip(left.column("locals"), left.column("times")):
            i, n = ids.values.to_numpy(), times.values.to_numpy()
            out.append((int(n[c[i] > 0].sum()), float(n @ base[i]), float(n @ p[i])))
        known, b, s = zip(*out) if out else ((), (), ())
        return pa.table([left.column("doc_id"), left.column("held_out"), left.column("n_tokens"), pa.array(known, pa.int64()), pa.array([total] * len(out), pa.int64()), pa.array(b, pa.float64()), pa.array(s, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return units.groupBy("chunk").cogroup(valued.groupBy("of")).applyInArrow(close, OUT)
