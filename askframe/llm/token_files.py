"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding, decoded by table lookup.

A file holds documents in ascending id order and stands alone.  Its ids are
replaced by their rank of frequency within the file, rank 0 being the most
frequent; a rank takes 1 to 4 bytes, little-endian, and its length stands as
two bits in a control byte that covers four ranks.  Layout, all little-endian:

    "FRB1", u32 ranks, u64 documents, u64 ids, u64 data bytes, u32 crc32 of all that follows
    u32 id by rank | u8 has an id, i64 doc_id, i64 length by document | control bytes | data bytes

A null text is an empty one, a single end id.  Null ids come first, as 0 with
their flag unset; rows that repeat an id are written once each, ordered by the
hash of their text, so the same table gives the same files.  An id that holds more than a
shard of rows is spread over several shards by that hash.
"""

from __future__ import annotations

import functools
import math
import os
import re
import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from askframe.llm.common import scratch, shard_of, stored
from askframe.llm.words import Table, encode_words, joined, slices

# Stretches that a Python worker remembers at most.
CACHE = 600_000
CHUNK = 1 << 20
MAGIC = b"FRB1"
HEAD = struct.Struct("<4sIQQQI")
# Length in bytes of each of the four ranks of a control byte, and which of four bytes a length keeps.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8) + 1
KEEP = np.arange(4)[None] < np.arange(5)[:, None]
_GAP = re.compile(r" (?:\s|$)")
_LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTER, _SPACE = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}", r"\t-\r\x1c-\x1f\x{85}\pZ"
# Spaces that white space or the text's end follows, and others; marks after a letter, but for the apostrophe, which may
# begin a match with letters; a line break between non-spaces.
_BEFORE_SPACE, _BEFORE_WORD = rf" ([{_SPACE}]|$)", rf" ([^{_SPACE}])"
_MARKS = rf"([{_LETTER}])([!-&(-/:-@\[-`{{-~])"
_LINE = rf"([^{_SPACE}])\n([^{_SPACE}])"


class Encoder(Table):
    """Ids of whole texts by a byte-level tokenizer file; distinct stretches are remembered up to a bound.

    The file's pre-tokenizer always begins a new match at a space that a
    non-space follows, at marks after a letter, and on either side of a single
    line break between non-spaces, so a text's ids are those of its stretches
    in turn.  A text that holds an added token is encoded whole.
    """

    def __init__(self, path: str):
        super().__init__(CACHE)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")

    def learn(self, words: list[str]) -> dict[str, bytes]:
        return encode_words(self.tokenizer, words, _LETTERS, self.dtype.char)

    def many(self, texts: pa.StringArray) -> Iterator[bytes]:
        """Ids of each text in turn."""
        for some in slices(texts):
            odd = functools.reduce(pc.or_, [pc.match_substring(some, x) for x in ["\0", *self.added]])
            plain = some.filter(pc.invert(odd))
            # Where every space begins a word, the simple replacement is the faster one.
            if pc.any(pc.match_substring_regex(plain, _BEFORE_SPACE)).as_py():
                cut = pc.replace_substring_regex(plain, _BEFORE_WORD, "\0 \\1")
            else:
                cut = pc.replace_substring(plain, " ", "\0 ")
            cut = pc.replace_substring_regex(pc.replace_substring_regex(cut, _LINE, "\\1\0\n\0\\2"), _MARKS, "\\1\0\\2")
            ids = joined(pc.split_pattern(cut, "\0"), "\0", self.codes)
            yield from (self.apart(t.as_py()) if apart else next(ids) for t, apart in zip(some, odd.to_pylist()))

    @staticmethod
    def stretches(text: str) -> list[str]:
        """The text cut before each space that a non-space follows."""
        if "\0" not in text and not _GAP.search(text):
            return text.replace(" ", "\0 ").split("\0")
        head, *rest = text.split(" ")
        found = [head]
        for r in rest:
            if r and not r[0].isspace():
                found.append(" " + r)
            else:
                found[-1] += " " + r
        return found

    def apart(self, text: str) -> bytes:
        """Ids of a text with an added token, or with the character that marks cuts in the others."""
        if any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(self.codes(self.stretches(text)))

    def encode(self, text: str) -> bytes:
        return next(self.many(pa.array([text], pa.string())))


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    two = np.zeros((len(ranks) + 3) // 4 * 4, np.uint8)
    two[: len(ranks)] = size - 1
    control = (two.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[KEEP[size]].tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """``n`` ranks: the tables give each one's length, and the bytes it keeps."""
    size = LENGTHS[control].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[KEEP[size]] = data
    return out.view("<u4").ravel()


def write_file(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The bytes of a file."""
    every = np.concatenate(ids).astype(np.int64)
    count = np.bincount(every)
    by_rank = np.lexsort((np.arange(len(count)), -count))[: np.count_nonzero(count)].astype("<u4")
    rank = np.zeros(len(count), "<u4")
    rank[by_rank] = np.arange(len(by_rank))
    coded = [pack_ranks(rank[every[at : at + CHUNK]]) for at in range(0, len(every), CHUNK)]
    control, data = (b"".join(c[k] for c in coded) for k in (0, 1))
    present = np.array([d is not None for d in doc_ids], np.uint8)
    table = [present, np.array([d or 0 for d in doc_ids], "<i8"), np.array([len(x) for x in ids], "<i8")]
    body = b"".join([by_rank.tobytes(), *[t.tobytes() for t in table], control, data])
    return HEAD.pack(MAGIC, len(by_rank), len(doc_ids), len(every), len(data), zlib.crc32(body)) + body


def read_file(raw: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """``(doc_id, ids)`` of each document in turn; fails on damage."""
    magic, n_ranks, n_docs, n, n_data, crc = HEAD.unpack_from(raw)
    if magic != MAGIC or zlib.crc32(memoryview(raw)[HEAD.size :]) != crc:
        raise ValueError("damaged token file")
    at = HEAD.size

    def take(dtype: str, k: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(raw, dtype, k, at)
        at += found.nbytes
        return found

    by_rank, present, doc_ids, lengths = take("<u4", n_ranks), take("u1", n_docs), take("<i8", n_docs), take("<i8", n_docs)
    control, data = take("u1", (n + 3) // 4), take("u1", n_data)
    ids, used = np.empty(n, "<u4"), 0
    for lo in range(0, n, CHUNK):
        part, k = control[lo // 4 : (lo + CHUNK) // 4], min(CHUNK, n - lo)
        size = int(LENGTHS[part].ravel()[:k].sum())
        ids[lo : lo + k] = by_rank[unpack_ranks(part, data[used : used + size], k)]
        used += size
    lo = 0
    for has, doc_id, length in zip(present.tolist(), doc_ids.tolist(), lengths.tolist()):
        yield (doc_id if has else None), ids[lo : lo + length]
        lo += length


def _shards(rows: DataFrame, shard_bytes: int, max_shards: int, sample: int = 50_000) -> tuple[list[int], list[int]]:
    """Ascending bounds of ``doc_id`` and how many shards begin at each: more than one where an id fills shards alone.

    The cuts are quantiles, weighted by bytes, of the ids whose hash falls into
    a fixed class, about ``sample`` of them; every row is dealt.
    """
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    shards = min(max_shards, math.ceil((total or 0) / shard_bytes))
    if shards < 2:
        return [], []
    every = max(1, n // sample)
    ids = rows.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sum("size").cast("double").alias("w"), F.count("*").alias("n"))
    # An id with many rows is never left to the sample.
    seen = ids.filter((F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0) | (F.col("n") > every)).toPandas().sort_values("doc_id")
    if seen.empty:
        return [], []
    weight = np.where(seen["n"] > every, seen["w"], seen["w"] * every)
    share = np.cumsum(weight) / max(weight.sum(), 1.0)
    at = np.minimum(np.searchsorted(share, np.arange(1, shards) / shards), len(seen) - 1)
    cuts = Counter(seen["doc_id"].to_numpy()[at].tolist())
    return sorted(cuts), [cuts[b] for b in sorted(cuts)]


def _place(bounds: list[int], many: list[int], tie: Column) -> Column:
    """A row's shard: ascending with the id, and for an id that begins several shards one of them by ``tie``."""
    if not bounds:
        return F.lit(0)
    below = shard_of(F.col("doc_id"), bounds)
    total = np.concatenate([[0], np.cumsum(many)]).tolist()
    last = F.element_at(F.lit(total), below + 1)
    own = F.coalesce(F.element_at(F.lit([bounds[0], *bounds]), below + 1) == F.col("doc_id"), F.lit(False))
    k = F.element_at(F.lit([1, *many]), below + 1)
    return F.when(own & (below > 0), last - F.pmod(tie, k)).otherwise(last).cast("int")


WRITTEN = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temp", pa.string()), ("final", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
MANIFEST = "shard int, seq int, temp string, final string, documents long, ids long, bytes long"
DOCUMENT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_tokens(docs: DataFrame, path: str, folder: str, end: int = 2, file_ids: int = 4_000_000, shard_bytes: int = 64 << 20, max_shards: int = 16_384) -> DataFrame:
    """Encode ``(doc_id, text)``, write files in ascending id order and return the manifest that commits them, with each file's ``start``.

    Ids are dealt to ranges of ``doc_id``; a range's task writes files of about
    ``file_ids`` ids under names of its own attempt, and a second step, which can be
    repeated, gives those of successful attempts their final names.  Memory is
    bounded by a file or the longest document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds, many = _shards(rows.select("doc_id", F.octet_length("text").alias("size")), shard_bytes, max_shards)
    tie = F.xxhash64("text")
    dealt = rows.select("doc_id", tie.alias("tie"), _place(bounds, many, tie).alias("shard"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        last = np.array([end], known.dtype).tobytes()
        for batch in batches:
            ids = pa.array([ids + last for ids in known.many(batch.column(3))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ids], names=["doc_id", "tie", "shard", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/_temporary", recursive=True)
        dtype, attempt = encoder(path).dtype, uuid.uuid4().hex
        held: tuple[list, list] = ([], [])
        at, seq, n, done = None, 0, 0, []

        def close() -> None:
            nonlocal seq, n
            if held[0]:
                raw, name = write_file(*held), f"tokens-{at:06d}-{seq:05d}.frb"
                with store.open_output_stream(f"{root}/_temporary/{name}.{attempt}") as out:
                    out.write(raw)
                done.append((at, seq, f"_temporary/{name}.{attempt}", name, len(held[0]), n, len(raw)))
                held[0].clear(), held[1].clear()
                seq, n = seq + 1, 0

        for batch in batches:
            for doc_id, shard, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                ids = np.frombuffer(ids.as_py(), dtype)
                if shard != at or n + len(ids) > file_ids:
                    close()
                    at, seq = shard, seq if shard == at else 0
                held[0].append(doc_id), held[1].append(ids)
                n += len(ids)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), WRITTEN)], schema=WRITTEN)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if store.get_file_info(f"{root}/{row['final']}").type == fs.FileType.NotFound:
                    store.move(f"{root}/{row['temp']}", f"{root}/{row['final']}")
            yield batch

    coded = dealt.mapInArrow(encode, "doc_id long, tie long, shard int, ids binary")
    # Equal texts of one id are equal rows, so their order does not show.
    sorted_rows = coded.repartitionById(sum(many) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "tie")
    written = stored(stored(sorted_rows.mapInArrow(write, MANIFEST), "tokens-written").mapInArrow(move, MANIFEST), "tokens-manifest")
    # One number a shard comes to the driver; files are summed within their shard.
    ids = {r["shard"]: r["n"] for r in written.groupBy("shard").agg(F.sum("ids").alias("n")).collect()}
    before = np.concatenate([[0], np.cumsum([ids.get(s, 0) for s in range(sum(many) + 1)])]).tolist()
    return written.selectExpr("*", "sum(ids) over (partition by shard order by seq) - ids as inner").withColumn("start", F.col("inner") + F.element_at(F.lit(before), F.col("shard") + 1)).drop("inner")


def read_tokens(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document of the files, with the ids on request."""
    schema = DOCUMENT.append(pa.field("ids", pa.list_(pa.uint32()))) if with_ids else DOCUMENT

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema).cast(pa.schema([*DOCUMENT, pa.field("ids", pa.list_(pa.int64()))]) if with_ids else schema)

        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{name}") as source:
                    raw = source.read()
                rows = []
                for doc_id, ids in read_file(raw):
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), *[ids] * with_ids))
                    at += len(ids)
                    if len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return manifest.select("final", "start").repartition(n, "final").mapInArrow(read, kinds)


def encode_and_read(spark: SparkSession, docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """Write the documents' ids to new files in the shared folder and read them back."""
    folder = scratch(spark, "tokens")
    return read_tokens(write_tokens(docs, path, folder, end), folder)
