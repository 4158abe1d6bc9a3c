"""WARC archives: a deterministic sharded writer with a manifest, and a reader that verifies digests.

Null payloads are empty payloads; null ids and urls leave out their headers.
Rows that repeat an id with the same payload are written once each.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.llm.common import scratch, shard_bounds, shard_of, stored

MANIFEST = "shard int, seq int, temp string, final string, records long, bytes long, first_id long, last_id long"
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, record_id string, target_uri string, file string, payload binary"
DATE = "1970-01-01T00:00:00Z"
LEVEL = 3


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; its id, lengths and digests follow from its content alone."""
    digest = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest.hex()}|{refers_to}")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", refers_to)]
    fields += [("X-Payload-Length", len(payload)), ("WARC-Payload-Digest", _b32(digest)), ("WARC-Block-Digest", _b32(hashlib.sha1(block).digest()))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Roller:
    """Files of one shard: a new one begins where the next member would pass the limit."""

    def __init__(self, folder: str, limit: int):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(f"{self.root}/_temporary", recursive=True)
        self.limit, self.attempt, self.shard, self.out = limit, uuid.uuid4().hex, None, None

    def add(self, shard: int, page_id: int | None, member: bytes) -> Iterator[tuple]:
        if shard != self.shard or self.size + len(member) > self.limit:
            yield from self.close()
            self.seq = self.seq + 1 if shard == self.shard else 0
            self.shard, self.size, self.n, self.first = shard, 0, 0, page_id
            self.name = f"part-{shard:06d}-{self.seq:05d}.warc.gz"
            self.temp = f"_temporary/{self.name}.{self.attempt}"
            self.out = self.store.open_output_stream(f"{self.root}/{self.temp}")
        self.out.write(member)
        self.size, self.n, self.last = self.size + len(member), self.n + 1, page_id

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.out = None
            yield self.shard, self.seq, self.temp, self.name, self.n, self.size, self.first, self.last


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temp", pa.string()), ("final", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])
_RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("file", pa.string()), ("payload", pa.binary())])


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = 128 << 20, max_shards: int = 65_536, file_bytes: int = 16 << 20, revisit_bytes: int = 1000) -> DataFrame:
    """Write ``(page_id, url, html)`` as records sorted by id and return the manifest that commits them.

    Shards are ranges of ids whose cuts depend on the rows alone; a shard is
    several files long, and a file ends at ``file_bytes`` compressed.  A task writes
    each file under a name of its own attempt; the manifest lists those of
    successful attempts, and a second step moves them to their final names.  It
    can be repeated: a file already moved is left.  Only files in the final
    manifest belong to the archive.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    sized = rows.withColumn("size", F.octet_length("payload"))
    copies = sized.filter(F.col("size") >= revisit_bytes).groupBy(F.sha1("payload").alias("digest")).agg(F.count("*").alias("n"), F.max("page_id").alias("kept"))
    kept = stored(copies.filter((F.col("n") > 1) & F.col("kept").isNotNull()).select("digest", "kept"), "warc-copies")
    bounds = shard_bounds(sized, "page_id", "size", shard_bytes, max_shards)
    # A short payload has no copy to find; its own key spreads it over the join's tasks.
    alone = F.concat_ws("-", F.lit("short"), F.col("page_id").cast("string"), F.xxhash64("payload").cast("string"))
    digest = F.when(F.col("size") >= revisit_bytes, F.sha1("payload")).otherwise(alone)
    marked = sized.withColumn("digest", digest).join(kept, "digest", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("kept"))
    marked = marked.select("page_id", "url", "payload", F.when(other, F.col("kept")).alias("refers_to"), shard_of(F.col("page_id"), bounds).alias("shard"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Roller(folder, file_bytes)
        done: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, refers, shard = (batch.column(k)[i].as_py() for k in range(5))
                done += out.add(shard, page_id, _member(record(page_id, url, payload, refers)))
        done += out.close()
        if done:
            yield _batch(done, _MANIFEST_ARROW)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if store.get_file_info(f"{root}/{row['final']}").type == fs.FileType.NotFound:
                    store.move(f"{root}/{row['temp']}", f"{root}/{row['final']}")
            yield batch

    spread = marked.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", F.sha1("payload"), "url")
    written = stored(spread.mapInArrow(write, MANIFEST), "warc-written")
    return stored(written.mapInArrow(move, MANIFEST), "warc-manifest")


def _records(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    """Members of a file one after the other; no more than one is held."""
    with store.open_input_file(path) as source:
        unpack, parts, data = zlib.decompressobj(31), [], b""
        while data or (data := source.read(1 << 20)):
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record; fails on a wrong digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if _b32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"] or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    if fields["WARC-Type"] == "response" and _b32(hashlib.sha1(payload).digest()) != fields["WARC-Payload-Digest"]:
        raise ValueError(f"wrong payload digest in {fields['WARC-Record-ID']}")
    return fields, payload


def read_warc(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record of the files in the manifest, digests verified, a task per group of files."""

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                for data in _records(store, f"{root}/{name}"):
                    f, payload = parse(data)
                    sha = base64.b32decode(f["WARC-Payload-Digest"][5:]).hex()
                    rows.append((number(f.get("X-Page-ID")), f["WARC-Type"], number(f.get("X-Refers-To-Page-ID")), int(f["X-Payload-Length"]), sha, f["WARC-Record-ID"], f.get("WARC-Target-URI"), name, payload if with_payload else None))
                    held += len(payload) if with_payload else 300
                    if held > 4 << 20:
                        yield _batch(rows, _RECORD_ARROW)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, _RECORD_ARROW)

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("final").repartition(n, "final").mapInArrow(read, RECORD)


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages to a new archive in the shared folder and read it back."""
    folder = scratch(spark, "warc")
    return read_warc(write_warc(pages, folder), folder, with_payload=False)
