"""Byte-level BPE through a sentencepiece model that is written out from a rank file.

A null text encodes like the empty one: no ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

CACHE = 300_000
LONG_TEXT, MATCHES = 2_000_000, 100_000
# Printable stand-ins for the 256 bytes, none of them white space for sentencepiece.
BYTE_CHARS = [chr(0x4E00 + i) for i in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return [base64.b64decode(token) for token, _ in sorted(pairs, key=lambda p: int(p[1]))]


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model: token i is piece i, scored -i, so lower ranks merge first."""
    model = proto.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(BYTE_CHARS[b] for b in token), score=-float(rank), type=proto.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="⁇", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    t, n = model.trainer_spec, model.normalizer_spec
    t.model_type, t.vocab_size, t.unk_id, t.bos_id, t.eos_id, t.pad_id = proto.TrainerSpec.BPE, len(model.pieces), len(tokens), -1, -1, -1
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one rank file; distinct pre-tokens are remembered up to a bound."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.pattern = regex.compile(pattern)
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def ids(self, word: str) -> list[int]:
        """A whole token is itself, as in the rank format's own library; all else is merged."""
        data = word.encode()
        whole = self.rank.get(data)
        return [whole] if whole is not None else self.model.encode("".join(BYTE_CHARS[b] for b in data))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)

    def look(self, word: str) -> tuple[str, int, bytes]:
        found = self.known.get(word)
        if found is None:
            ids = self.ids(word)
            found = (" ".join(map(str, ids)), len(ids), self.decode(ids))
            if len(word) < 64:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[word] = found
        return found

    def words(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LONG_TEXT:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(found, MATCHES)):
            yield part

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, SHA-256 of the decoded bytes."""
        n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
        look, known = self.look, self.known
        for part in self.words(text):
            rows = [known.get(w) or look(w) for w in part]
            if rows:
                ids.update(((" " if n else "") + " ".join([r[0] for r in rows])).encode())
                n += sum([r[1] for r in rows])
                back.update(b"".join([r[2] for r in rows]))
        return n, ids.hexdigest(), back.hexdigest()


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_tables(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, with the ids themselves on request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            n, ids, back = zip(*map(c.digest, texts)) if texts else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                columns.append(pa.array([[i for part in c.words(t) for w in part for i in c.ids(w)] for t in texts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
