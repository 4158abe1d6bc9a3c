"""Codes of many texts by way of their distinct words: Arrow cuts texts and finds distinct words, Python codes each of these once."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

# Bytes of texts, and a text more, whose distinct words are looked up at once.
BYTES_AT_ONCE = 4 << 20
# Words that the tokenizer gets in one call.
WORDS_AT_ONCE = 10_000


def _byte_chars() -> dict[int, str]:
    """How byte-level vocabularies spell a space and Latin letters: a character a byte, printable bytes as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(char[b] for b in chr(c).encode()) for c in [0x20, *range(0xC0, 0x100)]}


BYTE_CHARS = _byte_chars()


def encode_words(tokenizer: Tokenizer, words: list[str], plain: re.Pattern, kind: str) -> dict[str, bytes]:
    """Ids of words as arrays of ``kind``.

    A word that is ``plain``, letters that the tokenizer's other steps leave as one
    match, is asked of its model directly; all else takes the whole way.
    """
    model, found, hard = getattr(tokenizer, "model", None), {}, []
    for w in words:
        if model is not None and plain.fullmatch(w):
            spelt = w.replace(" ", BYTE_CHARS[0x20]) if w.isascii() else w.translate(BYTE_CHARS)
            found[w] = array(kind, [t.id for t in model.tokenize(spelt)]).tobytes()
        else:
            hard.append(w)
    for at in range(0, len(hard), WORDS_AT_ONCE):
        part = hard[at : at + WORDS_AT_ONCE]
        for w, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False)):
            found[w] = array(kind, e.ids).tobytes()
    return found


class Table:
    """Codes of words, remembered up to a bound.

    Words met since the table was last half full stay when it is full, so
    frequent ones are never forgotten; only one call's words may go beyond.
    """

    def __init__(self, limit: int):
        self.half = limit // 2
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Codes of words that the table does not hold."""
        raise NotImplementedError

    def codes(self, words: list[str]) -> list[bytes]:
        new = {w for w in words if w not in self.known}
        if new and len(self.known) + len(new) > self.half:
            self.known, self.before, new = {}, self.known, set(words)
        known, before, rest = self.known, self.before, []
        for w in new:
            if (code := before.get(w)) is not None:
                known[w] = code
            else:
                rest.append(w)
        known.update(self.learn(rest))
        return [known[w] for w in words]


def slices(texts: pa.StringArray) -> Iterator[pa.StringArray]:
    """The texts in turn, about ``BYTES_AT_ONCE`` at a time, nulls as empty ones."""
    texts = pc.fill_null(texts, "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // BYTES_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield texts.slice(lo, hi - lo)


def joined(words: pa.ListArray, mark: str, codes: Callable[[list[str]], list[bytes]]) -> Iterator[bytes]:
    """The codes of each list's words one after another; no word holds ``mark``."""
    table = words.flatten().dictionary_encode()
    # One string and a split make Python's words faster than a conversion each.
    names = pc.binary_join(pa.ListArray.from_arrays([0, len(table.dictionary)], table.dictionary), mark)[0].as_py().split(mark)
    found = pa.array(codes(names), pa.large_binary()).take(table.indices)
    ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)
    data = memoryview(found.buffers()[2] or b"")
    at = ends[np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])].tolist()
    for lo, hi in zip(at, at[1:]):
        yield bytes(data[lo:hi])
