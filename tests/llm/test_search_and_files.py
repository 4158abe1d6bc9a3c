"""Spelling variants, ranked search and token files against brute force and round trips."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from askframe.llm import ranked, spelling, token_files, words
from askframe.llm.common import scratch

VOCAB = P.path("byte_bpe_50k.json")


def texts(seed: int, n: int = 250) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base = ["house", "horse", "hourse", "river", "rivers", "driver", "Ñandú", "ñandus", "straße", "ab", "x1y", "naïve", "naive", "ÉCOLE", "école"]
    rows: list[tuple[int | None, str | None]] = [(i, " ".join(rng.choices(base, k=rng.randrange(30)))) for i in range(n)]
    rows += [(7, None), (8, ""), (None, "house house river"), (9, "river " * 5000), (9, "river " * 5000), (9, "école ÷ × 你好 house's\n\n end")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 1, "x") for i, t in texts(3)], "doc_id long, text string, word string, n int, rank string").repartition(5)


def spelled(rows):
    """Words and counts by the contract, one run after the other."""
    count = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("filter_bytes", [64 << 20, 20])
def test_spelling_equals_brute_force(spark, docs, filter_bytes):
    words = spelled(texts(3))
    got = {r.word: r for r in spelling.variants(docs, filter_bytes=filter_bytes).collect()}
    assert got.keys() == words.keys() and len(words) > 12
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}
    for w, r in got.items():
        root = w
        while root in form:
            root = form[root]
        assert (r.n, r.n_near, r.form, r.form_n, r.root) == (words[w], len(near[w]), form.get(w), words.get(form.get(w)), root)
    assert spelling.variants(docs.filter("false")).count() == 0


def test_near_words_of_a_random_vocabulary(spark):
    rng = random.Random(1)
    words = {"".join(rng.choices("abñ", k=rng.randrange(5, 8))): rng.randrange(3, 99) for _ in range(700)}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = Counter((r.word, r.other) for r in spelling.near_words(table, 700).collect())
    assert got == Counter((a, b) for a in words for b in words if one_apart(a, b))


def test_roots_follow_long_chains(spark):
    chain = [(str(i), str(i + 1)) for i in range(37)] + [("a", "0"), ("b", "36")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert set(got.values()) == {"37"} and len(got) == len(chain)


def ranking(rows, items, k):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    split = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in term.findall(t or "")]
    docs = [(i, Counter(split(t))) for i, t in rows]
    n, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    found = []
    for item_id, text in items:
        scores = []
        for i, c in docs:
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(split(text)) if t in c)
            scores += [(-s, i is None, i)] if s > 0 else []
        best = sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        found += [(item_id, r + 1, i, -s) for r, (s, _, i) in enumerate(best)]
    return Counter(found)


@pytest.mark.parametrize(("k", "postings", "item_bytes"), [(10, 2_000_000, 8 << 20), (3, 300, 1500)])
def test_ranked_search_equals_brute_force(spark, docs, k, postings, item_bytes):
    items = [(1, "House of the river, rivers"), (2, "house house"), (3, None), (4, ""), (5, "unknown words"), (6, "ñandus ÷ 你好 horse X1Y ÉCOLE"), (None, "driver"), (7, " ".join(t for _, t in texts(5, 20) if t and len(t) < 1000))]
    table = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int")
    got = ranked.top_documents(docs, table, k, item_bytes, postings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == ranking(texts(3), items, k)
    assert ranked.top_documents(docs.filter("false"), table).count() == 0
    assert ranked.top_documents(docs, table.filter("false")).count() == 0


def test_nra_reads_a_part_and_is_exact():
    rng = np.random.default_rng(2)
    n_docs, n_terms = 5000, 6
    doc = np.concatenate([rng.choice(n_docs, 2000, replace=False) for _ in range(n_terms)])
    term = np.repeat(np.arange(n_terms), 2000)
    impact = (1e6 / (1 + rng.permutation(len(doc)))).astype(np.int64)
    lists = ranked.Lists(doc, term, impact, n_terms)
    found, score = ranked.nra(lists, np.arange(n_terms), n_docs, 10, 0)
    full = np.bincount(doc, impact, n_docs).astype(np.int64)
    last = np.sort(full)[-10]
    assert sorted(found) == sorted(np.flatnonzero(full >= last)) and (score == full[found]).all()
    assert len(ranked.nra(lists, np.arange(n_terms), n_docs, 10, int(full.max()) + 1)[0]) == 0


def test_ranks_of_every_length_come_back():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 1001):
        ranks = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype("<u4")
        control, data = token_files.pack_ranks(ranks)
        assert len(control) == (n + 3) // 4
        assert (token_files.unpack_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks).all()


def test_file_is_ranked_by_frequency_and_finds_damage():
    ids = [np.array([70_000, 5, 5, 2]), np.array([2]), np.array([9, 2])]
    raw = token_files.write_file([None, 0, 4], ids)
    assert [(d, x.tolist()) for d, x in token_files.read_file(raw)] == [(None, [70_000, 5, 5, 2]), (0, [2]), (4, [9, 2])]
    assert np.frombuffer(raw, "<u4", 2, token_files.HEAD.size).tolist() == [2, 5]
    with pytest.raises(ValueError, match="damaged"):
        list(token_files.read_file(raw[:-1] + bytes([raw[-1] ^ 1])))


def test_stretches_encode_like_whole_texts():
    lib, own = Tokenizer.from_file(VOCAB), token_files.Encoder(VOCAB)
    rng = random.Random(4)
    odd = ["a.b", "it's", "'s", "\n", "\n\n", " ", "  ", "\t", "　", "\x1c", "word", "Wörter", "12", "...", "!?", "<|endoftext|>", "<|", "你好", "²", "x\ny", "end.\nNew", " ", "'"]
    for _ in range(3000):
        text = rng.choice(["", " "]).join(rng.choices(odd, k=rng.randrange(12)))
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_distinct_stretch_of_many_texts_is_coded_once(monkeypatch):
    own, looked = token_files.Encoder(VOCAB), []
    codes = own.codes
    monkeypatch.setattr(own, "codes", lambda words: looked.extend(words) or codes(words))
    some = ["The word, the word;\nthe naïve  word" * 20] * 30
    want = own.tokenizer.encode(some[0], add_special_tokens=False).ids
    assert all(np.frombuffer(x, own.dtype).tolist() == want for x in own.many(pa.array(some)))
    assert len(looked) == len(set(looked)) == 9


@pytest.mark.parametrize("at_once", [64, 1 << 20])
def test_odd_texts_of_a_batch_are_as_by_the_library(monkeypatch, at_once):
    monkeypatch.setattr(words, "BYTES_AT_ONCE", at_once)
    monkeypatch.setattr(token_files, "CACHE", 30)
    own, rng = token_files.Encoder(VOCAB), random.Random(6)
    odd = ["a.b", "it's", "'s", "\n", "\n\n", "\r\n", " ", "   ", "\t", "\u3000", "\x1c", "\x85", "\xa0", "\u0301", "É.", "÷.", "12", "x1.", "...", "<|endoftext|>", "<|", "你好.", "x\ny", "end.\nNew\nz", " \n", "\0", "a\0b", "\x0b"]
    some = [None, "", *(rng.choice(["", " "]).join(rng.choices(odd, k=rng.randrange(12))) for _ in range(2000)), None]
    want = [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.many(pa.array(some))] == want
    assert list(own.many(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("sizes", [{}, {"file_ids": 2000, "shard_bytes": 3000}])
def test_token_files_round_trip(spark, docs, sizes):
    lib, rows = Tokenizer.from_file(VOCAB), texts(3)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append((*lib.encode(t or "", add_special_tokens=False).ids, 2))
    contents = []
    for parts in (2, 7):
        folder = scratch(spark, "t")
        manifest = token_files.write_tokens(docs.repartition(parts), VOCAB, folder, **sizes)
        got = sorted(token_files.read_tokens(manifest, folder, with_ids=True).collect(), key=lambda r: r.start)
        at = 0
        for r in got:
            assert r.start == at and r.n_tokens == len(r.ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            want_here = want[r.doc_id]
            assert tuple(r.ids) in want_here
            at += r.n_tokens
        assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, x) for i, xs in want.items() for x in xs)
        order = [(-1 if r.doc_id is None else r.doc_id) for r in got]
        assert order == sorted(order)
        files = {r.final: (r.bytes, r.ids) for r in manifest.collect()}
        assert len(files) > 5 if sizes else len(files) == 1
        contents.append(files)
    assert contents[0] == contents[1]
    assert token_files.encode_and_read(spark, docs.filter("false"), VOCAB).count() == 0


def test_an_id_with_most_rows_is_spread(spark):
    rows = [(5, f"copy {i}") for i in range(400)] + [(i, "other") for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = scratch(spark, "t")
    manifest = token_files.write_tokens(table, VOCAB, folder, shard_bytes=300)
    assert max(r.documents for r in manifest.collect()) < 200
    got = sorted(token_files.read_tokens(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    assert [r.start for r in got][1:] == np.cumsum([r.n_tokens for r in got])[:-1].tolist()
