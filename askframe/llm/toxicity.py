"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

A null text is an empty one; labels that are null are not used, and a document
labelled twice counts once.  Fitting takes every labelled row, or at most
``max_labelled`` where a caller says so, those with the smallest hash of their
id; scoring takes every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import TEXTS_AT_ONCE, batches_of, split_of, stored
from askframe.llm.simhash import _passing, _sieve

LEXICON = 4_000
LEAST_DOCS, LEAST_ODDS = 4, 2.0
PREFIX = 5
NEAR = 4

# Second-person words of the corpus languages.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
# Characters that stand for letters.
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")

MARKS = '.,;:?"()[]'
_WORD = re.compile(rf"[^\s{re.escape(MARKS)}]+")
_ODD = re.compile(r"[^\W\d_][\d@$!|*_][^\W\d_]|[^\W\d_](?:[.\-*_][^\W\d_]){3,}")


@lru_cache(maxsize=50_000)
def plain(word: str) -> str:
    """A word with lookalikes put back, inner marks dropped and letter runs cut to one."""
    word = re.sub(r"[\W_]+", "", word.lower().translate(LOOKALIKE))
    return re.sub(r"(.)\1{2,}", r"\1", word)


def units(word: str) -> tuple[str, str]:
    """The lexicon's units of a lower-case word: itself, and its beginning where it is longer."""
    return word, f"{word[:PREFIX]}~" if len(word) > PREFIX else ""


def _words(text: str) -> list[str]:
    return _WORD.findall(text)


def lexicon(train: DataFrame, size: int) -> dict[str, float]:
    """Units that mark toxic documents, with smoothed log odds; at most ``size``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                found = {u for w in set(_words((text.as_py() or "").lower())) for u in units(plain(w)) if u}
                seen[toxic.as_py()].update(found)
        names = list(seen[1])  # a unit that no toxic document has cannot be chosen
        columns = [pa.array(names, pa.string()), pa.array([seen[1][u] for u in names], pa.int64()), pa.array([seen[0][u] for u in names], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["unit", "pos", "neg"])
        only = [u for u in seen[0] if u not in seen[1]]
        for at in range(0, len(only), 100_000):
            part = only[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([0] * len(part), pa.int64()), pa.array([seen[0][u] for u in part], pa.int64())], names=["unit", "pos", "neg"])

    n = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    sums = train.select("text", "toxic").mapInArrow(count, "unit string, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    best = sums.filter(F.col("pos") >= LEAST_DOCS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    with batches_of(train.sparkSession, TEXTS_AT_ONCE):
        rows = best.orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "unit").limit(size).collect()
    return {r["unit"]: r["odds"] for r in rows}


class Tokens(dict):
    """What each run of non-space characters adds to a text's features, remembered while it lasts.

    None stands for a token of one word that adds nothing else.  Otherwise:
    words, capitals, words in capitals, obfuscations, lexicon hits as ``(place,
    weight, exact, hidden, word)`` and places of second-person words, counted
    from the token's first word.  Long tokens are not kept, and a full table is emptied.
    """

    def __init__(self, weights: dict[str, float], most: int = 50_000, longest: int = 60):
        super().__init__()
        self.weights, self.most, self.longest = weights, most, longest

    def __missing__(self, token: str) -> tuple | None:
        found = self._of(token)
        if len(token) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[token] = found
        return found

    def _of(self, token: str) -> tuple | None:
        core = token.strip(MARKS)
        low = core.lower()
        if core.isalpha() and low.isalpha() and low not in SECOND_PERSON and self.weights.keys().isdisjoint(units(low)):
            # One word of letters that no list holds: most tokens end here.
            return None if core.islower() else (1, sum(map(str.isupper, core)), len(core) > 2 and core.isupper(), 0, (), ())
        words, hits, persons = _words(token), [], []
        for i, w in enumerate(map(str.lower, words)):
            p = w if w.isalpha() else plain(w)
            a, b = units(p)
            weight = max(self.weights.get(a, 0.0), self.weights.get(b, 0.0) if b else 0.0)
            if weight:
                hits.append((i, weight, a in self.weights, p != w.strip("'-"), w))
            if w in SECOND_PERSON:
                persons.append(i)
        shouted = sum(1 for w in words if len(w) > 2 and w.isupper())
        return len(words), sum(map(str.isupper, token)), shouted, len(_ODD.findall(token)), hits, persons


def features(text: str, tokens: Tokens) -> list[float]:
    parts = text.split()
    extra = capitals = shouted = odd = 0
    hits, persons = [], set()
    for at, part in enumerate(parts):
        if found := tokens[part]:
            if found[4]:
                hits += [(at + extra + i, *rest) for i, *rest in found[4]]
            if found[5]:
                persons.update(at + extra + i for i in found[5])
            extra += found[0] - 1
            capitals += found[1]
            shouted += found[2]
            odd += found[3]
    words = len(parts) + extra
    n, chars = max(1, words), max(1, len(text))
    exact = sum(h[2] for h in hits)
    near = sum(1 for h in hits if not persons.isdisjoint(range(h[0] - NEAR, h[0] + NEAR + 1)))
    return [
        sum(h[1] for h in hits) / n,
        len(hits) / n,
        exact / n,
        math.log1p(len(hits)),
        math.log1p(exact),
        math.log1p(len({h[4] for h in hits})),
        max((h[1] for h in hits), default=0.0),
        near / n,
        math.log1p(near),
        sum(h[3] for h in hits) / n,
        capitals / chars,
        shouted / n,
        sum(text.count(c) for c in ".,;:") / chars,
        (text.count("!") + text.count("?")) / chars,
        odd / n,
        math.log1p(words),
    ]


def _features(weights: dict[str, float]):
    @F.arrow_udf("array<double>")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = Tokens(weights)
        for texts in batches:
            # Texts leave the batch one by one, and numbers take their place.
            values = np.fromiter((x for t in texts for x in features(t.as_py() or "", tokens)), np.float64)
            width = len(values) // max(1, len(texts))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * np.int32(width)), pa.array(values))

    return udf


class Model:
    """A fitted scorer: ``score(text)`` is a column from 0 to 1."""

    def __init__(self, weights, trees, calibration, rate):
        self.weights, self.trees, self.calibration, self.rate = weights, trees, calibration, rate

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``score``; its other columns stay, a clashing one is replaced."""
        kept = [c for c in docs.columns if c != "score"]
        if self.trees is None:
            return docs.select(*kept, F.lit(self.rate).alias("score"))
        whole = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row")
        x = docs.select(whole, array_to_vector(_features(self.weights)(F.col("text").cast("string"))).alias("_x"))
        raw = self.trees.transform(x).select("_row", _margin(F.col("_raw")).alias("_margin"))
        return self.calibration.transform(raw).select("_row.*", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_score"))).alias("score"))


def _margin(raw: Column) -> Column:
    return vector_to_array(raw)[1]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int | None = None, size: int = LEXICON) -> Model:
    """Learn from labelled rows outside the held-out fold; lexicon, trees and calibration see disjoint parts.

    A table of bits keeps texts without a label out of the join, so labelled texts alone are shuffled.
    """
    usable = labels.filter((split_of(F.col("doc_id")) != 0) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    if max_labelled is not None:
        chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    chosen = stored(chosen, "toxic-labels")
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(20))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).alias("mark"))
    sieve = _sieve(chosen.select("doc_id", F.lit(0).alias("mark")), "toxic-sieve")
    train = stored(_passing(texts, sieve).join(chosen, "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic", part.alias("part")), "toxic-train")
    rate = train.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
    weights = lexicon(train.filter("part < 9"), size)
    x = stored(train.filter("part >= 9").select("part", F.col("toxic").cast("double").alias("_y"), _features(weights)("text").alias("f")), "toxic-features", TEXTS_AT_ONCE)
    x = x.select("part", "_y", array_to_vector("f").alias("_x"))
    learn, check = x.filter("part < 16"), x.filter("part >= 16")
    if {r["_y"] for r in learn.select("_y").distinct().collect()} != {0.0, 1.0} or not check.head(1):
        return Model(weights, None, None, rate)
    booster = GBTClassifier(featuresCol="_x", labelCol="_y", predictionCol="_hard", maxIter=15, maxDepth=3, stepSize=0.3, seed=7)
    booster = booster.setRawPredictionCol("_raw").setProbabilityCol("_p") if hasattr(booster, "setProbabilityCol") else booster
    trees = booster.fit(learn)
    margins = trees.transform(check).select("_y", _margin(F.col("_raw")).alias("_margin"))
    calibration = IsotonicRegression(featuresCol="_margin", labelCol="_y", predictionCol="_score").fit(margins)
    return Model(weights, trees, calibration, rate)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document."""
    scored = fit(docs, labels).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", (split_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below one half, all columns as they were."""
    clean = fit(docs, labels).score(docs.withColumn("_own", F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    return clean.filter(F.col("score") < 0.5).select("_own.*")
