"""Sparse retrieval: TF-IDF cosine top-k over a vocabulary taken from the queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askframe.cluster import arrow_rows, broadcast_when, is_small, small_row_groups, stored
from askframe.functions.text import terms
from askframe.operators.blocks import HIT_SCHEMA
from askframe.operators.inverted import ROW_DOCS, Questions, Weights, build_index, document_frequencies, search_index, weighted_index

# Terms, or query entries, that are sent to the tasks at a time: about 30 MB.
BLOCK_TERMS = 500_000
# Terms of a vocabulary that every task may be told, so that others do not enter the index: about 30 MB.
SHARED_TERMS = 2_000_000


def occurrences(texts: DataFrame, key: str) -> DataFrame:
    """``(key, term)``, one row per occurrence of a term in a text."""
    return texts.select(key, F.explode(terms(F.col("text"))).alias("term"))


def query_vocabulary(queries: DataFrame) -> DataFrame:
    """Every term of any query, once."""
    return queries.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()


def idf_fit(vocabulary: DataFrame, corpus: DataFrame, small: bool = False) -> DataFrame:
    """Smooth idf of every vocabulary term over all articles; an unseen term has df 0.

    Corpus terms meet the vocabulary before anything is shuffled, and document
    frequencies are counted inside each task first, so the shuffle carries at
    most one row per vocabulary term and task.
    """
    n = corpus.agg(F.count("*")).scalar()
    df = (
        corpus.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
        .join(broadcast_when(vocabulary, small), "term", "left_semi")
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )
    seen = F.coalesce(F.col("df"), F.lit(0))
    idf = F.log((n + 1).cast("double") / (seen + 1).cast("double")) + 1.0
    return vocabulary.join(df, "term", "left").select("term", idf.alias("idf"))


def tfidf_vectors(occurrences: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """``(key, term, w)`` unit vectors from one ``(key, term)`` row per occurrence.

    Occurrences are counted before they meet the vocabulary, so the join moves
    one row per text and term.
    """
    counted = occurrences.groupBy(key, "term").agg(F.count("*").alias("tf"))
    weighted = counted.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("w") / length).alias("w"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` rows per query: score rounded to 9 places, ties to the smaller id.

    Rounding first keeps exact copies in id order whatever the summation order.
    Each task keeps only its own best ``k`` per query before the shuffle.
    """
    rounded = scored.withColumn("score", F.round("score", 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return (
        rounded.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        # The nearest millionth in doubles, as the SQL's engine rounds; by decimals 0.2549295 would be 0.254930.
        .select("query_id", "rank", "doc_id", (F.round(F.col("score") * 1e6) / 1e6).alias("score"))
    )


def _strings(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([c.cast(pa.string()) for c in column.chunks] or [pa.array([], pa.string())])


def _idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((n + 1.0) / (df + 1.0)) + 1.0


def _stored_index(corpus: DataFrame, vocabulary: pa.Array | None) -> DataFrame:
    """The index, built from as many documents at a time as one row of it holds."""
    with arrow_rows(corpus.sparkSession, ROW_DOCS), small_row_groups(corpus.sparkSession):
        return stored(build_index(corpus, vocabulary), "index")


def _one_block(counted: pa.Table, corpus: DataFrame, k: int, index: DataFrame | None) -> DataFrame:
    """Hits of queries whose ``(query_id, term, tf)`` rows are one block: their side is made ready on the driver."""
    spark = corpus.sparkSession
    term = _strings(counted.column("term")).dictionary_encode()
    names, code = term.dictionary, term.indices.to_numpy()
    index = _stored_index(corpus, names) if index is None else index
    wanted = F.broadcast(spark.createDataFrame(pa.table({"term": names})))
    found = document_frequencies(index).join(wanted, "term", "left_semi").toArrow()
    df = np.zeros(len(names))
    df[pc.index_in(_strings(found.column("term")), value_set=names).to_numpy()] = found.column("df").to_numpy()
    idf = _idf(df, corpus.agg(F.count("doc_id")).first()[0])
    query, w = counted.column("query_id").to_numpy(), counted.column("tf").to_numpy() * idf[code]
    ids, place = np.unique(query, return_inverse=True)
    squares = np.bincount(place, weights=w * w, minlength=len(ids))[place]
    return search_index(index, Weights(names, idf), Questions(query, code, w, squares, len(names)), k)


def tfidf_hits(queries: DataFrame, corpus: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS, index: DataFrame | None = None) -> DataFrame:
    """The best hits ``(query_id, doc_id, score)`` of every query; see ``tfidf_topk``.

    A row without ``doc_id`` holds the number of scores that a task took.
    """
    counted = stored(occurrences(queries, "query_id").groupBy("query_id", "term").agg(F.count("*").alias("tf")), "query-terms")
    if counted.count() <= block_terms:
        return _one_block(counted.toArrow(), corpus, k, index)
    vocabulary = stored(counted.select("term").distinct(), "query-vocabulary")
    if index is None:
        # Only query terms are kept, unless there are too many to tell every task.
        index = _stored_index(corpus, _strings(vocabulary.toArrow().column("term")) if is_small(vocabulary, SHARED_TERMS) else None)
    n = corpus.agg(F.count("doc_id")).scalar()
    df = F.coalesce(F.col("df"), F.lit(0))
    weight = F.log((n + 1).cast("double") / (df + 1).cast("double")) + 1.0
    known = vocabulary.join(document_frequencies(index), "term", "left").select("term", "df", weight.alias("idf"))
    idf = stored(known.withColumn("number", F.monotonically_increasing_id()), "query-idf")
    found_terms = idf.filter(F.col("df").isNotNull()).select("term", "number", "idf")
    index = weighted_index(index, found_terms)

    w = F.col("tf") * F.col("idf")
    vectors = counted.join(idf, "term").select("query_id", "number", F.col("df").isNotNull().alias("found"), w.alias("w"))
    vectors = stored(vectors, "query-vectors")
    length = vectors.groupBy("query_id").agg(F.sum(F.col("w") * F.col("w")).alias("squares"), F.count_if("found").alias("n"))
    length = stored(length.filter("n > 0"), "query-lengths")
    blocks = max(1, -(-(length.agg(F.sum("n")).first()[0] or 0) // block_terms))
    # A job carries as many blocks as may be sent to the tasks at a time.
    jobs = -(-blocks // max(1, BLOCK_TERMS // block_terms))
    length = length.withColumn("job", F.pmod(F.xxhash64("query_id"), F.lit(jobs)).cast("int")).drop("n")
    vectors = stored(vectors.filter("found").drop("found").join(length, "query_id"), "query-blocks")
    found = None
    for j in range(jobs):
        rows = vectors.filter(F.col("job") == j).toArrow()
        query, number, weight, squares = (rows.column(c).to_numpy() for c in ("query_id", "number", "w", "squares"))
        if len(query):
            known, code = np.unique(number, return_inverse=True)
            hits = search_index(index, known, Questions(query, code, weight, squares, len(known)), k)
            found = hits if found is None else found.union(hits)
    return corpus.sparkSession.createDataFrame([], HIT_SCHEMA) if found is None else found


def tfidf_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS, index: DataFrame | None = None) -> DataFrame:
    """For each ``(query_id, text)`` the ``k`` most similar ``(doc_id, text)`` articles.

    The corpus is turned into an inverted index where it is read, or ``index``
    from ``build_index`` is used; no text is shuffled.  Queries go to the tasks in
    blocks of about ``block_terms`` entries, however many there are, as many
    blocks at a time as make ``BLOCK_TERMS`` entries; where there are several,
    terms get their weights by a join.  A task hands on its best ``k`` per query.  Fewer than ``k``
    matches give fewer than ``k`` rows.  Every ``query_id`` is one query; rows
    without one find nothing.  Rows without ``doc_id`` are no articles, rows
    that repeat one are articles of their own.
    """
    asked = queries.filter(F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "text")
    return top_k(tfidf_hits(asked, corpus, k, block_terms, index).filter(F.col("doc_id").isNotNull()), k)
