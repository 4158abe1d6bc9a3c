"""Find context for questions, sparse or dense."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe.cluster import stored
from askframe.functions.text import (
    bullets_from_columns,
    corpus_text_v0,
    corpus_text_v1,
    instruction_prefix,
    normalize_context,
    query_text_all,
    query_text_weighted,
)
from askframe.operators.dense import (
    candidate_sentences,
    embed,
    fetch_paragraphs,
    hits_to_index,
    letter_frequency_encoder,
    sentence_topk_per_question,
    vector_topk,
)
from askframe.operators.questions import pivot_contexts
from askframe.operators.sentences import process_documents
from askframe.operators.sparse import tfidf_topk


def sparse_context(questions: DataFrame, paragraphs: DataFrame, k: int = 3, sectioned: bool = True) -> DataFrame:
    """Questions with ``context_top1..k`` and bulleted ``context`` by TF-IDF.

    ``paragraphs`` is ``(article_id, title[, section], text)``.
    """
    queries = stored(questions.select(F.col("id").alias("query_id"), query_text_weighted().alias("text")), "queries")
    title, text = F.col("title"), F.col("text")
    if sectioned:
        search = corpus_text_v1(title, F.col("section"), text)
    else:
        search = corpus_text_v0(title, text)
    hits = stored(tfidf_topk(queries, paragraphs.select(F.col("article_id").alias("doc_id"), search.alias("text")), k), "hits")
    return _attach(questions, hits, paragraphs.select(F.col("article_id").alias("doc_id"), "text"), k, (lambda t: t) if sectioned else normalize_context)


def dense_context(
    questions: DataFrame, articles: DataFrame, k: int = 3, make_encoder=letter_frequency_encoder
) -> DataFrame:
    """The same by embeddings; ``articles`` is ``(doc_id, text, embedding)``."""
    q = questions.select(
        F.col("id").alias("query_id"), embed(instruction_prefix(query_text_all()), make_encoder).alias("embedding")
    )
    hits = stored(vector_topk(q, articles, k), "hits")
    return _attach(questions, hits, articles.select("doc_id", "text"), k)


def _attach(questions: DataFrame, hits: DataFrame, texts: DataFrame, k: int, shown=lambda text: text) -> DataFrame:
    """``shown`` makes the text to show of a hit's; texts that no question finds are not put through it."""
    ranked = fetch_paragraphs(hits, texts).withColumn("text", shown(F.col("text"))).withColumnRenamed("query_id", "id")
    return questions.join(pivot_contexts(ranked, k), "id", "left").withColumn("context", bullets_from_columns(k))


def two_stage_context(
    questions: DataFrame,
    article_vectors: DataFrame,
    index: DataFrame,
    fulltext,
    n_top: int = 5,
    n_sentences: int = 20,
    make_encoder=letter_frequency_encoder,
) -> DataFrame:
    """Closest articles by prompt, then their closest sentences by prompt and options.

    ``fulltext`` maps the hit list ``(id, prompt_id, file)`` to ``(id, text)`` of
    those articles only, so just their shards are read.
    """
    prompts = questions.select(F.col("id").alias("query_id"), embed(F.col("prompt"), make_encoder).alias("embedding"))
    hits = stored(vector_topk(prompts, article_vectors, n_top), "hits")
    texts = fulltext(hits_to_index(hits, index)).withColumnRenamed("id", "document_id")
    sentences = process_documents(texts).withColumn("embedding", embed(F.col("text"), make_encoder))
    q = questions.select(F.col("id").alias("query_id"), embed(query_text_all(), make_encoder).alias("embedding"))
    return sentence_topk_per_question(q, candidate_sentences(hits, sentences), n_sentences)
