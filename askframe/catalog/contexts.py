"""Text and retrieval operators on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from askframe.catalog import base
from askframe.catalog.base import TOKEN_SQL, query, table, words_sql
from askframe.cluster import parallel_scan, scratch_path, stored
from askframe.fixed_values import SEARCH_INSTRUCTION, STOP_WORDS
from askframe.functions import text as tx
from askframe.operators import dense, sentences, sparse
from askframe.operators.questions import keep_ids
from askframe.plans import contexts as flows
from askframe.sources import corpus

# ---- SQL pieces ------------------------------------------------------------

STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"


def kept_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '{TOKEN_SQL}'), lambda t: not list_contains({STOP_SQL}, t))"


def terms_sql(tokens: str) -> str:
    return (
        f"list_concat({tokens}, list_transform(range(1, len({tokens})), "
        f"lambda i: {tokens}[i] || ' ' || {tokens}[i + 1]))"
    )


def tfidf_sql(k: int, fit: str = "true") -> str:
    """Expressions ``hits(query_id, rank, doc_id, score)`` from ``q_text`` and ``d_text``."""
    return f"""
      q_tok as (select query_id, {kept_sql('text')} as t from q_text),
      d_tok as (select doc_id, {kept_sql('text')} as t from d_text),
      q_tf as (select query_id, term, count(*) as tf from (select query_id, unnest({terms_sql('t')}) as term from q_tok) group by all),
      vocab as (select distinct term from q_tf),
      d_tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest({terms_sql('t')}) as term from d_tok)
               where term in (select term from vocab) group by all),
      fit_docs as (select doc_id from d_text where {fit}),
      idf as (select v.term, ln((1 + (select count(*) from fit_docs))::double / (1 + count(d.doc_id))::double) + 1.0::double as idf
              from vocab v left join (select * from d_tf where doc_id in (select doc_id from fit_docs)) d on d.term = v.term group by v.term),
      d_w as (select doc_id, term, tf * idf as w from d_tf join idf using (term)),
      q_w as (select query_id, term, tf * idf as w from q_tf join idf using (term)),
      d_n as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as w from d_w),
      q_n as (select query_id, term, w / sqrt(sum(w * w) over (partition by query_id)) as w from q_w),
      scored as (select q.query_id, d.doc_id, round(sum(d.w * q.w), 9) as score from q_n q join d_n d using (term) group by all),
      hits as (select query_id, row_number() over (partition by query_id order by score desc, doc_id)::int as rank, doc_id, score from scored
               qualify row_number() over (partition by query_id order by score desc, doc_id) <= {k})"""


BENCH_DOCS_SQL = "q_text as (select item_id as query_id, text from benchmark), d_text as (select doc_id, text from documents), "


def bench_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def doc_texts(spark, sf):
    return parallel_scan(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


# ---- text ------------------------------------------------------------------


@query(f"select doc_id, array_to_string(regexp_extract_all(lower(text), '{TOKEN_SQL}'), ' ') as tokens from documents")
def tokenize(spark, sf):
    return doc_texts(spark, sf).select("doc_id", F.array_join(tx.tokenize(F.col("text")), " ").alias("tokens"))


@query(f"select doc_id, array_to_string({kept_sql('text')}, ' ') as tokens from documents")
def remove_stop_words(spark, sf):
    kept = tx.remove_stop_words(tx.tokenize(F.col("text")))
    return doc_texts(spark, sf).select("doc_id", F.array_join(kept, " ").alias("tokens"))


@query(f"kept as (select item_id, {kept_sql('text')} as t from benchmark) select item_id, array_to_string({terms_sql('t')}, '|') as terms from kept")
def ngrams(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(tx.terms(F.col("text")), "|").alias("terms"))


@query(f"kept as (select {kept_sql('text')} as t from benchmark) select distinct unnest({terms_sql('t')}) as term from kept")
def query_vocabulary(spark, sf):
    return sparse.query_vocabulary(bench_queries(spark, sf))


@query(BENCH_DOCS_SQL + tfidf_sql(1) + " select term, round(idf, 9) as idf from idf")
def idf_fit(spark, sf):
    vocabulary = sparse.query_vocabulary(bench_queries(spark, sf))
    return sparse.idf_fit(vocabulary, doc_texts(spark, sf), small=True).select("term", F.round("idf", 9).alias("idf"))


@query(BENCH_DOCS_SQL + tfidf_sql(1) + " select query_id, term, round(w, 9) as w from q_n")
def tfidf_vector(spark, sf):
    queries = bench_queries(spark, sf)
    idf = sparse.idf_fit(sparse.query_vocabulary(queries), doc_texts(spark, sf), small=True)
    vectors = sparse.tfidf_vectors(sparse.occurrences(queries, "query_id"), idf, "query_id")
    return vectors.select("query_id", "term", F.round("w", 9).alias("w"))


@query(f"select doc_id, cast({words_sql('text')} as int) as n_words from documents")
def word_count(spark, sf):
    return doc_texts(spark, sf).select("doc_id", tx.word_count(F.col("text")).alias("n_words"))


@query("select id, concat_ws(chr(10), prompt, prompt, prompt, A, B, C, D, E) as text from questions", "questions")
def query_text_weighted(spark, sf):
    return base.questions(spark, sf).select("id", tx.query_text_weighted().alias("text"))


@query(f"select id, '{SEARCH_INSTRUCTION}' || concat_ws(' ', prompt, A, B, C, D, E) as text from questions", "questions")
def query_text_all(spark, sf):
    return base.questions(spark, sf).select("id", tx.instruction_prefix(tx.query_text_all()).alias("text"))


@query(
    "select q.id, q.prompt || ' ' || o.answer_text as text from questions q join options o on o.id = q.id and o.letter = q.answer",
    "questions options",
)
def query_text_answer(spark, sf):
    return base.questions(spark, sf).select("id", tx.query_text_answer().alias("text"))


@query()
def corpus_text_v0(spark, sf):
    return base.paragraphs(spark, sf).select("article_id", tx.corpus_text_v0(F.col("title"), F.col("text")).alias("text"))


@query()
def normalize_context(spark, sf):
    return base.paragraphs(spark, sf).select("article_id", tx.normalize_context(F.col("text")).alias("text"))


@query(
    "select article_id, replace(replace(title || ' ' || section || ' ' || text, chr(10), ' '), '''', '') as text from paragraphs",
    "paragraphs",
)
def corpus_text_v1(spark, sf):
    text = tx.corpus_text_v1(F.col("title"), F.col("section"), F.col("text"))
    return base.paragraphs(spark, sf).select("article_id", text.alias("text"))


@query(
    "select id, string_agg('- ' || text, chr(10) order by rank) as context from contexts group by id", "contexts"
)
def context_bullets(spark, sf):
    ranked = F.array_sort(F.collect_list(F.struct("rank", "text")))
    grouped = base.contexts(spark, sf).groupBy("id").agg(F.transform(ranked, lambda r: r["text"]).alias("texts"))
    return grouped.select("id", tx.context_bullets(F.col("texts")).alias("context"))


# ---- sparse retrieval ------------------------------------------------------


@query(BENCH_DOCS_SQL + tfidf_sql(10) + " select query_id, rank, doc_id, round(score, 6) as score from hits")
def tfidf_topk(spark, sf):
    """For each benchmark text the ten closest documents."""
    return sparse.tfidf_topk(bench_queries(spark, sf), doc_texts(spark, sf), 10)


@query(
    "q_text as (select conv_id * 1000 + turn as query_id, text from conversations), d_text as (select doc_id, text from documents), "
    + tfidf_sql(5)
    + " select query_id, rank, doc_id, round(score, 6) as score from hits"
)
def tfidf_topk_of_many(spark, sf):
    """Every turn of every conversation is a query: terms and queries travel in several blocks over one stored index."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return sparse.tfidf_topk(turns, doc_texts(spark, sf), 5, block_terms=20_000)


SPARSE_SQL = (
    """q_text as (select id as query_id, concat_ws(chr(10), prompt, prompt, prompt, A, B, C, D, E) as text from questions),
       d_text as (select article_id as doc_id, replace(replace(title || ' ' || section || ' ' || text, chr(10), ' '), '''', '') as text
                  from paragraphs), """
    + tfidf_sql(3)
)


@query(
    SPARSE_SQL
    + """ select q.id, max(case when rank = 1 then p.text end) as context_top1, max(case when rank = 2 then p.text end) as context_top2,
            max(case when rank = 3 then p.text end) as context_top3, string_agg('- ' || p.text, chr(10) order by rank) as context
          from questions q left join hits h on h.query_id = q.id left join paragraphs p on p.article_id = h.doc_id group by q.id""",
    "questions paragraphs",
)
def sparse_context(spark, sf):
    found = flows.sparse_context(base.questions(spark, sf), base.paragraphs(spark, sf), 3)
    return found.select("id", "context_top1", "context_top2", "context_top3", "context")


@query()
def sparse_context_unsectioned(spark, sf):
    found = flows.sparse_context(base.questions(spark, sf), base.paragraphs(spark, sf), 3, sectioned=False)
    return found.select("id", "context_top1", "context_top2", "context_top3", "context")


@query(
    SPARSE_SQL + " select query_id, rank, doc_id, p.text from hits join paragraphs p on p.article_id = doc_id", "questions paragraphs"
)
def fetch_paragraphs(spark, sf):
    p = base.paragraphs(spark, sf).withColumnRenamed("article_id", "doc_id")
    queries = base.questions(spark, sf).select(F.col("id").alias("query_id"), tx.query_text_weighted().alias("text"))
    search = p.select("doc_id", tx.corpus_text_v1(F.col("title"), F.col("section"), F.col("text")).alias("text"))
    return dense.fetch_paragraphs(stored(sparse.tfidf_topk(queries, search, 3), "hits"), p)


# ---- sentences -------------------------------------------------------------

SENTENCES_SQL = r"""
    pieces as (select document_id, unnest(p) as piece, unnest(range(1, len(p) + 1)) as i
               from (select document_id, regexp_extract_all(text, '[^.!?\n]+[.!?]*|[.!?]+|\n') as p from full_texts)),
    placed as (select document_id, i, piece, coalesce(sum(length(piece)) over (partition by document_id order by i
                 rows between unbounded preceding and 1 preceding), 0) as pos from pieces),
    sentences as (select document_id, trim(piece, ' ') as text, cast(pos + length(piece) - length(ltrim(piece, ' ')) as int) as start,
                    cast(pos + length(piece) - length(ltrim(piece, ' ')) + length(trim(piece, ' ')) as int) as "end"
                  from placed where length(trim(piece, ' ')) > 3)"""

ALL_TEXTS_SQL = "full_texts as (select doc_id as document_id, text from documents), "


def documents(spark, sf):
    return doc_texts(spark, sf).withColumnRenamed("doc_id", "document_id")


@query('select doc_id as document_id, text, cast(0 as int) as start, cast(length(text) as int) as "end" from documents')
def sectionize(spark, sf):
    return sentences.sectionize(documents(spark, sf))


@query(ALL_TEXTS_SQL + SENTENCES_SQL + ' select document_id, text, start, "end" from sentences')
def sentencize(spark, sf):
    return sentences.process_documents(documents(spark, sf))


# ---- dense retrieval, with the letter-frequency encoder --------------------


def counts_sql(text: str) -> str:
    return f"list_transform(range(26), lambda i: (2 * length({text}) - length(replace({text}, chr((97 + i)::int), '')) - length(replace({text}, chr((65 + i)::int), '')))::double)"


def vectors_sql(name: str, source: str, key: str, text: str, extra: str = "") -> str:
    """Expression ``name(key, extra, v)`` with the encoder's vector as doubles of single-precision values."""
    return f"""{name} as (select {key}, {extra} list_transform(c, lambda x: ((x / case when n > 0 then n else 1.0::double end)::float)::double) as v
        from (select *, sqrt(list_sum(list_transform(c, lambda x: x * x))) as n from (select *, {counts_sql(text)} as c from {source})))"""


def nearest_sql(k: int) -> str:
    return f"""
      near as (select q.query_id, d.doc_id, round(list_inner_product(q.v, d.v), 9) as score from q_vec q cross join d_vec d),
      hits as (select query_id, row_number() over (partition by query_id order by score desc, doc_id)::int as rank, doc_id, score from near
               qualify row_number() over (partition by query_id order by score desc, doc_id) <= {k})"""


def doc_vectors(spark, sf):
    return doc_texts(spark, sf).select("doc_id", dense.embed(F.col("text")).alias("embedding"))


def bench_vectors(spark, sf):
    return bench_queries(spark, sf).select("query_id", dense.embed(F.col("text")).alias("embedding"))


BENCH_VECTORS_SQL = (
    vectors_sql("q_vec", "(select item_id as query_id, text from benchmark)", "query_id", "text")
    + ", "
    + vectors_sql("d_vec", "documents", "doc_id", "text")
    + ", "
)


@query(
    vectors_sql("d_vec", "documents", "doc_id", "text")
    + " select doc_id, array_to_string(list_transform(v, lambda x: floor(x * 1e6::double + 0.5::double)::bigint), ',') as embedding from d_vec"
)
def embed(spark, sf):
    """Vectors as whole millionths."""
    return doc_vectors(spark, sf).select("doc_id", F.array_join(base.millionths("embedding"), ",").alias("embedding"))


@query(BENCH_VECTORS_SQL + nearest_sql(5) + " select query_id, rank, doc_id, round(score, 6) as score from hits")
def vector_topk(spark, sf):
    return dense.vector_topk(bench_vectors(spark, sf), doc_vectors(spark, sf), 5)


@query(BENCH_VECTORS_SQL + nearest_sql(5) + " select query_id, rank, doc_id, round(score, 6) as score from hits")
def vector_topk_in_blocks(spark, sf):
    """The same search with queries in several blocks."""
    return dense.vector_topk(bench_vectors(spark, sf), doc_vectors(spark, sf), 5, query_block=15)


@query(BENCH_VECTORS_SQL + nearest_sql(5) + " select query_id, rank, doc_id, round(score, 6) as score from hits")
def vector_topk_in_cells(spark, sf):
    """The same search over a stored cell index."""
    return dense.vector_topk(bench_vectors(spark, sf), doc_vectors(spark, sf), 5, n_cells=64)


@query(
    "own as (select vec_id as query_id, embedding::double[] as v from embeddings), q_vec as (select * from own), "
    "d_vec as (select query_id as doc_id, v from own), "
    + nearest_sql(3)
    + " select query_id, rank, doc_id, round(score, 6) as score from hits"
)
def vector_topk_stored(spark, sf):
    """Stored 64-dimensional vectors against themselves."""
    e = table(spark, sf, "embeddings")
    return dense.vector_topk(e.select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("doc_id"), "embedding"), 3)


@query(
    BENCH_VECTORS_SQL + nearest_sql(5) + " select distinct h.doc_id as id, query_id as prompt_id, lang as file from hits h join documents d on d.doc_id = h.doc_id"
)
def hits_to_index(spark, sf):
    index = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("file"))
    return dense.hits_to_index(dense.vector_topk(bench_vectors(spark, sf), doc_vectors(spark, sf), 5), index)


@query("select doc_id, source from documents where doc_id in (select doc_id from labels where toxic = 1)")
def id_semi_join(spark, sf):
    return keep_ids(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels").filter("toxic = 1"), "doc_id")


CANDIDATES_SQL = "full_texts as (select doc_id as document_id, text from documents where doc_id in (select doc_id from hits)), " + SENTENCES_SQL


@query(
    BENCH_VECTORS_SQL + nearest_sql(5) + ", " + CANDIDATES_SQL
    + """ select s.document_id, h.query_id, s.text, s.start, s."end" from hits h join sentences s on s.document_id = h.doc_id"""
)
def candidate_sentences(spark, sf):
    hits = stored(dense.vector_topk(bench_vectors(spark, sf), doc_vectors(spark, sf), 5), "hits")
    found = keep_ids(documents(spark, sf), hits.withColumnRenamed("doc_id", "document_id"), "document_id")
    return dense.candidate_sentences(hits, sentences.process_documents(found))


DENSE_Q_SQL = vectors_sql(
    "q_vec", f"(select id as query_id, '{SEARCH_INSTRUCTION}' || concat_ws(' ', prompt, A, B, C, D, E) as text from questions)", "query_id", "text"
)


@query(
    DENSE_Q_SQL + ", " + vectors_sql("d_vec", "documents", "doc_id", "text") + ", " + nearest_sql(3)
    + """ select q.id, max(case when rank = 1 then d.text end) as context_top1, max(case when rank = 2 then d.text end) as context_top2,
            max(case when rank = 3 then d.text end) as context_top3, string_agg('- ' || d.text, chr(10) order by rank) as context
          from questions q left join hits h on h.query_id = q.id left join documents d on d.doc_id = h.doc_id group by q.id""",
    "questions",
)
def dense_context(spark, sf):
    articles = doc_texts(spark, sf).withColumn("embedding", dense.embed(F.col("text")))
    found = flows.dense_context(base.questions(spark, sf), articles, 3)
    return found.select("id", "context_top1", "context_top2", "context_top3", "context")


@query(
    vectors_sql("q_vec", "(select id as query_id, prompt as text from questions)", "query_id", "text")
    + ", " + vectors_sql("d_vec", "documents", "doc_id", "text") + ", " + nearest_sql(5) + ", " + CANDIDATES_SQL + ", "
    + vectors_sql("o_vec", "(select id as query_id, concat_ws(' ', prompt, A, B, C, D, E) as text from questions)", "query_id", "text")
    + ", " + vectors_sql("s_vec", "sentences", "document_id", "text", "text, start, ")
    + """, ranked as (select h.query_id, s.text, row_number() over (partition by h.query_id
             order by round(list_inner_product(o.v, s.v), 9) desc, s.document_id, s.start) as rank
           from hits h join s_vec s on s.document_id = h.doc_id join o_vec o on o.query_id = h.query_id)
         select query_id, string_agg(text, ' ' order by rank) as context, count(*) as n_sentences from ranked where rank <= 20 group by query_id""",
    "questions",
)
def two_stage_context(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("file"))
    path = scratch_path(spark, "shards")
    corpus.write_fulltext(docs, path)
    return flows.two_stage_context(
        base.questions(spark, sf),
        doc_vectors(spark, sf),
        docs.select("id", "file"),
        lambda hits: corpus.scan_fulltext(spark, path, hits),
    )
