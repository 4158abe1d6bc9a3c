"""The operators on the shared tables, with production parameters."""

from __future__ import annotations

import importlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    from askframe.llm.byte_bpe import encode_tables

    return encode_tables(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_ctph(spark: SparkSession, sf: str) -> DataFrame:
    from askframe.llm.ctph import fingerprint_neighbours

    return fingerprint_neighbours(table(spark, sf, "documents"))


def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    from askframe.llm.warc import archive

    return archive(spark, table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    from askframe.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    from askframe.llm.packing import pack

    return pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_lattice(spark: SparkSession, sf: str) -> DataFrame:
    from askframe.llm.lattice import scores

    return scores(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from askframe.llm.toxicity import scores

    return scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op6_covertree(spark: SparkSession, sf: str) -> DataFrame:
    from askframe.llm.covertree import near_duplicates

    return near_duplicates(table(spark, sf, "embeddings"))


def op7_pii(spark: SparkSession, sf: str) -> DataFrame:
    from askframe.llm.pii import report

    return report(table(spark, sf, "documents"))


def op9_licenses(spark: SparkSession, sf: str) -> DataFrame:
    from askframe.llm.licenses import scan

    return scan(table(spark, sf, "documents"))


def op11_spelling(spark: SparkSession, sf: str) -> DataFrame:
    from askframe.llm.spelling import variants

    return variants(table(spark, sf, "documents"))


def op12_ranked(spark: SparkSession, sf: str) -> DataFrame:
    from askframe.llm.ranked import top_documents

    return top_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op13_token_files(spark: SparkSession, sf: str) -> DataFrame:
    from askframe.llm.token_files import encode_and_read

    return encode_and_read(spark, table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op")}
    pipeline = importlib.import_module("corpus_pipeline")
    return {**found, "pipeline": pipeline.run}


def oracles() -> dict[str, str]:
    return dict(ORACLES)


ORACLES: dict[str, str] = {
    "op1_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as b from pages),
        d as (select page_id, octet_length(b) as n, sha1(b) as h from p),
        m as (select *, max(page_id) over (partition by h) as top from d)
        select page_id, cast(n as bigint) as payload_bytes, h as payload_digest,
          case when n >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
          case when n >= 1000 and page_id <> top then top end as refers_to
        from m""",
    "op6_covertree": """
        with recursive u as (select vec_id, embedding::double[] as e from embeddings),
        l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
        r(a, b) as (select vec_id, vec_id from u union select r.a, l.b from r join l on r.b = l.a),
        c as (select a, min(b) as component_id from r group by a),
        n as (select a, count(*) as n from l group by a)
        select u.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, u.vec_id = c.component_id as kept
        from u join c on c.a = u.vec_id left join n on n.a = u.vec_id""",
    "op12_ranked": r"""
        with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
        q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
        l as (select doc_id, count(*)::bigint as n from t group by doc_id),
        a as (select count(*)::bigint as nn, sum(n)::bigint as ll from l),
        c as (select doc_id, term, count(*)::bigint as tf from t where term in (select term from q) group by doc_id, term),
        w as (select term, floor(1000 * ln((2 * any_value(nn) + 2)::double / (2 * count(*) + 1)))::bigint as w from c, a group by term),
        s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::bigint as score
          from q join c using (term) join w using (term) join l using (doc_id) cross join a group by item_id, doc_id),
        r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
        select item_id, rank::int as rank, doc_id, score from r where rank <= 10""",
}
