"""Vectors, clusters and topic selection on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from askframe.catalog import base
from askframe.catalog.base import query, table
from askframe.catalog.contexts import nearest_sql
from askframe.cluster import scratch_path
from askframe.functions.vectors import l2_normalize as unit
from askframe.operators import clusters, layout
from askframe.plans.topics import select_topic_corpus

TOP_LABEL_SQL = "(select cluster_id from vector_docs where title in (select title from seed_titles) group by 1 order by count(*) desc, cluster_id limit 1)"


@query(
    """own as (select vec_id, list_transform(embedding, lambda x: x::double * 3) as v from embeddings),
       n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from own)
       select vec_id, array_to_string(list_transform(v, lambda x: floor((x / n)::float::double * 1e6::double + 0.5::double)::bigint), ',') as unit_vector from n"""
)
def l2_normalize(spark, sf):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    units = table(spark, sf, "embeddings").select("vec_id", unit(tripled).alias("unit"))
    return units.select("vec_id", F.array_join(base.millionths("unit"), ",").alias("unit_vector"))


@query(
    """c as (select vec_id as cluster_id, embedding as centroid from embeddings where vec_id in (select min(vec_id) from embeddings group by label)),
       d as (select e.vec_id as article_id, c.cluster_id,
               round(list_sum(list_transform(range(1, len(centroid) + 1), lambda i: (embedding[i]::double - centroid[i]::double) ** 2)), 9) as d
             from embeddings e cross join c)
       select article_id, cast(cluster_id as int) as cluster_id from d qualify row_number() over (partition by article_id order by d, cluster_id) = 1"""
)
def nearest_centroid(spark, sf):
    """The first vector of each label serves as its centroid."""
    e = table(spark, sf, "embeddings")
    centroids = e.groupBy("label").agg(F.min_by(F.struct(F.col("vec_id"), F.col("embedding")), "vec_id").alias("c"))
    centroids = centroids.select(F.col("c.vec_id").cast("int").alias("cluster_id"), F.col("c.embedding").alias("centroid"))
    docs = base.vector_docs(spark, sf).drop("cluster_id")
    return clusters.nearest_centroid(docs, centroids).select("article_id", "cluster_id")


@query()
def kmeans(spark, sf):
    return clusters.kmeans(base.vector_docs(spark, sf).drop("cluster_id"), 20, 0).select("article_id", "cluster_id")


@query()
def nested_kmeans(spark, sf):
    return clusters.nested_kmeans(base.vector_docs(spark, sf), 3, 6).select("article_id", "cluster_id")


@query()
def topic_corpus(spark, sf):
    docs = base.vector_docs(spark, sf).drop("cluster_id").withColumn("paragraph_id", F.lit(0))
    store = scratch_path(spark, "topics")
    found = select_topic_corpus(docs, base.seed_titles(spark, sf), base.known_titles(spark, sf), store, k=5, nested_k=3)
    return found.select("article_id", "title")


@query("select cluster_id, count(*) as n from vector_docs group by cluster_id", "vector_docs")
def value_counts(spark, sf):
    return clusters.value_counts(base.vector_docs(spark, sf), "cluster_id")


@query(f"select {TOP_LABEL_SQL} as cluster_id", "vector_docs seed_titles")
def seed_cluster_vote(spark, sf):
    return clusters.seed_cluster_vote(base.vector_docs(spark, sf), base.seed_titles(spark, sf))


@query("select article_id, title, cluster_id from vector_docs where cluster_id in (1, 5)", "vector_docs")
def filter_clusters(spark, sf):
    return clusters.filter_clusters(base.vector_docs(spark, sf), [5, 1]).select("article_id", "title", "cluster_id")


@query("select article_id, title from vector_docs where title in (select title from seed_titles)", "vector_docs seed_titles")
def title_semi_join(spark, sf):
    return clusters.keep_titles(base.vector_docs(spark, sf), base.seed_titles(spark, sf)).select("article_id", "title")


@query("select article_id, title from vector_docs where title not in (select title from known_titles)", "vector_docs known_titles")
def title_anti_join(spark, sf):
    return clusters.drop_titles(base.vector_docs(spark, sf), base.known_titles(spark, sf)).select("article_id", "title")


@query(
    "select article_id, cluster_id from vector_docs qualify row_number() over (partition by cluster_id order by article_id) <= 3", "vector_docs"
)
def cluster_examples(spark, sf):
    return clusters.cluster_examples(base.vector_docs(spark, sf), 3, "article_id").select("article_id", "cluster_id")


@query()
def project_2d(spark, sf):
    return clusters.project_2d(base.vector_docs(spark, sf)).select("article_id", "x", "y")


@query(
    "own as (select vec_id as query_id, embedding::double[] as v from embeddings), q_vec as (select * from own), "
    "d_vec as (select query_id as doc_id, v from own), "
    + nearest_sql(16)
    + """, e as (select query_id as a, doc_id as b, sqrt(greatest(2 - 2 * round(score, 6), 0)) as d from hits where query_id <> doc_id),
       m as (select *, min(d) over (partition by a) as low, avg(d) over (partition by a) as mean from e),
       c as (select a, b, case when mean - low > 0 then exp(-(d - low) / (mean - low)) else 1::double end as w from m)
       select a, b, round(1 - product(1 - w), 6) as w from (select a, b, w from c union all select b, a, w from c) group by a, b"""
)
def neighbour_graph(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("number"), F.col("embedding").alias("emb"))
    return layout.neighbour_graph(vectors).withColumn("w", F.round("w", 6))


@query()
def neighbour_layout(spark, sf):
    return layout.neighbour_layout(base.vector_docs(spark, sf), "article_id", steps=6)
