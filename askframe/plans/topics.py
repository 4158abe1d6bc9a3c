"""Select a topic corpus from embedded paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe.operators.clusters import clusters_by_seed_count, drop_titles, keep_titles, kmeans, seed_cluster_vote
from askframe.sources.corpus import scan_embeddings
from askframe.sources.sinks import materialize


def select_topic_corpus(
    paragraphs: DataFrame,
    seeds: DataFrame,
    known: DataFrame,
    store: str,
    k: int = 20,
    nested_k: int = 6,
    keep: int = 2,
) -> DataFrame:
    """Paragraphs of the seed-richest clusters, minus titles already known.

    First paragraphs are clustered, the cluster with most seeds is clustered
    again, and the ``keep`` sub-clusters with most seeds give the titles.  Both
    clusterings are stored below ``store``, so later steps and lost executors
    read them instead of training again.
    """
    spark = paragraphs.sparkSession
    first = materialize(
        spark,
        f"{store}/clusters",
        lambda: kmeans(scan_embeddings(paragraphs), k).select("title", "emb", "cluster_id"),
        [paragraphs],
        {"k": k},
    )
    # One row, then ``keep`` rows: broadcast whatever the corpus size.
    chosen = first.join(F.broadcast(seed_cluster_vote(first, seeds)), "cluster_id", "left_semi").drop("cluster_id")
    nested = materialize(spark, f"{store}/nested", lambda: kmeans(chosen, nested_k).select("title", "cluster_id"), [first, seeds], {"k": nested_k})
    titles = nested.join(F.broadcast(clusters_by_seed_count(nested, seeds, keep)), "cluster_id", "left_semi")
    return drop_titles(keep_titles(paragraphs, titles), known)
