"""Topic clusters: k-means, nearest centroid, seed votes and title filters."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe.cluster import broadcast_when, is_small
from askframe.functions.vectors import squared_distance
from askframe.operators.questions import head_per_group


def kmeans(df: DataFrame, k: int = 20, seed: int = 0, max_iter: int = 20, emb: str = "emb") -> DataFrame:
    """Fit and predict: adds ``cluster_id``."""
    vectors = df.withColumn("_features", array_to_vector(F.transform(emb, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol="cluster_id").fit(vectors)
    return model.transform(vectors).drop("_features")


def nearest_centroid(df: DataFrame, centroids: DataFrame, emb: str = "emb") -> DataFrame:
    """Assign each vector its closest centroid; ties to the smaller cluster.

    The centroids, one per cluster, travel as one array; rows are not multiplied.
    """
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster_id", "centroid")))).scalar()
    distances = F.transform(
        "_centroids",
        lambda c: F.struct(F.round(squared_distance(F.col(emb), c["centroid"]), 9).alias("d"), c["cluster_id"].alias("c")),
    )
    return df.withColumn("_centroids", packed).withColumn("cluster_id", F.array_min(distances)["c"]).drop("_centroids")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts by value, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def keep_titles(df: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows whose title is listed."""
    return df.join(broadcast_when(titles.select("title"), is_small(titles)), "title", "left_semi")


def drop_titles(df: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows whose title is not listed; null titles in the list match nothing."""
    return df.join(broadcast_when(titles.select("title"), is_small(titles)), "title", "left_anti")


def seed_cluster_vote(clustered: DataFrame, seeds: DataFrame) -> DataFrame:
    """The cluster holding most seed titles; ties to the smaller cluster."""
    counts = keep_titles(clustered, seeds).groupBy("cluster_id").agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("cluster_id", F.struct("n", (-F.col("cluster_id")).alias("c"))).alias("cluster_id"))


def filter_clusters(df: DataFrame, ids: list[int]) -> DataFrame:
    return df.filter(F.col("cluster_id").isin(*ids))


def clusters_by_seed_count(clustered: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """The ``n`` clusters with most seed titles."""
    return value_counts(keep_titles(clustered, seeds), "cluster_id").limit(n).select("cluster_id")


def nested_kmeans(df: DataFrame, cluster_id: int, k: int = 6, seed: int = 0) -> DataFrame:
    """Cluster again, inside one chosen cluster only."""
    return kmeans(filter_clusters(df, [cluster_id]).drop("cluster_id"), k, seed)


def cluster_examples(df: DataFrame, n: int = 3, order: str = "id") -> DataFrame:
    """The first ``n`` rows of each cluster."""
    return head_per_group(df, ["cluster_id"], [F.col(order)], n)


def project_2d(df: DataFrame, emb: str = "emb") -> DataFrame:
    """Two-dimensional view ``x, y`` by principal components."""
    vectors = df.withColumn("_features", array_to_vector(F.transform(emb, lambda x: x.cast("double"))))
    model = PCA(k=2, inputCol="_features", outputCol="_xy").fit(vectors)
    xy = vector_to_array("_xy")
    return model.transform(vectors).select(
        *df.columns, F.element_at(xy, 1).alias("x"), F.element_at(xy, 2).alias("y")
    )
