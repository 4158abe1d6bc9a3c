"""A two-dimensional view in which neighbours stay neighbours: a graph of nearest vectors, laid out by steps.

Linked points pull each other, and a few others, drawn anew for each point and
step, push it away.  The draws follow from the seed, so the same vectors give
the same view on any partitioning but for rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askframe.cluster import stored, with_row_index
from askframe.operators.clusters import project_2d
from askframe.operators.dense import vector_topk

# Forces beyond this length are shortened; closer than NEAR two points push no harder.
LONGEST, NEAR, AGAINST = 4.0, 0.01, 5


def neighbour_graph(vectors: DataFrame, k: int = 15, n_cells: int = 0) -> DataFrame:
    """Both directions ``(a, b, w)`` of the links between every ``(number, emb)`` of unit length and its ``k`` nearest.

    A link weighs 1 to the nearest neighbour and falls off by the point's own
    scale, so sparse regions hold together like dense ones; two points that chose
    each other weigh as either choice would.
    """
    asked = vectors.select(F.col("number").alias("query_id"), F.col("emb").alias("embedding"))
    near = vector_topk(asked, vectors.select(F.col("number").alias("doc_id"), F.col("emb").alias("embedding")), k + 1, n_cells=n_cells)
    near = near.filter(F.col("query_id") != F.col("doc_id")).withColumn("d", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))))
    own = Window.partitionBy("query_id")
    apart = F.col("d") - F.min("d").over(own)
    scale = F.avg("d").over(own) - F.min("d").over(own)
    weight = F.when(scale > 0, F.exp(-apart / scale)).otherwise(1.0)
    chosen = near.select(F.col("query_id").alias("a"), F.col("doc_id").alias("b"), weight.alias("w"))
    # Both directions of a row at once: the neighbours are found only once.
    both = chosen.select(F.inline(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w")))).groupBy("a", "b")
    return both.agg((1 - F.product(1 - F.col("w"))).alias("w"))


def _force(dx: Column, dy: Column, factor: Column) -> list[Column]:
    length = F.sqrt(dx * dx + dy * dy) * F.abs(factor)
    short = F.when(length > LONGEST, LONGEST / length).otherwise(1.0) * factor
    return [(short * dx).alias("x"), (short * dy).alias("y")]


def _step(places: DataFrame, graph: DataFrame, n: Column, step: int, rate: float, seed: int) -> DataFrame:
    """Places after one step: every point moves by the sum of its forces."""
    here = places.select(F.col("number").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    there = places.select(F.col("number").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    squared = dx * dx + dy * dy
    pulled = graph.join(here, "a").join(there, "b").select("a", *_force(dx, dy, -2 * F.col("w") / (1 + squared)))
    draws = F.array(*[F.pmod(F.xxhash64("a", F.lit(seed), F.lit(step), F.lit(j)), n) for j in range(AGAINST)])
    drawn = here.withColumn("b", F.explode(draws)).filter(F.col("a") != F.col("b"))
    pushed = drawn.join(there, "b").select("a", *_force(dx, dy, 2 / ((NEAR + squared) * (1 + squared))))
    moves = pulled.union(pushed).groupBy("a").agg(F.sum("x").alias("dx"), F.sum("y").alias("dy"))
    to = lambda c: (F.col(c) + rate * F.coalesce(F.col(f"d{c}"), F.lit(0.0))).alias(c)
    return places.join(moves, places.number == moves.a, "left").select("number", to("x"), to("y"))


def neighbour_layout(df: DataFrame, id_col: str, emb: str = "emb", k: int = 15, steps: int = 12, rate: float = 0.2, seed: int = 0, n_cells: int = 0) -> DataFrame:
    """``(id, x, y)`` of unit vectors; each step is stored, so a lost executor repeats at most one.

    The start is the view by principal components, widened so that points have room.
    """
    numbered = stored(with_row_index(df.filter(F.col(emb).isNotNull()).select(id_col, F.col(emb).alias("emb")), [F.col(id_col)], "number"), "layout-vectors")
    graph = stored(neighbour_graph(numbered.select("number", "emb"), k, n_cells), "layout-graph")
    flat = project_2d(numbered).select("number", "x", "y")
    wide = flat.agg(F.coalesce(F.stddev("x"), F.lit(1.0))).scalar()
    spread = F.when(wide > 0, 5 / wide).otherwise(1.0)
    places = stored(flat.select("number", (F.col("x") * spread).alias("x"), (F.col("y") * spread).alias("y")), "layout-0")
    n = numbered.agg(F.count("*")).scalar()
    for step in range(steps):
        places = stored(_step(places, graph, n, step, rate * (1 - step / steps), seed), "layout-step")
    return numbered.select("number", id_col).join(places, "number").select(id_col, "x", "y")
