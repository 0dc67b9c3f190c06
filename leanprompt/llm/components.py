"""Connected components by contraction: every vertex hooks to its smallest neighbour, edges are drawn again between
what their ends hooked to, until none is left. All steps are joins and grouped minima over narrow rows; the many
edges of one vertex are pre-aggregated before each shuffle, and its join side is one that Spark can split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for each vertex of edges(u long, v long): root is the smallest vertex of u's component.

    Loops, repeated edges and nulls are ignored; no edges give no rows.
    """
    left = keep(edges.select("u", "v").where("u <> v").distinct())
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("root")))
        if labels is None:
            labels = hooks
        else:
            step = hooks.select(F.col("u").alias("root"), F.col("root").alias("next"))
            labels = keep(labels.join(step, "root", "left").select("u", F.coalesce("next", "root").alias("root")))
        to_u, to_v = hooks.select("u", F.col("root").alias("ru")), hooks.select(F.col("u").alias("v"), F.col("root").alias("rv"))
        left = keep(left.join(to_u, "u").join(to_v, "v").where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
    return labels if labels is not None else left.select("u", F.col("v").alias("root"))
