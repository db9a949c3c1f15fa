"""Connected components labelled by the smallest member id.

Alternating large-star / small-star contraction: every round is a min
aggregate (combined map-side, so a hub does not gather its neighbours in one
task) and one equi-join. The label of a component is its smallest vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.runtime import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction; ``edges`` holds (u, v) with u > v."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame, left: str = "r1", right: str = "r2", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex that occurs in ``edges``.

    Self-loops keep their vertex as a singleton; rows with a null end are
    ignored; repeated and reversed rows count once. An empty input gives an
    empty result. Raises ``RuntimeError`` when the labels do not settle.
    """
    pairs = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(
        F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
    )
    base = checkpoint(pairs.distinct())
    work = base.where("u > v")
    for _ in range(max_rounds):
        work = checkpoint(_star(_star(work, True), False))
        below = work.groupBy("u").agg(F.count("*").alias("n"))
        # settled once every vertex hangs below one other that hangs below none
        chained = work.join(below.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if below.where("n > 1").select("u").unionByName(chained).isEmpty():
            break
    else:
        raise RuntimeError("connected components did not settle")
    vertices = base.select(F.col("u").alias("id")).unionByName(base.select(F.col("v").alias("id"))).distinct()
    labels = work.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return vertices.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
