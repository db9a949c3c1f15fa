"""Cluster membership, entropy-based quality, and what stays unprocessed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.components import connected_components


def clusters(link_rows: DataFrame) -> DataFrame:
    """(ref_id, cluster_id): linked references by the smallest id of their component."""
    return connected_components(link_rows, "r1", "r2").withColumnsRenamed({"id": "ref_id", "component": "cluster_id"})


def unprocessed(refs: DataFrame, members: DataFrame) -> DataFrame:
    """References in no cluster."""
    return refs.join(members.select("ref_id"), "ref_id", "left_anti")


def cluster_quality(members: DataFrame, refs: DataFrame, epsilon: float) -> DataFrame:
    """(cluster_id, n_refs, n_tokens, entropy, quality, is_good).

    The k-th occurrence of a token in a reference is matched with k-th
    occurrences in the others. With c of n references holding one, it adds
    -(c/n) log2(c/n); quality is 1 - entropy / (tokens * log2(n) / n).
    """
    each = members.join(refs, "ref_id").select("cluster_id", "ref_id", F.explode("toks").alias("t")).select("cluster_id", "ref_id", "t.pos", "t.tok")
    nth = F.row_number().over(Window.partitionBy("cluster_id", "ref_id", "tok").orderBy("pos"))
    held = each.withColumn("nth", nth).groupBy("cluster_id", "tok", "nth").agg(F.count("*").alias("c"))
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n_refs"))
    p = F.col("c") / F.col("n_refs")
    sums = held.join(sizes, "cluster_id").groupBy("cluster_id", "n_refs").agg(F.sum("c").alias("n_tokens"), F.sum(-p * F.log2(p)).alias("entropy"))
    most = F.col("n_tokens") * F.log2("n_refs") / F.col("n_refs")
    quality = F.when(F.col("n_refs") == 1, 1.0).otherwise(1 - F.col("entropy") / most)
    return sums.withColumn("quality", quality).withColumn("is_good", F.col("quality") >= epsilon)


def split_members(members: DataFrame, quality: DataFrame, good: bool) -> DataFrame:
    """Members of good or of bad clusters."""
    return members.join(quality.where(F.col("is_good") == good).select("cluster_id"), "cluster_id", "left_semi").select("ref_id", "cluster_id")
