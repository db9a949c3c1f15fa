"""Linked index, cluster profile, accuracy and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linked_index(refs: DataFrame, good: DataFrame) -> DataFrame:
    """(ref_id, cluster_id) of every reference: its good cluster, else itself."""
    found = refs.select("ref_id").join(good, "ref_id", "left")
    return found.select("ref_id", F.coalesce("cluster_id", "ref_id").alias("cluster_id"))


def with_bodies(index: DataFrame, references: DataFrame) -> DataFrame:
    """The index with each reference's body."""
    return index.join(references, "ref_id").select("ref_id", "cluster_id", "body")


def cluster_profile(index: DataFrame) -> DataFrame:
    """(cluster_size, n_clusters, n_refs) by size, and a total row with null size and the mean size."""
    sizes = index.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    rows = sizes.rollup("cluster_size").agg(F.count("*").alias("n_clusters"), F.sum("cluster_size").alias("n_refs"))
    return rows.withColumn("avg_size", F.round(F.col("n_refs") / F.col("n_clusters"), 4))


def er_matrix(index: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of pair counts, precision, recall and F over the references that have a truth id."""
    both = index.join(truth, "ref_id")
    pairs = lambda n: F.coalesce(F.sum(F.col(n) * (F.col(n) - 1) / 2), F.lit(0)).cast("bigint")
    cells = both.groupBy("cluster_id", "truth_id").agg(F.count("*").alias("n"))
    by = lambda c, out: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs("n").alias(out))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select((F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("d"))
    row = total.crossJoin(by("cluster_id", "l")).crossJoin(by("truth_id", "e")).crossJoin(cells.agg(pairs("n").alias("tp")))  # one row each
    row = row.withColumns({"fp": F.col("l") - F.col("tp"), "fn": F.col("e") - F.col("tp")})
    row = row.withColumn("tn", F.col("d") - F.col("tp") - F.col("fp") - F.col("fn"))
    row = row.withColumns({"precision": F.round(F.try_divide("tp", "l"), 4), "recall": F.round(F.try_divide("tp", "e"), 4)})
    f = F.round(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 4)
    return row.withColumn("f", f)


def write_index(index: DataFrame, path: str) -> None:
    """The index as text lines ``ref * cluster`` under a header."""
    lines = index.select(F.concat_ws(" * ", "ref_id", "cluster_id").alias("RefID * ClusterID"))
    lines.write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
