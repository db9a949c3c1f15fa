"""Candidate pairs from frequency-bounded blocks.

A token that names a block occurs ``beta`` times at most, so a block's members
fit in an array and its pairs are unfolded there: one shuffle by token, one by
pair, no join and no skew. Two references share a key of two tokens exactly if
they share two blocking tokens, so pairs are counted, not keys made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.config import Parameters
from kinfold.functions.tokens import blocks
from kinfold.runtime import checkpoint


def blocking_tokens(refs: DataFrame, p: Parameters) -> DataFrame:
    """(ref_id, tok, times): a reference's blocking tokens with their number."""
    each = refs.select("ref_id", F.explode(F.filter("toks", lambda x: blocks(x["tok"], x["freq"], p))).alias("t"))
    return each.groupBy("ref_id", F.col("t.tok").alias("tok")).agg(F.count("*").alias("times"))


def block_keys_single(refs: DataFrame, p: Parameters) -> DataFrame:
    """(t1, t2, ref_id) with t2 null: one key a blocking token."""
    return blocking_tokens(refs, p).select(F.col("tok").alias("t1"), F.lit(None).cast("string").alias("t2"), "ref_id")


def block_keys_pairs(refs: DataFrame, p: Parameters) -> DataFrame:
    """(t1, t2, ref_id), t1 <= t2: one key for each two of a reference's blocking tokens."""
    lists = refs.select("ref_id", F.transform(F.filter("toks", lambda x: blocks(x["tok"], x["freq"], p)), lambda x: x["tok"]).alias("b")).where(F.size("b") > 1)

    def with_later(x: Column, i: Column) -> Column:
        return F.transform(F.slice(F.col("b"), i + 2, F.greatest(F.size("b") - i - 1, F.lit(0))), lambda y: F.struct(F.least(x, y).alias("t1"), F.greatest(x, y).alias("t2")))

    return lists.select("ref_id", F.explode(F.flatten(F.transform("b", with_later))).alias("k")).select("k.t1", "k.t2", "ref_id")


def shared_tokens(block_toks: DataFrame) -> DataFrame:
    """(r1, r2, shared), r1 < r2: how many blocking tokens two references share, repeats paired off."""
    members = block_toks.groupBy("tok").agg(F.array_sort(F.collect_list(F.struct("ref_id", "times"))).alias("m")).where(F.size("m") > 1)

    def with_later(x: Column, i: Column) -> Column:
        rest = F.slice(F.col("m"), i + 2, F.size("m"))
        return F.transform(rest, lambda y: F.struct(x["ref_id"].alias("r1"), y["ref_id"].alias("r2"), F.least(x["times"], y["times"]).alias("n")))

    unfolded = members.select(F.explode(F.flatten(F.transform("m", with_later))).alias("p"))
    return unfolded.groupBy("p.r1", "p.r2").agg(F.sum("p.n").alias("shared"))


def candidate_pairs(refs: DataFrame, p: Parameters) -> DataFrame:
    """(r1, r2), each candidate once."""
    pairs = shared_tokens(blocking_tokens(refs, p))
    return pairs.where(F.col("shared") >= (2 if p.blockByPairs else 1)).select("r1", "r2")


def blocking_stats(refs: DataFrame, p: Parameters) -> DataFrame:
    """One row of counts over the blocking."""
    toks = checkpoint(blocking_tokens(refs, p))
    per_ref = toks.groupBy("ref_id").agg(F.sum("times").alias("k"))
    left = per_ref.where(F.col("k") >= (2 if p.blockByPairs else 1))
    records = F.col("k") * (F.col("k") - 1) / 2 if p.blockByPairs else F.col("k")
    n = F.col("shared")
    by_blocks = n * (n - 1) / 2 if p.blockByPairs else n
    all_refs = refs.agg(F.count("*").alias("refs"))
    chosen = per_ref.agg(F.count("*").alias("refs_selected"))
    kept = left.agg(F.count("*").alias("refs_left"), F.coalesce(F.sum(records), F.lit(0)).cast("bigint").alias("blocking_records"))
    pairs = shared_tokens(toks).where(n >= (2 if p.blockByPairs else 1)).agg(F.coalesce(F.sum(by_blocks), F.lit(0)).cast("bigint").alias("pairs_by_blocks"), F.count("*").alias("unique_pairs"))
    return all_refs.crossJoin(chosen).crossJoin(kept).crossJoin(pairs).withColumn("refs_excluded", F.col("refs") - F.col("refs_selected"))  # one row each
