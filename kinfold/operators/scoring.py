"""Scores of candidate pairs and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.config import Parameters
from kinfold.functions.similarity import comparator
from kinfold.functions.tokens import scoring_tokens


def pair_refs(pairs: DataFrame, refs: DataFrame, p: Parameters) -> DataFrame:
    """(r1, r2, l1, l2): the compared tokens of both references; the smaller id always comes first."""
    lists = refs.select("ref_id", scoring_tokens(F.col("toks"), p).alias("l"))
    one = lists.select(F.col("ref_id").alias("r1"), F.col("l").alias("l1"))
    two = lists.select(F.col("ref_id").alias("r2"), F.col("l").alias("l2"))
    return pairs.join(one, "r1").join(two, "r2").select("r1", "r2", "l1", "l2")


def score_pairs(pairs: DataFrame, refs: DataFrame, p: Parameters) -> DataFrame:
    """(r1, r2, score)."""
    both = pair_refs(pairs, refs, p)
    return both.select("r1", "r2", comparator(p)(F.col("l1"), F.col("l2")).alias("score"))


def links(scores: DataFrame, mu: float) -> DataFrame:
    return scores.where(F.col("score") >= mu)
