"""Tokens, token frequencies and references rebuilt with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.config import Parameters
from kinfold.functions.tokens import is_numeric, tokenize
from kinfold.runtime import checkpoint, stored

HOT_TOKENS = 10_000


def token_lists(references: DataFrame, p: Parameters) -> DataFrame:
    """(ref_id, found, toks): all tokens of a reference, and those that stay after de-duplication."""
    found = tokenize(F.col("body"), p)
    rows = references.select("ref_id", found.alias("found"))
    return rows.select("ref_id", "found", (F.array_distinct("found") if p.removeDuplicateTokens else F.col("found")).alias("toks"))


def positions(lists: DataFrame) -> DataFrame:
    """(ref_id, pos, tok) of ``lists`` (ref_id, toks), positions from 1; references without tokens have no rows."""
    return lists.select("ref_id", F.posexplode("toks").alias("at", "tok")).select("ref_id", (F.col("at") + 1).alias("pos"), "tok")


def tokens(references: DataFrame, p: Parameters) -> DataFrame:
    """(ref_id, pos, tok) of all references."""
    return positions(token_lists(references, p))


def token_frequency(toks: DataFrame) -> DataFrame:
    """(tok, freq)."""
    return toks.groupBy("tok").agg(F.count("*").alias("freq"))


def with_frequency(toks: DataFrame) -> DataFrame:
    """``toks`` with ``freq``.

    A token that makes up more than one in ``HOT_TOKENS`` of all occurrences
    would be one heavy key of the join; there are fewer than that many of them,
    so they are broadcast, and the others are joined by token.
    """
    freq = checkpoint(token_frequency(toks))
    total = freq.agg(F.sum("freq")).first()[0] or 0
    hot = F.col("freq") * F.lit(HOT_TOKENS) > F.lit(max(total, HOT_TOKENS * HOT_TOKENS))
    often = F.broadcast(freq.where(hot))
    rare = toks.join(often.select("tok"), "tok", "left_anti").join(freq.where(~hot), "tok")
    return rare.unionByName(toks.join(often, "tok"))


def reform(toks: DataFrame) -> DataFrame:
    """(ref_id, toks): each reference's (pos, tok, freq) in order."""
    return with_frequency(toks).groupBy("ref_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tok", "freq"))).alias("toks"))


def tokenization_stats(references: DataFrame, p: Parameters) -> DataFrame:
    """One row of counts over the tokenization."""
    lists = stored(token_lists(references, p), "lists")
    numeric = F.size(F.filter("toks", is_numeric))
    sums = lists.agg(
        F.count("*").alias("refs_read"), F.sum(F.size("found")).alias("tokens_found"), F.sum(numeric).alias("numeric_tokens"),
        F.sum(F.size("toks")).alias("tokens_left"), F.count_if(F.size("toks") == 0).alias("refs_without_tokens"),
    )
    unique = token_frequency(positions(lists)).agg(F.count("*").alias("unique_tokens"))
    ratio = lambda c: F.round(F.try_divide(F.col(c), F.col("tokens_found")), 4)
    return sums.crossJoin(unique).select(  # one row each
        "*", (F.col("tokens_found") - F.col("tokens_left")).alias("duplicate_tokens"), ratio("unique_tokens").alias("unique_ratio"), ratio("numeric_tokens").alias("numeric_ratio")
    )


def frequency_stats(freq: DataFrame) -> DataFrame:
    """Largest, mean and population deviation of the token frequencies."""
    return freq.agg(F.max("freq").alias("max_freq"), F.avg("freq").alias("mean_freq"), F.stddev_pop("freq").alias("stdev_freq"))
