"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source gets ``target / source_size`` copies on average. The
whole part is taken as it is; the fractional parts are rounded together: two
open documents trade words (what one gains in expectation the other loses)
until one of them is 0 or 1, at random so that every expectation is kept. A
group thus leaves one open document at most, and hands it on with its
``RESERVE`` smallest ones, which it leaves alone. These residuals meet in a
tree of ``FAN_IN``-way rounds, each a distributed grouping. In a source's last
round the one document still open goes to the nearer side, and some of the
small ones change sides to make up for the words that this adds or takes.

Sources stay in a DataFrame: the ceiling is a water level that a few sums over
them settle, and their order by code point is counted by ranges.

Null texts have size 0; documents of size 0 are taken 0 times over; a null
source is the last source; rows that repeat id, text and source share one
decision, weighed by their number; other columns are carried through by
``mix``; an empty table gives an empty result. The draw is seeded by source,
bucket and level, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.kernels import row_key
from kinfold.runtime import checkpoint

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CEILING = 2.0
BUCKET_ROWS = 8192
FAN_IN = 16
RESERVE = 64
SEED = 20


def word_count(text: Column) -> Column:
    """Runs of characters other than the six ASCII spaces; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` (src, ...) with ``source_no``: places from 0 by code point, null last, counted by ranges."""
    order = [F.col("src").isNull(), F.col("src")]
    dealt = checkpoint(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.join(before, "part").withColumn("source_no", F.col("before") + place).drop("part", "before")


def with_targets(sources: DataFrame, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``: shares of ``share`` of all sizes by weight, none above ``ceiling`` times its size.

    A target is the lesser of weight * level and the ceiling; the level rises as
    sources reach theirs, until none more does.
    """
    most = F.col("source_size") * F.lit(ceiling)
    level = 0.0
    while True:
        over = F.col("weight") * F.lit(level) > most
        row = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, most)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if not row["weight"]:
            break
        now = max(0.0, (share * row["all"] - (row["full"] or 0.0)) / row["weight"])
        if now <= level:
            break
        level = now
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), most.cast("double")))


def pivot(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round fractions in place, keeping sum(size * p); at most one entry stays open."""
    draws = rng.random(len(p))
    held = -1
    for i in range(len(p)):
        if not 1e-12 < p[i] < 1 - 1e-12:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b, sa, sb = p[held], p[i], size[held], size[i]
        up = min((1 - a) * sa, b * sb)  # words that may go to the held one
        down = min(a * sa, (1 - b) * sb)
        moved = up if draws[i] * (up + down) < down else -down
        a, b = a + moved / sa, b - moved / sb
        a = round(a) if not 1e-12 < a < 1 - 1e-12 else a
        b = round(b) if not 1e-12 < b < 1 - 1e-12 else b
        p[held], p[i] = a, b
        if 0 < b < 1:
            held = i
        elif not 0 < a < 1:
            held = -1
    return p


def settle(size: np.ndarray, p: np.ndarray, may: np.ndarray, excess: float) -> None:
    """Turn decisions (0 or 1) of the rows that ``may`` in place, one or two at a time, as long as that brings the excess of words nearer 0."""
    at = np.flatnonzero(may)
    while len(at):
        change = np.where(p[at] > 0, -size[at], size[at])
        both = excess + change[:, None] + change[None, :]
        np.fill_diagonal(both, excess + change)  # one row alone
        i, j = np.unravel_index(np.argmin(np.abs(both)), both.shape)
        if abs(both[i, j]) >= abs(excess):
            break
        excess = both[i, j]
        turned = at[[i, j]] if i != j else at[[i]]
        p[turned] = 1 - p[turned]


def _round_group(level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_key"], ascending=False).reset_index(drop=True)
        size, p = pdf["size"].to_numpy(float), pdf["p"].to_numpy(float).copy()
        last = int(pdf["nodes"].iloc[0]) == 1
        rng = np.random.default_rng([SEED, int(pdf["source_no"].iloc[0]), int(pdf["node"].iloc[0]), level])
        small = np.flatnonzero((p > 0) & (p < 1))[-RESERVE:]
        if not last:
            rest = np.setdiff1d(np.arange(len(p)), small)
            p[rest] = pivot(size[rest], p[rest], rng)
            return pdf.assign(p=p)
        want = (size * p).sum()
        p = pivot(size, p, rng)
        p[:] = np.round(p)
        settle(size, p, np.isin(np.arange(len(p)), small), (size * p).sum() - want)
        return pdf.assign(p=p)

    return run


def decisions(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """One row for each distinct (id, text, source): key, doc_key, n_rows, size, source_size, target, copies."""
    slim = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("src"), doc_key(F.col(key), F.col(text), F.col(source)).alias("doc_key"), word_count(F.col(text)).alias("words"))
    slim = checkpoint(slim.groupBy("doc_key", "key", "src", "words").agg(F.count("*").alias("n_rows")).withColumn("size", F.col("words") * F.col("n_rows")))
    sources = numbered(slim.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    sources = checkpoint(with_targets(checkpoint(sources.withColumn("weight", weight))))
    nodes = F.ceil(F.col("n") / F.lit(float(BUCKET_ROWS))).cast("bigint").alias("nodes")
    plan = sources.select(F.col("src").alias("plan_src"), "source_no", "source_size", "target", nodes)
    joined = slim.join(plan, F.col("src").eqNullSafe(F.col("plan_src"))).drop("src", "plan_src")
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = joined.withColumns(
        {"base": F.floor(rate).cast("bigint"), "p": rate - F.floor(rate), "node": F.pmod(F.xxhash64("doc_key", F.lit(SEED)), F.col("nodes"))}
    )
    done, level = [], 0
    while True:  # once for each level of the tree of the source with most rows
        state = checkpoint(state.groupBy("source_no", "node").applyInPandas(_round_group(level), state.schema))
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(state.where(~is_open))
        state = state.where(is_open).withColumns({"node": F.floor(F.col("node") / FAN_IN), "nodes": F.ceil(F.col("nodes") / F.lit(float(FAN_IN))).cast("bigint")})
        if state.isEmpty():
            break
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("base") + F.round("p").cast("bigint")).alias("copies")
    return out.select("key", "doc_key", "n_rows", F.col("words").alias("size"), "source_size", "target", copies)


def doc_key(key: Column, text: Column, source: Column) -> Column:
    return row_key(key, source, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: what the mix takes of every document."""
    made = decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    rows = made.withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows"))))
    return rows.select(F.col("key").alias("doc_id"), "size", "source_size", "target", taken)


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with each row held as often as the mix takes it."""
    taken = decisions(docs, text, source, key).where(F.col("copies") > 0).select(F.col("doc_key").alias("__key"), F.col("copies").alias("__copies"))
    marked = docs.withColumn("__key", doc_key(F.col(key), F.col(text), F.col(source)))
    held = marked.join(taken, "__key").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))))
    return held.select(*docs.columns)
