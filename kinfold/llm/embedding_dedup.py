"""Embedding near-dedup by cross-polytope hashing with multiprobe buckets.

A vector is rotated by random signs and fast Hadamard transforms; its hash is
the signed axis it lies nearest to. A table joins ``k`` such hashes; a vector
enters the bucket of its own axes and, by multiprobe, those where the least
certain hash takes the runner-up axis. ``k`` follows the number of vectors, the
number of tables follows ``k`` so that few pairs at the threshold meet in no
bucket (``TABLES``; tests measure the recall of every ``k``).

Identical vectors are one class. A bucket's pairs are verified; it hands on a
spanning forest of its links, never the pairs, and how many links each class
has there whose ends share no bucket of a smaller key. So each link is counted
in one bucket, and no pair that shares no bucket is looked at. A bucket of more
than ``BLOCK`` rows is split into blocks, and each pair of blocks is a unit of
work of bounded size.

Null, zero and empty vectors and those with null or non-finite components link
with nothing; vectors of different lengths don't link; a repeated vec_id is
counted for each of its rows; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.kernels import U64, column, mix, shared_counts
from kinfold.operators.components import connected_components
from kinfold.runtime import checkpoint

THRESHOLD = 0.95
BLOCK = 1024
ROUNDS = 3
PROBES = 6
LEAST_DIMS = 64  # shorter vectors are padded: signs and Hadamard transforms rotate few dimensions in few ways
TABLES = {1: 6, 2: 8, 3: 10, 4: 14, 5: 22, 6: 34}


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (their length is a power of two)."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def codes(x: np.ndarray, k: int, tables: int, probes: int = PROBES) -> np.ndarray:
    """(n, tables * probes) bucket keys of the rows of ``x``."""
    n, dim = x.shape
    d = max(LEAST_DIMS, 1 << (dim - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    probes = min(probes, 1 << k)
    out = np.zeros((n, tables, probes), dtype=np.uint64)
    rows = np.arange(n)
    for t in range(tables):
        axis = np.zeros((k, 2, n), dtype=np.uint64)  # nearest and next
        gap = np.zeros((k, n))
        for j in range(k):
            rng = np.random.default_rng([5, d, t, j])
            y = padded
            for _ in range(ROUNDS):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            a = np.abs(y)
            for r in (0, 1):
                i = a.argmax(axis=1)
                axis[j, r] = 2 * i + (y[rows, i] < 0)
                gap[j] += (1 - 2 * r) * a[rows, i]
                a[rows, i] = -1
        # the sets of hashes that take the runner-up, cheapest first
        sets = sorted(range(1 << k), key=lambda s: (bin(s).count("1"), s))
        cost = np.stack([sum((gap[j] ** 2 for j in range(k) if s >> j & 1), np.zeros(n)) for s in sets])
        order = np.argsort(cost, axis=0, kind="stable")[:probes]
        for p in range(probes):
            s = np.array(sets)[order[p]]
            key = np.full(n, t * 1009 + dim, dtype=np.uint64)
            for j in range(k):
                key = mix(key * U64(31) + np.where(s >> j & 1, axis[j, 1], axis[j, 0]) + U64(1))
            out[:, t, p] = key
    return out.reshape(n, -1)


# --- classes and grouped comparison --------------------------------------


def usable(v: Column) -> Column:
    """Neither null nor zero, every component a finite number."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def in_blocks(rows: DataFrame, size: Column) -> DataFrame:
    """Units of work (group, one, two) over the blocks of each group, so that every pair of rows meets in one unit.

    A group of up to ``BLOCK`` rows is one unit; a larger one gets a unit for
    each pair of blocks, and a row goes to every unit of its block.
    """
    n = F.ceil(size / F.lit(float(BLOCK))).cast("int")
    mine = F.pmod(F.xxhash64("rep", F.lit(3)), n).cast("int")
    units = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(F.least(mine, o).alias("one"), F.greatest(mine, o).alias("two")))
    dealt = rows.withColumn("__mine", mine).withColumn("__unit", F.explode(units))
    return dealt.select("group", F.col("__unit.one").alias("one"), F.col("__unit.two").alias("two"), (F.col("__mine") == F.col("__unit.one")).alias("first"), "rep", "n", "vector", "keys")


@dataclass
class _Unit:
    """Rows of a unit of work: whether in the first block, class, size, unit vectors and bucket keys (two dimensions)."""

    bucket: int
    same: bool
    first: np.ndarray
    rep: np.ndarray
    n: np.ndarray
    x: np.ndarray
    keys: np.ndarray


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[_Unit]:
    """The units of a task; rows come sorted by unit."""
    unit: tuple | None = None
    held: list[tuple] = []

    def made() -> _Unit:
        first, rep, n, vec, keys = zip(*held)
        x = np.array([np.asarray(v) for v in vec], dtype=float)
        x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return _Unit(unit[0], unit[1] == unit[2], np.array(first), np.array(rep), np.array(n), x, np.array([np.asarray(k) for k in keys]))

    for batch in batches:
        get = lambda c: column(batch, c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
        for *now, first, rep, n, vec, keys in zip(*(get(c) for c in ("group", "one", "two", "first", "rep", "n", "vector", "keys"))):
            if tuple(now) != unit:
                if len(held) > 1:
                    yield made()
                unit, held = tuple(now), []
            held.append((first, rep, n, vec, keys))
    if len(held) > 1:
        yield made()


def _links(u: _Unit) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of linked rows of a unit, each pair once."""
    left = np.arange(len(u.x)) if u.same else np.flatnonzero(u.first)
    right = left if u.same else np.flatnonzero(~u.first)
    i, j = np.nonzero(u.x[left] @ u.x[right].T >= THRESHOLD)
    i, j = left[i], right[j]
    keep = (u.rep[i] != u.rep[j]) & ((i < j) | (not u.same))
    return i[keep], j[keep]


def _met_before(u: _Unit, rows: np.ndarray) -> np.ndarray:
    """Which two of ``rows`` share a bucket of a smaller key than this unit's."""
    keys = u.keys[rows]
    at, _ = earlier = np.nonzero(keys < u.bucket)
    return shared_counts(at, keys[earlier], len(rows)) > 0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each unit (rep, low, links): rep hangs below low in a spanning forest of its links, links are those first met here."""
    for u in _units(batches):
        i, j = _links(u)
        if not len(i):
            continue
        root = np.arange(len(u.x))
        while True:  # hang the larger root below the smaller until all ends agree
            a, b = root[i], root[j]
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
        rows = np.unique(np.concatenate([i, j]))
        seen = _met_before(u, rows)
        fresh = ~seen[np.searchsorted(rows, i), np.searchsorted(rows, j)]
        total = np.bincount(i[fresh], u.n[j[fresh]], len(u.x)) + np.bincount(j[fresh], u.n[i[fresh]], len(u.x))
        yield pa.RecordBatch.from_arrays([pa.array(u.rep[rows], pa.int64()), pa.array(u.rep[root[rows]], pa.int64()), pa.array(total[rows].astype(np.int64))], ["rep", "low", "links"])


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, n_links, component_id and kept of every row."""
    base = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    base = base.withColumn("ok", usable(F.col("vector"))).withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(7), "vector")})
    classes = checkpoint(base.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("vector").alias("vector")).withColumn("rep", F.xxhash64("h1", "h2")))
    many = classes.count()
    k = min(max(TABLES), max(1, math.ceil(math.log(max(many, 2)) / math.log(128))))
    tables = TABLES[k]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = column(batch, "rep").to_numpy()
            vec = column(batch, "vector").to_numpy(zero_copy_only=False)
            size = np.array([len(v) for v in vec], dtype=np.int64)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = np.array(vec[at].tolist(), dtype=float)
                x /= np.abs(x).max(axis=1, keepdims=True)
                c = codes(x / np.linalg.norm(x, axis=1, keepdims=True), k, tables).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(list(c), pa.list_(pa.int64()))], ["rep", "keys"])

    keyed = checkpoint(classes.select("rep", "vector").mapInArrow(hashed, "rep bigint, keys array<bigint>"))
    entries = keyed.select("rep", F.explode(F.array_distinct("keys")).alias("group"))
    crowded = entries.groupBy("group").agg(F.count("*").alias("size")).where("size > 1")
    work = entries.join(crowded, "group").join(classes.select("rep", "n", "vector").join(keyed, "rep"), "rep")
    unit = ["group", "one", "two"]
    met = checkpoint(in_blocks(work, F.col("size")).repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_verify, "rep bigint, low bigint, links bigint"))
    labels = checkpoint(connected_components(met, "rep", "low").withColumnsRenamed({"id": "rep", "component": "group"}))
    counts = met.groupBy("rep").agg(F.sum("links").alias("links"))
    lows = classes.select("rep", "low").join(labels, "rep").groupBy("group").agg(F.min("low").alias("component"))
    found = classes.select("h1", "h2", "rep", "low", "n").join(labels, "rep", "left").join(lows, "group", "left").join(counts, "rep", "left")
    found = found.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "low").alias("component"))
    out = base.withColumns({c: F.when(F.col("ok"), F.col(c)) for c in ("h1", "h2")}).join(found, ["h1", "h2"], "left")
    component = F.coalesce(F.when(F.col("ok"), F.col("component")), F.col("id"))
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: links and components of all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
with recursive v as (select row_number() over () as r, vec_id, embedding::double[] as x from embeddings),
u as (select r, x from v where x is not null and len(x) > 0 and len(list_filter(x, lambda y: y is null or isnan(y) or isinf(y))) = 0 and len(list_filter(x, lambda y: y <> 0)) > 0),
link as materialized (select a.r as a, b.r as b from u a join u b on a.r < b.r and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.95),
edge as materialized (select a, b from link union select b, a from link union select r, r from v),
reach as (select a, b from edge union select x.a, e.b from reach x join edge e on x.b = e.a),
low as (select a as r, min(vec_id) as component_id from reach join v on v.r = reach.b group by a),
n as (select a as r, count(*) as n from edge where a <> b group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from v join low using (r) left join n using (r)
"""
