"""MinHash near-dedup with b-bit signatures.

A document's set holds its distinct five-word shingles. Minima of as many hashes
as the threshold needs give band keys of ``ROWS`` each for candidates, and their
low ``BITS`` bits, packed into words, give a similarity estimate by counting
equal cells and correcting for chance. Candidates whose estimate is far below
the threshold (six standard deviations) go; the rest are confirmed on their
full sets.

Equal sets are one class. Within a band's bucket, classes are first compared
with the bucket's hub, the class that meets the most others; links make
components. In buckets whose classes are still in different components, all
pairs across components are then compared: of small buckets as listed pairs, of
larger ones within tasks, by pairs of blocks that hand on a spanning forest.
Blocks are bounded by classes and by shingles. No link between components is left out, and no bucket's pairs are listed.

Null texts and texts without words have an empty set and link with nothing;
fewer than five words make one shingle; repeated rows are copies of each other;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.kernels import SLICE_BYTES, U64, SpanHash, as_bytes, column, compressed, mix, row_key, shared_counts, slices, words
from kinfold.operators.components import connected_components
from kinfold.runtime import bound_batches, checkpoint, scratch_table

SHINGLE = 5
THRESHOLD = 80  # in hundredths, unless the caller gives another
CONTRACT = 85  # what the registered query takes
ROWS = 4
BITS = 4
CELLS = 64 // BITS
MISSED = 1e-6  # of the pairs at the threshold, the share that may meet in no band
MARGIN = 0.25
SMALL = 16  # classes of a bucket whose pairs are listed
BLOCK = 1024  # classes of a larger bucket that are compared at once
BLOCK_SHINGLES = 500_000  # and their shingles, but for a class that has more alone

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def hashes_for(threshold: int) -> int:
    """How many minima miss few enough pairs at the threshold (in hundredths); whole words of cells."""
    if not 50 <= threshold <= 100:
        raise ValueError(f"threshold must be from 50 to 100 hundredths, not {threshold}")
    n = CELLS
    while (1 - (threshold / 100) ** ROWS) ** (n // ROWS) >= MISSED and threshold < 100:
        n += CELLS
    return n


@cache
def _mixers(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**64, hashes, dtype=np.uint64), rng.integers(0, 2**64, hashes, dtype=np.uint64) | U64(1)


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of the rows, in order, repeats included."""
    buf = _LOWER[buf]
    starts, ends, first = words(buf, offs)
    count = np.diff(first)
    h = SpanHash(buf).of(starts, ends)
    n = len(h)
    row = np.repeat(np.arange(len(count)), count)
    take = np.minimum(count, SHINGLE)[row]  # how many words a shingle of this row has
    left = (first[1:][row] - np.arange(n)) if n else np.zeros(0, np.int64)
    begins = np.flatnonzero(left >= take)
    begins = begins[(count[row[begins]] >= SHINGLE) | (begins == first[row[begins]])]
    out = take[begins].astype(np.uint64)
    for k in range(SHINGLE):
        on = k < take[begins]
        word = h[np.minimum(begins + k, n - 1)] if n else h
        out = np.where(on, mix(out * U64(0x9E3779B97F4A7C15) + word), out)
    return row[begins], out


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' sets, sorted by row and hash."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[fresh], h[fresh]


SKETCH = "doc_id bigint, doc_key binary, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>, signature array<bigint>"


def _sketch(batches: Iterator[pa.RecordBatch], threshold: int = THRESHOLD) -> Iterator[pa.RecordBatch]:
    hashes = hashes_for(threshold)
    flip, times = _mixers(hashes)
    for batch in batches:
        for part, buf, offs in slices(batch, "text"):
            n = part.num_rows
            row, h = distinct(*shingles(buf, offs))
            size = np.bincount(row, minlength=n)
            h1, h2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            has = np.flatnonzero(size)
            bands = np.zeros((n, hashes // ROWS), np.uint64)
            packed = np.zeros((n, hashes // CELLS), np.uint64)
            if len(has):
                begin = np.concatenate([[0], np.cumsum(size[has])])[:-1]
                h1[has] = np.add.reduceat(mix(h), begin)
                h2[has] = np.add.reduceat(mix(h ^ U64(0x5BD1E995)), begin)
                for i in range(hashes):
                    least = mix(np.minimum.reduceat((h ^ flip[i]) * times[i], begin))
                    bands[has, i // ROWS] = mix(bands[has, i // ROWS] * U64(31) + least + U64(i // ROWS))
                    packed[has, i // CELLS] |= (least & U64((1 << BITS) - 1)) << U64(BITS * (i % CELLS))
            lists = [pa.array(list(x.view(np.int64)), pa.list_(pa.int64())) for x in (bands, packed)]
            flat = [pa.array(x.view(np.int64)) for x in (h1, h2)]
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "doc_key"), pa.array(size, pa.int64()), *flat, *lists], [x.split()[0] for x in SKETCH.split(", ")])


def estimate(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """Similarity from packed b-bit signatures: equal cells by bit counts, corrected for chance."""
    ones = 0
    for i in range(CELLS):
        ones |= 1 << (BITS * i)
    low = F.lit(ones if ones < 2**63 else ones - 2**64)

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for s in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, s))
        return F.bit_count(d.bitwiseAND(low))

    hashes = hashes_for(threshold)
    differ = sum((unequal(a[i], b[i]) for i in range(hashes // CELLS)), F.lit(0))
    chance = 2.0**-BITS
    return ((1 - differ / hashes) - chance) / (1 - chance)


def _at(work: Callable, threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: work(batches, threshold)


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, bodies in compressed(batch, "text"):
            yield pa.RecordBatch.from_arrays([column(part, "doc_key"), bodies], ["doc_key", "body"])


PAIRS_AT_ONCE = 1 << 19


def _confirm(batches: Iterator[pa.RecordBatch], threshold: int = THRESHOLD) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets are similar enough."""
    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        sides = [column(batch, c).to_pylist() for c in ("body_a", "body_b")]
        at, n = 0, batch.num_rows
        while at < n:
            texts: tuple[list, list] = ([], [])
            size, to = 0, at
            while to < n and size < PAIRS_AT_ONCE:
                for side, body in zip(texts, sides):
                    side.append(opener.decompress(body[to]))
                    size += len(side[-1])
                to += 1
            sets = [distinct(*shingles(*as_bytes(pa.array(t, pa.large_binary())))) for t in texts]
            m = to - at
            sizes = [np.bincount(r, minlength=m) for r, _ in sets]
            row, h = (np.concatenate([sets[0][i], sets[1][i]]) for i in (0, 1))
            kept = np.bincount(distinct(row, h)[0], minlength=m)  # sizes of the unions
            both = sizes[0] + sizes[1] - kept
            good = 100 * both >= threshold * kept
            part = batch.slice(at, m).filter(pa.array(good & (both > 0)))
            yield pa.RecordBatch.from_arrays([column(part, "a"), column(part, "b")], ["a", "b"])
            at = to


def bodies(need: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_key, body): the compressed texts of the wanted keys, from a written table."""
    pressed = docs.mapInArrow(_squeeze, "doc_key binary, body binary").join(need, "doc_key", "left_semi").groupBy("doc_key").agg(F.first("body").alias("body"))
    path = scratch_table(docs.sparkSession, "texts")
    pressed.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def confirmed(pairs: DataFrame, docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) among ``pairs`` (a, b, key_a, key_b) by the whole texts of ``docs`` (doc_key, text)."""
    found = bodies(pairs.select("key_a").unionByName(pairs.select(F.col("key_b").alias("key_a"))).distinct().withColumnRenamed("key_a", "doc_key"), docs)
    side = lambda s: found.select(F.col("doc_key").alias(f"key_{s}"), F.col("body").alias(f"body_{s}"))
    both = pairs.join(side("a"), "key_a").join(side("b"), "key_b")
    return both.select("a", "b", "body_a", "body_b").mapInArrow(_at(_confirm, threshold), "a binary, b binary")


# --- crowded buckets -----------------------------------------------------


def _join_unit(first: np.ndarray, label: np.ndarray, rows: np.ndarray, h: np.ndarray, same: bool, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, between labels, of the links of one unit."""
    n = len(label)
    left = np.arange(n) if same else np.flatnonzero(first)
    right = left if same else np.flatnonzero(~first)
    size = np.bincount(rows, minlength=n)
    both = shared_counts(rows, h, n)[np.ix_(left, right)]
    links = 100 * both >= threshold * (size[left][:, None] + size[right][None, :] - both)
    names, which = np.unique(label, return_inverse=True)
    i, j = np.nonzero(links & (which[left][:, None] != which[right][None, :]))
    ends = np.unique(np.sort(np.stack([which[left][i], which[right][j]], axis=1), axis=1), axis=0)
    root = np.arange(len(names))
    while len(ends) and (root[ends[:, 0]] != root[ends[:, 1]]).any():
        a, b = root[ends[:, 0]], root[ends[:, 1]]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def _join_units(batches: Iterator[pa.RecordBatch], threshold: int = THRESHOLD) -> Iterator[pa.RecordBatch]:
    """Links between labels, unit by unit; rows come sorted by unit."""
    opener = zstandard.ZstdDecompressor()
    key, held = None, []

    def work() -> pa.RecordBatch:
        first, label = np.array([r[0] for r in held]), np.array([r[1] for r in held], dtype=object)
        sets, texts, size = [], [], 0
        for i, r in enumerate(held, 1):  # a bounded stretch of text at a time
            texts.append(opener.decompress(r[2]))
            size += len(texts[-1])
            if size >= SLICE_BYTES or i == len(held):
                row, h = distinct(*shingles(*as_bytes(pa.array(texts, pa.large_binary()))))
                sets.append((row + i - len(texts), h))
                texts, size = [], 0
        rows, h = (np.concatenate(x) for x in zip(*sets))
        a, b = _join_unit(first, label, rows, h, key[1] == key[2], threshold)
        return pa.RecordBatch.from_arrays([pa.array(a.tolist(), pa.binary()), pa.array(b.tolist(), pa.binary())], ["a", "b"])

    for batch in batches:
        for *unit, first, label, body in zip(*(column(batch, c).to_pylist() for c in ("band", "one", "two", "first", "label", "body"))):
            if unit != key:
                if held:
                    yield work()
                key, held = unit, []
            held.append((first, label, body))
    if held:
        yield work()


def joined_labels(rows: DataFrame, docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between the labels of crowded buckets ``rows`` (band, class, label, member, n, mass), compared in pairs of blocks."""
    blocks = F.ceil(F.greatest(F.col("n") / F.lit(float(BLOCK)), F.col("mass") / F.lit(float(BLOCK_SHINGLES)))).cast("int")
    mine = F.pmod(F.xxhash64("class", F.lit(5)), blocks).cast("int")
    units = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(mine, o).alias("one"), F.greatest(mine, o).alias("two")))
    dealt = rows.join(bodies(rows.select(F.col("member").alias("doc_key")).distinct(), docs).withColumnRenamed("doc_key", "member"), "member")
    dealt = dealt.withColumn("mine", mine).withColumn("unit", F.explode(units))
    dealt = dealt.select("band", F.col("unit.one").alias("one"), F.col("unit.two").alias("two"), (F.col("mine") == F.col("unit.one")).alias("first"), "label", "body")
    return dealt.repartition("band", "one", "two").sortWithinPartitions("band", "one", "two").mapInArrow(_at(_join_units, threshold), "a binary, b binary")


def grouped(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_key (a hash of id and text), key, n_shingles, component_id, kept and group (null for an empty set) of every row; ``threshold`` in hundredths."""
    bound_batches(documents.sparkSession)
    docs = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("doc_key", row_key(F.col("doc_id"), F.col("text")))
    sketches = checkpoint(docs.mapInArrow(_at(_sketch, threshold), SKETCH).withColumn("class", F.when(F.col("n_shingles") > 0, row_key(F.col("h1"), F.col("h2"), F.col("n_shingles")))))
    classes = checkpoint(
        sketches.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("low"), F.first("doc_key").alias("member"), F.first("n_shingles").alias("mass"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    )
    entries = classes.select("class", "mass", F.explode("bands").alias("band"))
    crowded = entries.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    met = checkpoint(entries.join(crowded, "band"))
    degree = met.groupBy("class").agg(F.sum("size").alias("degree"))
    ranked = met.join(degree, "class")
    hubs = ranked.groupBy("band").agg(F.max_by("class", F.struct("degree", "class")).alias("hub"))
    spokes = met.join(hubs, "band").where("class != hub").select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()

    floor = threshold / 100 - MARGIN
    sides = {s: classes.select(F.col("class").alias(s), F.col("member").alias(f"key_{s}"), F.col("signature").alias(f"sig_{s}")) for s in ("a", "b")}

    def likely(pairs: DataFrame) -> DataFrame:
        return pairs.join(sides["a"], "a").join(sides["b"], "b").where(estimate(F.col("sig_a"), F.col("sig_b"), threshold) >= floor).select("a", "b", "key_a", "key_b")

    texts = docs.select("doc_key", "text")
    tried = checkpoint(likely(spokes))
    links = checkpoint(confirmed(tried, texts, threshold))
    labels = checkpoint(connected_components(links, "a", "b").withColumnsRenamed({"id": "class", "component": "label"}))

    placed = met.join(labels, "class", "left").select("band", "class", "mass", F.coalesce("label", "class").alias("label"))
    mixed = placed.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("mass").alias("mass")).groupBy("band").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("mass").alias("mass")).where("labels > 1")
    rest = checkpoint(placed.drop("mass").join(mixed.select("band", "n", "mass"), "band").join(classes.select("class", "member", "signature"), "class"))
    few = rest.where(F.col("n") <= SMALL)
    one, two = (few.select("band", *[F.col(c).alias(f"{c}_{s}") for c in ("class", "label", "signature", "member")]) for s in ("a", "b"))
    apart = (F.col("class_a") < F.col("class_b")) & (F.col("label_a") != F.col("label_b")) & (estimate(F.col("signature_a"), F.col("signature_b"), threshold) >= floor)
    crossed = one.join(two, "band").where(apart).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), F.col("member_a").alias("key_a"), F.col("member_b").alias("key_b")).distinct()
    crossed = checkpoint(crossed.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    more = [labels.select(F.col("class").alias("a"), F.col("label").alias("b"))]
    if not crossed.isEmpty():
        more.append(confirmed(crossed, texts, threshold))
    many = rest.where(F.col("n") > SMALL)
    if not many.isEmpty():
        more.append(joined_labels(many.select("band", "class", "label", "member", "n", "mass"), texts, threshold))
    if len(more) > 1:
        edges = checkpoint(reduce(DataFrame.unionByName, more))
        labels = checkpoint(connected_components(edges, "a", "b").withColumnsRenamed({"id": "class", "component": "label"}))

    lows = classes.select("class", "low").join(labels, "class").groupBy("label").agg(F.min("low").alias("component"))
    found = classes.select("class", "low").join(labels, "class", "left").join(lows, "label", "left").select("class", F.coalesce("component", "low").alias("component"), F.coalesce("label", "class").alias("group"))
    out = sketches.select("doc_id", "doc_key", "n_shingles", "class").join(found, "class", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_key", F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "group")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_key (a hash of id and text), key, n_shingles, component_id and kept of every row; ``threshold`` in hundredths."""
    return grouped(documents, key, text, threshold).drop("group")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: shingle counts and components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), threshold=CONTRACT).drop("doc_key")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each group of near duplicates: of its smallest doc_id, a null one only if there is no other. Rows without words stay, repeated ones once."""
    rows = grouped(docs, threshold=threshold)
    first = F.min_by("doc_key", F.struct(F.col("doc_id").isNull(), "doc_id", "doc_key")).alias("__key")
    kept = rows.groupBy(F.col("group").isNull(), F.coalesce("group", "doc_key")).agg(first).select("__key")
    once = docs.withColumn("__key", row_key(F.col("doc_id").cast("bigint"), F.col("text"))).join(kept, "__key", "left_semi")
    return once.dropDuplicates(["__key"]).select(*docs.columns)


ORACLE = r"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct r, md5(array_to_string(w[i:i + 4], ' ')) as k from (select r, w, unnest(case when len(w) >= 5 then range(1, len(w) - 3) when len(w) > 0 then [1] else [] end) as i from d)),
n as materialized (select r, count(*) as n from g group by r),
shared as (select a.r as a, b.r as b, count(*) as c from g a join g b on a.k = b.k and a.r < b.r group by all),
link as materialized (select a, b from shared join n x on x.r = a join n y on y.r = b where 100 * c >= 85 * (x.n + y.n - c)),
edge as materialized (select a, b from link union select b, a from link union select r, r from d),
reach as (select a, b from edge union select x.a, e.b from reach x join edge e on x.b = e.a),
low as (select a as r, min(doc_id) as component_id from reach join d on d.r = reach.b group by a)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id, coalesce(doc_id = component_id, true) as kept from d left join n using (r) left join low using (r)
"""
