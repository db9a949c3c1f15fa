"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded
as statistics of its bytes and words and as a hashed bag of words; a hidden
layer embeds it, a gated attention (tanh times sigmoid) weighs it against the
document's other passages, and the weighted mean of the embeddings is scored.
Only documents have labels. The model is trained with Adam on a bounded sample
(``TRAIN_ROWS`` labelled documents outside the held-out fold, whole texts);
labels, language, source and id are never inputs.

A text without words (null or empty too) is one passage of zeros; without
labelled rows every score is 0.5; repeated rows score alike; other columns are
carried through, one named as the new column gives way to it; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.kernels import U64, SpanHash, column, slices, words

TRAIN_ROWS = 4000
PASSAGE = 100
BUCKETS = 64
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, STEP, DECAY = 40, 64, 0.01, 1e-4
FOLDS, CUT = 5, 0.3
SLICE = 1 << 19

_CLASSES = []
for _chars in (bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".,;:", b"!?", b"#*$%&|<>@^~=+_{}[]\\/", b"\n", bytes(range(0xC0, 0x100))):
    _flags = np.zeros(256, dtype=bool)
    _flags[list(_chars)] = True
    _CLASSES.append(_flags)
N_STATS = len(_CLASSES) + 5
WIDTH = N_STATS + BUCKETS


def encode_passages(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage vectors (m, WIDTH) float32, first passage of each row (n + 1))."""
    n = len(offs) - 1
    starts, ends, first = words(buf, offs)
    count = np.diff(first)
    bags = np.maximum(1, -(-count // PASSAGE))
    begin = np.concatenate([[0], np.cumsum(bags)])
    row = np.repeat(np.arange(n), count)
    passage = begin[row] + (np.arange(len(starts)) - first[row]) // PASSAGE
    m = int(begin[-1])
    size = np.bincount(passage, minlength=m)
    w = np.maximum(size, 1)
    x = np.zeros((m, WIDTH), dtype=np.float32)
    if len(starts):
        h = SpanHash(buf).of(starts, ends)
        opens = np.searchsorted(passage, np.arange(m))  # first word of each passage
        has = size > 0
        lo = np.where(has, starts[np.minimum(opens, len(starts) - 1)], 0)
        hi = np.where(has, ends[np.minimum(opens + size - 1, len(ends) - 1)], 0)
        span = np.maximum(hi - lo, 1)
        for k, flags in enumerate(_CLASSES):
            total = np.concatenate([[0], np.cumsum(flags[buf])])
            x[:, k] = (total[hi] - total[lo]) / span
        length = np.bincount(passage, ends - starts, m)
        key = np.sort((passage.astype(np.uint64) << U64(40)) | (h >> U64(24)))
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        distinct = np.bincount((key[fresh] >> U64(40)).astype(np.int64), minlength=m)
        k = len(_CLASSES)
        x[:, k] = length / w / 10
        x[:, k + 1] = distinct / w
        x[:, k + 2] = size / PASSAGE
        x[:, k + 3] = np.log1p(count)[np.repeat(np.arange(n), bags)] / 10
        x[:, k + 4] = np.bincount(passage, h == np.concatenate([[U64(0)], h[:-1]]), m) / w
        cell = passage * BUCKETS + (h & U64(BUCKETS - 1)).astype(np.int64)
        x[:, N_STATS:] = np.bincount(cell, minlength=m * BUCKETS).reshape(m, BUCKETS) / w[:, None]
    return x, begin


def _softmax(a: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Softmax within the runs that begin at ``begin``."""
    size = np.diff(begin)
    e = np.exp(a - np.repeat(np.maximum.reduceat(a, begin[:-1]), size))
    return e / np.repeat(np.add.reduceat(e, begin[:-1]), size)


@dataclass
class Attention:
    """shift and scale of inputs; w: embedding; v, u, a: the gated attention; c: the bag's score."""

    shift: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, begin: np.ndarray) -> tuple:
        p = self.params
        z = (x - self.shift) * self.scale
        e = np.tanh(z @ p["w"] + p["wb"])
        t = np.tanh(e @ p["v"])
        s = 1 / (1 + np.exp(-(e @ p["u"])))
        att = _softmax((t * s) @ p["a"], begin)
        bag = np.add.reduceat(e * att[:, None], begin[:-1])
        return z, e, t, s, att, bag, bag @ p["c"] + p["cb"][0]

    def score(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        if len(begin) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-self.forward(x, begin)[-1].astype(float)))

    def step(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss over the bags."""
        p = self.params
        z, e, t, s, att, bag, margin = self.forward(x, begin)
        size = np.diff(begin)
        d = (1 / (1 + np.exp(-margin)) - y) / len(y)
        d_bag = np.repeat(d, size)[:, None] * p["c"]
        d_att = (d_bag * e).sum(1)
        mean = np.repeat(np.add.reduceat(att * d_att, begin[:-1]), size)
        d_a = att * (d_att - mean)
        d_ts = d_a[:, None] * p["a"]
        d_t, d_s = d_ts * s * (1 - t**2), d_ts * t * s * (1 - s)
        d_e = (d_bag * att[:, None] + d_t @ p["v"].T + d_s @ p["u"].T) * (1 - e**2)
        return {"w": z.T @ d_e, "wb": d_e.sum(0), "v": e.T @ d_t, "u": e.T @ d_s, "a": (t * s).T @ d_a, "c": bag.T @ d, "cb": np.array([d.sum()])}


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> Attention:
    rng = np.random.default_rng(8)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    params = {"w": draw(WIDTH, HIDDEN), "wb": np.zeros(HIDDEN), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "a": draw(GATE), "c": draw(HIDDEN) * 0, "cb": np.zeros(1)}
    if not len(bags):
        return Attention(np.zeros(WIDTH), np.ones(WIDTH), params)
    x = np.concatenate(bags).astype(float)
    model = Attention(x.mean(0), 1 / (x.std(0) + 1e-3), params)
    begin = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    m1 = {k: np.zeros_like(v) for k, v in params.items()}
    m2 = {k: np.zeros_like(v) for k, v in params.items()}
    turn = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = STEP * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            rows = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in pick])
            grads = model.step(x[rows], np.concatenate([[0], np.cumsum(begin[pick + 1] - begin[pick])]), y[pick])
            turn += 1
            for k, g in grads.items():
                g = g + DECAY * params[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                params[k] -= rate * (m1[k] / (1 - 0.9**turn)) / (np.sqrt(m2[k] / (1 - 0.99**turn)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves no remainder by ``FOLDS``; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Attention:
    """A model from at most ``rows`` labelled documents outside the held-out fold."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    pairs = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in slices(batch, "text", SLICE):
                x, begin = encode_passages(buf, offs)
                vectors = pa.array([x[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([column(part, "doc_id").cast(pa.int64()), column(part, "quality").cast(pa.int32()), vectors], ["doc_id", "quality", "x"])

    got = pairs.mapInArrow(work, "doc_id bigint, quality int, x binary").toPandas().sort_values(["doc_id", "x"])
    bags = [np.frombuffer(b, dtype=np.float32).reshape(-1, WIDTH) for b in got["x"]]
    return train(bags, got["quality"].to_numpy(float))


def score(docs: DataFrame, model: Attention, out: str = "score") -> DataFrame:
    """``docs`` with the model's score of every whole text, in place of a column of that name."""
    docs = docs.drop(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in slices(batch, "text", SLICE):
                s = model.score(*encode_passages(buf, offs))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], [*part.schema.names, out])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: quality scores of all documents, learned outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
