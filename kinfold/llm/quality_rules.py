"""Quality rules: base counts and gradient-boosted trees over document statistics.

Statistics come from whole texts by byte kernels. The trees are grown on
histogram bins of a bounded sample of labelled rows (``TRAIN_ROWS``), with
monotonic constraints: on the features of ``FALLING`` a document's score can
only fall as the statistic grows. A fitted model is a set of flat node arrays
(feature, threshold, children, value), scored for all rows and trees at once.

Null texts have no words and fail the base rules; without labelled rows the
verdict is the base rules' alone; repeated rows are judged alike; other columns
are carried through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.kernels import U64, SpanHash, column, mix, slices, words
from kinfold.runtime import bound_batches

TRAIN_ROWS = 5000
TREES, DEPTH, BINS, RATE, LEAST = 60, 4, 32, 0.15, 20
KEEP_AT = 0.5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_UPPER = _table(bytes(range(65, 91)))
_LOWER = _table(bytes(range(97, 123)))
_DIGIT = _table(b"0123456789")
_STOP = _table(b".!?;:,")
_BANG = _table(b"!?")
_TAIL = np.zeros(256, dtype=bool)
_TAIL[0x80:0xC0] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "stops", "bangs", "beyond_ascii", "distinct", "line_words", "repeat_bytes")
FALLING = ("symbols", "dup_lines", "repeats", "digits", "bangs")


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more, is not the first) for each key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, dtype=bool)
    same[1:-1] = k[1:] == k[:-1]
    twice, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def statistics(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base counts (n, 5), features (n, len(FEATURES))) of every text."""
    n = len(offs) - 1
    starts, ends, first = words(buf, offs)
    row = np.repeat(np.arange(n), np.diff(first))
    spans = SpanHash(buf)
    h = spans.of(starts, ends)
    salt = mix(row.astype(np.uint64) + U64(1))
    n_words = np.diff(first)
    inside = np.zeros(len(buf) + 1, dtype=np.int8)
    inside[starts] += 1
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    char = ~_TAIL[buf]
    word_chars = _per_row(inside & char, offs)
    n_symbols = _per_row(_SYMBOL[buf], offs)

    breaks = np.flatnonzero(buf == 10)
    line_at = np.union1d(offs[:-1][np.diff(offs) > 0], breaks + 1)
    line_at = line_at[line_at < len(buf)]
    line_row = np.searchsorted(offs, line_at, side="right") - 1
    line_to = np.minimum(np.append(line_at[1:], len(buf)), offs[line_row + 1])
    closed = np.zeros(len(buf) + 1, dtype=bool)
    closed[breaks + 1] = True
    line_to = line_to - (closed[line_to] & (line_to > line_at))
    has = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_at)
    line_at, line_to, line_row = line_at[has], line_to[has], line_row[has]
    _, again = _repeated(spans.of(line_at, line_to) ^ mix(line_row.astype(np.uint64) + U64(1)))
    n_lines = np.bincount(line_row, minlength=n)
    n_dup = np.bincount(line_row[again], minlength=n)

    mark = np.zeros(len(h), dtype=bool)
    if len(h) > 2:
        tri = mix(h[:-2] * U64(3) + mix(h[1:-1]) * U64(5) + mix(mix(h[2:])) * U64(7)) ^ salt[:-2]
        whole = row[:-2] == row[2:]
        at = np.flatnonzero(whole)
        hit = at[_repeated(tri[at])[0]]
        mark[hit] = mark[hit + 1] = mark[hit + 2] = True
    n_repeat = np.bincount(row[mark], minlength=n)
    distinct = np.bincount(row[~_repeated(h ^ salt)[1]], minlength=n) if len(h) else np.zeros(n, int)

    base = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], axis=1).astype(np.int64)
    w = np.maximum(n_words, 1)
    chars = np.maximum(_per_row(char, offs), 1)
    letters = np.maximum(_per_row(_UPPER[buf] | _LOWER[buf], offs), 1)
    feats = np.stack(
        [np.log1p(n_words), word_chars / w, n_symbols / w, n_dup / np.maximum(n_lines, 1), n_repeat / w, _per_row(_UPPER[buf], offs) / letters, _per_row(_DIGIT[buf], offs) / chars,
         _per_row(_STOP[buf], offs) / w, _per_row(_BANG[buf], offs) / w, _per_row(buf >= 0xC0, offs) / chars, distinct / w, n_words / np.maximum(n_lines, 1),
         _per_row(np.concatenate([[False], buf[1:] == buf[:-1]]) if len(buf) else buf.astype(bool), offs) / chars],
        axis=1,
    )
    return base, feats


# --- boosted trees -------------------------------------------------------


@dataclass
class Trees:
    """Flat node arrays of all trees; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.prior)
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            down = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(down, self.left[at], self.right[at])
        return self.prior + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = TREES) -> Trees:
    """Boost logistic loss; ``signs`` holds -1 where the score may only fall with the feature, +1 where only rise."""
    rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    prior = float(np.log(rate / (1 - rate)))
    nodes: list[list] = []
    roots: list[int] = []
    if len(np.unique(y)) == 2:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), prior)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(len(nodes))
            _grow(nodes, bins, cuts, y - p, p * (1 - p), signs, np.arange(len(y)), 0, -np.inf, np.inf, margin)
    cols = list(zip(*nodes)) if nodes else [()] * 5
    kinds = (np.int64, float, np.int64, np.int64, float)
    return Trees(*[np.array(c, dtype=k) for c, k in zip(cols, kinds)], np.array(roots, dtype=np.int64), prior)


def _grow(nodes, bins, cuts, grad, hess, signs, rows, depth, low, high, margin) -> int:
    """Add the best subtree over ``rows`` whose leaves stay within low and high."""
    me = len(nodes)
    g, h = grad[rows].sum(), hess[rows].sum()
    leaf = float(np.clip(g / (h + 1.0), low, high))
    nodes.append([0, np.inf, me, me, RATE * leaf])
    best = (1e-6, -1, -1, 0.0)
    if depth < DEPTH and len(rows) >= 2 * LEAST:
        for f, cut in enumerate(cuts):
            size = len(cut) + 1
            b = bins[rows, f]
            gs = np.cumsum(np.bincount(b, grad[rows], size))[:-1]
            hs = np.cumsum(np.bincount(b, hess[rows], size))[:-1]
            ns = np.cumsum(np.bincount(b, minlength=size))[:-1]
            if not len(gs):
                continue
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            lv, rv = np.clip(gs / (hs + 1), low, high), np.clip((g - gs) / (h - hs + 1), low, high)
            bad = (ns < LEAST) | (len(rows) - ns < LEAST) | (signs[f] * (rv - lv) < 0)
            gain[bad] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k, (lv[k] + rv[k]) / 2)
    _, f, k, mid = best
    if f < 0:
        margin[rows] += RATE * leaf
        return me
    down = bins[rows, f] <= k
    bounds = ((low, high), (low, high))
    if signs[f] < 0:
        bounds = ((mid, high), (low, mid))
    elif signs[f] > 0:
        bounds = ((low, mid), (mid, high))
    left = _grow(nodes, bins, cuts, grad, hess, signs, rows[down], depth + 1, *bounds[0], margin)
    right = _grow(nodes, bins, cuts, grad, hess, signs, rows[~down], depth + 1, *bounds[1], margin)
    nodes[me] = [f, float(cuts[f][k]), left, right, 0.0]
    return me


# --- distribution --------------------------------------------------------


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees from at most ``rows`` labelled documents, drawn by the hash of their ids."""
    drawn = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    pairs = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("quality", "text")
    width = len(FEATURES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in slices(batch, "text"):
                _, x = statistics(buf, offs)
                values = pa.array(list(x), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([column(part, "quality").cast(pa.int32()), values], ["quality", "x"])

    got = pairs.mapInArrow(work, "quality int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, width)
    y = got["quality"].to_numpy(float)
    order = np.lexsort([*x.T, y])  # the same model whatever order the rows came in
    signs = np.array([-1 if f in FALLING else 0 for f in FEATURES])
    return fit_trees(x[order], y[order], signs)


VERDICT = (*[(b, T.LongType(), pa.int64()) for b in BASE], ("base_failed", T.BooleanType(), pa.bool_()), ("kept", T.BooleanType(), pa.bool_()), ("score", T.DoubleType(), pa.float64()))


def judge(docs: DataFrame, trees: Trees, prefix: str = "", keep_at: float = KEEP_AT) -> DataFrame:
    """``docs`` with the base counts and the verdict, in place of columns of those names; the names begin with ``prefix``."""
    bound_batches(docs.sparkSession)
    docs = docs.drop(*[prefix + v for v, _, _ in VERDICT])
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in slices(batch, "text"):
                base, x = statistics(buf, offs)
                failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
                score = trees.score(x)
                cols = [*base.T, failed, ~failed & (score >= keep_at), score]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, k) for c, (_, _, k) in zip(cols, VERDICT)]], [*names, *[prefix + v for v, _, _ in VERDICT]])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(prefix + v, k) for v, k, _ in VERDICT]])
    return docs.mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: base counts and verdict of every whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trees = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, trees).drop("text")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return judge(docs, fit(docs, labels), "__").where(F.col("__kept")).select(*docs.columns)
