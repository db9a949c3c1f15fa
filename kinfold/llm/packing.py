"""Packing documents into sequences along a space-filling curve.

A document's hashed word vector is projected to ``DIMS`` dimensions, each is
cut into cells, and the cells' Hilbert key orders the documents: neighbours on
the curve have similar words. The curve is divided into ranges of about equal
bytes (a first pass sums the bytes of ``1 << STRETCH_BITS`` stretches of it), rows
are sorted by key within their range and laid end to end in sequences of
``SEQUENCE`` ids; documents are cut where a sequence ends. What is left at a
range's end goes into sequences whose lengths are powers of two, so no sequence
needs padding.

A stretch with more bytes than a range (many copies, say) is shared out among
several ranges by a hash of id and text, so no range grows with a hot key;
only rows equal in both stay together, and a range is streamed.

Null texts hold the end id alone; texts without words have the key of the zero
vector; equal keys are ordered by id and content; repeated rows are packed
each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.encoding import BYTES_FILE, SLICE, encoder, public_path
from kinfold.llm.kernels import U64, SpanHash, column, mix, slices, words
from kinfold.llm.token_files import with_end
from kinfold.runtime import bound_batches

SEQUENCE = 2048
END_ID = 1
DIMS = 4
CELL_BITS = 12
STRETCH_BITS = 16
RANGE_BYTES = (4 << 20, 256 << 20)  # least of a range, and most whatever the session's number of partitions
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def hilbert_key(cells: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    """Positions on the Hilbert curve of points with integer coordinates (n, dims).

    The coordinates are brought into the curve's transposed form by undoing the
    reflections and exchanges level by level, then their bits are interleaved.
    """
    x = cells.astype(np.int64).copy()
    n, dims = x.shape
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for d in range(dims):
            on = (x[:, d] & level) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] = np.where(on, x[:, 0] ^ low, x[:, 0] ^ swap)
            if d:
                x[:, d] ^= swap
        level >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(n, dtype=np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where((x[:, dims - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flip[:, None]
    key = np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> b) & 1)
    return key


def curve_keys(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Hilbert key of each text's hashed word vector, projected by signs drawn from the words' hashes."""
    starts, ends, first = words(buf, offs)
    h = mix(SpanHash(buf).of(starts, ends))
    cells = np.zeros((len(offs) - 1, DIMS), dtype=np.int64)
    count = np.maximum(np.diff(first), 1)
    for d in range(DIMS):
        sign = ((h >> U64(d)) & U64(1)).astype(np.int64) * 2 - 1
        total = np.concatenate([[0], np.cumsum(sign)])
        z = (total[first[1:]] - total[first[:-1]]) / np.sqrt(count) / 4  # the sum of random signs has this scale
        cells[:, d] = np.clip((np.tanh(z) + 1) / 2 * (1 << CELL_BITS), 0, (1 << CELL_BITS) - 1)
    return hilbert_key(cells)


def _stretch(keys: np.ndarray) -> np.ndarray:
    return keys >> (DIMS * CELL_BITS - STRETCH_BITS)


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes in each stretch of the curve, one more for every row, once a task."""
    total = np.zeros(1 << STRETCH_BITS, dtype=np.int64)
    for batch in batches:
        for _, buf, offs in slices(batch, "text"):
            np.add.at(total, _stretch(curve_keys(buf, offs)), np.diff(offs) + 1)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["stretch", "size"])


def range_of(keys: np.ndarray, share: np.ndarray, sizes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each row: by its stretch, and by ``share`` (0 to 1) within the stretch."""
    ends = np.cumsum(sizes)
    at = _stretch(keys)
    place = (ends[at] - sizes[at]) + share * sizes[at]
    return np.clip(place * ranges / max(int(ends[-1]), 1), 0, ranges - 1).astype(np.int32)


def _add_keys(sizes: np.ndarray, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in slices(batch, "text"):
                keys = curve_keys(buf, offs)
                ids = column(rows, "doc_id").fill_null(0).to_numpy().astype(np.int64).view(U64)
                drawn = mix(SpanHash(buf).of(offs[:-1], offs[1:]) ^ mix(ids)).astype(np.float64) / 2.0**64
                out = [column(rows, "doc_id"), column(rows, "text"), pa.array(keys, pa.int64()), pa.array(range_of(keys, drawn, sizes, ranges), pa.int32())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "text", "curve", "range"])

    return run


def _tails(length: int) -> list[int]:
    """Powers of two that add up to ``length``, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def _pack(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path, True)
        sequence = TaskContext.get().partitionId() << 32
        wait_ids = np.zeros(0, np.uint32)  # less than a sequence, with where it comes from
        wait: list[list] = []  # doc_id, start, length, doc_tokens

        def cut(ids: np.ndarray, runs: list[list], lengths: list[int]) -> pa.RecordBatch:
            nonlocal sequence
            rows: list[tuple] = []
            k = at = used = 0
            for size in lengths:
                offset = 0
                while offset < size:
                    doc, begin, length, total = runs[k]
                    n = min(size - offset, length - used)
                    rows.append((doc, begin + used, n, zlib.crc32(ids[at : at + n]), total, sequence, offset))
                    at, offset, used = at + n, offset + n, used + n
                    if used == length:
                        k, used = k + 1, 0
                sequence += 1
            wait[:] = [[runs[k][0], runs[k][1] + used, runs[k][2] - used, runs[k][3]], *runs[k + 1 :]] if k < len(runs) else []
            cols = list(zip(*rows)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for rows, buf, offs in slices(batch, "text", SLICE):
                ids, to = with_end(*enc.encode(buf, offs), END_ID)
                n = np.diff(to).tolist()
                runs = wait + [[d, 0, m, m] for d, m in zip(column(rows, "doc_id").to_pylist(), n)]
                ids = np.concatenate([wait_ids, ids]).astype("<u4")
                full = len(ids) // SEQUENCE
                yield cut(ids, runs, [SEQUENCE] * full)
                wait_ids = ids[full * SEQUENCE :]
        yield cut(wait_ids, list(wait), _tails(len(wait_ids)))

    return run


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The pieces of every document of ``docs`` (doc_id, text) in sequences along the curve."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = np.zeros(1 << STRETCH_BITS, dtype=np.int64)
    for r in rows.select("text").mapInArrow(_weigh, "stretch bigint, size bigint").groupBy("stretch").agg(F.sum("size").alias("size")).collect():
        sizes[r["stretch"]] = r["size"]
    least, most = (-(-int(sizes.sum()) // x) for x in RANGE_BYTES)
    ranges = max(1, min(least, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), most)))
    keyed = rows.mapInArrow(_add_keys(sizes, ranges), "doc_id bigint, text string, curve bigint, range int")
    dealt = keyed.repartitionById(ranges, "range").sortWithinPartitions("curve", "doc_id", F.xxhash64("text"))
    return dealt.select("doc_id", "text").mapInArrow(_pack(tokenizer or public_path(BYTES_FILE)), PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the pieces of all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
