"""Vectorised byte kernels over Arrow text columns.

A batch's texts are read as one contiguous UTF-8 buffer with offsets, cut into
slices of about ``SLICE_BYTES`` (a longer text is a slice of its own), so the
temporaries of a task stay bounded whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) on uint64 arrays."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def row_key(*columns: Column) -> Column:
    """128 bits that tell rows apart by the named columns; null and empty differ."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\u0001", *parts)))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def as_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buffer, offsets) of a text or binary array; null counts as empty."""
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = pc.fill_null(arr, b"")
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    lo, hi = int(offs[0]), int(offs[-1])
    buf = np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return buf, offs - lo


def slices(batch: pa.RecordBatch, name: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, buffer, offsets) of runs of rows of about ``size`` bytes."""
    buf, offs = as_bytes(column(batch, name))
    n, at = batch.num_rows, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at), buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the runs of non-space bytes; ``first[d]`` counts the words before row d."""
    n = len(buf)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~SPACE[buf]
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] = inside[1:-1][edge]
    stops[edge - 1] = inside[1:-1][edge - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offs)


class SpanHash:
    """Polynomial hashes of any span of bytes, or of 64-bit symbols, from one prefix sum.

    Arithmetic is modulo 2**64 with an odd base, so dividing by a power of the
    base is a multiplication; equal spans give equal hashes wherever they lie.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, buf: np.ndarray, lane: int = 0):
        self.lane = lane
        if buf.dtype == np.uint8:
            values = np.random.default_rng(90210 + lane).integers(0, 2**64, 256, dtype=np.uint64)[buf]
        else:
            values = mix(buf + U64(90210 + lane))
        up, self.down = self._power(lane, len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(buf)], out=self.sums[1:])

    @classmethod
    def _power(cls, lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(lane)
        if have is None or len(have[0]) < n:
            base = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)[lane]
            size = max(n, SLICE_BYTES + 1)
            out = []
            for b in (base, pow(base, -1, 2**64)):
                steps = np.full(size, b, dtype=np.uint64)
                steps[0] = 1
                out.append(np.multiply.accumulate(steps))
            have = cls._powers[lane] = (out[0], out[1])
        return have

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * U64(0xA24BAED4963EE407))


def compressed(batch: pa.RecordBatch, name: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(rows, their texts as zstd frames), a bounded stretch at a time; null counts as empty."""
    press = zstandard.ZstdCompressor(level=1)
    for part, buf, offs in slices(batch, name):
        raw = memoryview(buf)
        at = offs.tolist()
        yield part, pa.array([press.compress(raw[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())


FEW_ROWS = 24  # a member of so many sets adds its pairs one by one


def shared_counts(rows: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """(n, n): how many members each two of n sets share; (rows, h) lists the sets' members."""
    _, col, times = np.unique(h, return_inverse=True, return_counts=True)
    often = times[col] > 1
    _, col = np.unique(col[often], return_inverse=True)
    rows = rows[often]
    out = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    rows = rows[order]
    size = np.bincount(col)
    begin = np.cumsum(size) - size
    for k in range(2, FEW_ROWS + 1):  # members of k sets: their pairs
        at = begin[size == k]
        for part in np.array_split(at, max(1, len(at) * k * k >> 21)):
            held = rows[part[:, None] + np.arange(k)]
            np.add.at(out, (held[:, :, None], held[:, None, :]), np.float32(1))
    wide = np.flatnonzero(size > FEW_ROWS)
    for at in range(0, len(wide), 2048):  # the others: products of stripes of the incidence matrix
        part = wide[at : at + 2048]
        cell = np.repeat(np.arange(len(part)), size[part])
        held = rows[np.arange(len(cell)) + np.repeat(begin[part] - (np.cumsum(size[part]) - size[part]), size[part])]
        stripe = np.zeros((n, len(part)), dtype=np.float32)
        stripe[held, cell] = 1
        out += stripe @ stripe.T
    return out
