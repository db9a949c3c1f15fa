"""Token ids in directly addressable codes.

A block splits every id into 8-bit chunks. Level 0 holds the low chunk of all
ids, level k the k-th chunk of those ids that have one; a bitmap a level marks
the ids that go on, and a directory of ranks (one count per 512 bits) finds
their place in the next level. Any id is thus read by itself, without decoding
its neighbours. A block also holds its documents' ids and starts.

Block layout, little-endian: magic, counts (documents, ids, levels), document
ids (int64, with a byte mask for nulls), starts (int64, one more than documents),
then for each level: count, chunks (uint8), bitmap (uint8), ranks (uint32).

Null texts hold the end id alone; equal doc_ids stay apart, ordered by content;
null doc_ids come first; an empty table gives an empty file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.encoding import SLICE, WORDS_FILE, encoder, public_path
from kinfold.llm.kernels import column, slices
from kinfold.runtime import bound_batches, scratch_table

MAGIC = b"DAC1"
RANK_BITS = 512
END_ID = 2
BLOCK_IDS = 1 << 20
TABLE = "part int, seq int, part_start bigint, n_ids bigint, block binary"


def write_block(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64))]) if len(more) else np.zeros(1, np.int64)
        levels.append(struct.pack("<q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u4").tobytes())
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    head = MAGIC + struct.pack("<qqi", len(doc_ids), len(ids), len(levels))
    return b"".join([head, keys.tobytes(), null.tobytes(), starts.astype("<i8").tobytes(), *levels])


class Block:
    """Random access to the ids of one block."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        n_docs, self.n_ids, n_levels = struct.unpack_from("<qqi", raw, 4)
        at = 24

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype=dtype, count=n, offset=at)
            at += out.nbytes
            return out

        keys, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else int(k) for k, z in zip(keys, null)]
        self.starts = take("<i8", n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<i8", 1)[0])
            self.levels.append((take("u1", n), take("u1", -(-n // 8)), take("<u4", -(-n // RANK_BITS) + 1)))

    def rank(self, level: int, i: int) -> int:
        """Marked ids of the level before its i-th."""
        _, bits, ranks = self.levels[level]
        block = i // RANK_BITS
        tail = np.unpackbits(bits[block * RANK_BITS // 8 : -(-i // 8)], bitorder="little")[: i - block * RANK_BITS]
        return int(ranks[block]) + int(tail.sum())

    def access(self, i: int) -> int:
        """The i-th id."""
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            i = self.rank(level, i)
        return value

    def read(self, lo: int, hi: int, level: int = 0) -> np.ndarray:
        """ids lo to hi, by a slice of each level."""
        chunks, bits, _ = self.levels[level]
        out = chunks[lo:hi].astype(np.uint32)
        more = np.unpackbits(bits[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
        if more.any():
            begin = self.rank(level, lo)
            out[more] |= self.read(begin, begin + int(more.sum()), level + 1) << np.uint32(8)
        return out


def with_end(ids: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' ids with ``end`` after each row."""
    return np.insert(ids, offs[1:], end).astype(np.uint32), offs + np.arange(len(offs))


def _encode_blocks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, done = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, done, size
            starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            raw = write_block(keys, starts, np.concatenate(held))
            row = [[part], [seq], [done], [size], [raw]]
            seq, done, size = seq + 1, done + size, 0
            keys.clear(), held.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["part", "seq", "part_start", "n_ids", "block"])

        enc = encoder(path, False)
        for batch in batches:
            for rows, buf, offs in slices(batch, "text", SLICE):
                ids, to = with_end(*enc.encode(buf, offs), END_ID)
                keys += column(rows, "doc_id").to_pylist()
                held.append(ids)
                counts.append(np.diff(to))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield flush()
        if keys:
            yield flush()

    return run


def write_token_table(docs: DataFrame, out: str, tokenizer: str | None = None) -> None:
    """Write ``docs`` (doc_id, text) as blocks in ascending doc_id order under ``out``."""
    bound_batches(docs.sparkSession)
    # the columns are bound to plain names before the order is set, so that other columns can't clash
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_encode_blocks(tokenizer or public_path(WORDS_FILE)), TABLE).write.parquet(out)


def read_token_table(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the blocks."""
    table = spark.read.schema(TABLE).parquet(path)
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row a written part
    base, total = {}, 0
    for r in parts:
        base[r["part"]] = total
        total += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, part_start, raw in zip(*(column(batch, c).to_pylist() for c in ("part", "part_start", "block"))):
                block = Block(raw)
                starts = block.starts
                ids = block.read(0, block.n_ids).astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                cols = (block.doc_ids, starts[:-1] + part_start + base[part], np.diff(starts), crc)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.select("part", "part_start", "block").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every whole text, written as blocks and read back."""
    out = scratch_table(spark, "tokens")
    write_token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), out)
    return read_token_table(spark, out)
