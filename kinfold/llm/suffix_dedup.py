"""Removal of long repeated substrings by column-wise collection indexing.

The method inserts one symbol of every text a round, from the right, and keeps
the collection's suffix order, its Burrows-Wheeler column and the common
prefixes of neighbours, reading symbols and writing columns in sequential
files. Done over whole texts it takes as many passes over the collection as the
longest text has bytes. Only equal strings of a fixed length matter here, so
the texts are cut into short windows first, losslessly:

1. Each string of ``length`` symbols holds ``length - gram + 1`` grams; the gram
   of least hash (the last of equals) is its anchor. Equal strings have equal
   anchors at equal places. Consecutive starts with one anchor form a window,
   which holds all their strings (at most ``2 * length - gram`` symbols).
2. Windows whose anchor occurs once hold nothing that repeats. The others are
   grouped by content (128-bit hashes). If a window occurs twice, all its
   starts repeat.
3. Different windows with one anchor (one of each content) are indexed column by
   column, aligned at the anchor. The index's own columns are then read again:
   neighbours with a common prefix of ``length`` or more are repeated starts. An
   anchor with more than ``BLOCK`` different windows is not gathered: its strings
   are compared by 128-bit fingerprints in a distributed grouping.
4. What is known of a content goes to all windows that have it.

``BYTES`` are the strings that are cut out: 400 bytes that also start anywhere
else, same document included. ``PASSAGES`` are only counted: strings of 51 words
that also start in another document, whatever their bytes.

Null texts count as empty; texts shorter than a string lose nothing; rows with
equal id and text repeat each other wholly; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.kernels import SLICE_BYTES, U64, SpanHash, as_bytes, column, compressed, words
from kinfold.runtime import bound_batches, checkpoint, release_table, shuffles_released, stored


@dataclass(frozen=True)
class Kind:
    """Strings of ``length`` symbols, anchored by grams of ``gram``."""

    number: int
    length: int
    gram: int

    @property
    def span(self) -> int:
        """Grams in a string."""
        return self.length - self.gram + 1

    @property
    def left(self) -> int:
        """Most symbols of a window before its anchor; from the anchor on it has ``length`` at most."""
        return self.length - self.gram


BYTES = Kind(0, 400, 100)
PASSAGES = Kind(1, 51, 13)
KINDS = (BYTES, PASSAGES)
BLOCK = 4096
BATCH = 8192
CHUNK = 1 << 20

_PLACE = (1 << 24) - 1


def windows(symbols: np.ndarray, offs: np.ndarray, kind: Kind = BYTES) -> tuple[np.ndarray, ...]:
    """(row, start in its row, starts in the window, symbols before the anchor, anchor, w1, w2) of all windows."""
    if len(offs) == 2 and len(symbols) > CHUNK + kind.length:
        parts = []
        for at in range(0, len(symbols), CHUNK):
            piece = symbols[at : at + CHUNK + kind.length - 1]
            row, start, *rest = windows(piece, np.array([0, len(piece)]), kind)
            parts.append((row, start + at, *rest))
        return tuple(np.concatenate(x) for x in zip(*parts))
    size = np.diff(offs)
    fit = np.flatnonzero(size >= kind.length)
    count = size[fit] - kind.length + 1
    total = int(count.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(U64), none.astype(U64), none.astype(U64)
    before = np.concatenate([[0], np.cumsum(count)[:-1]])
    start = np.arange(total) + np.repeat(offs[fit] - before, count)
    one, two = SpanHash(symbols, 0), SpanHash(symbols, 1)
    at = np.arange(len(symbols) - kind.gram + 1)
    gram = one.of(at, at + kind.gram)
    key = (gram & ~U64(_PLACE)) | (U64(_PLACE) - at.astype(U64))
    blocks = -(-len(key) // kind.span) + 1
    padded = np.full(blocks * kind.span, np.iinfo(np.uint64).max, dtype=U64)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, kind.span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (U64(_PLACE) - (np.minimum(behind[start], ahead[start + kind.span - 1]) & U64(_PLACE))).astype(np.int64)
    opens = np.ones(total, dtype=bool)
    opens[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(opens)
    n = np.diff(np.append(first, total))
    s, a = start[first], anchor[first]
    end = s + n - 1 + kind.length
    row = np.searchsorted(offs, s, side="right") - 1
    return row, s - offs[row], n, a - s, gram[a], one.of(s, end), two.of(s, end)


def _symbols(buf: np.ndarray, offs: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets) of texts: their bytes, or their words' hashes."""
    if kind is BYTES:
        return buf, offs
    starts, ends, first = words(buf, offs)
    return SpanHash(buf).of(starts, ends), first


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end, texts) of bounded stretches of a batch's compressed texts."""
    opener = zstandard.ZstdDecompressor()
    texts: list[bytes] = []
    size = at = 0
    for i, raw in enumerate(column(batch, "body").to_pylist(), 1):
        texts.append(opener.decompress(raw))
        size += len(texts[-1])
        if size >= SLICE_BYTES or i == batch.num_rows:
            yield at, i, texts
            texts, size, at = [], 0, i


def _typed(schema: str) -> tuple[list[str], list[pa.DataType]]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return list(names), [kinds[t] for t in types]


OCCURRENCES = "kind int, row bigint, start int, n int, lead int, anchor bigint, w1 bigint, w2 bigint"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = _typed(OCCURRENCES)
    for batch in batches:
        rows = column(batch, "row").to_numpy()
        for a, b, texts in _opened(batch):
            buf, offs = as_bytes(pa.array(texts, pa.large_binary()))
            for kind in KINDS:
                row, start, n, lead, *hashes = windows(*_symbols(buf, offs, kind), kind)
                cols = [np.full(len(row), kind.number), rows[a:b][row], start, n, lead, *[h.view(np.int64) for h in hashes]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


# --- column-wise index ---------------------------------------------------


def _dealt(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in the order of their groups, group number by place in the order)."""
    order = np.argsort(group, kind="stable")
    fresh = np.ones(len(group), dtype=bool)
    fresh[1:] = group[order][1:] != group[order][:-1]
    return order, np.cumsum(fresh) - 1


def build_columns(group: np.ndarray, symbols: io.BytesIO, rounds: int, kinds: int) -> tuple[io.BytesIO, io.BytesIO]:
    """The files of the Burrows-Wheeler and the common-prefix columns, one column (int32) a round.

    Every round reads the next symbol to the left of every row and inserts it
    into the order: rows are dealt by (group, symbol), stably, so that equal
    symbols keep the order of what follows them; the common prefix of new
    neighbours is one more than the least over the old places between them.
    """
    m = len(group)
    bwt, prefixes = io.BytesIO(), io.BytesIO()
    order, deal = _dealt(group)
    deal = deal * kinds
    prefix = np.zeros(m, dtype=np.int32)
    for _ in range(rounds):
        symbol = np.frombuffer(symbols.read(4 * m), dtype=np.int32)[order]
        bwt.write(symbol.tobytes())
        key = deal + symbol
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        at = np.flatnonzero(key[1:] == key[:-1]) + 1
        fresh = np.zeros(m, dtype=np.int32)
        if len(at):
            # the least common prefix over the old places (earlier, later]
            lo, hi = moved[at - 1] + 1, moved[at] + 1
            near = hi - lo == 1
            fresh[at[near]] = prefix[lo[near]] + 1
            far = np.flatnonzero(~near)
            if len(far):
                edges = np.stack([lo[far], hi[far]], axis=1).ravel()
                fresh[at[far]] = np.minimum.reduceat(np.append(prefix, np.int32(0)), edges)[::2] + 1
        order, prefix = order[moved], fresh
        prefixes.write(prefix.tobytes())
    return bwt, prefixes


def repeated_starts(group: np.ndarray, rows: list[np.ndarray], lead: np.ndarray, n: np.ndarray, often: np.ndarray, low: np.ndarray, high: np.ndarray, kind: Kind) -> np.ndarray:
    """(windows, left + 1) flags: the string ``o`` symbols before the anchor repeats within its group.

    The order of every round is read off the Burrows-Wheeler file (a row's next
    place follows from the symbols in the places before it), runs of equal
    strings off the file of common prefixes.
    """
    m, left, right = len(rows), kind.left, kind.length
    distinct, codes = np.unique(np.concatenate(rows), return_inverse=True)
    table = np.zeros((left + right, m), dtype=np.int32)
    at = np.concatenate([np.arange(len(r)) + left - a for r, a in zip(rows, lead)])
    table[at, np.repeat(np.arange(m), [len(r) for r in rows])] = codes + 1
    symbols = io.BytesIO(table[::-1].tobytes())  # one column a round, in the order of the rounds
    del table
    bwt, prefixes = build_columns(group, symbols, left + right, len(distinct) + 1)
    bwt.seek(0)
    prefixes.seek(0)
    out = np.zeros((m, left + 1), dtype=bool)
    order, deal = _dealt(group)
    deal = deal * (len(distinct) + 1)
    for turn in range(left + right):
        order = order[np.argsort(deal + np.frombuffer(bwt.read(4 * m), dtype=np.int32), kind="stable")]
        prefix = np.frombuffer(prefixes.read(4 * m), dtype=np.int32)
        o = turn + 1 - right  # the suffixes now begin this many symbols before the anchor
        if o < 0:
            continue
        live = ((o <= lead) & (o > lead - n))[order]
        opens = prefix < kind.length
        begin = np.flatnonzero(opens)
        run = np.cumsum(opens) - 1
        if kind is BYTES:
            again = np.bincount(run, often[order] * live) >= 2
        else:
            again = np.minimum.reduceat(np.where(live, low[order], np.iinfo(np.int64).max), begin) < np.maximum.reduceat(np.where(live, high[order], -1), begin)
        out[order[live & again[run]], o] = True
    return out


CONTENT = "kind int, w1 bigint, w2 bigint, n int, lead int, often bigint, low bigint, high bigint"
WINDOWS = f"anchor bigint, salt int, part_of int, {CONTENT}, body binary"


def _cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The symbols of the wanted windows of each text."""
    names, kinds = _typed(WINDOWS)
    for batch in batches:
        wanted = column(batch, "wanted").to_pylist()
        for a, _, texts in _opened(batch):
            for i, text in enumerate(texts, a):
                held = [_symbols(*as_bytes(pa.array([text], pa.large_binary())), kind)[0] if any(w["kind"] == kind.number for w in wanted[i]) else None for kind in KINDS]
                rows = [(*[w[c] for c in names[:-1]], held[w["kind"]][w["start"] : w["start"] + w["n"] - 1 + KINDS[w["kind"]].length].tobytes()) for w in wanted[i]]
                for at in range(0, len(rows), BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + BATCH]), kinds)], names)


def _unpacked(body: bytes, kind: Kind) -> np.ndarray:
    return np.frombuffer(body, dtype=np.uint8 if kind is BYTES else U64)


MARKS = "w1 bigint, w2 bigint, off int, n int"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated stretches of the contents that don't repeat wholly; rows come sorted by kind and anchor."""
    held: list[tuple] = []
    names, kinds = _typed(MARKS)
    wanted = ("kind", "anchor", "w1", "w2", "n", "lead", "often", "low", "high", "body")

    def work(rows: list[tuple]) -> pa.RecordBatch:
        *cols, bodies = zip(*rows)
        number, group, w1, w2, n, lead, often, low, high = (np.array(c, dtype=np.int64) for c in cols)
        kind = KINDS[number[0]]
        flags = repeated_starts(group, [_unpacked(b, kind) for b in bodies], lead, n, np.minimum(often, 2), low, high, kind)
        flags[often > 1 if kind is BYTES else low < high] = False  # known already
        edge = np.diff(np.pad(flags[:, ::-1], ((0, 0), (1, 1))).astype(np.int8), axis=1)  # by ascending starts
        i, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)
        out = [w1[i], w2[i], lead[i] - kind.left + a, b - a]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    for batch in batches:
        for r in zip(*(column(batch, c).to_pylist() for c in wanted)):
            if held and (len(held) >= BATCH and held[-1][1] != r[1] or held[-1][0] != r[0]):
                yield work(held)
                held = []
            held.append(r)
    if held:
        yield work(held)


STRINGS = "f1 bigint, f2 bigint, kind int, w1 bigint, w2 bigint, off int, often bigint, low bigint, high bigint"


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A fingerprint of every string of the windows of crowded anchors."""
    names, kinds = _typed(STRINGS)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            number, n = (column(part, c).to_numpy() for c in ("kind", "n"))
            bodies = column(part, "body").to_pylist()
            for kind in KINDS:
                mine = np.flatnonzero(number == kind.number)
                if not len(mine):
                    continue
                held = [_unpacked(bodies[i], kind) for i in mine]
                offs = np.cumsum([0, *map(len, held)])
                row = np.repeat(np.arange(len(mine)), n[mine])
                off = np.arange(len(row)) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])
                s = offs[row] + off
                joined = np.concatenate(held)
                prints = [SpanHash(joined, lane).of(s, s + kind.length).view(np.int64) for lane in (0, 1)]
                rest = {c: column(part, c).to_numpy()[mine][row] for c in ("kind", "w1", "w2", "often", "low", "high")}
                cols = [*prints, rest["kind"], rest["w1"], rest["w2"], off, rest["often"], rest["low"], rest["high"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


# --- removal -------------------------------------------------------------


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, bodies in compressed(batch, "text"):
            yield pa.RecordBatch.from_arrays([column(part, "row"), column(part, "doc_id"), bodies], ["row", "doc_id", "body"])


CLEANED = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, n_passage_words bigint, kept_text string"


def _merged(spans: list[dict], kind: Kind) -> list[tuple[int, int]]:
    """Maximal runs of symbols (start, end) under the repeated strings of one kind."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["start"] + x["n"] - 1 + kind.length) for x in spans if x["kind"] == kind.number):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _remove(with_text: bool):
    names, kinds = _typed(CLEANED)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, found = (column(batch, c).to_pylist() for c in ("doc_id", "spans"))
            for at, _, texts in _opened(batch):
                rows = []
                for i, text in enumerate(texts, at):
                    cut, passages = (_merged(found[i] or [], kind) for kind in KINDS)
                    ends = [0, *[x for run in cut for x in run], len(text)]
                    rest = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
                    kept = rest.decode("utf-8", "ignore") if with_text else None
                    rows.append((doc_ids[i], len(text), len(text) - len(rest), len(cut), hashlib.sha256(rest).hexdigest(), len(passages), sum(b - a for a, b in passages), kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return work


def _repeats() -> Column:
    """Whether strings that occur ``often`` times, in rows from ``low`` to ``high``, repeat in the sense of their kind."""
    return F.when(F.col("kind") == BYTES.number, F.col("often") > 1).otherwise(F.col("low") < F.col("high"))


def _runs(offs: Column) -> Column:
    """Runs (off, n) of consecutive numbers of an ascending array."""
    none = F.array().cast("array<struct<off:int,n:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["off"].alias("off"), (last["n"] + 1).alias("n"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["off"] + F.try_element_at(acc, F.lit(-1))["n"] == x), longer).otherwise(
            F.concat(acc, F.array(F.struct(x.alias("off"), F.lit(1).alias("n"))))
        )

    return F.aggregate(offs, none, step)


def _spans(texts: DataFrame) -> DataFrame:
    """row and spans: the starts of repeated strings of every text that has any."""
    found = stored(texts.select("row", "body").mapInArrow(_occurrences, OCCURRENCES), "windows")
    shared = stored(found.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "shared")
    live = stored(found.join(shared, "anchor", "left_semi"), "live")
    release_table(texts.sparkSession, "windows")

    firsts = [F.first(c).alias(c) for c in ("kind", "anchor", "n", "lead", "row", "start")]
    classes = stored(live.groupBy("w1", "w2").agg(*firsts, F.count("*").alias("often"), F.min("row").alias("low"), F.max("row").alias("high")), "contents")
    met = classes.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1")
    salts = F.ceil(F.col("contents") / F.lit(float(BLOCK))).cast("int")
    wanted = classes.join(met, "anchor").withColumns({"part_of": salts, "salt": F.pmod(F.xxhash64("w1", "w2"), salts).cast("int")})
    each = F.struct("start", *[x.split()[0] for x in WINDOWS.split(", ")[:-1]])
    wanted = wanted.groupBy("row").agg(F.collect_list(each).alias("wanted"))
    cut = checkpoint(texts.join(wanted, "row").select("body", "wanted").mapInArrow(_cut_windows, WINDOWS).repartition("anchor", "salt").sortWithinPartitions("kind", "anchor"))
    few = cut.where("part_of = 1").mapInArrow(_index, MARKS)
    strings = cut.where("part_of > 1").mapInArrow(_fingerprints, STRINGS)
    again = strings.groupBy("f1", "f2").agg(F.first("kind").alias("kind"), F.sum("often").alias("often"), F.min("low").alias("low"), F.max("high").alias("high")).where(_repeats())
    many = strings.where(~_repeats()).join(again.select("f1", "f2"), ["f1", "f2"], "left_semi").groupBy("w1", "w2").agg(F.array_sort(F.collect_set("off")).alias("offs"))
    many = many.select("w1", "w2", F.explode(_runs(F.col("offs"))).alias("r")).select("w1", "w2", "r.off", "r.n")
    sure = classes.where(_repeats()).select("w1", "w2", F.lit(0).alias("off"), "n")

    marks = sure.unionByName(few).unionByName(many)
    spans = live.select("w1", "w2", "kind", "row", "start").join(marks, ["w1", "w2"]).select("row", F.struct("kind", (F.col("start") + F.col("off")).alias("start"), "n").alias("span"))
    return spans.groupBy("row").agg(F.collect_list("span").alias("spans"))


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words and kept_text of every row.

    ``kept_text`` drops characters that are cut in two, and is null unless ``with_text``.
    """
    bound_batches(documents.sparkSession)
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = stored(docs.mapInArrow(_squeeze, "row bigint, doc_id bigint, body binary"), "texts")
    with shuffles_released(documents.sparkSession):
        spans = _spans(texts)
    return texts.join(spans, "row", "left").select("doc_id", "body", "spans").mapInArrow(_remove(with_text), CLEANED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: what stays of every whole text, and what it holds of passages of over 50 words that other documents hold too."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept_text")


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
h as (select r, doc_id, hex(b) as x, octet_length(b) as n, w from d),
s as (select r, i, md5(substr(x, 2 * i - 1, 800)) as k from (select r, x, unnest(range(1, n - 398)) as i from h where n >= 400)),
hit as (select r, i from (select r, i, count(*) over (partition by k) as c from s) where c > 1),
run as (select r, min(i) as a, max(i) + 400 as z from (select r, i, sum(fresh) over (partition by r order by i) as g
    from (select r, i, case when i - lag(i) over (partition by r order by i) <= 400 then 0 else 1 end as fresh from hit)) group by r, g),
cut as (select r, count(*) as n_spans, sum(z - a)::bigint as n_removed, list(a order by a) as a, list(z order by a) as z from run group by r),
kept as (select h.r, h.doc_id, h.n, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
    case when a is null then x else substr(x, 1, 2 * (a[1] - 1)::bigint)
        || array_to_string(list_transform(range(1, len(a) + 1), lambda i: substr(x, (2 * z[i] - 1)::bigint, case when i < len(a) then 2 * (a[i + 1] - z[i])::bigint else 2 * h.n end)), '') end as rest
    from h left join cut using (r)),
ws as (select r, i, md5(array_to_string(w[i:i + 50], ' ')) as k from (select r, w, unnest(range(1, len(w) - 49)) as i from h where len(w) >= 51)),
wk as (select k from ws group by k having min(r) < max(r)),
wrun as (select r, min(i) as a, max(i) + 51 as z from (select r, i, sum(fresh) over (partition by r order by i) as g
    from (select r, i, case when i - lag(i) over (partition by r order by i) <= 51 then 0 else 1 end as fresh from ws join wk using (k))) group by r, g),
passages as (select r, count(*) as n_passages, sum(z - a)::bigint as n_passage_words from wrun group by r)
select doc_id, n as n_bytes, n_removed, n_spans, sha256(unhex(rest)) as kept_sha256, coalesce(n_passages, 0) as n_passages, coalesce(n_passage_words, 0)::bigint as n_passage_words
from kept left join passages using (r)
"""
