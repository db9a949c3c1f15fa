"""Secret scan over an incremental blob ledger, in DataFrame functions only.

Every version of a path is addressed by the SHA-256 of its content. Only the
(blob, rule version) pairs that the ledger has not seen are scanned; findings
are kept per blob and joined back to every path that holds it. A rule version
is a digest of the rules, so changed rules never meet older findings. A regular
expression's matches are placed by splitting the text at them: the lengths of
the pieces between and of the matches add up to code-point offsets, so no
Python is needed on the way.

Null texts count as empty, rows with equal content share one scan, a null or
repeated id keeps its row, an empty table gives an empty result, and columns
beside the named ones are carried through; one named as the new column gives
way to it. A blob that was recorded twice (a retried or concurrent append)
counts once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.runtime import scratch_table

WORD = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"


@dataclass(frozen=True)
class Rule:
    """One kind of span. ``group``/``least``: a match counts if that group is as long; ``hint``: a cheap test that any match passes."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    hint: str = ""


RULES = (
    Rule("assign", WORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}", hint="AKIA"),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
)
BASE = ("assign", "access", "hex")
STRIDE = 256  # matches that are placed together
LEDGER = "spark.kinfold.secretLedger"  # names the ledger that registered runs go on with
SPAN = "array<struct<s:bigint,k:int,e:bigint>>"


def _spans(text: Column, rule: Rule, k: int) -> Column:
    """Spans of one rule as array<struct<s, k, e>> in code points."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    cells = F.arrays_zip(found.alias("m"), gaps.alias("g"), *([F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("v")] if rule.group else []))
    keep = (lambda c: F.length(c["v"]) >= rule.least) if rule.group else (lambda c: F.lit(True))
    none = F.array().cast(SPAN)

    def step(acc: Column, c: Column) -> Column:
        s = acc["at"] + F.length(c["g"])
        e = s + F.length(F.coalesce(c["m"], F.lit("")))
        one = F.array(F.struct(s.cast("bigint").alias("s"), F.lit(k).alias("k"), e.cast("bigint").alias("e")))
        ok = c["m"].isNotNull() & keep(c)
        return F.struct(e.cast("bigint").alias("at"), F.when(ok, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def stride(acc: Column, part: Column) -> Column:
        now = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(now["at"].alias("at"), F.concat(acc["out"], F.array(now["out"])).alias("out"))

    # strides keep the copying of growing arrays short
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(cells) - 1) / STRIDE).cast("int")), lambda i: F.slice(cells, i * STRIDE + 1, STRIDE))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    test = F.contains(text, F.lit(rule.hint)) if rule.hint else F.lit(True)
    return F.when(test & text.rlike(rule.pattern), F.aggregate(parts, start, stride, lambda acc: F.flatten(acc["out"]))).otherwise(none)


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of the rules, ordered by start, then by the rules' order."""
    return F.array_sort(F.concat(*[_spans(text, r, k) for k, r in enumerate(rules)]))


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class BlobLedger:
    """The (blob, rule version) pairs scanned so far, with their findings, as Parquet under ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        if self.path is None:
            return None
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.spark.read.parquet(self.path) if fs.exists(p) else None

    def scan(self, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, spans) of every blob of ``versions`` that has a finding; blobs unseen under these rules are scanned and recorded."""
        version = rule_version(rules)
        blobs = versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("body"))
        seen = self.read()
        if seen is not None:
            blobs = blobs.join(seen.where(F.col("rules") == version).select("blob"), "blob", "left_anti")
        once = blobs.groupBy("blob").agg(F.first("body").alias("body"))
        fresh = once.select("blob", find_spans(F.col("body"), rules).alias("spans"))
        if self.path is None:
            return fresh.where(F.size("spans") > 0)
        fresh.select("blob", F.lit(version).alias("rules"), "spans").write.mode("append").parquet(self.path)
        done = self.spark.read.parquet(self.path).where((F.col("rules") == version) & (F.size("spans") > 0)).dropDuplicates(["blob"])
        here = versions.select(address(F.col(text)).alias("blob")).distinct()
        return done.select("blob", "spans").join(here, "blob", "left_semi")


def run_ledger(spark: SparkSession) -> BlobLedger:
    """The ledger that the session names, else a fresh one in the shared folder."""
    return BlobLedger(spark, spark.conf.get(LEDGER, None) or scratch_table(spark, "ledger"))


def scan_secrets(versions: DataFrame, text: str = "text", ledger: BlobLedger | None = None, spans: str = "spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with a column ``spans`` of array<struct<s, k, e>> (k indexes ``rules``), in place of one of that name."""
    ledger = ledger or run_ledger(versions.sparkSession)
    found = ledger.scan(versions, text, rules).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    marked = versions.withColumn("__blob", address(F.col(text))).drop(*{spans} - {text})
    return marked.join(found, "__blob", "left").withColumn(spans, F.coalesce("__spans", F.array().cast(SPAN))).drop("__blob", "__spans")


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(versions: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``versions`` with every finding (overlaps merged) replaced by ``mark``."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    body = F.col(text)

    def step(acc: Column, x: Column) -> Column:
        ahead = F.concat(acc["out"], F.substring(body, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], ahead).otherwise(acc["out"]).alias("out"))

    def end(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(body, (acc["at"] + 1).cast("int"), F.length(body)))

    spans = F.col("__found")
    out = scan_secrets(versions, text, spans="__found")
    out = out.withColumn("__body", F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, end)).otherwise(body))
    return out.select(*[F.col("__body").alias(c) if c == text else F.col(c) for c in versions.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every whole text of documents, base kinds counted and digested, all spans listed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs)
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda x: x["k"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)],
        F.sha2(span_text(F.filter(spans, lambda x: x["k"] < len(BASE))), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
    )


def _oracle() -> str:
    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        values = f"regexp_extract_all(t, '{p}', {r.group})"
        test = f"length(v[i]) >= {r.least}" if r.group else "true"
        parts.append(
            f"select rid, '{r.kind}' kind, {k} k, s, s + length(m[i]) e from (select rid, m, v, i, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as bigint) s "
            f"from (select rid, m, v, g, unnest(range(1, len(m) + 1)) i from (select rid, regexp_extract_all(t, '{p}') m, {values} v, string_split_regex(t, '{p}') g from d where regexp_matches(t, '{p}')))) where {test}"
        )
    body = " union all ".join(parts)
    return (
        "with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents), "
        f"f as ({body}), "
        "a as (select rid, count(*) filter (k = 0) n_assign, count(*) filter (k = 1) n_access, count(*) filter (k = 2) n_hex, "
        "coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (k < 3), '') base, "
        "string_agg(kind || ':' || s || ':' || e, ',' order by s, k) spans from f group by rid) "
        "select doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex, "
        "sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join a using (rid)"
    )


ORACLE = _oracle()
