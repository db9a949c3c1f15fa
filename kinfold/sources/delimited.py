"""References and truth sets from delimited text, and references from any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.config import Parameters

RAW = "\u0001"  # a separator that no line holds, so that a line stays whole


def _lines(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """The file's lines as one column ``line``; each file's first line is dropped if it is a header."""
    reader = spark.read.option("sep", RAW).option("quote", "").option("escape", "").option("header", header).option("enforceSchema", True)
    return reader.schema("line string").csv(path)


def read_references(spark: SparkSession, path: str, p: Parameters) -> DataFrame:
    """(ref_id, body): the id stands before the first delimiter, the body is the rest, unparsed.

    Lines without a delimiter are left to ``rejected_lines``.
    """
    line = F.trim("line")
    at = F.instr(line, p.separator)
    rows = _lines(spark, path, p.hasHeader).where(at > 0)
    return rows.select(F.upper(F.trim(F.substring_index(line, p.separator, 1))).alias("ref_id"), F.substring(line, at + F.lit(1), F.length(line)).alias("body"))


def rejected_lines(spark: SparkSession, path: str, p: Parameters) -> DataFrame:
    """Lines that hold no delimiter and so no id."""
    return _lines(spark, path, p.hasHeader).where((F.instr(F.trim("line"), p.separator) == 0) & (F.length(F.trim("line")) > 0))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, truth_id) from a two-column CSV with a header."""
    rows = spark.read.option("header", True).schema("ref_id string, truth_id string").csv(path)
    return rows.select(F.upper(F.trim("ref_id")).alias("ref_id"), F.upper(F.trim("truth_id")).alias("truth_id"))


def from_table(df: DataFrame, ref_id: Column, body: Column) -> DataFrame:
    """References from the columns of a table; ids are compared as text. A table of fewer partitions than there are cores is dealt out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df.select(F.upper(F.trim(ref_id.cast("string"))).alias("ref_id"), body.cast("string").alias("body"))


def require_unique(references: DataFrame) -> DataFrame:
    """``references``, or ``ValueError`` if an id comes twice."""
    twice = references.groupBy("ref_id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"reference ids come twice: {', '.join(str(r['ref_id']) for r in twice)}")
    return references
