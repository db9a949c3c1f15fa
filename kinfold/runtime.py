"""Session helpers shared by the operators: checkpoints and scratch tables.

Everything an executor may have to read again lives in the folder that the
session names in ``spark.checkpoint.dir``; a machine-local folder is used only
when that setting is absent (local tests).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder, set to a temporary one if unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="kinfold-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lower Spark's default rows per Arrow batch: rows here are whole texts, and a batch of them has to fit beside others.

    A setting that the user has chosen stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within, a table's or checkpoint's shuffle files go once it is written, not when the driver happens to collect its garbage.

    A plan that is run twice here makes its shuffles twice.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_SCRATCH: list[str] = []


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder, there until ``release``."""
    path = f"{shared_dir(spark)}/kinfold-{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch table and read from it."""
    path = scratch_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _SCRATCH.remove(path)


def release(spark: SparkSession, *keep: str) -> None:
    """Delete this session's scratch tables but those to keep; results not written yet must not need them."""
    for path in [p for p in _SCRATCH if p not in keep]:
        _delete(spark, path)


def release_table(spark: SparkSession, name: str) -> None:
    """Delete the scratch table of that name that was made last."""
    _delete(spark, next(p for p in reversed(_SCRATCH) if p.rsplit("/", 1)[1].startswith(f"kinfold-{name}-")))
