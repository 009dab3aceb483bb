"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words in every word-level contract.
WORD_SPACE = b" \t\n\x0b\x0c\r"
WORD_REGEX = r"[^\x20\x09-\x0D]+"
#: Bounds of an Arrow batch: rows for tables of numbers, bytes where rows hold whole texts.
BATCH_ROWS = 20_000
BATCH_BYTES = "2m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds; the settings are read when a plan is executed."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def tidy(run):
    """Give freed memory back when a task ends: a Python worker lives on, and what it keeps adds up over stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names. Where none is named, one is made if all runs on this machine; a cluster must name one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pointloom-checkpoint-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table in whatever store the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_checkpoint(*frames: DataFrame | None) -> None:
    """Delete what ``cut_lineage`` wrote for frames that nothing reads any more."""
    for df in frames:
        file = df._jdf.logicalPlan().rdd().getCheckpointFile() if df is not None else None
        if file is not None and file.isDefined():
            delete(df.sparkSession, file.get())


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out everywhere. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0)).cast("int")


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
