"""What the operators of this subpackage share: reading tables, cutting lineage, word and key rules."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reachable

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of one Arrow batch handed to a Python worker, which bounds a worker's memory whatever the row widths.
ARROW_BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one only where all run in one process."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and go on from the files, which outlive any executor."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark knows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound Arrow batches by rows and bytes (both settings are runtime ones), and let workers find this package."""
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    except Exception:  # noqa: BLE001  an older Spark has no such setting; the bound by rows stays
        pass


def release() -> None:
    """Give memory that a worker no longer needs back to the system, as workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another system's C library
        pass


def portions(text: str, most: int) -> Iterator[str]:
    """A text in pieces of about ``most`` characters, cut before white space; a run without any stays whole."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind(" ", at + 1, at + most), text.rfind("\n", at + 1, at + most))
        if end < 0:
            found = [e for e in (text.find(" ", at + most), text.find("\n", at + most)) if e >= 0]
            if not found:
                break
            end = min(found)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def lower_ascii(text: Column) -> Column:
    """A-Z only: other letters keep their case."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(frame: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of the frame has."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(frame: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in frame.columns]
