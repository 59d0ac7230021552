"""Helpers shared by the operators: the shared folder, text chunks and packed arrays."""

from __future__ import annotations

import ctypes
import functools
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of bytes that are neither a space nor one of the controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only where that is unset and Spark is on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tremora-checkpoints-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query when it ends, and not when the driver next needs memory.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: it cuts the lineage and survives lost executors.
    The shuffle files of the write are deleted with it."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes tables that written() made, in whatever file system holds them: those that no later plan reads."""
    for df in frames:
        context, path = df.sparkSession.sparkContext, getattr(df, "_written_path", None)
        if path:
            hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over now, instead of when the driver next needs memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, unless the session names a number: batches of whole texts take memory in
    the JVM and in the worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, rows)


def give_back() -> None:
    """Returns freed memory to the system: a worker that waits for its next task keeps what its allocators hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow, with memory given back when a task ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts: one narrow scan, used to size chunks and sketches."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def chunk_count(total_bytes: int, chunk_bytes: int) -> int:
    return max(1, math.ceil(total_bytes / chunk_bytes))


def with_chunk(docs: DataFrame, chunks: int) -> DataFrame:
    """doc_id, text and the chunk that holds the row: by hash of both, so that repeated ids spread out."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"),
    )


def pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def unpack(data: bytes | None, dtype: str) -> np.ndarray:
    return np.frombuffer(data or b"", dtype)
