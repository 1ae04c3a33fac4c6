"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import ensure_checkpoint_dir

#: Rows of a few numbers that are sent to all tasks at most; more are joined.
SENT = 1 << 20


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``; every run of an operator takes its own."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written as Parquet below ``folder`` and read again: cuts the lineage, survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent_if_few(df: DataFrame) -> DataFrame:
    """``df``, whose rows are a few numbers each, for a join with wide rows: at most ``SENT`` rows are broadcast, so that texts stay where they are."""
    return F.broadcast(df) if df.count() <= SENT else df


def drop_tables(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete tables below ``folder`` that no later step reads."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give memory that this worker has freed back to the system: workers stay when their task has ended, and others start beside them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` of batches, and :func:`release` at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def local_path(uri: str) -> str | None:
    """The mounted path of a ``file:`` address or plain path; None for other stores."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def put_file(uri: str, data: np.ndarray) -> None:
    """Write an array under a name of its own, then move it in place: a repeated task leaves one whole file."""
    path = local_path(uri)
    if path is None:
        raise ValueError(f"{uri}: memory-mapped files need a shared folder that is mounted as files")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    data.tofile(own)
    os.replace(own, path)


def map_file(uri: str, dtype: str) -> np.ndarray:
    """The file as a memory-mapped array; an empty file is an empty array."""
    path = local_path(uri)
    if os.path.getsize(path) == 0:
        return np.empty(0, dtype)
    return np.memmap(path, dtype, "r")
