"""Shared plumbing: the shared work folder, written tables and column names."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of packed payload that one exchange bucket should hold.
BUCKET_BYTES = 48 << 20

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session leaves it unset a local temporary folder is used, but only
    with an in-process master; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="siftwell-")
    return _local_dirs[app]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siftwell-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it again.

    Cuts the lineage: what was written survives the loss of any executor.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that is no longer read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: file sizes for scans."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def n_buckets(df: DataFrame, factor: float = 2.0, least: int | None = None) -> int:
    """Exchange buckets so that each holds about ``BUCKET_BYTES``.

    Follows the input's size and is never below the session's shuffle partitions.
    ``factor`` is exchanged bytes per byte of input.
    """
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    if size > 1 << 50:  # no statistics
        size = 0
    return max(least or conf, int(size * factor / BUCKET_BYTES) + 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that clash with none of ``df``'s, whatever their case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def picked(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, renamed: ``picked(df, id="doc_id")``; quoting keeps dots in names."""
    return df.select([df[f"`{c}`"].alias(k) for k, c in cols.items()])


def broadcast_if(df: DataFrame, n_bytes: int, limit: int) -> DataFrame:
    """A broadcast hint only below ``limit``; else Spark joins by shuffle."""
    return F.broadcast(df) if n_bytes <= limit else df


def default_tokenizer() -> str:
    return os.environ.get("SIFTWELL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """A large object that this Python worker keeps between tasks; it keeps one at a time."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Gives back what an earlier task left in this worker: what it kept, and memory that is free but still held.

    Workers outlive stages, so a task that keeps nothing calls it first.
    """
    _kept.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Hands memory that is free but still held back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library
