"""Helpers shared by the text operators: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, read by Spark (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the context's. Where both are unset, a local master (tests) gets a
    temporary one; on a cluster that is an error, for other machines don't see local folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="swathkit-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/swathkit-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for these frames; nothing that is still to be computed may read them."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame._written)
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_kept: dict = {}


def kept(key, make: Callable):
    """What ``make`` gives, held in a worker from task to task of one stage; what other stages held goes first."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """In a worker, where a stage starts or ends: what earlier stages held goes, and free memory goes back to the machine,
    for the next stage may meet other workers of the same executor."""
    _kept.clear()
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


BATCH_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def by_bytes(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of at most ``BATCH_BYTES`` (or one row), unless the user has set
    another bound: texts differ in length by orders of magnitude, and a batch is held on both sides."""
    if spark.conf.get(_BATCH_SETTING) in ("67108864b", "64MB", "64m"):  # the default
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    """As many partitions as shuffles have: for rows few in bytes but costly, which adaptive execution would put together."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
