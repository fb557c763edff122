"""Tables in the folder that every executor sees, and small plan helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="docloom-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where none is named, a local folder for a session of one machine (tests),
    and an error on a cluster, whose executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{_own_folder()}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no result reads any more."""
    for df in tables:
        path = vars(df).get("staged_at")
        if path:
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has staged, once its results are written elsewhere."""
    _delete(spark, f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Project the named input columns to the operator's own names, so extra columns can't clash."""
    return df.select([F.col(f"`{source}`").alias(own) for own, source in columns.items()])


#: Ids that are broadcast to select rows, once counted: beyond, Spark joins by a shuffle.
BROADCAST_IDS = 4_000_000


def selected(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join on an id column without a shuffle of ``df`` while the ids are provably few."""
    ids = staged(ids.select(F.col(column).alias("_wanted")).distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, F.col(f"`{column}`") == F.col("_wanted"), how)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch that goes to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` in bounded memory: batches of at most BATCH_BYTES (the session's limit is lowered to that if it is
    higher), and what a task leaves unused goes back to the system at its end."""
    spark = df.sparkSession
    if _bytes(spark.conf.get(ARROW_BYTES)) > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))

    def bounded(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(bounded, schema)


def _bytes(size: str) -> float:
    """A size setting in bytes; none or less is no limit."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", size.strip().lower()).groups()
    value = int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit[:1], 0)
    return value if value > 0 else float("inf")


_held: dict = {}


def worker_cache(owner: tuple, make):
    """What an operator keeps between the tasks of a Python worker. A worker keeps one operator's cache at a time:
    workers are reused, and several full caches would not fit an executor."""
    if owner not in _held:
        release_worker_cache()
        _held[owner] = make()
    return _held[owner]


def release_worker_cache() -> None:
    """Drop what another operator left in this worker."""
    if _held:
        _held.clear()
        trim()


def trim() -> None:
    """Give unused memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own policy
        pass
