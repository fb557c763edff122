"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch that goes to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="docloom-scratch-")


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where none is set, a local folder for a session of one machine (tests), and
    an error on a cluster, whose executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{_own_folder()}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write once, read as often as the plan needs: later stages restart from files, not from the scan."""
    spark = df.sparkSession
    path = f"{folder(spark)}/docloom-scratch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what this application has materialised, once its results are written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/docloom-scratch/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` in memory that doesn't grow with the input: batches of at most BATCH_BYTES (a higher limit of the session
    is lowered), and what a task leaves unused goes back to the system."""
    spark = df.sparkSession
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", spark.conf.get(ARROW_BYTES).strip().lower()).groups()
    limit = int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit[:1], 0)
    if limit <= 0 or limit > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))

    def bounded(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library keeps its own policy
                pass

    return df.mapInArrow(bounded, schema)
