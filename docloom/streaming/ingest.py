"""Incremental ingestion: new files below a folder are ingested as they arrive. An extension; batches are ordinary calls of
``plans.pipeline.ingest``, so a replayed batch upserts the same points."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from docloom.plans.pipeline import ingest
from docloom.sources.store import Store

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(spark: SparkSession, folder: str, store: Store, checkpoint: str, chat_id: str | None = None, files_per_batch: int = 100, **options) -> StreamingQuery:
    """Start a query that takes everything there is and then stops; run it again (or on a schedule) for what came since."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: ingest(store, batch, chat_id=chat_id, **options)).start()
