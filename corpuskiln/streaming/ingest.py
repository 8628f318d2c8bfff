"""Ingestion and expiry as streams: the incremental forms of loading a folder and of the lifetime of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuskiln.plans.ingestion import Store, ingest
from corpuskiln.sources import files


def ingest_stream(spark: SparkSession, folder: str, into: Store, checkpoint: str, **options) -> StreamingQuery:
    """Stores the files that came into a folder since the last run, then stops. Each file is seen once; a batch that
    is run again after a failure skips what it stored before."""
    arrived = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "[!.]*").load(folder)
    )

    def store_batch(batch: DataFrame, _: int) -> None:
        loaded = files.documents(batch.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "content"), F.current_timestamp())
        ingest(loaded, into, **options)

    return arrived.writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_traces(traces: DataFrame, late: str = "7 days") -> DataFrame:
    """A stream of traces without rows repeated under one trace_id, as far as they come within ``late``."""
    return traces.withWatermark("started_at", late).dropDuplicatesWithinWatermark(["trace_id"])


def trace_windows(traces: DataFrame, every: str = "1 hour", late: str = "7 days") -> DataFrame:
    """(start, runs, failures, mean_ms) per window of a stream of traces; a window closes when no row can come late."""
    return (
        traces.withWatermark("started_at", late)
        .groupBy(F.window("started_at", every))
        .agg(F.count("*").alias("runs"), F.count_if(~F.col("success")).alias("failures"), F.avg(F.when(F.col("duration_ms") >= 0, F.col("duration_ms"))).alias("mean_ms"))
        .select(F.col("window.start").alias("start"), "runs", "failures", "mean_ms")
    )
