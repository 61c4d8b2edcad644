"""Incremental ingestion: files that land in a folder are read as a stream and ingested in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.ingestion import ingest
from lodestone.sources.files import checked_uploads


def landing_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, content, modified_at) of files as they land."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.col("modificationTime").alias("modified_at"))


def ingest_landing(spark: SparkSession, folder: str, tables: str, checkpoint: str, course: str, **sizes: int) -> StreamingQuery:
    """Ingests what has landed and stops, like a worker that empties its queue. Each batch writes documents, chunks
    and vectors under its own batch folder, which a repeated batch overwrites: so a batch that runs twice leaves one copy."""

    def batch(files: DataFrame, number: int) -> None:
        checked = checked_uploads(files).withColumn("document_id", F.sha2(F.concat_ws("/", F.lit(course), "filename"), 256)).withColumn("course_id", F.lit(course))
        done = ingest(checked.where("error_code IS NULL").drop("error_code"), **sizes)
        rejected = checked.where("error_code IS NOT NULL").select("document_id", F.lit("failed").alias("ingestion_status"), "error_code", F.lit("The file was rejected.").alias("error_message"), F.lit(0).cast("long").alias("chunk_count"), F.lit(0).cast("long").alias("characters"))
        for name, df in (("documents", done.documents.unionByName(rejected, allowMissingColumns=True)), ("chunks", done.chunks), ("vectors", done.vectors)):
            df.write.mode("overwrite").parquet(f"{tables}/{name}/batch={number}")

    return landing_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by type in windows of event time, for a batch or a stream; rows later than ``late`` are
    dropped by the watermark of a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "events", "total")
