"""Incremental ingest (an extension): each micro-batch of new files is one batch id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.plans import ingest
from quillstrata.sources.storage import Store


def stage_available(spark: SparkSession, source: str, schema: str, store: Store, checkpoint: str, key: str = "doc_id", text: str = "text", name: str = "stream", max_files: int | None = None) -> None:
    """Stages what has come to a Parquet folder since the last run, then stops.

    The batch id follows from the micro-batch number, so a micro-batch that is run again
    after a failure writes the same batch.
    """

    def write(df: DataFrame, number: int) -> None:
        batch = f"{name}-{number:08d}"
        at = F.timestamp_seconds(F.lit(number))
        with store.writing():
            old = store.read("chunk_slices") if "chunk_slices" in store.tables() else ingest.empty(df, ingest.SLICES)
            store.publish(chunk_slices=ingest.stage(old, ingest.text_slices(df, key, text), batch, at).drop("op"))

    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    query = reader.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a stream of events by window and type, closed by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
