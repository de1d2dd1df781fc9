"""Incremental chunking: new files become chunks as they arrive, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.chunking import chunk_documents


def stream_chunks(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: str, size: int = 1024, overlap: int = 50) -> StreamingQuery:
    """Chunk the Parquet files of documents (doc_id, text) that appear in folder, until none is left.

    A batch overwrites its own partition of out, so that one which is run again after a failure leaves no copy.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        chunk_documents(batch, size, overlap).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    files = spark.readStream.schema(schema).parquet(folder)
    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events by hour and type, late ones up to the watermark; the same on streams and tables."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    stamped = stamped.withWatermark("at", late) if events.isStreaming else stamped
    return stamped.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
