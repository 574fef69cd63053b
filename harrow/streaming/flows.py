"""Structured Streaming forms, extensions of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def upsert_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append each version of a file once: (path, content_hash) seen before is dropped.

    A batch that is retried finds its own rows in the target and adds none twice.
    """

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(["path", "content_hash"])
        try:
            known = batch.sparkSession.read.parquet(target).select("path", "content_hash")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            fresh = fresh.join(known, ["path", "content_hash"], "left_anti")
        fresh.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream of events (user_id, ts): counts by session window, late rows within ``late``."""
    windowed = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return windowed.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")
