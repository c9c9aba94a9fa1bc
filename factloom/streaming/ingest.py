"""Ingestion as a stream: utterances in, evidence and activity out, late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(events: DataFrame, key: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def activity(events: DataFrame, time: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their value by window and kind."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def evidence(events: DataFrame) -> DataFrame:
    """Running count of writes of each natural key: the streaming form of the upsert."""
    return events.groupBy("user_id", "event_type", F.get_json_object("props", "$.k").alias("object")).agg(F.count("*").alias("evidence_count"))


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Run to the end of what is there, into an in-memory table (for tests and small results)."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
