"""Event files as a stream: daily counts in the reporting time zone, and appending to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from firnline.functions.time import ZONE

SCHEMA = "session_id string, event_name string, created_at timestamp, payload string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def valid(events: DataFrame) -> DataFrame:
    """Events with a session of 1 to 120 characters and a name."""
    return events.where(F.length("session_id").between(1, 120) & (F.length("event_name") > 0))


def daily_counts(events: DataFrame, lateness: str = "7 days") -> DataFrame:
    """day, event_name, event_count and a sketch of the sessions; days older than ``lateness`` behind are closed."""
    local = events.withColumn("local", F.from_utc_timestamp("created_at", ZONE)).withWatermark("local", lateness)
    counted = local.groupBy(F.window("local", "1 day").alias("w"), "event_name").agg(F.count(F.lit(1)).alias("event_count"), F.approx_count_distinct("session_id").alias("sessions"))
    return counted.select(F.to_date("w.start").alias("day"), "event_name", "event_count", "sessions")


def append(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends valid events to Parquet files, partitioned by local day, until the folder is read up."""
    dated = valid(events).withColumn("day", F.to_date(F.from_utc_timestamp("created_at", ZONE)))
    return dated.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start()
