"""Report windows kept up to date by a stream of event files.

Each batch is stored once under its number, split by local day. Only the days that it touches are counted again, from
all stored events of those days, and only the windows that hold one of them; both tables change in one step, in a
version that names the batch. A batch that comes again after a crash finds itself named, or writes the same places
again; late and out-of-order events touch their own days. So after any batches the tables are what a batch job over all
files gives.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from firnline.functions.time import as_of, local_date, report_windows
from firnline.operators.events import COUNTED
from firnline.sources.versions import Versions
from firnline.streaming.event_stream import SCHEMA, read_events, valid



def counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("event_count"), F.countDistinct("session_id").alias("unique_sessions")]


def _window_rows(events: DataFrame, windows: dict[str, tuple[date, date]]) -> DataFrame:
    """window_key, event_name, event_count, unique_sessions of the given windows; every pair has a row."""
    spark = events.sparkSession
    pairs = spark.createDataFrame([(w, e) for w in windows for e in COUNTED], "window_key string, event_name string")
    if not windows:
        return pairs.select("*", F.lit(0).cast("long").alias("event_count"), F.lit(0).cast("long").alias("unique_sessions"))
    low, high = min(a for a, _ in windows.values()), max(z for _, z in windows.values())
    keys = F.array_compact(F.array(*[F.when(F.col("day").between(F.lit(a), F.lit(z)), F.lit(k)) for k, (a, z) in windows.items()]))
    found = events.where(F.col("day").between(F.lit(low), F.lit(high)) & F.col("event_name").isin(COUNTED)).withColumn("window_key", F.explode(keys)).groupBy("window_key", "event_name").agg(*counts())
    return pairs.join(found, ["window_key", "event_name"], "left").select("window_key", "event_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("event_count", "unique_sessions")])


def merge_batch(batch: DataFrame, number: int, store: Versions, now: datetime) -> list[date]:
    """Takes a batch of events into the tables ``days`` and ``windows`` of the store; returns the days that it touched.

    Nothing happens for a batch that a version names already. A report day other than the last version's makes all
    windows anew. The days of one batch are a short list of the calendar.
    """
    spark, at = batch.sparkSession, store.version()
    if at.note.get("batch", -1) >= number:
        return []
    place = f"{store.root}/events"
    valid(batch).withColumn("day", local_date(F.col("created_at"))).write.mode("overwrite").partitionBy("day").parquet(f"{place}/batch={number}")
    here = spark.read.schema(f"{SCHEMA}, day date").parquet(f"{place}/batch={number}")
    touched = sorted(r.day for r in here.select("day").distinct().collect() if r.day is not None)
    if touched or not at.tables:
        every = spark.read.option("basePath", place).schema(f"{SCHEMA}, batch int, day date").parquet(place).where(F.col("batch") <= number)
        days = every.where(F.col("day").isin(touched)).groupBy("day", "event_name").agg(*counts())
        windows = report_windows(now)
        same = at.note.get("as_of") == str(as_of(now))
        again = {k: (a, z) for k, (a, z) in windows.items() if not same or any(a <= d <= z for d in touched)}
        rows = _window_rows(every, again)
        if at.tables:
            days = store.staged(at.tables["days"]).where(~F.col("day").isin(touched)).unionByName(days)
            rows = store.staged(at.tables["windows"]).where(~F.col("window_key").isin(list(again))).unionByName(rows)
        tables = {"days": store.stage("days", days), "windows": store.stage("windows", rows)}
    else:
        tables = {}
    store.commit(at, tables, {"batch": number, "as_of": str(as_of(now)), "touched": [str(d) for d in touched]})
    return touched


def keep_windows(spark: SparkSession, folder: str, store: Versions, now: datetime, checkpoint: str, files_per_trigger: int | None = None) -> StreamingQuery:
    """A query that takes in a folder's event files until it is read up; start it again for what lands later."""
    writer = read_events(spark, folder, files_per_trigger).writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, store, now) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
