"""The stream's tables are those of a batch job, after late, out-of-order and repeated batches."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from firnline.operators.events import event_counts
from firnline.sources.versions import Versions
from firnline.streaming import report_stream
from firnline.streaming.event_stream import SCHEMA, valid
from firnline.functions.time import local_date
from pyspark.sql import functions as F

NOW = datetime(2024, 3, 1, 9, tzinfo=timezone.utc)


def event(rng, days):
    at = NOW - timedelta(days=rng.choice(days), hours=rng.randint(0, 23), minutes=rng.randint(0, 59))
    return (rng.choice(["a", "b", "c", "d", "", None]), rng.choice(["home_viewed", "quiz_started", "other", "result_viewed"]), at, None)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_stream_is_the_batch(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    folder = tmp_path / "in"
    store = Versions(spark, f"file://{tmp_path}/store")
    files = [[event(rng, [40, 2]) for _ in range(40)], [event(rng, [1, 2, 3, 9]) for _ in range(60)], [event(rng, [70, 80]) for _ in range(20)], [event(rng, [40]) for _ in range(20)]]

    def land(i):
        df = spark.createDataFrame(files[i], SCHEMA).coalesce(1)
        df.write.mode("append").parquet(str(folder))

    def run():
        report_stream.keep_windows(spark, str(folder), store, NOW, str(tmp_path / "cp"), 1).awaitTermination()

    def same():
        every = valid(spark.read.schema(SCHEMA).parquet(str(folder)))
        assert rows(store.read("windows")) == rows(event_counts(every, NOW).select("window_key", "event_name", "event_count", "unique_sessions"))
        days = every.withColumn("day", local_date(F.col("created_at"))).groupBy("day", "event_name").agg(*report_stream.counts())
        assert rows(store.read("days")) == rows(days)

    land(0)
    land(1)
    run()
    assert store.version().note["batch"] == 1
    same()
    # an old batch's events are late by weeks; it comes again after the driver died before the exchange
    land(3)
    commit = Versions.commit

    def dies(self, base, tables, note):
        raise RuntimeError("killed")

    monkeypatch.setattr(Versions, "commit", dies)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(Versions, "commit", commit)
    assert store.version().note["batch"] == 1
    run()
    assert store.version().note["batch"] == 2 and set(store.version().note["touched"]) <= {"2024-01-20", "2024-01-21"}
    same()
    # a batch that is named already changes nothing, and events outside all windows change no window
    before = store.version()
    assert report_stream.merge_batch(spark.createDataFrame(files[3], SCHEMA), 2, store, NOW) == [] and store.version() == before
    land(2)
    run()
    same()
    old = {r[:2]: r for r in rows(store.read("windows", before.number))}
    assert {r[:2]: r for r in rows(store.read("windows"))} == old
    assert report_stream.merge_batch(spark.createDataFrame([], SCHEMA), 9, store, NOW) == [] and store.version().note["batch"] == 9
    same()
