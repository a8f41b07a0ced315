"""Event report queries over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.operators import events as ev
from firnline.plans.bindings import NOW, events
from firnline.sources.rounds import Rounds
from firnline.sources.versions import Versions
from firnline.streaming import report_stream


def _listed(items: str, name: str):
    return F.array_join(F.transform(items, lambda x: F.concat(x["item"], F.lit(":"), x["click_events"].cast("string"))), ",").alias(name)


def _readiness_inputs(e: DataFrame) -> DataFrame:
    f = ev.funnel(e, NOW).where("window_key = 'last30Days'")
    d = lambda c: F.col(c).cast("double")
    row = f.select(d("quiz_start_sessions").alias("traffic_users_30d"), d("quiz_completed_sessions").alias("quiz_completed_sessions_30d"), d("store_click_sessions").alias("store_click_sessions_30d"), F.col("result_to_store_rate").alias("result_to_store_rate_30d"), F.lit(1).alias("k"))
    h = ev.history(e, NOW).select(d("history_days").alias("analytics_history_days"), F.lit(1).alias("k"))
    return row.join(h, "k")


def event_counts(s: SparkSession, d: str) -> DataFrame:
    return ev.event_counts(events(s, d), NOW)


def event_funnel(s: SparkSession, d: str) -> DataFrame:
    return ev.funnel(events(s, d), NOW)


def session_timeline(s: SparkSession, d: str) -> DataFrame:
    return ev.session_timeline(events(s, d))


def commerce_report(s: SparkSession, d: str) -> DataFrame:
    return ev.commerce(events(s, d), NOW)


def commerce_shares(s: SparkSession, d: str) -> DataFrame:
    return ev.shares(ev.commerce(events(s, d), NOW))


def merchant_evidence(s: SparkSession, d: str) -> DataFrame:
    return ev.merchant_evidence(ev.commerce(events(s, d), NOW)).select("merchant", "click_events", _listed("top_boards", "boards"), _listed("top_offers", "offers"), _listed("top_sizes", "sizes"))


def top_items(s: SparkSession, d: str) -> DataFrame:
    return ev.top_items(events(s, d), NOW)


def event_history(s: SparkSession, d: str) -> DataFrame:
    return ev.history(events(s, d), NOW)


def event_trends(s: SparkSession, d: str) -> DataFrame:
    return ev.trends(events(s, d), NOW)


def partner_readiness(s: SparkSession, d: str) -> DataFrame:
    return ev.readiness(_readiness_inputs(events(s, d))).select("score", F.array_join("failing_metrics", ",").alias("failing_metrics"), "status")


QUERIES = [event_counts, event_funnel, session_timeline, commerce_report, commerce_shares, merchant_evidence, top_items, event_history, event_trends, partner_readiness]


def streamed_event_counts(s: SparkSession, d: str) -> DataFrame:
    """The counts of the windows as a stream keeps them: events land in files in no order and are taken in a few at a time."""
    tables = Rounds(s, "streamed")
    landed = events(s, d).select("session_id", F.coalesce("event_name", F.lit("none")).alias("event_name"), "created_at", "payload").repartition(6, F.xxhash64("session_id", "created_at"))
    tables.put(landed, "landed")
    store = Versions(s, f"{tables.root}/store")
    report_stream.keep_windows(s, f"{tables.root}/landed", store, NOW, f"{tables.root}/checkpoint", 2).awaitTermination()
    return store.read("windows")


QUERIES += [streamed_event_counts]
