"""Event reports over calendar windows: counts, ordered funnel, commerce breakdowns, top items, trends, readiness.

Events belong to at most a few of five fixed windows. Each event's windows come from its local day by a projection
(an array of window keys that is exploded), so no report joins events with windows, and the span of all windows is
pushed to the scan as one range of instants.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.functions.jsons import field, is_invalid, is_legacy, merchant, payload_object
from firnline.functions.num import clamp, rate, round_to, share, trend_percent
from firnline.functions.time import as_of, history_days, local_date, midnight, report_windows

COUNTED = ["home_viewed", "quiz_started", "quiz_completed", "result_viewed", "product_clicked", "email_submitted"]
STEPS = ["quiz_started", "quiz_completed", "result_viewed", "product_clicked"]
#: What a partner report needs, and the points it gives.
TARGETS = {"traffic_users_30d": (10_000.0, 25.0), "quiz_completed_sessions_30d": (1_000.0, 20.0), "store_click_sessions_30d": (300.0, 25.0), "result_to_store_rate_30d": (0.1, 20.0), "analytics_history_days": (60.0, 10.0)}


def window_frame(spark: SparkSession, now: datetime) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for k, (a, b) in report_windows(now).items()], "window_key string, start_date date, end_date date")


def in_span(events: DataFrame, now: datetime, keys: list[str] | None = None) -> DataFrame:
    """Events from the first to the last day of the windows, as one range that the scan can use."""
    days = [w for k, w in report_windows(now).items() if keys is None or k in keys]
    lo, hi = min(a for a, _ in days), max(b for _, b in days)
    end = midnight(hi).timestamp() + 86400
    return events.where((F.col("created_at") >= F.timestamp_seconds(F.lit(midnight(lo).timestamp()))) & (F.col("created_at") < F.timestamp_seconds(F.lit(end))))


def with_windows(events: DataFrame, now: datetime) -> DataFrame:
    """One row per event and window that holds its local day."""
    day = local_date(F.col("created_at"))
    keys = F.array_compact(F.array(*[F.when(day.between(F.lit(a), F.lit(b)), F.lit(k)) for k, (a, b) in report_windows(now).items()]))
    return in_span(events, now).withColumn("window_key", F.explode(keys))


def event_counts(events: DataFrame, now: datetime) -> DataFrame:
    """window_key, event_name, event_count, unique_sessions; every pair has a row."""
    spark = events.sparkSession
    pairs = spark.createDataFrame([(w, e) for w in report_windows(now) for e in COUNTED], "window_key string, event_name string")
    found = with_windows(events.where(F.col("event_name").isin(COUNTED)), now).groupBy("window_key", "event_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("s"))
    return pairs.join(found, ["window_key", "event_name"], "left").select("window_key", "event_name", F.coalesce("n", F.lit(0)).alias("event_count"), F.coalesce("s", F.lit(0)).alias("unique_sessions"))


def session_steps(events: DataFrame, by: list[str]) -> DataFrame:
    """First start, last completion, first view and last click of each session: what the ordered steps depend on."""
    at = lambda name: F.when(F.col("event_name") == name, F.col("created_at"))
    return events.groupBy(*by, "session_id").agg(
        F.min(at("quiz_started")).alias("started"),
        F.max(at("quiz_completed")).alias("completed"),
        F.min(at("result_viewed")).alias("viewed"),
        F.max(at("product_clicked")).alias("clicked"),
    )




def _flags() -> dict[str, Column]:
    """Steps of a session; a completion at the instant of the start counts, a click must come after the view."""
    return {
        "quiz_start_sessions": F.col("started").isNotNull(),
        "quiz_completed_sessions": F.col("completed") >= F.col("started"),
        "result_viewed_sessions": F.col("viewed").isNotNull(),
        "result_to_store_sessions": F.col("clicked") > F.col("viewed"),
        "store_click_sessions": F.col("clicked").isNotNull(),
    }


def funnel(events: DataFrame, now: datetime) -> DataFrame:
    """Sessions per window that reach each step in order, and the two rates; every window has a row."""
    steps = session_steps(with_windows(events.where(F.col("event_name").isin(STEPS)), now), ["window_key"])
    counted = steps.groupBy("window_key").agg(*[F.count_if(c).alias(n) for n, c in _flags().items()])
    out = window_frame(events.sparkSession, now).select("window_key").join(counted, "window_key", "left").na.fill(0)
    return out.withColumn("quiz_completion_rate", rate(F.col("quiz_completed_sessions"), F.col("quiz_start_sessions"))).withColumn("result_to_store_rate", rate(F.col("result_to_store_sessions"), F.col("result_viewed_sessions")))


def session_timeline(events: DataFrame) -> DataFrame:
    """Ordered steps of each session over all time."""
    f = _flags()
    names = {"has_quiz_start": "quiz_start_sessions", "has_ordered_quiz_completion": "quiz_completed_sessions", "has_result_view": "result_viewed_sessions", "has_ordered_store_click": "result_to_store_sessions"}
    return session_steps(events, []).select("session_id", *[F.coalesce(f[v], F.lit(False)).alias(k) for k, v in names.items()])


def clicks(events: DataFrame, now: datetime) -> DataFrame:
    """Store clicks of all windows with their properties."""
    v = payload_object(F.col("payload"))
    rows = in_span(events.where(F.col("event_name") == "product_clicked"), now).select("session_id", "created_at", v.alias("p"))
    names = ["source", "placement", "board_slug", "offer_slug", "size_label"]
    return rows.select("session_id", "created_at", *[field(F.col("p"), n).alias(n) for n in names], merchant(F.try_variant_get("p", "$.destination_url", "string")).alias("merchant"))


def last_30_days(rows: DataFrame, now: datetime) -> DataFrame:
    a, b = report_windows(now)["last30Days"]
    return rows.where(local_date(F.col("created_at")).between(F.lit(a), F.lit(b)))


BREAKDOWNS = ["source", "placement", "size_label", "merchant"]
ITEMS = {"merchant_board": "board_slug", "merchant_offer": "offer_slug", "merchant_size": "size_label"}


def commerce(events: DataFrame, now: datetime, top: int = 5) -> DataFrame:
    """kind, window_key, group_value, item_value, event_count, unique_sessions.

    Totals per window (zero rows kept), four breakdowns of the last 30 days with their null group, and each merchant's
    ``top`` boards, offers and sizes. Each click becomes one row per breakdown, so that one aggregation serves all.
    """
    found = clicks(events, now)
    totals = with_windows(found, now).groupBy("window_key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("s"))
    total = window_frame(events.sparkSession, now).join(totals, "window_key", "left").select(F.lit("total").alias("kind"), "window_key", F.lit(None).cast("string").alias("group_value"), F.lit(None).cast("string").alias("item_value"), F.coalesce("n", F.lit(0)).alias("event_count"), F.coalesce("s", F.lit(0)).alias("unique_sessions"))
    none = F.lit(None).cast("string")
    entry = lambda kind, group, item: F.struct(F.lit(kind).alias("kind"), group.alias("group_value"), item.alias("item_value"))
    groups = [entry("size" if c == "size_label" else c, F.col(c), none) for c in BREAKDOWNS]
    items = [F.when(F.col("merchant").isNotNull() & F.col(c).isNotNull(), entry(k, F.col("merchant"), F.col(c))) for k, c in ITEMS.items()]
    recent = last_30_days(found, now).select("session_id", F.explode(F.array_compact(F.array(*groups, *items))).alias("e")).select("session_id", "e.*")
    counted = recent.groupBy("kind", "group_value", "item_value").agg(F.count(F.lit(1)).alias("event_count"), F.countDistinct("session_id").alias("unique_sessions"))
    place = F.row_number().over(Window.partitionBy("kind", "group_value").orderBy(F.desc("event_count"), "item_value"))
    kept = counted.withColumn("place", place).where((F.col("place") <= top) | F.col("item_value").isNull())
    return total.unionByName(kept.select("kind", F.lit("last30Days").alias("window_key"), "group_value", "item_value", "event_count", "unique_sessions"))


def shares(report: DataFrame) -> DataFrame:
    """Breakdown rows of a commerce report with their share of the 30-day clicks."""
    whole = report.where("kind = 'total' and window_key = 'last30Days'").select(F.col("event_count").alias("whole"))
    rows = report.where(F.col("kind").isin("source", "placement", "size", "merchant"))
    return rows.join(F.broadcast(whole.withColumn("k", F.lit(1))), F.lit(1) == F.col("k")).select("kind", F.col("group_value").alias("value"), F.col("event_count").alias("click_events"), F.col("unique_sessions").alias("unique_click_sessions"), share(F.col("event_count"), F.col("whole")).alias("share_of_clicks"))


def top_items(events: DataFrame, now: datetime, top: int = 10) -> DataFrame:
    """The most clicked boards and offers; an offer's source and merchant only where there is one of each."""
    rows = last_30_days(clicks(events, now), now)
    only = lambda c: F.when(F.countDistinct(c) == 1, F.min(c))
    count = [F.count(F.lit(1)).alias("event_count"), F.countDistinct("session_id").alias("unique_sessions")]
    boards = rows.where("board_slug is not null").groupBy(F.col("board_slug").alias("identity")).agg(*count)
    offers = rows.where("offer_slug is not null").groupBy(F.col("offer_slug").alias("identity")).agg(*count, only("source").alias("source"), only("merchant").alias("merchant"))
    ordered = lambda df: df.orderBy(F.desc("event_count"), "identity").limit(top)
    none = F.lit(None).cast("string")
    first = ordered(boards).select(F.lit("board").alias("kind"), "identity", "event_count", "unique_sessions", none.alias("source"), none.alias("merchant"))
    return first.unionByName(ordered(offers).select(F.lit("offer").alias("kind"), "identity", "event_count", "unique_sessions", "source", "merchant"))


def merchant_evidence(report: DataFrame) -> DataFrame:
    """Each merchant with its best boards, offers and sizes as arrays in rank order."""
    items = report.where(F.col("kind").isin(list(ITEMS)))
    ranked = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct((-F.col("event_count")).alias("o"), F.col("item_value").alias("item"))))), lambda x: F.struct(x["item"].alias("item"), (-x["o"]).alias("click_events")))
    nested = items.groupBy("group_value").agg(ranked("merchant_board").alias("top_boards"), ranked("merchant_offer").alias("top_offers"), ranked("merchant_size").alias("top_sizes"))
    rows = shares(report).where("kind = 'merchant'").withColumnRenamed("value", "merchant")
    return rows.join(nested, rows["merchant"] == nested["group_value"], "left").select("merchant", "click_events", "unique_click_sessions", "share_of_clicks", *[F.coalesce(c, F.array()).alias(c) for c in ("top_boards", "top_offers", "top_sizes")])


def history(events: DataFrame, now: datetime) -> DataFrame:
    """first_event_at, history_days, legacy_payload_rows, invalid_payload_rows: one row over all events."""
    row = events.agg(F.min("created_at").alias("first_event_at"), F.count_if(is_legacy(F.col("payload"))).alias("legacy_payload_rows"), F.count_if(is_invalid(F.col("payload"))).alias("invalid_payload_rows"))
    return row.select(history_days(F.col("first_event_at"), as_of(now)).alias("history_days"), "legacy_payload_rows", "invalid_payload_rows")


def trends(events: DataFrame, now: datetime) -> DataFrame:
    """period, metric, current, previous, absolute, percent of funnel and click sessions, week and month."""
    sessions = funnel(events, now).select("window_key", "quiz_completed_sessions", "result_viewed_sessions", "store_click_sessions")
    long = sessions.unpivot("window_key", ["quiz_completed_sessions", "result_viewed_sessions", "store_click_sessions"], "metric", "v")
    at = lambda key: F.max(F.when(F.col("window_key") == key, F.col("v")))
    wide = long.groupBy("metric").agg(*[at(k).alias(k) for k in ("last7Days", "previous7Days", "last30Days", "previous30Days")])
    both = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(a).alias("current"), F.col(b).alias("previous")) for p, a, b in (("week", "last7Days", "previous7Days"), ("month", "last30Days", "previous30Days"))]))
    rows = wide.select("metric", both.alias("x")).select("metric", "x.*")
    return rows.select("period", "metric", "current", "previous", (F.col("current") - F.col("previous")).alias("absolute"), trend_percent(F.col("current"), F.col("previous")).alias("percent"))


def readiness(inputs: DataFrame) -> DataFrame:
    """score, status, ready and failing metrics from one column per target (null: not known)."""
    points = {k: F.when(F.col(k).isNotNull(), round_to(clamp(F.col(k) / F.lit(t), 0.0, 1.0) * F.lit(p), 1)) for k, (t, p) in TARGETS.items()}
    out = inputs.select("*", *[v.alias(f"points_{k}") for k, v in points.items()])
    cols = [F.col(f"points_{k}") for k in TARGETS]
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    failing = F.array_compact(F.array(*[F.when(F.col(k).isNull() | (F.col(k) < t), F.lit(k)) for k, (t, _) in TARGETS.items()]))
    out = out.withColumn("score", round_to(total, 1)).withColumn("failing_metrics", failing)
    status = F.when(F.col("score").isNull(), "insufficient_data").when(F.size("failing_metrics") == 0, "metric_ready").when(F.col("score") < 40, "early").when(F.col("score") < 70, "building_evidence").otherwise("approaching")
    return out.withColumn("status", status).withColumn("strict_outreach_ready", (F.size("failing_metrics") == 0) & F.col("score").isNotNull())
