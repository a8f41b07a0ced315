"""Calendar windows in the reporting time zone."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Moscow"
#: First and last day of each window, counted from the last whole day.
WINDOW_DAYS = {"yesterday": (0, 0), "last7Days": (-6, 0), "previous7Days": (-13, -7), "last30Days": (-29, 0), "previous30Days": (-59, -30)}


def as_of(now: datetime) -> date:
    """The last whole day before the instant ``now``."""
    return now.astimezone(ZoneInfo(ZONE)).date() - timedelta(days=1)


def report_windows(now: datetime) -> dict[str, tuple[date, date]]:
    """First and last day of each window, both included."""
    day = as_of(now)
    return {k: (day + timedelta(days=a), day + timedelta(days=b)) for k, (a, b) in WINDOW_DAYS.items()}


def local_date(instant: Column) -> Column:
    """Calendar day of an instant (a timestamp in a UTC session) in the reporting zone."""
    return F.to_date(F.from_utc_timestamp(instant, ZONE))


def midnight(day: date) -> datetime:
    """The instant at which a local day begins."""
    return datetime.combine(day, datetime.min.time(), ZoneInfo(ZONE))


def history_days(first: Column, day: date) -> Column:
    return F.when(first.isNull(), 0).otherwise(F.greatest(F.datediff(F.lit(day), local_date(first)) + 1, F.lit(0))).cast("long")


def iso_week(day: Column) -> Column:
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), day).cast("int"), F.weekofyear(day))
