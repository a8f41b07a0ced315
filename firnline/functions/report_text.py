"""Small text and calendar functions of reports and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Events that are goals outside, and the longest wait that a header may ask for.
GOALS = ["quiz_started", "quiz_step_completed", "quiz_completed", "result_viewed", "product_clicked", "email_submitted", "recalculation_started"]
LONGEST_WAIT_MS = 10_000


def weight_range(low: Column, high: Column) -> Column:
    """A size's range of rider weights as text; an open one has its beginning alone."""
    return F.when((low <= 0) & high.isNull(), "нет данных").when(high.isNull(), F.concat(F.lit("от "), low.cast("string"), F.lit(" кг"))).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" кг")))


def weight_limit(high: Column) -> Column:
    return F.coalesce(high.cast("double"), F.lit(float("inf")))


def escape_html(x: Column) -> Column:
    """The five signs that mean something in HTML, as entities; the ampersand first."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(sign), F.lit(entity))
    return x


def strict_date(text: Column) -> Column:
    """A date that is written as yyyy-MM-dd and exists; anything else is null."""
    d = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
    return F.when(F.date_format(d, "yyyy-MM-dd") == text, d)


def is_whole_week(start: Column, end: Column) -> Column:
    """Whether two dates are a Monday and the Sunday after it."""
    return F.coalesce((F.weekday(start) == 0) & (F.datediff(end, start) == 6), F.lit(False))


def weeks_follow(start: Column, end: Column, before_start: Column, before_end: Column) -> Column:
    """Whether two periods are whole weeks, one right after the other."""
    return is_whole_week(start, end) & is_whole_week(before_start, before_end) & F.coalesce(F.datediff(start, before_end) == 1, F.lit(False))


def merchant_host(url: Column) -> Column:
    """The host of a URL in lower case, without a leading ``www.``; user, port and path are not in it."""
    host = F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def goals(event: Column, placement: Column, prefix: str = "") -> Column:
    """Goals to report for an event: its own, and for a click on a board's page one of that page."""
    own = F.when(event.isin(GOALS), F.concat(F.lit(prefix), event))
    return F.array_compact(F.array(own, F.when((event == "product_clicked") & (placement == "board-page"), F.lit(f"{prefix}product_clicked_board_page"))))


def relative_movement(current: Column, previous: Column, threshold: float, least_base: float) -> Column:
    """absolute, relative and direction (up or down) of a change that is large enough; null if it, or its base, is not."""
    absolute, base = current - previous, F.abs(previous)
    relative = absolute / F.nullif(base, F.lit(0)).cast("double")
    counts = (base >= least_base) & (absolute != 0) & (F.abs(relative) >= threshold)
    return F.when(counts, F.struct(absolute.alias("absolute"), relative.alias("relative"), F.when(absolute > 0, "up").otherwise("down").alias("direction")))


def retry_after_ms(header: Column, now: Column) -> Column:
    """A Retry-After header in milliseconds: seconds, or an HTTP date from now on; null for anything else."""
    seconds = F.when(F.trim(header).rlike(r"^\d+$"), F.trim(header).cast("long") * 1000)
    at = F.try_to_timestamp(F.regexp_replace(F.trim(header), "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    found = F.coalesce(seconds, F.when(at.isNotNull(), F.greatest(F.unix_millis(at) - F.unix_millis(now), F.lit(0).cast("long"))))
    return F.when(found.isNotNull(), F.least(found, F.lit(LONGEST_WAIT_MS).cast("long")))


def failure_kind(status: Column) -> Column:
    """What a failed HTTP status means to a caller."""
    return F.when(status.isin(401, 403), "authentication").when(status == 429, "rate_limited").otherwise("upstream")


def is_retryable(status: Column) -> Column:
    return F.coalesce((status == 429) | (status >= 500), F.lit(False))
