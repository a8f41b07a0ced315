"""Delivery ledger: what to do with each logical delivery, and its state afterwards.

Transitions are projections over a snapshot of the ledger; one writer at a time is assumed.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the delivery protocol
MAX_ATTEMPTS = 5
UNKNOWN_GUARD_HOURS = 23
BACKOFF_MINUTES = [15, 60, 360, 720]
RETENTION_DAYS = 90
TERMINAL = ["sent", "partial_sent", "failed", "conflict"]
SWEEP_RANKS = {"disabled": 0, "noop": 0, "sent": 1, "partial_sent": 1, "busy": 2, "pending": 3, "conflict": 4, "failed": 5}


def claim_decision(now: datetime) -> Column:
    """Struct of action and category for ledger rows that carry the content hash of the digest at hand (new_hash).

    The first rule that holds decides; a row without a status is a delivery that the ledger does not know yet.
    """
    status, at = F.col("delivery_status"), F.lit(now)
    out = lambda action, category=None: F.struct(F.lit(action).alias("action"), (category if category is not None else F.lit(None).cast("string")).alias("category"))
    stale = F.col("last_attempt_at") <= F.lit(now - timedelta(hours=UNKNOWN_GUARD_HOURS))
    expired = out("fail", F.lit("provider_outcome_unknown_expired"))
    rules = [
        (status.isNull(), out("create_and_claim")),
        (~F.col("content_hash").eqNullSafe(F.col("new_hash")), out("conflict", F.lit("logical_id_content_conflict"))),
        (status.isin("sent", "partial_sent"), out("noop")),
        (status == "conflict", out("conflict", F.coalesce("last_error_category", F.lit("delivery_conflict")))),
        (status == "failed", out("fail", F.coalesce("last_error_category", F.lit("delivery_failed")))),
        ((status == "sending") & (F.col("lease_expires_at") > at), out("busy")),
        ((status == "sending") & stale, expired),
        (F.col("attempt_count") >= MAX_ATTEMPTS, out("fail", F.lit("delivery_attempts_exhausted"))),
        (F.col("next_attempt_at") > at, out("busy")),
        ((F.col("last_error_category") == "provider_outcome_unknown") & stale, expired),
    ]
    chain = F.when(*rules[0])
    for when, then in rules[1:]:
        chain = chain.when(when, then)
    return chain.otherwise(out("claim_stored"))


def backoff_minutes(attempts: Column) -> Column:
    return F.element_at(F.lit(BACKOFF_MINUTES), F.least(F.greatest(attempts, F.lit(1)), F.lit(len(BACKOFF_MINUTES))).cast("int"))


def provider_outcome() -> Column:
    """Struct of type and category from message_id, threw, error_name and status_code."""
    name, code = F.col("error_name"), F.col("status_code")
    out = lambda kind, category=None: F.struct(F.lit(kind).alias("type"), F.lit(category).cast("string").alias("category"))
    return (
        F.when(F.length("message_id") > 0, out("success"))
        .when(F.coalesce("threw", F.lit(False)) | (name.isNull() & code.isNull()), out("retry", "provider_outcome_unknown"))
        .when(name == "invalid_idempotent_request", out("conflict", "provider_idempotency_conflict"))
        .when(name == "concurrent_idempotent_requests", out("retry", "provider_concurrent_request"))
        .when((code == 429) | (name == "rate_limit_exceeded"), out("retry", "provider_rate_limited"))
        .when(code.isNull(), out("retry", "provider_outcome_unknown"))
        .when(code >= 500, out("retry", "provider_unavailable"))
        .otherwise(out("failed", "provider_request_rejected"))
    )


def finished(claims: DataFrame, now: datetime) -> DataFrame:
    """Claims (with lease_token, held_token, digest_status and outcome) in the state after the provider has answered."""
    kind, category = F.col("outcome.type"), F.col("outcome.category")
    held = (F.col("delivery_status") == "sending") & F.col("lease_token").eqNullSafe(F.col("held_token"))
    over = kind.isin("conflict", "failed") | (F.col("attempt_count") >= MAX_ATTEMPTS)
    status = F.when(kind == "success", F.when(F.col("digest_status") == "complete", "sent").otherwise("partial_sent")).when(kind == "conflict", "conflict").when(over, "failed").otherwise("pending")
    again = F.when(status == "pending", F.lit(now) + F.make_dt_interval(mins=backoff_minutes(F.col("attempt_count"))))
    return claims.select(
        "logical_id",
        F.when(held, status).otherwise(F.col("delivery_status")).alias("delivery_status"),
        F.when(held, F.when(kind == "success", None).otherwise(category)).otherwise(F.lit("delivery_lease_lost")).alias("category"),
        F.when(held, again).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"),
    )


def due(ledger: DataFrame, now: datetime, limit: int = 10) -> DataFrame:
    at = F.lit(now)
    waiting = (F.col("delivery_status") == "pending") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= at))
    left = (F.col("delivery_status") == "sending") & (F.col("lease_expires_at") <= at)
    return ledger.where(waiting | left).orderBy(F.coalesce("next_attempt_at", "lease_expires_at", "created_at"), "logical_id").limit(limit)


def retained(ledger: DataFrame, now: datetime, limit: int = 100) -> DataFrame:
    """The ledger without the oldest ``limit`` rows whose retention is over."""
    old = ledger.where(F.col("delivery_status").isin(TERMINAL) & (F.col("created_at") <= F.lit(now - timedelta(days=RETENTION_DAYS))))
    gone = old.orderBy("created_at", "logical_id").limit(limit).select(F.col("logical_id").alias("_gone"))
    return ledger.join(gone, F.col("logical_id") == F.col("_gone"), "left_anti")


def sweep_status(results: DataFrame) -> DataFrame:
    """The gravest status of each sweep; the first of equals wins."""
    rank = F.lit(None).cast("int")
    for status, r in SWEEP_RANKS.items():
        rank = F.when(F.col("status") == status, r).otherwise(rank)
    return results.groupBy("sweep").agg(F.max_by("status", F.struct(rank.alias("r"), (-F.col("position")).alias("p"))).alias("status"))


def latest_per(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
