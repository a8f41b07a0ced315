"""Golden audit of rider profiles: allowed ranges and sets per case, and pairwise rules between cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.operators.catalogue import WIDTHS, order_in

RISKS = ["low", "medium", "high"]


def _check(name: str, good: Column, bad: Column, priority: Column) -> Column:
    """A check passes, or has the status ``bad`` with a priority."""
    return F.struct(F.lit(name).alias("check"), F.when(good, "PASS").otherwise(bad).alias("status"), F.when(~good, priority).alias("priority"))


def audit_cases(profiles: DataFrame) -> DataFrame:
    """case_id, check, status, priority of profiled cases.

    Cases have sane_min_cm, sane_max_cm, widths, waist_min, waist_max, drag_risks and primary_shapes (arrays). Too
    narrow is a failure of safety, too wide a matter of review.
    """
    rank = lambda c: order_in(F.col(c), WIDTHS)
    least = F.array_min(F.transform("widths", lambda w: order_in(w, WIDTHS)))
    least_risk = F.array_max(F.transform("drag_risks", lambda r: order_in(r, RISKS)))
    narrow = rank("width_type") < least
    checks = [
        _check("length", (F.col("lo") >= F.col("sane_min_cm")) & (F.col("hi") <= F.col("sane_max_cm")), F.lit("REVIEW"), F.lit("P1-fit")),
        _check("width", F.array_contains("widths", F.col("width_type")), F.when(narrow, "FAIL").otherwise("REVIEW"), F.when(narrow, "P0-safety").otherwise("P2-profile")),
        _check("waist", F.col("waist").between(F.col("waist_min"), F.col("waist_max")), F.when(F.col("waist") < F.col("waist_min"), "FAIL").otherwise("REVIEW"), F.when(F.col("waist") < F.col("waist_min"), "P0-safety").otherwise("P2-profile")),
        _check("boot_drag", F.array_contains("drag_risks", F.col("boot_drag_risk")), F.when(order_in(F.col("boot_drag_risk"), RISKS) > least_risk, "REVIEW").otherwise("FAIL"), F.when(order_in(F.col("boot_drag_risk"), RISKS) > least_risk, "P2-profile").otherwise("P0-safety")),
        _check("shape", F.array_contains("primary_shapes", F.col("shape_first")), F.lit("REVIEW"), F.lit("P2-profile")),
    ]
    return profiles.select("case_id", F.explode(F.array(*checks)).alias("c")).select("case_id", "c.*")


def audit_invariants(rules: DataFrame, profiles: DataFrame) -> DataFrame:
    """rule_id, status and priority of rules (rule_id, rule, left_id, right_id) between profiled cases."""
    shown = ["lo", "hi", "width_type", "waist", "boot_drag_risk", "shape_first"]
    side = lambda s: profiles.select(F.col("case_id").alias(f"{s}_id"), F.struct(*shown).alias(s))
    j = rules.join(side("left"), "left_id").join(side("right"), "right_id")
    a, b = lambda c: F.col(f"left.{c}"), lambda c: F.col(f"right.{c}")
    wide, risk = lambda c: order_in(c, WIDTHS), lambda c: order_in(c, RISKS)
    holds = {
        "length_not_shorter": (b("lo") >= a("lo")) & (b("hi") >= a("hi")),
        "length_not_longer": (b("lo") <= a("lo")) & (b("hi") <= a("hi")),
        "waist_not_narrower": b("waist") >= a("waist"),
        "width_not_narrower": wide(b("width_type")) >= wide(a("width_type")),
        "boot_drag_not_lower": risk(b("boot_drag_risk")) >= risk(a("boot_drag_risk")),
        "same_physical_fit_expectation": F.col("left") == F.col("right"),
    }
    ok = F.lit(None).cast("boolean")
    for name, when in holds.items():
        ok = F.when(F.col("rule") == name, when).otherwise(ok)
    safety = (a("width_type") != b("width_type")) | (a("waist") != b("waist")) | (a("boot_drag_risk") != b("boot_drag_risk"))
    length = (a("lo") != b("lo")) | (a("hi") != b("hi"))
    fit = F.when(F.col("rule").startswith("length"), "P1-fit").when(F.col("rule") == "same_physical_fit_expectation", F.when(safety, "P0-safety").when(length, "P1-fit").otherwise("P2-profile")).otherwise("P0-safety")
    return j.select("rule_id", F.when(ok.isNull(), "NOT_OBSERVABLE").when(ok, "PASS").otherwise("FAIL").alias("status"), F.when(ok.isNull(), "P3-observability").when(~ok, fit).alias("priority"))


def summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("check").pivot("status", ["PASS", "REVIEW", "FAIL"]).count().na.fill(0)
