"""Responses of a web-analytics service that have landed as JSON: positional metrics become columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.num import clamp, share

RESPONSE = "struct<totals:array<double>,data:array<struct<dimensions:array<struct<id:string,name:string>>,metrics:array<double>>>,sampled:boolean,sample_share:double>"
TOTALS = ["users", "visits", "bounce_rate", "page_depth", "avg_visit_seconds"]
GOALS = ["goal_1", "goal_2", "goal_3"]
#: Two such pairs of wrongly decoded letters, or the replacement character, spoil a label.
MOJIBAKE = r"[РС][\x{80}-\x{BF}\x{400}\x{402}-\x{40F}\x{450}\x{452}-\x{45F}\x{2000}-\x{206F}]"
FALLBACKS = {"organic": "Переходы из поисковых систем", "referral": "Переходы по ссылкам на сайтах", "direct": "Прямые заходы", "internal": "Внутренние переходы"}


def clean_label(source: Column, name: Column) -> Column:
    bad = (F.size(F.regexp_extract_all(name, F.lit(MOJIBAKE), F.lit(0))) >= 2) | F.contains(name, F.lit("�"))
    plain = source
    for k, v in FALLBACKS.items():
        plain = F.when(source == k, v).otherwise(plain)
    return F.when(name.isNull() | (F.trim(name) == ""), source).when(bad, plain).otherwise(F.trim(name))


def percent(x: Column) -> Column:
    return clamp(x / F.lit(100.0), 0.0, 1.0)


def totals(raw: DataFrame) -> DataFrame:
    """window_key and the five traffic figures, null where the response lacks one."""
    t = F.from_json("response", RESPONSE)["totals"]
    whole = F.coalesce((F.size(t) >= len(TOTALS)) & ~F.exists(F.slice(t, 1, len(TOTALS)), lambda x: x.isNull()), F.lit(False))
    cols = [F.when(whole, percent(t[i]) if n == "bounce_rate" else t[i]).alias(n) for i, n in enumerate(TOTALS)]
    return raw.select("window_key", *cols)


def sources(raw: DataFrame) -> DataFrame:
    """window_key, source, label, visits, users, share; rows that lack a field are left out before shares are taken."""
    from pyspark.sql import Window

    row = F.explode(F.from_json("response", RESPONSE)["data"])
    r = raw.select("window_key", row.alias("r")).select("window_key", F.nullif(F.trim(F.get("r.dimensions", F.lit(0))["id"]), F.lit("")).alias("source"), F.get("r.dimensions", F.lit(0))["name"].alias("name"), F.get("r.metrics", F.lit(0)).alias("visits"), F.get("r.metrics", F.lit(1)).alias("users"))
    r = r.where("source is not null and visits is not null and users is not null")
    return r.select("window_key", "source", clean_label(F.col("source"), F.col("name")).alias("label"), "visits", "users", share(F.col("visits"), F.sum("visits").over(Window.partitionBy("window_key"))).alias("share"))


def goals(metrics: Column) -> Column:
    """Array of a struct per goal from four metrics each after the first two; null where one is missing."""
    at = lambda i: F.get(metrics, F.lit(i))
    each = [F.struct(F.lit(g).alias("goal"), at(2 + 4 * k).alias("users"), at(3 + 4 * k).alias("visits"), percent(at(4 + 4 * k)).alias("visit_rate"), percent(at(5 + 4 * k)).alias("user_rate")) for k, g in enumerate(GOALS)]
    whole = F.size(F.filter(F.slice(metrics, 3, 4 * len(GOALS)), lambda x: x.isNotNull())) == 4 * len(GOALS)
    return F.when(whole, F.array(*each))


def safe_landing(path: Column) -> Column:
    """A path of this site without query or fragment."""
    return path.startswith("/") & ~path.startswith("//") & ~F.contains(path, F.lit("?")) & ~F.contains(path, F.lit("#"))
