"""Entities of this package as deterministic views of the supplied benchmark tables.

Each view is arithmetic on keys, so that any SQL engine builds the same rows. The SQL twins are in ``oracle``.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.sources import rounds

NOW = datetime(2024, 1, 20, 12, tzinfo=timezone.utc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, *columns: str, rows: int = rounds.DEALT_ROWS) -> DataFrame:
    """A table, or columns of it, in parts of about so many rows: for queries that work long on each row."""
    return rounds.dealt(table(spark, sf_dir, name).select(*(columns or ["*"])), rows)


def pick(x: Column, values: list) -> Column:
    """The value at x modulo the number of values; None gives null."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(x, F.lit(len(values))).cast("int"))


def _json(x: Column) -> Column:
    return F.coalesce(F.concat(F.lit('"'), x, F.lit('"')), F.lit("null"))


def payload(i: Column) -> Column:
    text = F.concat(
        F.lit('{"source":'), _json(pick(i, ["catalog", "result", " ", None, "quiz"])),
        F.lit(',"placement":'), _json(pick(i, ["card", "hero", "", "list"])),
        F.lit(',"board_slug":'), _json(F.when(i % 13 != 0, F.concat(F.lit("b-"), (i % 37).cast("string")))),
        F.lit(',"offer_slug":'), _json(F.when(i % 7 != 0, F.concat(F.lit("o-"), (i % 53).cast("string")))),
        F.lit(',"size_label":'), _json(F.concat((F.lit(150) + i % 9).cast("string"), pick(i, ["", "W"]))),
        F.lit(',"destination_url":'), _json(pick(i, ["https://www.shop-a.example/x", "http://Shop-B.example:8080/p?q=1", "https://WWW.shop-c.example#f", "not a url", "https://shop-d.example/", None])),
        F.lit("}"),
    )
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(i % 101 == 0, F.lit("{broken")).when(i % 17 == 0, quoted).otherwise(text)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, event_name, created_at, payload: the stored times are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    names = {"signup": "quiz_started", "purchase": "quiz_completed", "view": "result_viewed", "click": "product_clicked", "error": "home_viewed"}
    name = F.lit(None).cast("string")
    for k, v in names.items():
        name = F.when(F.col("event_type") == k, F.lit(v)).otherwise(name)
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("session_id"), name.alias("event_name"), F.col("ts").cast("timestamp").alias("created_at"), payload(F.col("event_id")).alias("payload"))


STYLES = ["all-mountain", "park", "freeride"]
SKILLS = ["beginner", "intermediate", "advanced"]
SHAPES = ["twin", "directional-twin", "directional", None, "tapered-directional", "asym-twin"]
CAMBERS = ["camber", "hybrid-camber", None, "rocker", "hybrid-rocker", "flat"]
LINES = ["men", "women", "unisex"]
STATUSES = ["verified", "draft", "verified"]
SOURCES = ["https://maker.example/specs", "https://trial-sport.ru/p", None, " ", "https://maker.example/b", "https://WWW.Traektoria.ru/x"]
LINKS = ["https://shop.example.net/x", "https://store-a.test/p", "", "https://store-b.test/q", "https://store-c.test/r"]


def products(spark: SparkSession, sf_dir: str, part: DataFrame | None = None) -> DataFrame:
    """``part``: its rows, where they have been read."""
    k = F.col("p_partkey")
    return (table(spark, sf_dir, "part") if part is None else part).select(
        F.concat(F.lit("id-"), k.cast("string")).alias("id"),
        F.concat(F.lit("p-"), k.cast("string")).alias("slug"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("model_name"),
        pick(k, ["2023/2024", None, "2024/2025"]).alias("season_label"),
        pick(k, STYLES).alias("riding_style"),
        pick(F.floor(k / 3), SKILLS).alias("skill_level"),
        (F.col("p_size") % 10 + 1).cast("int").alias("flex"),
        F.when(k % 19 == 0, 0).otherwise(F.floor("p_retailprice")).cast("int").alias("price_from"),
        pick(F.floor(k / 2), LINES).alias("board_line"),
        pick(F.floor(k / 5), SHAPES).alias("shape_type"),
        pick(F.floor(k / 7), CAMBERS).alias("camber_profile"),
        pick(k, STATUSES).alias("data_status"),
        F.when(k % 23 != 0, F.lit("maker")).alias("source_name"),
        pick(F.floor(k / 3), SOURCES).alias("source_url"),
        F.when(k % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 28).cast("int"))).alias("source_checked_at"),
        pick(F.floor(k / 11), LINKS).alias("affiliate_url"),
        (k % 11 != 0).alias("is_active"),
        F.when(k % 5 < 2, F.concat(F.lit("f-"), F.floor(k / 5).cast("string"))).alias("family_id"),
        F.when(k % 5 == 0, "base").when(k % 5 == 1, "wide").alias("member_role"),
        F.concat(F.lit("img-"), (k % 40).cast("string")).alias("image_url"),
        F.array(F.concat(F.lit("img-"), (k % 40).cast("string")), F.lit(" "), F.concat(F.lit(" g-"), (k % 7).cast("string"))).alias("gallery_images"),
    )


def sizes(spark: SparkSession, sf_dir: str, part: DataFrame | None = None) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("n")
    waist = (F.lit(238) + (k * 5 + n * 3) % 40).cast("int")
    low = (F.lit(40) + (k * 3 + n * 7) % 40).cast("int")
    return (table(spark, sf_dir, "part") if part is None else part).select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n")).where((k % 29 != 0)).select(
        F.concat(F.lit("s-"), k.cast("string"), F.lit("-"), n.cast("string")).alias("id"),
        F.concat(F.lit("id-"), k.cast("string")).alias("product_id"),
        F.when((k + n) % 37 == 0, 95.0).otherwise((F.lit(138) + (k * 7 + n * 4) % 30).cast("double")).alias("size_cm"),
        F.when(n == 4, F.concat((F.lit(138) + (k * 7 + n * 4) % 30).cast("string"), F.lit("w"))).alias("size_label"),
        waist.alias("waist_width_mm"),
        F.when((k + n) % 13 == 0, 0).otherwise(low).cast("int").alias("recommended_weight_min"),
        F.when((k + n) % 13 == 0, F.lit(None)).when((k + n) % 5 == 0, F.lit(None)).otherwise(low + 20).cast("int").alias("recommended_weight_max"),
        F.when(waist >= 264, "wide").when(waist >= 257, "mid-wide").otherwise("regular").alias("width_type"),
        ((k + n) % 3 != 0).alias("is_available"),
    )


def riders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("rider_id"),
        (F.lit(150) + (k * 11) % 45).cast("double").alias("height_cm"),
        (F.lit(42) + (k * 7) % 60).cast("double").alias("weight_kg"),
        (F.lit(36) + (k % 26) / F.lit(2.0)).cast("double").alias("boot_size_eu"),
        pick(F.floor(k / 2), ["men", "women", "any"]).alias("board_line_preference"),
        pick(F.floor(k / 5), SKILLS).alias("skill_level"),
        pick(k, STYLES).alias("riding_style"),
        pick(F.floor(k / 3), ["balanced", "switch-freestyle", "groomers-carving", "soft-snow"]).alias("terrain_priority"),
        pick(F.floor(k / 7), ["relaxed", "balanced", "aggressive"]).alias("aggressiveness"),
        pick(F.floor(k / 11), ["standard", "duck", "unknown"]).alias("stance_type"),
    )


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One family for each pair of neighbouring products that the product view groups, with the base's attributes."""
    p = products(spark, sf_dir).where("member_role = 'base'")
    return p.select(
        F.col("family_id").alias("id"),
        F.concat(F.lit("fam-"), F.col("family_id")).alias("slug"),
        "brand",
        "model_name",
        "season_label",
        "riding_style",
        "skill_level",
        F.when(F.col("flex") != 5, F.col("flex")).alias("flex"),
        "board_line",
        "shape_type",
        "camber_profile",
        "data_status",
        "source_name",
        "source_url",
        "source_checked_at",
    )
