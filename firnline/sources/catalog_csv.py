"""Catalogue CSV files: models with their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.functions.text import split_list, truthy

ALLOWED = {
    "riding_style": ["all-mountain", "park", "freeride"],
    "skill_level": ["beginner", "intermediate", "advanced"],
    "board_line": ["men", "women", "unisex"],
    "shape_type": ["twin", "asym-twin", "directional-twin", "directional", "tapered-directional"],
    "camber_profile": ["camber", "rocker", "flat", "hybrid-camber", "hybrid-rocker"],
    "data_status": ["draft", "verified"],
    "width_type": ["regular", "mid-wide", "wide"],
}
MODEL_COLUMNS = ["slug", "brand", "model_name", "description_short", "description_full", "riding_style", "skill_level", "flex", "price_from", "image_url", "affiliate_url", "is_active", "board_line", "shape_type", "camber_profile", "data_status", "source_name", "source_url", "source_checked_at", "scenarios", "not_ideal_for"]
REQUIRED = ["slug", "brand", "model_name", "description_short", "description_full", "riding_style", "skill_level", "image_url", "affiliate_url", "board_line"]
SIZE_COLUMNS = ["product_slug", "size_cm", "size_label", "waist_width_mm", "recommended_weight_min", "recommended_weight_max", "width_type", "is_available"]


def delimiter(spark: SparkSession, path: str) -> str:
    """Semicolon unless the first line that is not blank has more commas."""
    first = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1).collect()
    line = first[0][0] if first else ""
    return ";" if line.count(";") >= line.count(",") else ","


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as trimmed text, null where blank or absent."""
    raw = spark.read.csv(path, sep=delimiter(spark, path), header=True, multiLine=True, escape='"', inferSchema=False)
    names = {c.replace("﻿", "").strip(): c for c in raw.columns}
    return raw.select(*[(F.nullif(F.trim(F.col(f"`{names[c]}`")), F.lit("")) if c in names else F.lit(None).cast("string")).alias(c) for c in columns])


def number(c: str) -> Column:
    return F.regexp_replace(F.col(c), "^([^,]*),", "$1.").try_cast("double")


def _not_allowed(c: str) -> Column:
    return F.when(F.col(c).isNotNull() & ~F.col(c).isin(ALLOWED[c]), F.lit(f"{c} is not allowed"))


def _missing(c: str) -> Column:
    return F.when(F.col(c).isNull(), F.lit(f"{c} is missing"))


def _no_number(c: str, optional: bool = False) -> Column:
    bad = number(c).isNull() & F.col(c).isNotNull() if optional else number(c).isNull()
    return F.when(bad, F.lit(f"{c} is no number"))


def check_models(models: DataFrame, sizes: DataFrame) -> DataFrame:
    """models with problems (array of text); sound rows have none."""
    have = sizes.select(F.col("product_slug").alias("_s")).distinct()
    status = F.coalesce("data_status", F.lit("draft"))
    problems = [_missing(c) for c in REQUIRED] + [_not_allowed(c) for c in ALLOWED if c != "width_type"] + [_no_number("flex"), _no_number("price_from")]
    problems += [
        F.when(F.col("source_url").isNotNull() & F.try_parse_url("source_url", F.lit("HOST")).isNull(), "source_url is no URL"),
        F.when(F.col("source_checked_at").isNotNull() & ~F.col("source_checked_at").rlike(r"^\d{4}-\d{2}-\d{2}$"), "source_checked_at is no date"),
        F.when((status == "verified") & (F.col("source_name").isNull() | F.col("source_url").isNull()), "verified without a source"),
        F.when(F.col("_s").isNull(), "no sizes"),
    ]
    return models.join(have, F.col("slug") == F.col("_s"), "left").withColumn("problems", F.array_compact(F.array(*problems))).drop("_s")


def check_sizes(sizes: DataFrame) -> DataFrame:
    problems = [_missing("product_slug"), _missing("width_type"), _not_allowed("width_type"), *[_no_number(c) for c in ("size_cm", "waist_width_mm", "recommended_weight_min")], _no_number("recommended_weight_max", optional=True)]
    return sizes.withColumn("problems", F.array_compact(F.array(*problems)))


def products_of(models: DataFrame, sizes: DataFrame) -> DataFrame:
    """Typed products with their sizes nested in order of length and label; raises on the first problem if there is one."""
    good = lambda df, what: df.withColumn("problems", F.when(F.size("problems") > 0, F.raise_error(F.concat(F.lit(f"{what}: "), F.array_join("problems", "; ")))).otherwise(F.col("problems")))
    s = good(check_sizes(sizes), "sizes").where(F.size("problems") == 0)
    one = F.struct(number("size_cm").alias("size_cm"), F.coalesce("size_label", F.lit("")).alias("size_label"), number("waist_width_mm").cast("int").alias("waist_width_mm"), number("recommended_weight_min").cast("int").alias("recommended_weight_min"), number("recommended_weight_max").cast("int").alias("recommended_weight_max"), "width_type", F.when(F.col("is_available").isNull(), True).otherwise(truthy(F.col("is_available"))).alias("is_available"))
    nested = s.groupBy(F.col("product_slug").alias("_p")).agg(F.array_sort(F.collect_list(one)).alias("sizes"))
    m = good(check_models(models, sizes), "models").where(F.size("problems") == 0).drop("problems")
    typed = m.withColumns({"flex": number("flex"), "price_from": number("price_from"), "is_active": truthy(F.col("is_active")), "data_status": F.coalesce("data_status", F.lit("draft")), "source_checked_at": F.col("source_checked_at").try_cast("date"), "scenarios": split_list(F.col("scenarios")), "not_ideal_for": split_list(F.col("not_ideal_for"))})
    return typed.join(nested, F.col("slug") == F.col("_p")).drop("_p")


def read_catalogue(spark: SparkSession, models_path: str, sizes_path: str) -> DataFrame:
    return products_of(read_csv(spark, models_path, MODEL_COLUMNS), read_csv(spark, sizes_path, SIZE_COLUMNS))


def overlay_official(products: DataFrame, specs: DataFrame) -> DataFrame:
    """Products with flex, camber and shape of official specs (slug, flex, camber_profile, shape_type, board_line); a spec of another line is left out."""
    s = specs.select(F.col("slug").alias("_s"), *[F.col(c).alias(f"_{c}") for c in ("flex", "camber_profile", "shape_type", "board_line")])
    fits = F.col("_s").isNotNull() & (F.col("_board_line").isNull() | (F.col("_board_line") == F.col("board_line")))
    joined = products.join(s, F.col("slug") == F.col("_s"), "left")
    return joined.withColumns({c: F.when(fits, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in ("flex", "camber_profile", "shape_type")}).select(*products.columns)
