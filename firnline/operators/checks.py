"""Data-quality checks of the catalogue and its repair.

Every check is a predicate; one pass over products and one over sizes counts them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Link prefixes of known stores.
STORE_LINKS = ["https://trial-sport.ru/goods/", "https://www.trial-sport.ru/goods/", "https://www.traektoria.ru/product/", "https://traektoria.ru/product/"]
STORE_SITES = ["https://trial-sport.ru/", "https://www.trial-sport.ru/", "https://traektoria.ru/", "https://www.traektoria.ru/"]
PLACEHOLDER = "/boards/"


def _starts(c: str, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.col(c).startswith(p)
    return out


def implausible_waist(cm: Column, mm: Column) -> Column:
    return (mm <= 0) | (mm >= 400) | ((cm >= 140) & ~mm.between(200, 340)) | ((cm >= 100) & (cm < 140) & ~mm.between(170, 340)) | ((cm < 100) & ~mm.between(120, 240))


def product_checks() -> dict[str, tuple[str, Column]]:
    """Severity and predicate of the checks on active products (with has_size and has_free_size)."""
    trusted = (F.col("data_status") == "verified") & (F.trim(F.coalesce("source_url", F.lit(""))) != "") & ~_starts("source_url", STORE_SITES)
    return {
        "without_sizes": ("error", ~F.col("has_size")),
        "without_available_size": ("warning", ~F.col("has_free_size")),
        "price_not_positive": ("error", F.col("price_from") <= 0),
        "missing_image": ("warning", F.trim(F.coalesce("image_url", F.lit(""))) == ""),
        "placeholder_image": ("warning", F.col("image_url").startswith(PLACEHOLDER) | F.exists("gallery_images", lambda x: F.contains(x, F.lit(PLACEHOLDER)))),
        "not_a_store_link": ("warning", ~_starts("affiliate_url", STORE_LINKS)),
        "untrusted_flex": ("warning", ~F.coalesce(trusted, F.lit(False))),
        "incomplete_specs": ("warning", F.col("shape_type").isNull() | F.col("camber_profile").isNull()),
    }


def with_size_flags(products: DataFrame, sizes: DataFrame) -> DataFrame:
    have = sizes.groupBy(F.col("product_id").alias("_p")).agg(F.bool_or("is_available").alias("free"))
    return products.join(have, F.col("id") == F.col("_p"), "left").withColumn("has_size", F.col("_p").isNotNull()).withColumn("has_free_size", F.coalesce("free", F.lit(False))).drop("_p", "free")


def audit(products: DataFrame, sizes: DataFrame) -> DataFrame:
    """name, severity, failures, passed of every check."""
    p = with_size_flags(products.where("is_active"), sizes)
    checks = product_checks()
    counted = p.agg(*[F.count_if(c).alias(n) for n, (_, c) in checks.items()])
    s = sizes.join(products.select(F.col("id").alias("_p"), F.col("is_active").alias("_a")), F.col("product_id") == F.col("_p"))
    by_size = s.agg(F.count_if((F.col("size_cm") < 100) & (F.col("waist_width_mm") >= 235)).alias("short_adult_size"), F.count_if(F.col("_a") & implausible_waist(F.col("size_cm"), F.col("waist_width_mm"))).alias("implausible_waist"))
    severity = {n: x for n, (x, _) in checks.items()} | {"short_adult_size": "error", "implausible_waist": "error"}
    rows = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(severity[n]).alias("severity"), F.col(n).alias("failures")) for n in df.columns])).alias("r")).select("r.*")
    return rows(counted).unionByName(rows(by_size)).withColumn("passed", F.col("failures") == 0)


def failing_products(products: DataFrame, sizes: DataFrame, limit: int | None = None) -> DataFrame:
    """name and slug of active products that fail a check; ``limit`` keeps that many samples of each check."""
    from pyspark.sql import Window

    p = with_size_flags(products.where("is_active"), sizes)
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, (_, c) in product_checks().items()]))
    out = p.select(F.explode(names).alias("name"), "slug", "brand", "model_name")
    if limit is not None:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("brand", "model_name", "slug"))).where(F.col("_n") <= limit).drop("_n")
    return out


def source_counts(products: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.trim("source_name"), F.lit("")), F.lit("unknown")).alias("source_name")
    return products.groupBy(name).agg(F.count(F.lit(1)).alias("total_products"), F.count_if("is_active").alias("active_products"))


def width_of(mm: Column) -> Column:
    return F.when(mm >= 264, "wide").when(mm >= 257, "mid-wide").otherwise("regular")


def repaired_waists(sizes: DataFrame) -> DataFrame:
    """id, size_cm, old and new waist, new width type of the sizes whose waist was in the wrong unit."""
    mm = F.col("waist_width_mm")
    fixed = F.when(mm.between(1000, 4000), F.floor(mm / 10.0 + 0.5)).when((mm > 0) & (mm < 100), mm * 10).when((F.col("size_cm") >= 140) & mm.between(100, 199), mm + 100).otherwise(mm).cast("int")
    out = sizes.select("id", "size_cm", mm.alias("old_waist_width_mm"), fixed.alias("waist_width_mm"))
    return out.where("old_waist_width_mm <> waist_width_mm").withColumn("width_type", width_of(F.col("waist_width_mm")))


def with_repairs(sizes: DataFrame) -> DataFrame:
    """All sizes, repaired in place."""
    fixes = repaired_waists(sizes).select(F.col("id").alias("_i"), F.col("waist_width_mm").alias("_w"), F.col("width_type").alias("_t"))
    joined = sizes.join(fixes, F.col("id") == F.col("_i"), "left")
    return joined.withColumns({"waist_width_mm": F.coalesce("_w", "waist_width_mm"), "width_type": F.coalesce("_t", "width_type")}).drop("_i", "_w", "_t")


def invalid_families(offers: DataFrame) -> DataFrame:
    """family_id, members, bases and wides of families that are not one base and one wide member."""
    g = offers.where("family_id is not null").groupBy("family_id").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("member_role") == "base").alias("bases"), F.count_if(F.col("member_role") == "wide").alias("wides"))
    return g.where("members <> 2 or bases <> 1 or wides <> 1")
