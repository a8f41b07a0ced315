"""Recommendation, catalogue and data-quality queries over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.operators import catalogue as cat
from firnline.operators import checks as chk
from firnline.operators import match_texts as txt
from firnline.operators import recommend as rec
from firnline.plans import bindings as b


def rider_profiles(s: SparkSession, d: str) -> DataFrame:
    out = rec.with_profile(b.riders(s, d))
    return out.select("rider_id", "lo", "hi", "target", "width_type", "waist", "boot_drag_risk", "shape_first", F.array_join("shape_others", ",").alias("shape_others"), "flex_lo", "flex_hi", "over_width")


def product_readiness(s: SparkSession, d: str) -> DataFrame:
    return rec.with_trust(b.products(s, d)).select("slug", "verified", "has_source", "flex_trusted", "placeholder_link", "ready")


def recommendations(s: SparkSession, d: str) -> DataFrame:
    return rec.recommend(b.riders(s, d), b.products(s, d), b.sizes(s, d))


QUERIES = [rider_profiles, product_readiness, recommendations]


def _items(s: SparkSession, d: str) -> DataFrame:
    return cat.items(b.families(s, d), b.products(s, d), b.sizes(s, d))


def _placed(df: DataFrame) -> DataFrame:
    """Slug and place of a result of a few rows."""
    return df.select("slug").withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long"))


def catalogue_items(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).select("slug", "family_id", "brand", "season_label", "riding_style", F.col("flex").cast("double").alias("flex"), "source_url", "price_from", "has_available_size", F.size("offers").cast("long").alias("n_offers"), F.size("sizes").cast("long").alias("n_sizes"), "default_offer_slug", F.array_join("sizes.label", ",").alias("labels"), F.array_join("media", ",").alias("media"))


def catalogue_presentation(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).select("slug", F.array_join(cat.width_types(), ",").alias("widths"), cat.width_summary().alias("width_summary"), cat.availability_headline().alias("headline"), cat.availability_preview().alias("preview"))


def catalogue_browse(s: SparkSession, d: str) -> DataFrame:
    found = cat.matching(_items(s, d), query="Brand#1", styles=["park", "all-mountain"], lines=["men", "unisex"], widths=["wide", "mid-wide"])
    return cat.with_places(found).select("slug", "place")


def catalogue_by_price(s: SparkSession, d: str) -> DataFrame:
    return cat.with_places(_items(s, d), "price-desc").select("slug", "place")


def catalogue_related(s: SparkSession, d: str) -> DataFrame:
    return _placed(cat.related(_items(s, d), "p-4"))


def catalogue_routes(s: SparkSession, d: str) -> DataFrame:
    p = b.products(s, d)
    aliases = p.where("family_id is null").select(F.concat(F.lit("old-"), "slug").alias("alias"), "slug")
    asked = p.select("slug").unionByName(aliases.select(F.col("alias").alias("slug"))).unionByName(b.families(s, d).select(F.concat(F.lit("nowhere-"), "id").alias("slug")))
    return cat.resolve_slug(asked, _items(s, d), aliases, p)


def quality_audit(s: SparkSession, d: str) -> DataFrame:
    return chk.audit(b.products(s, d), b.sizes(s, d))


def waist_repair(s: SparkSession, d: str) -> DataFrame:
    w, kind = F.col("waist_width_mm"), F.split_part("id", F.lit("-"), F.lit(2)).cast("int") % 4
    broken = b.sizes(s, d).withColumn("waist_width_mm", F.when(kind == 0, w * 10 + 5).when(kind == 1, F.floor(w / 10)).when(kind == 2, w - 100).otherwise(w).cast("int"))
    return chk.repaired_waists(broken)


def source_counts(s: SparkSession, d: str) -> DataFrame:
    return chk.source_counts(b.products(s, d))


def invalid_families(s: SparkSession, d: str) -> DataFrame:
    return chk.invalid_families(b.products(s, d).where("is_active"))


def failing_products(s: SparkSession, d: str) -> DataFrame:
    return chk.failing_products(b.products(s, d), b.sizes(s, d), limit=50)


QUERIES += [catalogue_items, catalogue_presentation, catalogue_browse, catalogue_by_price, catalogue_related, catalogue_routes, quality_audit, waist_repair, source_counts, invalid_families, failing_products]


def product_issues(s: SparkSession, d: str) -> DataFrame:
    return cat.product_issues(rec.with_trust(b.products(s, d))).select("slug", F.array_join("issues", ",").alias("issues"))


def representative_widths(s: SparkSession, d: str) -> DataFrame:
    return cat.representative_width(b.sizes(s, d))


def board_details(s: SparkSession, d: str) -> DataFrame:
    return cat.board_details(_items(s, d))


def match_trust(s: SparkSession, d: str) -> DataFrame:
    return rec.match_trust(rec.recommend(b.riders(s, d), b.products(s, d), b.sizes(s, d)), b.products(s, d)).withColumn("last_checked", F.col("last_checked").cast("string"))


def result_snapshots(s: SparkSession, d: str) -> DataFrame:
    made = rec.result_snapshots(rec.recommend(b.riders(s, d), b.products(s, d), b.sizes(s, d)))
    slugs = F.from_json("snapshot", "array<struct<place:long,slug:string,score:long>>")
    return made.select("rider_id", F.array_join(F.transform(slugs, lambda x: F.concat_ws(":", x["place"].cast("string"), x["slug"], x["score"].cast("string"))), ",").alias("boards"))


QUERIES += [product_issues, representative_widths, board_details, match_trust, result_snapshots]


def match_reasons(s: SparkSession, d: str) -> DataFrame:
    made = txt.matches_with_texts(b.riders(s, d), b.products(s, d), b.sizes(s, d))
    return made.select("rider_id", "list", "place", "slug", F.array_join("reason_codes", ",").alias("reasons"))


def match_comparison(s: SparkSession, d: str) -> DataFrame:
    made = txt.comparison(b.riders(s, d), b.products(s, d), b.sizes(s, d))
    word = lambda i, *words: F.regexp_extract(F.col("highlights")[i], f"({'|'.join(words)})", 1)
    return made.select("rider_id", "rank", "title", "role_label", word(0, "нижней", "верхней", "центральный").alias("length_word"), F.col("highlights")[1].alias("width_line"), word(2, "совпадает", "универсальный", "смещена", "компромиссный").alias("style_word"), word(3, "не уточнена", "попадание", "рабочий", "смещена").alias("shape_word"), F.contains(F.col("highlights")[4], F.lit("проверена:")).alias("ready"))


QUERIES += [match_reasons, match_comparison]
