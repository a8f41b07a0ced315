"""Model families: which products are widths of one model.

A variant's name without its width marker is joined to the names of its brand; rules in order decide each pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.text import blank_to_null, family_brand, family_model, family_season, width_marker

#: Name endings that are part of a model's identity, by priority.
PROTECTED = ["pro model", "2 0", "limited", "carbon", "women", "womens", "youth", "ultra", "team", "plus", "kids", "pro", "ltd", "x"]


def named(products: DataFrame) -> DataFrame:
    """Products with normalised brand, model, season and width marker (one Python pass for the compatibility form)."""
    out = products.withColumn("n_brand", family_brand(F.col("brand"))).withColumn("n_model", family_model(F.col("model_name"))).withColumn("n_season", family_season(F.col("season_label")))
    return out.withColumn("marker", width_marker(F.col("n_model")))


def with_width_evidence(products: DataFrame, sizes: DataFrame) -> DataFrame:
    """n_sizes and wide_evidence (a W label or a width that is not regular) of each product."""
    w = sizes.groupBy(F.col("product_id").alias("_p")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(F.col("size_label").rlike(r"(?i)\d+(?:[.,]\d+)?\s*w\b"), F.lit(False)) | F.col("width_type").isin("mid-wide", "wide")).alias("e"))
    return products.join(w, F.col("id") == F.col("_p"), "left").withColumn("n_sizes", F.coalesce("n", F.lit(0))).withColumn("wide_evidence", F.coalesce("e", F.lit(False))).drop("_p", "n", "e")


def _differs(a: str, b: str, known_only: bool) -> Column:
    x, y = F.lower(F.coalesce(F.trim(F.col(a)), F.lit(""))), F.lower(F.coalesce(F.trim(F.col(b)), F.lit("")))
    return (x != y) & (x != "") & (y != "") if known_only else x != y


def conflicts(left: str, right: str) -> Column:
    """Fields that differ; an unknown shape or camber conflicts with nothing."""
    strict = [(c, False) for c in ("riding_style", "skill_level", "board_line")] + [(c, True) for c in ("shape_type", "camber_profile")]
    return F.array_compact(F.array(*[F.when(_differs(f"{left}.{c}", f"{right}.{c}", k), F.lit(c)) for c, k in strict]))


def width_pairs(products: DataFrame, sizes: DataFrame) -> DataFrame:
    """base, variant, marker, classification and reason of every variant and base of one brand and name."""
    p = with_width_evidence(named(products), sizes)
    pairs = p.where("marker.kind <> 'base'").alias("v").join(p.alias("b"), (F.col("v.n_brand") == F.col("b.n_brand")) & (F.col("v.marker.base") == F.col("b.n_model")))
    both = F.col("b.n_season").isNotNull() & F.col("v.n_season").isNotNull()
    clash = conflicts("b", "v")
    rules = [
        (both & (F.col("b.n_season") != F.col("v.n_season")), "KEEP_SEPARATE", "seasons differ"),
        (F.col("v.marker.kind") != "explicit-wide", "REVIEW_WIDTH_FAMILY", "marker is ambiguous"),
        (~both, "REVIEW_WIDTH_FAMILY", "season is missing"),
        (F.size(clash) > 0, "REVIEW_WIDTH_FAMILY", "fields conflict"),
        ((F.col("b.n_sizes") == 0) | (F.col("v.n_sizes") == 0), "REVIEW_WIDTH_FAMILY", "no sizes"),
        (~F.col("v.wide_evidence"), "REVIEW_WIDTH_FAMILY", "no wide sizes"),
    ]
    kind, why = F.lit("HIGH_CONFIDENCE_WIDTH_FAMILY"), F.lit("same name, season and make")
    for when, k, r in reversed(rules):
        kind, why = F.when(when, k).otherwise(kind), F.when(when, r).otherwise(why)
    return pairs.select(F.col("b.slug").alias("base"), F.col("v.slug").alias("variant"), F.col("v.marker.kind").alias("marker"), kind.alias("classification"), why.alias("reason"), clash.alias("conflicts"), F.col("b.n_brand").alias("brand"), F.col("v.marker.base").alias("model"), F.when(both & (F.col("b.n_season") == F.col("v.n_season")), F.col("b.n_season")).alias("season"))


def orphans(products: DataFrame) -> DataFrame:
    """Variants by name of which there is no base."""
    p = named(products)
    bases = p.select(F.col("n_brand").alias("_b"), F.col("n_model").alias("_m"))
    return p.where("marker.kind <> 'base'").join(bases, (F.col("n_brand") == F.col("_b")) & (F.col("marker.base") == F.col("_m")), "left_anti").select("slug", F.col("marker.kind").alias("marker"))


def protected_pairs(products: DataFrame) -> DataFrame:
    """base, variant, suffix of names that differ by a protected ending; the first ending that has a base counts."""
    p = named(products).select("slug", "n_brand", "n_model")
    endings = F.array_compact(F.array(*[F.when(F.endswith("n_model", F.lit(f" {s}")), F.struct(F.lit(i).alias("place"), F.lit(s).alias("suffix"), F.trim(F.regexp_replace("n_model", f" {s}$", "")).alias("stem"))) for i, s in enumerate(PROTECTED)]))
    tried = p.select(F.col("slug").alias("variant"), "n_brand", F.explode(endings).alias("e")).where(F.length("e.stem") > 0)
    met = tried.alias("t").join(p.alias("b"), (F.col("t.n_brand") == F.col("b.n_brand")) & (F.col("t.e.stem") == F.col("b.n_model"))).select(F.col("b.slug").alias("base"), "t.variant", F.col("t.e.place").alias("place"), F.col("t.e.suffix").alias("suffix"))
    best = met.groupBy(F.col("variant").alias("_v")).agg(F.min("place").alias("_p"))
    return met.join(best, (F.col("variant") == F.col("_v")) & (F.col("place") == F.col("_p"))).select("base", "variant", "suffix")


def duplicates(products: DataFrame) -> DataFrame:
    """brand, model, season, slugs, hosts of products equal in all three; and, with a null season, equal names without one."""
    host = F.lower(F.try_parse_url(F.trim("source_url"), F.lit("HOST")))
    g = named(products).groupBy("n_brand", "n_model", "n_season").agg(F.array_sort(F.collect_list("slug")).alias("slugs"), F.countDistinct(host).alias("hosts"))
    return g.where(F.size("slugs") > 1).select(F.col("n_brand").alias("brand"), F.col("n_model").alias("model"), F.col("n_season").alias("season"), "slugs", "hosts")


def proposals(pairs: DataFrame) -> DataFrame:
    """Families of the sure pairs: identity_key, base, wide; pairs that share a product are in ``contested``."""
    sure = pairs.where("classification = 'HIGH_CONFIDENCE_WIDTH_FAMILY'")
    uses = sure.select(F.explode(F.array("base", "variant")).alias("slug")).groupBy("slug").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("slug")
    free = sure.join(uses, F.col("base") == F.col("slug"), "left_anti").join(uses, F.col("variant") == F.col("slug"), "left_anti")
    return free.select(F.concat_ws("|", F.lit("v1"), "brand", "model", "season").alias("identity_key"), "base", F.col("variant").alias("wide"))


def contested(pairs: DataFrame) -> DataFrame:
    """base, wide and slug of the sure pairs that ``proposals`` leaves to review, with a product that is in two of them."""
    sure = pairs.where("classification = 'HIGH_CONFIDENCE_WIDTH_FAMILY'").select("base", F.col("variant").alias("wide"))
    each = sure.select("base", "wide", F.explode(F.array("base", "wide")).alias("slug"))
    uses = each.groupBy(F.col("slug").alias("_s")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return each.join(uses, F.col("slug") == F.col("_s"), "left_semi").select("base", "wide", "slug")


def reconcile(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """identity_key and action for proposed (identity_key, base, wide) against existing families (the same, manual_override)."""
    e = existing.select(F.col("identity_key").alias("_k"), F.col("base").alias("_b"), F.col("wide").alias("_w"), "manual_override")
    joined = proposed.join(e, F.col("identity_key") == F.col("_k"), "full_outer")
    same = F.col("base").eqNullSafe(F.col("_b")) & F.col("wide").eqNullSafe(F.col("_w"))
    action = F.when(F.col("_k").isNull(), "create").when(F.col("manual_override"), "keep_manual").when(F.col("identity_key").isNull(), "review_missing").when(same, "noop").when(F.col("base").eqNullSafe(F.col("_b")), "replace_wide").when(F.col("wide").eqNullSafe(F.col("_w")), "replace_base").otherwise("conflict")
    return joined.select(F.coalesce("identity_key", "_k").alias("identity_key"), action.alias("action"))


def size_collisions(left: DataFrame, right: DataFrame) -> DataFrame:
    """pair, same labels, same lengths and lengths of different waists; both sides have pair and size columns."""
    text = lambda side: F.lower(F.coalesce(blank_to_null(F.col(f"{side}.size_label")), F.lit("")))
    met = left.alias("l").join(right.alias("r"), "pair")
    label = (text("l") != "") & (text("l") == text("r"))
    cm, waist = F.col("l.size_cm") == F.col("r.size_cm"), F.col("l.waist_width_mm").eqNullSafe(F.col("r.waist_width_mm"))
    return met.groupBy("pair").agg(F.array_sort(F.collect_set(F.when(label, F.col("l.size_label")))).alias("same_labels"), F.array_sort(F.collect_set(F.when(cm, F.col("l.size_cm")))).alias("same_cm"), F.count_if(cm & ~waist).alias("cm_of_other_waist"), F.count_if(label & ~waist).alias("label_of_other_waist"))
