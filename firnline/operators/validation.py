"""Rules of what may be stored: rider answers, edited products, result snapshots. Each yields codes of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds (both ends included) and enumerations of the stored records.
RIDER_BOUNDS = {"height_cm": (140, 210), "weight_kg": (35, 150), "boot_size_eu": (34, 52)}
RIDER_VALUES = {
    "board_line_preference": ["men", "women", "any"],
    "skill_level": ["beginner", "intermediate", "advanced"],
    "riding_style": ["all-mountain", "park", "freeride"],
    "terrain_priority": ["balanced", "switch-freestyle", "groomers-carving", "soft-snow"],
    "aggressiveness": ["relaxed", "balanced", "aggressive"],
    "stance_type": ["standard", "duck", "unknown"],
}
PRODUCT_VALUES = {"riding_style": RIDER_VALUES["riding_style"], "skill_level": RIDER_VALUES["skill_level"], "board_line": ["men", "women", "unisex"], "data_status": ["draft", "verified"]}
PRODUCT_OPTIONAL = {"shape_type": ["twin", "asym-twin", "directional-twin", "directional", "tapered-directional"], "camber_profile": ["camber", "rocker", "flat", "hybrid-camber", "hybrid-rocker"]}
PRODUCT_BOUNDS = {"flex": (1, 10), "price_from": (0, 500_000)}
SIZE_BOUNDS = {"size_cm": (120, 200), "waist_width_mm": (220, 300), "recommended_weight_min": (30, 180)}
MOST_SIZES, LONGEST_LABEL, LONGEST_SOURCE = 20, 24, 160
# -----------------------------------------------------------------------------------------------------------------


def _outside(x: Column, bounds: tuple) -> Column:
    return ~F.coalesce(x.between(*bounds), F.lit(False))


def _not_in(x: Column, values: list[str]) -> Column:
    return ~F.coalesce(x.isin(values), F.lit(False))


def _codes(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(when, F.lit(code)) for code, when in rules.items()]))


def rider_problems(riders: DataFrame) -> DataFrame:
    """rider_id and problems (names of answers that are missing or out of bounds; empty for a sound rider)."""
    rules = {c: _outside(F.col(c).cast("double"), b) for c, b in RIDER_BOUNDS.items()} | {c: _not_in(F.col(c), v) for c, v in RIDER_VALUES.items()}
    return riders.select("rider_id", _codes(rules).alias("problems"))


def _url(x: Column) -> Column:
    return F.coalesce(F.try_parse_url(F.trim(x), F.lit("PROTOCOL")).isNotNull() & (F.length(F.coalesce(F.try_parse_url(F.trim(x), F.lit("HOST")), F.lit(""))) > 0), F.lit(False))


def product_problems(products: DataFrame, sizes: DataFrame) -> DataFrame:
    """slug and problems of products as an editor saves them, those of their sizes among them."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    high = F.col("recommended_weight_max")
    size_rules = {f"sizes.{c}": _outside(F.col(c).cast("double"), b) for c, b in SIZE_BOUNDS.items()}
    size_rules |= {
        "sizes.size_label": F.length(text("size_label")) > LONGEST_LABEL,
        "sizes.recommended_weight_max": high.isNotNull() & (_outside(high.cast("double"), (30, 180)) | (high < F.col("recommended_weight_min"))),
        "sizes.width_type": _not_in(F.col("width_type"), ["regular", "mid-wide", "wide"]),
    }
    per = sizes.groupBy(F.col("product_id").alias("_p")).agg(F.count(F.lit(1)).alias("n_sizes"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(_codes(size_rules))))).alias("of_sizes"))
    n, source = F.coalesce("n_sizes", F.lit(0)), text("source_url")
    rules = {
        "slug": ~F.coalesce(F.trim("slug").rlike("^(?=..)[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False)),
        "brand": text("brand") == "",
        "model_name": text("model_name") == "",
        **{c: _outside(F.col(c).cast("double"), b) for c, b in PRODUCT_BOUNDS.items()},
        **{c: _not_in(F.col(c), v) for c, v in PRODUCT_VALUES.items()},
        **{c: F.col(c).isNotNull() & _not_in(F.col(c), v) for c, v in PRODUCT_OPTIONAL.items()},
        "image_url": ~(F.startswith(text("image_url"), F.lit("/")) | _url(F.col("image_url"))),
        "affiliate_url": ~_url(F.col("affiliate_url")),
        "source_name": (F.length(text("source_name")) > LONGEST_SOURCE) | ((F.col("data_status") == "verified") & (text("source_name") == "")),
        "source_url": ((source != "") & ~_url(F.col("source_url"))) | ((F.col("data_status") == "verified") & (source == "")),
        "sizes": (n < 1) | (n > MOST_SIZES),
    }
    joined = products.join(per, F.col("id") == F.col("_p"), "left")
    return joined.select("slug", F.concat(_codes({k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}), F.coalesce("of_sizes", F.array().cast("array<string>"))).alias("problems"))


BOARD = "struct<place:long,slug:string,size_cm:double,size_label:string,score:long,role:string,confidence:string>"


def snapshot_problems(snapshots: DataFrame) -> DataFrame:
    """rider_id and problem (null if sound) of JSON snapshots: not a list, a board with other keys, or a value not known."""
    boards, raw = F.from_json("snapshot", f"array<{BOARD}>"), F.from_json("snapshot", "array<map<string,string>>")
    names = sorted(c.split(":")[0] for c in BOARD[7:-1].split(","))
    keys = F.exists(raw, lambda b: ~F.coalesce(F.array_sort(F.map_keys(b)) == F.lit(names), F.lit(False)))
    known = F.exists(boards, lambda b: b["place"].isNull() | b["slug"].isNull() | b["score"].isNull() | _not_in(b["role"], ["best-overall", "playful", "stable", "width-safe"]) | _not_in(b["confidence"], ["high", "medium", "careful"]))
    return snapshots.select("rider_id", F.when(boards.isNull() | raw.isNull(), "not_a_list").when(F.size(raw) == 0, F.lit(None)).when(keys, "keys").when(known, "values").alias("problem"))
