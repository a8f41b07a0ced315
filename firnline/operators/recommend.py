"""Scoring board sizes for riders and ranking them, for any number of riders in one job.

A rider's wishes become a profile (a projection). A score has two parts: one of the board and the rider's tastes, one of
the size's measures and the rider's body. Only the best sizes of equal measures for each set of tastes can be among a
rider's first seven, so riders meet those instead of all sizes, through buckets of length; pool gates come from a count
per riding style; the best size per product and per family is one minimum over a sort key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.functions.num import clamp, outside, round_half_up
from firnline.sources.rounds import Rounds

# Fixed values of the scoring model ------------------------------------------------------------------------------
#: Weight in kg (both ends included) and the base length range in cm; other weights take the default.
WEIGHT_LENGTHS = [(35, 44.99, 138, 142), (45, 54.99, 142, 147), (55, 64.99, 147, 152), (65, 74.99, 152, 156), (75, 84.99, 155, 159), (85, 94.99, 158, 162), (95, 150, 161, 166)]
DEFAULT_LENGTHS = (152, 156)
LENGTH_SHIFTS = {
    "riding_style": {"park": (-2, -1), "freeride": (1, 3)},
    "terrain_priority": {"switch-freestyle": (-1, 0), "groomers-carving": (0, 1), "soft-snow": (1, 2)},
    "aggressiveness": {"relaxed": (-1, 0), "aggressive": (1, 1)},
}
TARGET_SHIFTS = {
    "riding_style": {"park": -0.5, "freeride": 0.75},
    "terrain_priority": {"switch-freestyle": -0.5, "groomers-carving": 0.25, "soft-snow": 0.75},
    "aggressiveness": {"relaxed": -0.25, "aggressive": 0.25},
}
SKILLS = ["beginner", "intermediate", "advanced"]
#: By how far the board's level is above the rider's, from -2 to 2.
SKILL_POINTS = [6, 12, 16, 4, -14]
#: Points of a board style for a rider style; terrain exceptions of the all-mountain rider come first.
STYLE_POINTS = {("all-mountain", "all-mountain"): 18, ("park", "park"): 18, ("freeride", "freeride"): 18, ("park", "all-mountain"): 8, ("freeride", "all-mountain"): 8, ("all-mountain", "park"): -8, ("all-mountain", "freeride"): -8, ("park", "freeride"): -12, ("freeride", "park"): -12}
STYLE_EXCEPTIONS = {("switch-freestyle", "park"): 4, ("soft-snow", "freeride"): 3, ("groomers-carving", "freeride"): 3}
PREFERRED_STYLES = {"park": ["park", "all-mountain"], "freeride": ["freeride", "all-mountain"]}
PREFERRED_ALL_MOUNTAIN = {"switch-freestyle": ["all-mountain", "park"], "groomers-carving": ["all-mountain", "freeride"], "soft-snow": ["all-mountain", "freeride"], "balanced": ["all-mountain"]}
TERRAIN_STYLE = {
    "balanced": {"all-mountain": 8, "*": -3},
    "switch-freestyle": {"park": 8, "all-mountain": 3, "*": -8},
    "groomers-carving": {"freeride": 7, "all-mountain": 5, "*": -6},
    "soft-snow": {"freeride": 9, "all-mountain": 3, "*": -8},
}
TERRAIN_SHAPE = {
    "balanced": {"directional-twin": 4, "directional": 1, "twin": 1, "asym-twin": 1, "tapered-directional": -3, "*": 0},
    "switch-freestyle": {"twin": 6, "asym-twin": 6, "directional-twin": 3, "*": -6},
    "groomers-carving": {"directional": 6, "tapered-directional": 5, "directional-twin": 4, "*": -4},
    "soft-snow": {"tapered-directional": 8, "directional": 5, "directional-twin": 1, "*": -6},
}
RECOMMENDED_FROM, ALTERNATIVE_FROM = 56, 40
MOST_RECOMMENDED, MOST_ALTERNATIVES = 4, 3
FAR_LENGTH, FAR_WAIST, FAR_WEIGHT = 12, 12, 20
STORE_HOSTS = ["trial-sport.ru", "www.trial-sport.ru", "traektoria.ru", "www.traektoria.ru"]
# ----------------------------------------------------------------------------------------------------------------

INPUTS = ["height_cm", "weight_kg", "boot_size_eu", "board_line_preference", "skill_level", "riding_style", "terrain_priority", "aggressiveness", "stance_type"]
#: What the part of a score that is the board's depends on; the other wishes are the rider's body and stance.
TASTES = ["board_line_preference", "skill_level", "rider_style", "terrain_priority", "aggressiveness"]
#: What eligibility and the part of a score that is the size's depend on.
MEASURES = ["size_cm", "waist_width_mm", "recommended_weight_min", "recommended_weight_max"]
#: What the board's part depends on.
TRAITS = ["riding_style", "board_skill", "flex", "flex_trusted", "board_line", "shape_type", "camber_profile", "ready", "verified", "placeholder_link"]
BUCKET_CM = 8


def choose(key: Column, table: dict, default) -> Column:
    """The table's value for a key, else the default; ``*`` in a table stands for any other key that is not null."""
    known = {k: v for k, v in table.items() if k != "*"}
    other = F.when(key.isNotNull(), F.lit(table["*"])).otherwise(F.lit(default)) if "*" in table else F.lit(default)
    return reduce(lambda out, kv: F.when(key == kv[0], F.lit(kv[1])).otherwise(out), reversed(list(known.items())), other)


def _carving() -> Column:
    return F.col("terrain_priority") == "groomers-carving"


def _soft() -> Column:
    return F.col("terrain_priority") == "soft-snow"


def _freestyle() -> Column:
    return (F.col("riding_style") == "park") | (F.col("terrain_priority") == "switch-freestyle")


def _directed() -> Column:
    return (F.col("riding_style") == "freeride") | _carving() | _soft()


def _temper(relaxed, aggressive, neither=0) -> Column:
    return choose(F.col("aggressiveness"), {"relaxed": relaxed, "aggressive": aggressive}, neither)


def with_profile(riders: DataFrame) -> DataFrame:
    """Riders with their length range and target, width, waist, boot drag risk, shapes, flex range and preferences."""
    kg, boot = F.col("weight_kg"), F.col("boot_size_eu")
    by_weight = lambda i: reduce(lambda out, r: F.when(kg.between(r[0], r[1]), F.lit(r[2 + i])).otherwise(out), reversed(WEIGHT_LENGTHS), F.lit(DEFAULT_LENGTHS[i]))
    tall = F.when(F.col("height_cm") <= 160, -1).when(F.col("height_cm") >= 186, 2).when(F.col("height_cm") >= 179, 1).otherwise(0)
    shifted = lambda i: by_weight(i) + tall + sum(choose(F.col(c), {k: v[i] for k, v in t.items()}, 0) for c, t in LENGTH_SHIFTS.items())
    out = riders.withColumn("base_lo", by_weight(0)).withColumn("base_hi", by_weight(1)).withColumn("lo", clamp(shifted(0), 138, 166)).withColumn("hi", clamp(shifted(1), 141, 168))
    out = out.withColumn("hi", F.when(F.col("hi") - F.col("lo") < 2, F.col("lo") + 2).otherwise(F.col("hi")))
    middle = (F.col("lo") + F.col("hi")) / F.lit(2.0) + sum(choose(F.col(c), t, 0.0) for c, t in TARGET_SHIFTS.items())
    out = out.withColumn("target", clamp(middle, F.col("lo").cast("double"), F.col("hi").cast("double")))

    edge = _carving() & (boot >= 43) & (boot < 43.5)
    waist = F.when(boot >= 48, 272).when(boot >= 45.5, 264).when(boot >= 43.5, 257).when(boot <= 38, 240).otherwise(250)
    waist = F.when(edge, 258).when(_carving(), waist + 3).otherwise(waist)
    unsure = (F.col("stance_type") == "unknown") & (boot >= 43.5)
    out = out.withColumn("width_type", F.when(boot >= 45.5, "wide").when((boot >= 43.5) | edge, "mid-wide").otherwise("regular"))
    out = out.withColumn("waist", waist - F.when(F.col("stance_type") == "duck", 2).otherwise(0) + F.when(unsure, 1).otherwise(0))
    drag = F.when(boot >= 48, 3).when(boot >= 45.5, 2).when(boot >= 43.5, 1).otherwise(0) + F.when(unsure, 1).otherwise(0)
    drag = drag - F.when(((F.col("stance_type") == "duck") | (F.col("width_type") == "wide")) & (drag > 0), 1).otherwise(0)
    out = out.withColumn("boot_drag_risk", F.when(drag <= 0, "low").when(drag == 1, "medium").otherwise("high"))

    style, terrain, temper = F.col("riding_style"), F.col("terrain_priority"), F.col("aggressiveness")
    first = (
        F.when(terrain == "switch-freestyle", "twin")
        .when(_carving(), F.when(style == "park", "directional-twin").otherwise("directional"))
        .when(_soft(), F.when((style == "all-mountain") & (temper == "relaxed"), "directional").otherwise("tapered-directional"))
        .when(style == "park", "twin")
        .when(style == "freeride", F.when(temper == "relaxed", "directional").otherwise("tapered-directional"))
        .when(temper == "aggressive", "directional")
        .otherwise("directional-twin")
    )
    names = lambda *xs: F.array(*[F.lit(x) for x in xs])
    others = (
        F.when(terrain == "switch-freestyle", names("asym-twin", "directional-twin"))
        .when(_carving(), F.when(style == "park", names("twin", "directional")).otherwise(names("directional-twin", "tapered-directional")))
        .when(_soft(), names("directional", "directional-twin"))
        .when(style == "park", names("asym-twin", "directional-twin"))
        .when(style == "freeride", F.when(temper == "relaxed", names("tapered-directional", "directional-twin")).otherwise(names("directional", "directional-twin")))
        .when(temper == "aggressive", names("directional-twin", "tapered-directional"))
        .otherwise(names("twin", "asym-twin", "directional"))
    )
    out = out.withColumn("shape_first", first).withColumn("shape_others", others)

    shift = F.when(_freestyle(), -1).otherwise(0) + F.when(_directed(), 1).otherwise(0) + _temper(-1, 1)
    skill = F.col("skill_level")
    flex_lo = clamp(F.lit(4) + choose(skill, {"beginner": -2, "advanced": 1}, 0) + shift, 1, 9)
    out = out.withColumn("flex_lo", flex_lo).withColumn("flex_hi", clamp(F.lit(6) + choose(skill, {"beginner": -1, "advanced": 2}, 0) + shift, F.col("flex_lo") + 1, 10))
    out = out.withColumn("soft_boost", choose(skill, {"advanced": 2}, 0) + _temper(0, 3) + F.when(_directed(), 2).otherwise(0))
    out = out.withColumn("stiff_boost", choose(skill, {"beginner": 3}, 0) + _temper(2, 0) + F.when(_freestyle(), 2).otherwise(0))
    over = F.lit(4.0) - F.when(_freestyle(), 1.5).otherwise(0.0) + F.when(_directed(), 1.5).otherwise(0.0) + _temper(-0.5, 0.5, 0.0)
    out = out.withColumn("over_width", clamp(over, 2.0, 7.0))

    hard = (skill == "advanced") & (temper == "aggressive")
    easy = (skill == "beginner") | (temper == "relaxed")
    cambers = [
        (_soft(), ("hybrid-rocker", "rocker"), ("hybrid-camber",)),
        (_carving(), ("camber", "hybrid-camber"), ("flat",)),
        (_freestyle() & hard, ("camber", "hybrid-camber"), ("flat", "hybrid-rocker")),
        (_freestyle() | easy, ("flat", "hybrid-rocker"), ("rocker", "hybrid-camber")),
        (style == "freeride", ("hybrid-camber", "camber"), ("hybrid-rocker",)),
    ]
    best, fair = names("hybrid-camber"), names("camber", "flat")
    for when, a, b in reversed(cambers):
        best, fair = F.when(when, names(*a)).otherwise(best), F.when(when, names(*b)).otherwise(fair)
    styles = reduce(lambda x, kv: F.when((style == "all-mountain") & (terrain == kv[0]), names(*kv[1])).otherwise(x), PREFERRED_ALL_MOUNTAIN.items(), names("all-mountain"))
    styles = F.when(style == "park", names(*PREFERRED_STYLES["park"])).when(style == "freeride", names(*PREFERRED_STYLES["freeride"])).otherwise(styles)
    return out.withColumn("camber_best", best).withColumn("camber_fair", fair).withColumn("styles", styles)


def filled(c: str) -> Column:
    return F.coalesce(F.length(F.trim(F.col(c))) > 0, F.lit(False))


def with_trust(products: DataFrame) -> DataFrame:
    """Products with verified, has_source, flex_trusted, placeholder_link and ready."""
    host = F.lower(F.try_parse_url(F.trim("source_url"), F.lit("HOST")))
    placeholder = F.coalesce(F.col("affiliate_url").rlike(r"(?i)example\.(com|org|net)"), F.lit(False))
    out = products.withColumn("verified", F.coalesce(F.col("data_status") == "verified", F.lit(False))).withColumn("has_source", filled("source_name") & filled("source_url"))
    out = out.withColumn("flex_trusted", F.col("verified") & F.col("has_source") & ~F.coalesce(host.isin(STORE_HOSTS), F.lit(False))).withColumn("placeholder_link", placeholder)
    complete = F.col("shape_type").isNotNull() & F.col("camber_profile").isNotNull()
    return out.withColumn("ready", F.col("verified") & F.col("has_source") & complete & filled("affiliate_url") & ~F.col("placeholder_link"))


def open_boards(products: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active products that have an available size, and those sizes."""
    free = sizes.where(F.coalesce("is_available", F.lit(True)))
    boards = with_trust(products.where("is_active")).join(free.select(F.col("product_id").alias("id")).distinct().hint("merge"), "id", "left_semi")
    return boards, free


def with_pool(profiles: DataFrame, boards: DataFrame) -> DataFrame:
    """Profiles with the pool they choose from: focused (preferred styles only) and gate (ready, verified or any).

    The gates look at how many boards of each style there are, and styles are an enumeration: the counts are one row.
    """
    counts = boards.groupBy("riding_style").agg(F.count(F.lit(1)).alias("n"), F.count_if("ready").alias("r"), F.count_if("verified").alias("v"))
    one = counts.agg(F.collect_list(F.struct("riding_style", "n", "r", "v")).alias("counts")).withColumn("k", F.lit(1))
    joined = profiles.withColumn("k", F.lit(1)).join(F.broadcast(one), "k").drop("k")
    total = lambda f, when: F.aggregate("counts", F.lit(0).cast("long"), lambda acc, c: acc + F.when(when(c), c[f]).otherwise(F.lit(0).cast("long")))
    preferred = lambda c: F.array_contains(F.col("styles"), c["riding_style"])
    joined = joined.withColumn("focused", total("n", preferred) >= 3)
    inside = lambda c: ~F.col("focused") | preferred(c)
    return joined.withColumn("gate", F.when(total("r", inside) >= 3, "ready").when(total("v", inside) >= 3, "verified").otherwise("any")).drop("counts")


def _mismatches() -> tuple[Column, Column, Column]:
    """Severity of length, weight and width: 0 fits, 1 soft, 2 hard."""
    length, weight = F.col("length_off"), F.col("weight_off")
    slack = F.when(F.col("stance_type") == "duck", -1.5).otherwise(-1.0)
    level = lambda x, soft: F.when(x == 0, 0).when(x <= soft, 1).otherwise(2)
    return level(length, 2.5), level(weight, 5), F.when(F.col("spare") >= slack, 0).when(F.col("spare") >= -3, 1).otherwise(2)


def style_points() -> Column:
    own, board, terrain = F.col("rider_style"), F.col("riding_style"), F.col("terrain_priority")
    exceptions = reduce(lambda out, kv: F.when((own == "all-mountain") & (terrain == kv[0][0]) & (board == kv[0][1]), F.lit(kv[1])).otherwise(out), STYLE_EXCEPTIONS.items(), F.lit(None).cast("int"))
    return F.coalesce(exceptions, choose(F.concat_ws("|", own, board), {"|".join(k): v for k, v in STYLE_POINTS.items()}, -12))


def skill_points() -> Column:
    rank = {k: i for i, k in enumerate(SKILLS)}
    return F.get(F.array(*[F.lit(p) for p in SKILL_POINTS]), choose(F.col("board_skill"), rank, 0) - choose(F.col("skill_level"), rank, 0) + 2)


def terrain_points() -> Column:
    f, out = F.col("flex"), F.lit(0)
    for t in reversed(list(TERRAIN_STYLE)):
        points = choose(F.col("riding_style"), TERRAIN_STYLE[t], 0) + choose(F.col("shape_type"), TERRAIN_SHAPE[t], 0)
        if t == "groomers-carving":
            points = points + F.when(f >= 6, 2).when(f <= 4, -2).otherwise(0)
        if t == "soft-snow":
            points = points + F.when(f >= 6, 2).otherwise(0)
        out = F.when(F.col("terrain_priority") == t, points).otherwise(out)
    return out


def _close(x: Column, reach) -> Column:
    return clamp(F.lit(1.0) - x / reach, 0.0, 1.0)


def _size_score() -> Column:
    """The part of the score that is the size's measures for a rider's body, a whole number as double."""
    c, close = F.col, _close
    size, spare, over = c("size_cm"), c("spare"), c("over_width")
    half = F.greatest((c("hi") - c("lo")) / F.lit(2.0), F.lit(1.5))
    length = F.when(c("length_off") == 0, round_half_up(F.lit(20) + close(F.abs(size - c("target")), half + 0.75) * 16)).when(c("length_off") <= 2.5, round_half_up(F.lit(10) - c("length_off") * 2)).otherwise(-14.0)
    wmin, wmax = c("recommended_weight_min"), c("recommended_weight_max")
    ideal = F.when(wmax.isNull(), wmin + 8.0).otherwise((wmin + wmax) / F.lit(2.0))
    reach = F.when(wmax.isNull(), 12.0).otherwise(F.greatest((wmax - wmin) / F.lit(2.0), F.lit(8.0)))
    weight = F.when(~c("weight_known"), -4.0).when(c("weight_off") == 0, round_half_up(F.lit(14) + close(F.abs(c("weight_kg") - ideal), reach) * 10)).when(c("weight_off") <= 5, 6.0).otherwise(-8.0)
    slack = F.when(c("stance_type") == "duck", -1.5).otherwise(-1.0)
    boost = F.when((c("aggressiveness") == "aggressive") | _carving(), 4).otherwise(0)
    wide = (
        F.when((spare >= 0) & (spare <= over), round_half_up(F.lit(12) + close(spare, F.greatest(over, F.lit(1.0))) * 8))
        .when((spare > over) & (spare <= over + 4), round_half_up(F.lit(6) - (spare - over) * 1.5))
        .when(spare >= slack, 0.0)
        .when(spare >= -3, (F.lit(-8) - boost).cast("double"))
        .otherwise((F.lit(-24) - boost).cast("double"))
    )
    hard, mild = c("hard"), c("mild")
    critical = F.when(hard >= 2, -18).when((hard == 1) & (mild >= 1), -10).when((hard == 1) & (c("skill_level") == "beginner"), -6).otherwise(0)
    return length + weight + wide + critical


def _board_score() -> Column:
    """The part of the score that is the board for a rider's tastes, a whole number as double."""
    c, close = F.col, _close
    style = style_points()
    shape = F.when(c("shape_type").isNull(), 0).when(c("shape_type") == c("shape_first"), 10).when(F.array_contains("shape_others", c("shape_type")), 6).otherwise(-6)
    skill = skill_points()
    f, flo, fhi = c("flex"), c("flex_lo"), c("flex_hi")
    off, soft, stiff = outside(f, flo, fhi), c("soft_boost"), c("stiff_boost")
    width = F.greatest((fhi - flo) / F.lit(2.0), F.lit(1.0))
    flex = (
        F.when(off == 0, F.lit(12) + close(F.abs(f - (flo + fhi) / F.lit(2.0)), width) * 6)
        .when(f < flo, F.when(off <= 0.5, F.lit(4) - soft * 0.5).when(off <= 1, F.lit(1) - soft).when(off <= 2, F.lit(-5) - soft * 1.5).otherwise(F.lit(-10) - soft * 2))
        .otherwise(F.when(off <= 1, F.lit(6) - stiff).when(off <= 2, F.lit(0) - stiff * 1.5).otherwise(F.lit(-6) - stiff * 2))
    )
    flex = F.when(c("flex_trusted"), round_half_up(flex.cast("double"))).otherwise(0.0)
    line = F.when(c("board_line_preference") == "any", 0).when(c("board_line") == "unisex", 6).when(c("board_line") == c("board_line_preference"), 10).otherwise(-12)
    terrain = terrain_points()
    camber = F.when(c("camber_profile").isNull(), 0).when(F.array_contains("camber_best", c("camber_profile")), 8).when(F.array_contains("camber_fair", c("camber_profile")), 3).otherwise(-6)
    trust = F.when(c("ready"), 10).when(c("verified"), 4).otherwise(0) - F.when(c("placeholder_link"), 12).otherwise(0)
    return (style + shape + skill + line + terrain + camber + trust + flex).cast("double")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _near(profiles: DataFrame, stock: DataFrame, on: list[str]) -> DataFrame:
    """Profiles with the rows of ``stock`` (MEASURES and others) that are not too far from them, and by how much they fit."""
    bucket = lambda x: F.floor(x / F.lit(float(BUCKET_CM)))
    reach = F.sequence(bucket(F.col("lo") - FAR_LENGTH), bucket(F.col("hi") + FAR_LENGTH))
    n = _tasks(profiles)  # few bytes, much work: not for Spark to put together by size
    left = profiles.withColumn("bucket", F.explode(reach)).repartition(n, *on, "bucket")
    right = stock.withColumn("bucket", bucket(F.col("size_cm"))).repartition(n, *on, "bucket")
    return _measured(left.join(right.hint("merge"), [*on, "bucket"]).drop("bucket"))


def _measured(met: DataFrame) -> DataFrame:
    """Pairs of profiles and sizes with by how much they fit; those too far apart go."""
    known = (F.col("recommended_weight_min") > 0) | F.col("recommended_weight_max").isNotNull()
    top = F.coalesce(F.col("recommended_weight_max").cast("double"), F.lit(float("inf")))
    met = met.withColumn("spare", (F.col("waist_width_mm") - F.col("waist")).cast("double")).withColumn("length_off", outside(F.col("size_cm"), F.col("lo"), F.col("hi"))).withColumn("weight_known", known)
    met = met.withColumn("weight_off", F.when(known, outside(F.col("weight_kg"), F.col("recommended_weight_min"), top)).otherwise(0.0))
    met = met.where((F.col("length_off") < FAR_LENGTH) & (F.col("spare") > -FAR_WAIST) & (F.col("weight_off") < FAR_WEIGHT))
    grades = _mismatches()
    return met.withColumn("hard", sum((g == 2).cast("int") for g in grades)).withColumn("mild", sum((g == 1).cast("int") for g in grades)).where("hard < 2")


def _in_pool() -> Column:
    gate = F.col("gate")
    return (~F.col("focused") | F.array_contains("styles", F.col("riding_style"))) & ((gate == "any") | ((gate == "verified") & F.col("verified")) | ((gate == "ready") & F.col("ready")))


def _scored(met: DataFrame) -> DataFrame:
    met = met.withColumn("score", _size_score() + _board_score()).withColumn("size_label", F.coalesce("size_label", F.lit("")))
    role = F.when(F.col("spare") >= 6, "width-safe").when(F.col("size_cm") <= F.col("target") - 0.75, "playful").when(F.col("size_cm") >= F.col("target") + 0.75, "stable").otherwise("best-overall")
    sure = F.when((F.col("score") >= 78) & F.col("ready"), "high").when(F.col("score") >= 64, "medium").otherwise("careful")
    return met.withColumn("role", role).withColumn("confidence", sure)


def _family() -> Column:
    return F.coalesce(F.when(F.length(F.trim("family_id")) > 0, F.concat(F.lit("family:"), "family_id")), F.concat(F.lit("product:"), "product_id"))


def _profiles_and_stock(riders: DataFrame, products: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    boards, free = open_boards(products, sizes)
    profiles = with_pool(with_profile(riders.select(*INPUTS).distinct()), boards).withColumnRenamed("riding_style", "rider_style")
    stock = free.join(boards.withColumnRenamed("id", "product_id").withColumnRenamed("skill_level", "board_skill").hint("merge"), "product_id")
    return profiles, stock.drop("is_available", "is_active")


def candidates(riders: DataFrame, products: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every eligible size for every distinct set of wishes (columns INPUTS), with score, role and confidence.

    There are as many as wishes times sizes: ``shortlist`` is what a choice needs of them.
    """
    profiles, stock = _profiles_and_stock(riders, products, sizes)
    return _scored(_near(profiles, stock, []).where(_in_pool()))


def _first_families(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each family of a group, of as many families as can be shown."""
    own = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "family_key").orderBy(*order))).where("_n = 1")
    return own.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= MOST_RECOMMENDED + MOST_ALTERNATIVES).drop("_n")


def shortlist(riders: DataFrame, products: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of ``candidates`` that are the best of the first seven families of every rider and may be shown.

    Sizes of the same measures have the same part of the score for a rider, and boards of the same traits the other. So of
    equal measures and traits only the first seven families count, and of equal measures, for riders of equal tastes, the
    seven with most points. A rider's sizes that fit in every measure give a floor, the score of the seventh family (or
    the least that is shown): a size that cannot reach it is left out before boards are looked at.
    """
    most = MOST_RECOMMENDED + MOST_ALTERNATIVES
    profiles, stock = _profiles_and_stock(riders, products, sizes)
    tables = Rounds(riders.sparkSession, "shortlist")
    profiles = tables.put(profiles.withColumn("pid", F.monotonically_increasing_id()), "profiles")
    label = F.coalesce("size_label", F.lit("")).alias("size_label")
    at = [F.col(c) for c in ("slug", "size_cm", "size_label", "product_id")]
    rows = stock.select("product_id", "slug", label, "width_type", _family().alias("family_key"), *MEASURES, *TRAITS)
    # dealt by measures, so that all that follows stays where it is
    rows = _first_families(rows.repartition(_tasks(rows), *MEASURES), [*MEASURES, *TRAITS], at)
    taste = profiles.select(*TASTES, "focused", "gate", "styles", "shape_first", "shape_others", "flex_lo", "flex_hi", "soft_boost", "stiff_boost", "camber_best", "camber_fair").distinct()
    taken = rows.join(F.broadcast(taste), _in_pool()).withColumn("points", _board_score())
    best = _first_families(taken.select(*TASTES, *MEASURES, "points", "product_id", "slug", "size_label", "family_key"), [*TASTES, *MEASURES], [F.col("points").desc(), *at])
    best = tables.put(best, "best")
    tops = best.groupBy(*TASTES, *MEASURES).agg(F.max_by(F.struct("points", "family_key"), F.struct("points", "family_key")).alias("top")).select(*TASTES, *MEASURES, F.col("top.points").alias("points"), F.col("top.family_key").alias("family_key"))
    tops = tables.put(tops, "tops")
    met = _near(profiles, tops, TASTES).withColumn("most", _size_score() + F.col("points"))
    fits = met.where("length_off = 0 and weight_off = 0 and spare >= 0 and spare <= over_width")
    families = fits.groupBy("pid", "family_key").agg(F.max("most").alias("most")).groupBy("pid").agg(F.try_element_at(F.sort_array(F.collect_list("most"), asc=False), F.lit(most)).alias("floor"))
    floors = tables.put(families.where(F.col("floor") > ALTERNATIVE_FROM), "floors")
    asked = profiles.join(floors.hint("merge"), "pid", "left").withColumn("floor", F.coalesce("floor", F.lit(float(ALTERNATIVE_FROM))))
    reached = _near(asked, tops, TASTES).withColumn("body", _size_score()).where(F.col("body") + F.col("points") >= F.col("floor")).select("pid", *TASTES, *MEASURES, "body", "floor")
    named = best.select(*[F.col(c).alias(f"_{c}") for c in (*TASTES, *MEASURES)], "points", "product_id", "slug", "size_label", "family_key")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*TASTES, *MEASURES)])
    each = reached.join(named.hint("merge"), same).withColumn("o", -(F.col("body") + F.col("points"))).where(-F.col("o") >= F.col("floor"))
    chosen = tables.put(_first_families(each.select("pid", "o", *MEASURES, "product_id", "slug", "size_label", "family_key"), ["pid"], [F.col("o"), *at]).select("pid", *MEASURES, "product_id", "size_label"), "chosen")
    boards = open_boards(products, sizes)[0].withColumnRenamed("id", "product_id").withColumnRenamed("skill_level", "board_skill").drop("is_active")
    pairs = chosen.join(profiles.hint("merge"), "pid").drop("pid").join(boards.hint("merge"), "product_id")
    return _scored(_measured(pairs))


def recommend(riders: DataFrame, products: DataFrame, sizes: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """rider_id, list (recommended or alternative), place, slug, size_cm, size_label, score, role, confidence.

    ``also`` names further columns, made of those of ``shortlist``: of a size, only its measures and label.
    """
    inputs = [c if c != "riding_style" else "rider_style" for c in INPUTS]
    key = F.struct((-F.col("score")).alias("o"), "slug", "size_cm", "size_label", "product_id", "score", "role", "confidence", *[c.alias(n) for n, c in (also or {}).items()])
    best = shortlist(riders, products, sizes).groupBy(*inputs, _family().alias("family_key")).agg(F.min(key).alias("m"))
    each = Window.partitionBy(*inputs)
    ranked = best.withColumn("place", F.row_number().over(each.orderBy("m"))).where(F.col("place") <= MOST_RECOMMENDED + MOST_ALTERNATIVES)
    chosen = (F.col("place") <= MOST_RECOMMENDED) & (F.col("m.score") >= RECOMMENDED_FROM)
    ranked = ranked.withColumn("chosen", chosen).withColumn("n", F.count_if("chosen").over(each))
    kept = ranked.where(F.col("chosen") | ((F.col("place") <= F.col("n") + MOST_ALTERNATIVES) & (F.col("m.score") >= ALTERNATIVE_FROM)))
    rows = kept.select(*inputs, F.when(F.col("chosen"), "recommended").otherwise("alternative").alias("list"), F.when(F.col("chosen"), F.col("place")).otherwise(F.col("place") - F.col("n")).cast("long").alias("place"), "m.slug", "m.size_cm", "m.size_label", F.col("m.score").cast("long").alias("score"), "m.role", "m.confidence", *[f"m.{n}" for n in also or {}]).withColumnRenamed("rider_style", "riding_style")
    return riders.select("rider_id", *INPUTS).join(rows.hint("merge"), INPUTS).drop(*INPUTS)


def result_snapshots(matches: DataFrame) -> DataFrame:
    """rider_id and snapshot: the recommended boards of a rider as JSON in order of place."""
    one = F.struct("place", "slug", "size_cm", "size_label", "score", "role", "confidence")
    nested = matches.where("list = 'recommended'").groupBy("rider_id").agg(F.array_sort(F.collect_list(one)).alias("boards"))
    return nested.select("rider_id", F.to_json("boards").alias("snapshot"))


def match_trust(matches: DataFrame, products: DataFrame) -> DataFrame:
    """rider_id, boards, ready, verified and the newest check of a rider's recommended boards."""
    p = with_trust(products).select(F.col("slug").alias("_s"), "ready", "verified", "source_checked_at")
    j = matches.where("list = 'recommended'").join(p, F.col("slug") == F.col("_s"))
    return j.groupBy("rider_id").agg(F.count(F.lit(1)).alias("boards"), F.count_if("ready").alias("ready"), F.count_if("verified").alias("verified"), F.max("source_checked_at").alias("last_checked"))
