"""Reconciliation of families over groups of four parts, of which each has one of twenty cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.operators import reconcile
from firnline.operators.changes import AUTOMATIC_CONFIDENCE, AUTOMATIC_RULE, FROM_MEMBER
from firnline.plans import bindings as b
from firnline.sources.rounds import Rounds
from firnline.sources.versions import Versions

CASES = 20
#: Cases that a run may carry out: none of them is a conflict.
PEACEFUL = [0, 1, 2, 6, 10, 14, 16, 17]
MATCHED_AT = "2024-01-20T12:00:00Z"


def _parts(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return b.table(s, d, "part").select(k.alias("k"), F.floor(k / 4).alias("g"), (k % 4).alias("r"), (F.floor(k / 4) % CASES).alias("c"))


def _name(text: str, of: str = "g") -> Column:
    return F.concat(F.lit(text), F.col(of).cast("string"))


def products(s: SparkSession, d: str) -> DataFrame:
    c, r = F.col("c"), F.col("r")
    held = (c <= 13) & ((r == 0) | ((r == 1) & (c != 3)))
    by_hand = ((c == 2) & (r == 0)) | ((c == 16) & (r == 0)) | ((c == 19) & (r == 3)) | ((c == 8) & (r == 2) & (F.col("g") % 3 == 1))
    family = F.when(held | ((c == 19) & (r == 3)), _name("fam-")).when((c == 18) & (r == 0), _name("lost-"))
    return _parts(s, d).select(
        _name("id-", "k").alias("id"), _name("p-", "k").alias("slug"), (~(c.between(6, 10) & (r == 0))).alias("is_active"), family.alias("family_id"), F.when(held, F.when(r == 0, "base").otherwise("wide")).alias("role"), by_hand.alias("manual_override"),
        F.when((c == 17) & (r == 0), "manual").when((c == 4) & (r == 1), "other").when(held, AUTOMATIC_RULE).alias("match_method"), F.when(held, AUTOMATIC_CONFIDENCE).alias("confidence"), F.when(held, "before").alias("reason"), F.when(held, "2023-01-01T00:00:00Z").alias("matched_at"),
        (F.col("k") % 97).alias("price"),
    )


def members(s: SparkSession, d: str) -> DataFrame:
    """The memberships of the products; the wide one of case 5 is not in the catalogue."""
    held = reconcile.memberships(products(s, d)).withColumn("g", F.floor(F.regexp_extract("product_id", r"(\d+)$", 1).cast("long") / 4))
    lost = (F.col("g") % CASES == 5) & (F.col("role") == "wide")
    return held.withColumn("product_id", F.when(lost, _name("gone-")).otherwise(F.col("product_id"))).drop("g")


def _fields(old: bool) -> list[Column]:
    g, c = F.col("g"), F.col("c")
    other = (c == 1) if old else F.lit(False)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (g % 28).cast("int"))
    values = {
        "description_short": F.when(other & (g % 3 != 0), "old words").otherwise(_name("short ")), "description_full": _name("full "), "riding_style": b.pick(g, b.STYLES), "skill_level": b.pick(F.floor(g / 2), b.SKILLS), "flex": (g % 10 + F.when(other, 1).otherwise(0)).cast("int"),
        "board_line": b.pick(g, b.LINES), "shape_type": b.pick(g, b.SHAPES), "camber_profile": F.when(other & (g % 3 == 1), F.lit(None)).otherwise(b.pick(g, b.CAMBERS)), "data_status": b.pick(g, b.STATUSES), "source_name": F.lit("maker"), "source_url": b.pick(g, b.SOURCES),
        "source_checked_at": F.when(other & (g % 2 == 1), F.date_add(day, 1)).otherwise(day),
    }
    return [v.alias(k) for k, v in values.items()]


def _key() -> Column:
    return F.concat_ws("|", F.lit("v1"), F.concat(F.lit("make "), F.floor(F.col("g") / 5).cast("string")), _name("model "), F.lit("2024/2025"))


def families(s: SparkSession, d: str) -> DataFrame:
    p = _parts(s, d).where("r = 0 and (c <= 13 or c = 19)")
    return p.select(
        _name("fam-").alias("id"), F.when(F.col("c") == 19, _name("held-")).otherwise(_key()).alias("identity_key"), F.when(F.col("c") == 19, _name("new-")).otherwise(_name("family-")).alias("slug"),
        F.concat(F.lit("Make "), F.floor(F.col("g") / 5).cast("string")).alias("brand"), _name(" MODEL ").alias("model_name"), F.lit("24/25").alias("season_label"), F.when(F.col("g") % 60 == 41, "editorial").otherwise(FROM_MEMBER).alias("source_kind"), *_fields(True),
    )


def candidates(s: SparkSession, d: str) -> DataFrame:
    g, c = F.col("g"), F.col("c")
    part = lambda r: F.concat((g * 4 + r).cast("string"))
    one = lambda r, role: F.struct(F.concat(F.lit("id-"), part(r)).alias("product_id"), F.concat(F.lit("p-"), part(r)).alias("product_slug"), F.lit(role).alias("role"), F.lit("seen").alias("reason"))
    gone = F.struct(_name("gone-").alias("product_id"), _name("gone-").alias("product_slug"), F.lit("wide").alias("role"), F.lit("seen").alias("reason"))
    base = F.when(c.isin(6, 7, 8, 9), one(2, "base")).otherwise(one(0, "base"))
    wide = F.when((c == 13) | ((c == 8) & (g % 3 == 0)), one(3, "wide")).when(c == 15, gone).otherwise(one(1, "wide"))
    slug = F.when(c == 6, _name("next-")).when(c == 12, _name("else-")).when(c.isin(14, 15, 16, 17, 18, 19), _name("new-")).when((c == 8) & (g % 3 == 2), F.concat(F.lit("family-"), (g + 1).cast("string"))).otherwise(_name("family-"))
    names = [F.concat(F.when(c == 7, "Other ").otherwise("make "), F.floor(g / 5).cast("string")).alias("brand"), _name("Model ").alias("model_name"), F.lit("2024/2025").alias("season_label")]
    p = _parts(s, d).where("r = 0 and c not in (10, 11)")
    first = p.select(F.when(c == 9, _name("other-")).otherwise(_key()).alias("identity_key"), slug.alias("slug"), *names, F.array(base, wide).alias("members"), *_fields(False))
    again = p.where("c = 14 and g % 40 = 34").select(_name("w-dup-").alias("identity_key"), _name("dup-").alias("slug"), *names, F.array(one(0, "base"), one(3, "wide")).alias("members"), *_fields(False))
    return first.unionByName(again)


def family_plan(s: SparkSession, d: str) -> DataFrame:
    """Every bucket and every conflict code has rows."""
    x = reconcile.Inputs(candidates(s, d), families(s, d), members(s, d), products(s, d))
    aside = lambda case: _parts(s, d).where((F.col("c") == case) & (F.col("r") == 0)).select(_name("aside-").alias("identity_key"))
    return reconcile.plan(Rounds(s, "family-plan").put(reconcile.decisions(x), "decided"), x.candidates, aside(3), aside(7))


def _peaceful(df: DataFrame, column: str) -> DataFrame:
    n = F.regexp_extract(column, r"(\d+)(?:\|[^|]*)?$", 1).cast("long")
    g = F.floor(n / 4) if column == "id" else n
    return df.where((g % CASES).isin(PEACEFUL) & (g % 40 != 34))


def family_post_state(s: SparkSession, d: str) -> DataFrame:
    """What a run leaves: stored, seen, applied under the plan's fingerprint, and read back."""
    store = Versions(s, f"{Rounds(s, 'family-run').root}/store")
    f = families(s, d).where(F.regexp_extract("id", r"(\d+)$", 1).cast("long") % CASES != 19)
    g = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    kept = f.where((g % CASES).isin(PEACEFUL))
    store.commit(store.version(), {"families": store.stage("families", kept), "products": store.stage("products", _peaceful(products(s, d), "id"))}, {"first": True})
    wanted = Rounds(s, "family-run").put(_peaceful(candidates(s, d), "identity_key").where(~F.startswith("identity_key", F.lit("w-dup"))), "wanted")
    seen = reconcile.preview(store, wanted)[3]
    at = reconcile.apply(store, wanted, seen, MATCHED_AT)
    p = store.read("products", at.number).select(F.lit("product").alias("kind"), "id", F.col("family_id").alias("of"), "role", "reason", "matched_at")
    new = F.when(F.startswith("id", F.lit("family:")), "new").otherwise(F.col("id"))
    return p.withColumn("of", F.when(F.startswith("of", F.lit("family:")), "new").otherwise(F.col("of"))).unionByName(store.read("families", at.number).select(F.lit("family").alias("kind"), new.alias("id"), F.col("slug").alias("of"), F.concat_ws("|", "identity_key", F.col("flex").cast("string"), "description_short", "camber_profile").alias("role"), F.col("source_kind").alias("reason"), F.col("source_checked_at").cast("string").alias("matched_at")))


QUERIES = [family_plan, family_post_state]
