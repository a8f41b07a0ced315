"""Deciding whether a plan of offer identities may be applied: AUTO, REVIEW or BLOCK per group, with reasons.

Members are proposed offers (offer_identities plus ``assigned``, the slug they would get); owners are stored products
(offer_identities plus manual). Each rule is a flag of a member or of an assignment; a group's gravest flags decide.
Joins say ``merge``: all tables grow with the offers, and Spark would send small-looking ones through the driver. Members
and owners are read by several branches, so give tables, not what is yet to be parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.text import identity_text

YOUTH = r"(?<![a-z0-9])(kid|kids|junior|youth|boy|boys|girl|girls|mini|child|children)(?![a-z0-9])"
ADULT = r"(?<![a-z0-9])adults?(?![a-z0-9])"
FIELDS = ["n_brand", "n_model", "board_line", "line_evidence", "season", "variant", "audience", "source_key"]


def audience(model: Column) -> Column:
    t = identity_text(model)
    return F.when(t.rlike(YOUTH), "youth").when(t.rlike(ADULT), "adult").otherwise("unknown")


def _line(a, b) -> Column:
    return (a("line_evidence") == "known") & (b("line_evidence") == "known") & (a("board_line") != b("board_line"))


def _known(a, b, c: str) -> Column:
    return F.coalesce(a(c) != b(c), F.lit(False))


def _audience(a, b) -> Column:
    return (a("audience") != "unknown") & (b("audience") != "unknown") & (a("audience") != b("audience"))


def same_public_identity(a, b) -> Column:
    return (a("n_brand") == b("n_brand")) & (a("n_model") == b("n_model")) & ~_line(a, b) & ~_known(a, b, "season") & a("variant").eqNullSafe(b("variant")) & ~_audience(a, b)


def reuse_conflicts(a, b) -> list[Column]:
    """Why a source id cannot have gone from one identity to the other."""
    rules = {
        "SOURCE_ID_REUSE_BRAND_CONFLICT": a("n_brand") != b("n_brand"),
        "SOURCE_ID_REUSE_MODEL_CONFLICT": a("n_model") != b("n_model"),
        "SOURCE_ID_REUSE_BOARD_LINE_CONFLICT": _line(a, b),
        "SOURCE_ID_REUSE_SEASON_CONFLICT": _known(a, b, "season"),
        "SOURCE_ID_REUSE_VARIANT_CONFLICT": ~a("variant").eqNullSafe(b("variant")),
        "PROTECTED_AUDIENCE_COLLAPSE": _audience(a, b),
    }
    return [F.when(when, F.lit(name)) for name, when in rules.items()]


def _side(prefix: str):
    return lambda c: F.col(f"{prefix}_{c}")


def authorize(members: DataFrame, owners: DataFrame) -> DataFrame:
    """base_slug, decision and reasons (sorted) of every group of members."""
    m = members.withColumn("audience", audience(F.col("model_name")))
    o = owners.withColumn("audience", audience(F.col("model_name")))
    mine = m.select("base_slug", "assigned", "id", *[F.col(c).alias(f"m_{c}") for c in FIELDS])
    by_key = o.where("source_key is not null").select(F.col("source_key").alias("_key"), *[F.col(c).alias(f"k_{c}") for c in FIELDS])
    uses = m.where("source_key is not null").groupBy(F.col("source_key").alias("_u")).agg(F.countDistinct("assigned").alias("uses"))
    claims = by_key.groupBy(F.col("_key").alias("_q")).agg(F.count(F.lit(1)).alias("claims"))
    a, k = _side("m"), _side("k")
    met = mine.join(by_key.hint("merge"), F.col("m_source_key") == F.col("_key"), "left").join(uses.hint("merge"), F.col("m_source_key") == F.col("_u"), "left").join(claims.hint("merge"), F.col("m_source_key") == F.col("_q"), "left")
    own = F.array_compact(F.array(F.when(a("source_key").isNull(), "MISSING_STABLE_SOURCE_IDENTITY"), F.when(F.col("uses") > 1, "DUPLICATE_SOURCE_KEY_PROPOSAL"), F.when(F.col("claims") > 1, "MULTIPLE_CLUSTERS_CLAIM_HISTORICAL_IDENTITY"), *[F.when(F.col("_key").isNotNull(), c) for c in reuse_conflicts(k, a)]))
    blocks = met.select("base_slug", F.explode(own).alias("reason")).withColumn("level", F.lit(2))

    first = mine.groupBy("base_slug", "assigned").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct(*[F.col(f"m_{c}") for c in FIELDS]), "id").alias("first"),
        F.collect_set("m_source_key").alias("keys"),
        F.bool_and((F.col("m_line_evidence") == "known") & F.col("m_season").isNotNull()).alias("known"),
        F.countDistinct(F.struct(*[F.coalesce(f"m_{c}", F.lit("")) for c in ("n_brand", "n_model", "board_line", "season", "variant")])).alias("kinds"),
    )
    slugs = lambda p: o.select(F.col("slug").alias(f"{p}_slug"), F.col("manual").alias(f"{p}_manual"), *[F.col(c).alias(f"{p}_{c}") for c in FIELDS])
    j = first.join(slugs("o").hint("merge"), F.col("assigned") == F.col("o_slug"), "left").join(slugs("h").hint("merge"), F.col("base_slug") == F.col("h_slug"), "left")
    f, h = lambda c: F.col(f"first.m_{c}"), _side("h")
    owned, exact = F.col("o_slug").isNotNull(), F.coalesce(F.array_contains("keys", F.col("o_source_key")), F.lit(False))
    suffixed = (F.col("assigned") != F.col("base_slug")) & F.col("h_slug").isNotNull()
    stem = lambda c: F.trim(F.regexp_replace(c, r"( ?mid)? ?wide$", ""))
    sibling = suffixed & (F.col("n") == 1) & (h("n_brand") == f("n_brand")) & (stem(h("n_model")) == stem(f("n_model"))) & (_line(h, f) | _known(h, f, "season") | ~h("variant").eqNullSafe(f("variant")) | _audience(h, f))
    complete = F.col("known") & (F.col("kinds") == 1)
    rules = [
        (2, "MANUAL_IDENTITY_REASSIGNMENT", owned & ~exact & F.col("o_manual")),
        (2, "CROSS_BRAND_SLUG_COLLISION", owned & ~exact & (F.col("o_n_brand") != f("n_brand"))),
        (2, "HISTORICAL_BASE_TAKEOVER", owned & ~exact & (F.col("o_n_brand") == f("n_brand"))),
        (0, "STABLE_PROTECTED_IDENTITIES", owned & exact),
        (0, "NEW_PROTECTED_IDENTITY_SUFFIX", ~owned & F.coalesce(sibling, F.lit(False))),
        (0, "NEW_CLEAN_MULTI_SOURCE", ~owned & ~F.coalesce(sibling, F.lit(False)) & (F.col("n") > 1) & complete),
        (1, "INCOMPLETE_CROSS_STORE_EVIDENCE_REVIEW", ~owned & ~F.coalesce(sibling, F.lit(False)) & (F.col("n") > 1) & ~complete),
        (1, "COLLISION_SUFFIX_REVIEW", ~owned & (F.col("n") == 1) & suffixed & F.coalesce(same_public_identity(h, f), F.lit(False))),
        (0, "NEW_CLEAN_SINGLE_SOURCE", ~owned & (F.col("n") == 1) & ~F.coalesce(sibling, F.lit(False)) & ~(suffixed & F.coalesce(same_public_identity(h, f), F.lit(False)))),
    ]
    flags = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(name).alias("reason"), F.lit(level).alias("level"))) for level, name, when in rules]))
    planned = j.select("base_slug", F.explode(flags).alias("f")).select("base_slug", "f.reason", "f.level")
    every = blocks.unionByName(planned)
    worst = every.groupBy(F.col("base_slug").alias("_b")).agg(F.max("level").alias("_w"))
    kept = every.join(worst.hint("merge"), (F.col("base_slug") == F.col("_b")) & (F.col("level") == F.col("_w")))
    g = kept.groupBy("base_slug").agg(F.max("level").alias("w"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return g.select("base_slug", F.element_at(F.lit(["AUTO", "REVIEW", "BLOCK"]), F.col("w") + 1).alias("decision"), "reasons")
