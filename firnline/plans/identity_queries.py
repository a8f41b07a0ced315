"""The identity plan over offers of two stores, against a stored catalogue in which each rule of naming has its case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.operators import identity, identity_plan
from firnline.plans import bindings as b
from firnline.plans.domain_queries import _offers
from firnline.sources.rounds import Rounds


def _number():
    return F.regexp_extract("id", r"(\d+)$", 1).cast("long")


def imports(s: SparkSession, d: str, part: DataFrame) -> DataFrame:
    """Offers with what a merge reads; one in 41 has a link to no managed store."""
    k = _number()
    o = _offers(s, d, "price_from", "image_url", "gallery_images", "shape_type", "flex", part=part)
    return identity.offer_identities(o.withColumn("affiliate_url", F.when(k % 41 == 0, "https://elsewhere.test/x").otherwise(F.col("affiliate_url"))))


def stored_products(offers: DataFrame) -> DataFrame:
    """Per group of four offers: none, an owner of the base slug, one without a store, an older name, a stranger on a wanted name, two owners, two older names."""
    o = offers.where("store_code is not null").withColumn("k", _number()).withColumn("g", F.floor(F.col("k") / 4))
    kind, first, third = F.col("g") % 7, F.col("k") % 4 == 0, F.col("k") % 4 == 2
    base = F.concat(F.lit("o-"), F.col("g").cast("string"))
    name = lambda text: F.concat(F.lit(text), F.col("g").cast("string"))
    cases = F.array_compact(
        F.array(
            F.when((kind == 1) & third, F.struct(base.alias("slug"), F.lit(True).alias("linked"))),
            F.when((kind == 2) & first, F.struct(base.alias("slug"), F.lit(False).alias("linked"))),
            F.when((kind == 3) & first, F.struct(name("old-").alias("slug"), F.lit(True).alias("linked"))),
            F.when((kind == 4) & first, F.struct(F.concat(base, F.lit("-traektoria-"), (F.col("k") + 1002).cast("string")).alias("slug"), F.lit(True).alias("linked"))),
            F.when((kind == 5) & (first | third), F.struct(base.alias("slug"), F.lit(True).alias("linked"))),
            F.when((kind == 6) & first, F.struct(name("old-").alias("slug"), F.lit(True).alias("linked"))),
            F.when((kind == 6) & first, F.struct(name("older-").alias("slug"), F.lit(True).alias("linked"))),
            F.when((F.col("g") % 11 == 0) & third, F.struct(name("gone-").alias("slug"), F.lit(True).alias("linked"))),
        )
    )
    rows = o.withColumn("c", F.explode(cases))
    moved = F.when(F.col("g") % 2 == 0, F.concat(F.lit("id-"), (F.col("k") + 1).cast("string"))).otherwise(F.col("id"))
    url = F.when(F.col("c.linked"), F.col("affiliate_url")).otherwise("https://elsewhere.test/x")
    apart = F.startswith("c.slug", F.lit("gone-"))
    number = F.when(apart, F.concat(F.lit("9"), F.col("source_product_id"))).otherwise(F.col("source_product_id"))
    key = F.when(F.col("c.linked"), F.concat_ws("|", "store_code", number))
    return rows.select(
        F.col("c.slug").alias("slug"), F.col("id"), moved.alias("ref"), F.when(F.col("c.linked"), F.col("store_code")).alias("store_code"), F.when(F.col("c.linked"), number).alias("source_product_id"), key.alias("source_key"),
        "n_brand", "n_model", F.when((kind == 3) & (F.col("g") % 2 == 0), "women").otherwise(F.col("board_line")).alias("board_line"), "season", "variant", url.alias("affiliate_url"),
    )


def official(part: DataFrame) -> DataFrame:
    g = F.floor(F.col("p_partkey") / 4)
    return part.select(g.alias("g")).distinct().where("g % 4 = 0").select(F.concat(F.lit("o-"), F.col("g").cast("string")).alias("slug"), F.when(F.col("g") % 3 == 0, "women").otherwise("men").alias("board_line"))


def _plan(s: SparkSession, d: str) -> tuple[identity_plan.Plan, DataFrame]:
    """The plan and the stored products; both are tables, as is what they are made of, so that no link or name is read twice."""
    tables, part = Rounds(s, "imports"), b.dealt(s, d, "part")
    offers = tables.put(imports(s, d, part), "offers")
    stored = tables.put(stored_products(offers), "stored")
    return identity_plan.identity_plan(offers, b.sizes(s, d, part), stored, official(part)), stored


def identity_plan_products(s: SparkSession, d: str) -> DataFrame:
    """Every product of the plan: who gives its description, who sells, and what came of the rest."""
    p = _plan(s, d)[0].assignments
    return p.select("base_slug", "cluster", "slug", "reason", "base", "seller", "n_offers", "n_sizes", "season_label", "price_from", "is_active", "image_url", F.array_join("gallery_images", ",").alias("gallery"), "members")


def identity_groups(s: SparkSession, d: str) -> DataFrame:
    return _plan(s, d)[0].groups


def identity_operations(s: SparkSession, d: str) -> DataFrame:
    return identity_plan.plan_operations(*_plan(s, d))


def identity_audit(s: SparkSession, d: str) -> DataFrame:
    """Counts by class, signal and issue, and of the operations by kind and class."""
    plan, stored = _plan(s, d)
    made = identity_plan.plan_operations(plan, stored).groupBy(F.col("operation").alias("kind"), F.coalesce("class", F.lit("none")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return identity_plan.plan_signals(plan).unionByName(made)


QUERIES = [identity_plan_products, identity_groups, identity_operations, identity_audit]
