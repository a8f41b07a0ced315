"""Reads, validation, imports and report texts over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.functions import report_text as rt
from firnline.operators import catalogue as cat
from firnline.operators import changes
from firnline.operators import families as fam
from firnline.operators import match_texts as txt
from firnline.operators import reads, validation
from firnline.plans import bindings as b
from firnline.plans.domain_queries import _named
from firnline.sources import merge


def _key(c: str = "id"):
    return F.regexp_extract(c, r"(\d+)$", 1).cast("long")


def product_by_slug(s: SparkSession, d: str) -> DataFrame:
    return reads.by_slug(b.products(s, d), b.sizes(s, d), "p-4").select("slug", "brand", F.array_join(F.transform("sizes", lambda x: x["id"]), ",").alias("size_ids"))


def product_slugs(s: SparkSession, d: str) -> DataFrame:
    return reads.slugs(b.products(s, d))


def offer_scans(s: SparkSession, d: str) -> DataFrame:
    """The three ways in which offers are asked for, told apart by mode."""
    p, mode = b.products(s, d), lambda df, m: df.select(F.lit(m).alias("mode"), "slug")
    return mode(reads.all_offers(p), "all").unionByName(mode(reads.family_offers(p, "f-2"), "family")).unionByName(mode(reads.single_offer(p, "p-4"), "single"))


def editor_products(s: SparkSession, d: str) -> DataFrame:
    return reads.for_editor(b.products(s, d), b.sizes(s, d)).select("slug", "is_active", F.size("sizes").cast("long").alias("n_sizes"))


def catalogue_page(s: SparkSession, d: str) -> DataFrame:
    return reads.page(cat.browse(cat.items(b.families(s, d), b.products(s, d), b.sizes(s, d)), "price-asc"), 24).select("slug")


def family_members(s: SparkSession, d: str) -> DataFrame:
    made = reads.families_with_members(b.families(s, d), b.products(s, d))
    return made.select("id", F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["role"], m["slug"])), ",").alias("members"))


def empty_families(s: SparkSession, d: str) -> DataFrame:
    """Every third family has lost its products."""
    return reads.families_without_products(b.families(s, d), b.products(s, d).where(F.floor(_key() / 5) % 3 != 0)).select("id")


def catalogue_snapshot(s: SparkSession, d: str) -> DataFrame:
    return reads.snapshot(b.products(s, d), b.sizes(s, d), b.families(s, d)).withColumn("newest", F.col("newest").cast("string"))


def catalogue_brands(s: SparkSession, d: str) -> DataFrame:
    return reads.brands(b.products(s, d))


def size_total(s: SparkSession, d: str) -> DataFrame:
    return reads.size_total(reads.with_sizes(b.products(s, d), b.sizes(s, d)))


def related_pages(s: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    to = F.array(*[F.concat(F.lit("page-"), ((k * 7 + i * i) % 40).cast("string")) for i in range(6)])
    pages = b.table(s, d, "nation").select(F.concat(F.lit("page-"), k.cast("string")).alias("slug"), to.alias("related"))
    return reads.related_pages(pages).select("slug", F.array_join("related", ",").alias("related"))


def shared_images(s: SparkSession, d: str) -> DataFrame:
    p = b.products(s, d)
    other = F.array(F.concat(F.lit("img-"), (_key() % 8).cast("string")), F.lit("g-1"), F.lit("g-1"))
    return p.select("slug", reads.shared_images(F.col("gallery_images"), other).cast("long").alias("n"))


def rider_problems(s: SparkSession, d: str) -> DataFrame:
    """Answers of which each is at times missing, out of bounds or unknown."""
    k = F.col("rider_id")
    odd = {"height_cm": (11, 139.5), "boot_size_eu": (13, 52.5), "board_line_preference": (17, "kids"), "skill_level": (19, "expert"), "riding_style": (23, "moguls"), "terrain_priority": (29, "ice"), "aggressiveness": (31, "wild"), "stance_type": (7, "goofy"), "weight_kg": (9, 20.0)}
    riders = b.riders(s, d).withColumns({c: F.when(k % n == 0, v).when(k % n == 1, F.lit(None)).otherwise(F.col(c)) for c, (n, v) in odd.items()})
    return validation.rider_problems(riders).select("rider_id", F.array_join("problems", ",").alias("problems"))


def product_problems(s: SparkSession, d: str) -> DataFrame:
    """Products and sizes of which each rule finds some."""
    k, of = _key(), F.regexp_extract("product_id", r"(\d+)$", 1).cast("long")
    c = F.col
    p = b.products(s, d).withColumns({
        "name": c("slug"), "slug": F.when(k % 31 == 0, F.concat(F.lit("P_"), k.cast("string"))).when(k % 37 == 0, "x").otherwise(c("slug")), "brand": F.when(k % 29 == 3, " ").otherwise(c("brand")), "model_name": F.when(k % 41 == 0, F.lit(None)).otherwise(c("model_name")),
        "flex": F.when(k % 17 == 0, 0).when(k % 17 == 1, 11).otherwise(c("flex")), "price_from": F.when(k % 43 == 0, -1).when(k % 43 == 1, 600_000).otherwise(c("price_from")), "riding_style": F.when(k % 47 == 0, "moguls").otherwise(c("riding_style")), "skill_level": F.when(k % 53 == 0, F.lit(None)).otherwise(c("skill_level")),
        "board_line": F.when(k % 59 == 0, "kids").otherwise(c("board_line")), "data_status": F.when(k % 61 == 0, "new").otherwise(c("data_status")), "shape_type": F.when(k % 67 == 0, "odd").otherwise(c("shape_type")), "camber_profile": F.when(k % 71 == 0, "odd").otherwise(c("camber_profile")),
        "image_url": b.pick(k, ["/i.jpg", "https://img.example/i.jpg", "img"]), "source_name": F.when(k % 73 == 0, F.repeat(F.lit("x"), 161)).otherwise(c("source_name")),
    })
    z = b.sizes(s, d).withColumns({
        "size_label": F.when(of % 19 == 0, F.repeat(F.lit("y"), 25)).otherwise(c("size_label")), "recommended_weight_max": F.when(of % 23 == 0, 20).when(of % 23 == 1, c("recommended_weight_min") - 1).otherwise(c("recommended_weight_max")), "width_type": F.when(of % 27 == 0, "slim").otherwise(c("width_type")),
        "copy": F.explode(F.sequence(F.lit(1), F.when(of % 33 == 0, 6).otherwise(1))),
    })
    return validation.product_problems(p, z).select("slug", F.array_join("problems", ",").alias("problems"))


def import_changes(s: SparkSession, d: str) -> DataFrame:
    p = b.products(s, d)
    imported = p.where(_key() % 3 != 0).withColumn("slug", F.when(_key() % 10 == 1, F.concat(F.lit("new-"), "slug")).otherwise(F.col("slug")))
    return merge.partition_changes(p, imported, "slug")


def import_counts(s: SparkSession, d: str) -> DataFrame:
    p = b.products(s, d)
    imported = p.where(_key() % 3 != 0).withColumn("slug", F.when(_key() % 10 == 1, F.concat(F.lit("new-"), "slug")).otherwise(F.col("slug")))
    return merge.upsert_counts(p, imported, "slug")


def merged_imports(s: SparkSession, d: str) -> DataFrame:
    k, p = _key(), b.products(s, d)
    imported = p.where(k % 6 != 5).select("slug", F.when(k % 4 == 0, "unisex").otherwise(F.col("board_line")).alias("board_line"), F.when(k % 5 == 0, F.lit(" ")).otherwise(F.col("season_label")).alias("season_label"), F.when(k % 7 == 0, 0).otherwise(F.col("price_from") + 10).alias("price_from"), "affiliate_url", (k % 8 != 0).alias("is_active"), F.when(k % 2 == 0, "missing").otherwise("known").alias("line_evidence"))
    return merge.merged_import(p, imported)


def changed_rows(s: SparkSession, d: str) -> DataFrame:
    k, p = _key(), b.products(s, d)
    after = p.where(k % 12 != 0).withColumn("price_from", F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("price_from"))).withColumn("brand", F.when(k % 4 == 0, "other").otherwise(F.col("brand")))
    return merge.changed(p, after, "slug", ["brand", "price_from"]).select("slug", "kind", F.array_join("columns", ",").alias("columns"))


def gallery_rewrites(s: SparkSession, d: str) -> DataFrame:
    p = b.products(s, d).withColumn("gallery_images", F.when(_key() % 2 == 0, F.array("image_url")).otherwise(F.col("gallery_images")))
    return merge.normalized_galleries(p).select("slug", F.array_join("gallery_images", ",").alias("gallery"))


def deleted_sizes(s: SparkSession, d: str) -> DataFrame:
    z, p = b.sizes(s, d), b.products(s, d)
    doomed = z.where("size_cm < 100")
    _, gone = merge.delete_where(z, doomed, "id", F.col("is_available"), z.join(p.where("is_active").select(F.col("id").alias("product_id")), "product_id", "left_semi").where("recommended_weight_min = 0"))
    return gone.select("id")


def contested_families(s: SparkSession, d: str) -> DataFrame:
    pairs = fam.width_pairs(_named(s, d), b.sizes(s, d))
    again = pairs.where(F.regexp_extract("base", r"(\d+)$", 1).cast("long") % 4 == 0).withColumn("variant", F.concat(F.lit("again-"), "variant"))
    return fam.contested(pairs.unionByName(again))


def priority_impacts(s: SparkSession, d: str) -> DataFrame:
    return txt.priority_impact(b.riders(s, d)).select("rider_id", F.col("cards")[0]["value"].alias("length"), F.col("cards")[1]["value"].alias("shape"), F.col("cards")[2]["value"].alias("feel"), F.regexp_extract(F.col("cards")[0]["description"], r"(\d+-\d+ см)", 1).alias("span"))


def report_texts(s: SparkSession, d: str) -> DataFrame:
    """Small text functions over sizes."""
    k, n = F.split_part("id", F.lit("-"), F.lit(2)).cast("int"), F.split_part("id", F.lit("-"), F.lit(3)).cast("int")
    day = F.concat(F.lit("2024-0"), (k % 9 + 1).cast("string"), F.lit("-"), F.lpad((k % 33 + 1).cast("string"), 2, "0"))
    monday = F.date_add(F.lit("2024-01-01").cast("date"), 7 * n + F.when(k % 5 == 0, 1).otherwise(0))
    moved = rt.relative_movement(k.cast("double"), (n * 100).cast("double"), 0.25, 150.0)
    return b.sizes(s, d).select(
        "id",
        rt.weight_range(F.col("recommended_weight_min"), F.col("recommended_weight_max")).alias("weights"),
        rt.escape_html(F.concat(F.lit("<b>\"'&"), F.coalesce("size_label", F.lit("")))).alias("html"),
        rt.strict_date(day).cast("string").alias("day"),
        rt.is_whole_week(monday, F.date_add(monday, 6)).alias("week"),
        rt.merchant_host(F.concat(F.lit("https://WWW.Shop-"), k.cast("string"), F.lit(".example:80/a?b"))).alias("host"),
        moved["direction"].alias("moved"),
        F.array_join(rt.goals(F.when(n < 3, "product_clicked").otherwise("home_viewed"), F.when(k % 2 == 0, "board-page"), "x_"), ",").alias("goals"),
        rt.failure_kind(F.lit(400) + k % 40).alias("failure"),
        rt.is_retryable(F.lit(400) + k % 120).alias("again"),
        rt.retry_after_ms(F.when(k % 2 == 0, (k % 30).cast("string")).otherwise("soon"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("wait"),
    )


def _keyed_families(s: SparkSession, d: str, role=None, at: str = "t1") -> DataFrame:
    made = reads.families_with_members(b.families(s, d), b.products(s, d))
    member = lambda m: F.struct(m["product_id"], m["slug"], (role if role is not None else m["role"]).alias("role"), F.lit(False).alias("manual_override"), F.lit(changes.AUTOMATIC_RULE).alias("match_method"), F.lit(changes.AUTOMATIC_CONFIDENCE).alias("confidence"), F.lit(at).alias("matched_at"))
    return made.select(F.concat(F.lit("v1|"), "id").alias("identity_key"), F.transform("members", member).alias("members"))


def stored_family_state(s: SparkSession, d: str) -> DataFrame:
    """Stored families of which every seventh is gone and every fifth has one role twice."""
    k = _key("identity_key")
    wanted = _keyed_families(s, d)
    twice = _keyed_families(s, d, F.lit("base")).where(k % 5 == 1)
    stored = wanted.where(k % 5 != 1).unionByName(twice).where(k % 7 != 0)
    return changes.stored_state(wanted, stored).select("status", F.array_join("reasons", ",").alias("reasons"), "matched_at")


def family_structure(s: SparkSession, d: str) -> DataFrame:
    """Families by what keeps them from being kept."""
    k = _key("identity_key")
    mixed = _keyed_families(s, d).where(k % 3 != 0).unionByName(_keyed_families(s, d, F.lit("base")).where(k % 3 == 0))
    some = mixed.withColumn("members", F.when(k % 4 == 0, F.slice("members", 1, 1)).otherwise(F.col("members")))
    return some.select("identity_key", changes.structural_problem(F.col("members")).alias("problem"))


def metadata_changes(s: SparkSession, d: str) -> DataFrame:
    """Families whose fields, each for some, are no longer their base's; every seventh is written by hand."""
    k = F.regexp_extract("identity_key", r"(\d+)$", 1).cast("long")
    key = lambda c: F.concat(F.lit("v1|"), c).alias("identity_key")
    f = b.families(s, d).select(key("id"), *changes.METADATA).withColumn("source_kind", F.when(k % 7 == 0, "editorial").otherwise(changes.FROM_MEMBER))
    fields = changes.METADATA
    c = b.products(s, d).where("member_role = 'base'").select(key("family_id"), *fields)
    moved = {x: F.when(k % len(fields) == i, F.lit(None)).otherwise(F.col(x)) for i, x in enumerate(fields)}
    return changes.metadata_changes(f, c.withColumns(moved), fields)


def offer_repairs(s: SparkSession, d: str) -> DataFrame:
    """Offers whose evidence changes when every third price and every size of 95 cm does."""
    p, z = b.products(s, d), b.sizes(s, d)
    after = changes.offer_evidence(p.withColumn("price_from", F.when(_key() % 3 == 0, 0).otherwise(F.col("price_from"))), z.withColumn("size_cm", F.when(F.col("size_cm") == 95, 96.0).otherwise(F.col("size_cm"))))
    return changes.repairs(changes.offer_evidence(p, z), after)


def digest_rows(s: SparkSession, d: str) -> DataFrame:
    """Ledger rows against the digests that they hold."""
    k = F.col("o_orderkey")
    n = k.cast("string")
    body = F.to_json(F.struct(n.alias("logicalId"), F.lit("daily").alias("kind"), F.lit("ok").alias("status"), F.struct(F.concat(F.lit("c"), n).alias("contentHash")).alias("delivery"), F.struct(F.concat(F.lit("e"), n).alias("evidenceHash")).alias("sourceReport")))
    rows = b.table(s, d, "orders").select(n.alias("logical_id"), F.when(k % 5 == 0, "weekly").otherwise("daily").alias("kind"), F.lit("ok").alias("digest_status"), F.concat(F.lit("c"), n).alias("content_hash"), F.when(k % 7 == 0, "old").otherwise(F.concat(F.lit("e"), n)).alias("evidence_hash"), F.when(k % 11 == 0, "{broken").otherwise(body).alias("digest"))
    return changes.stored_digest_problem(rows)


QUERIES = [product_by_slug, product_slugs, offer_scans, editor_products, catalogue_page, family_members, empty_families, catalogue_snapshot, catalogue_brands, size_total, related_pages, shared_images, rider_problems, product_problems, import_changes, import_counts, merged_imports, changed_rows, gallery_rewrites, deleted_sizes, contested_families, priority_impacts, report_texts, stored_family_state, family_structure, metadata_changes, offer_repairs, digest_rows]
