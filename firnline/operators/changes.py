"""Plans of change to product families: what is stored against what is wanted, and fingerprints of both.

Families here have identity_key and members (an array of product_id, slug, role, manual_override, match_method,
confidence and matched_at). A plan is a table; its fingerprint is one hash over its rows in key order.

Joins of offers say ``merge``: Spark guesses the size of a table from its compressed files, and would send all evidence
to every task through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.text import family_brand, family_model, family_season
from firnline.operators.digest import checksum, plan_hash

# How an automatic membership is marked, and the fields that a family takes from its base.
AUTOMATIC_RULE, AUTOMATIC_CONFIDENCE = "audit-high-v1", "high"
METADATA = ["riding_style", "skill_level", "flex", "board_line", "shape_type", "camber_profile", "data_status", "source_name", "source_url", "source_checked_at"]
FROM_MEMBER = "fallback-member"


def is_manual(m: Column) -> Column:
    return F.coalesce(m["manual_override"], F.lit(False)) | F.coalesce(m["match_method"] == "manual", F.lit(False))


def is_automatic(m: Column) -> Column:
    return ~F.coalesce(m["manual_override"], F.lit(False)) & F.coalesce((m["match_method"] == AUTOMATIC_RULE) & (m["confidence"] == AUTOMATIC_CONFIDENCE), F.lit(False))


def structural_problem(members: Column) -> Column:
    """Why a family cannot be kept by itself; null for one base and one wide member, both matched by the rule."""
    roles = F.array_sort(F.transform(members, lambda m: F.coalesce(m["role"], F.lit(""))))
    return F.when(F.size(members) != 2, "members").when(F.exists(members, lambda m: ~is_automatic(m)), "provenance").when(roles != F.array(F.lit("base"), F.lit("wide")), "roles")


def same_identity(families: DataFrame, candidates: DataFrame) -> DataFrame:
    """identity_key, logical (names and season agree) and exact (the slug too) of families and candidates of one key."""
    text = lambda side: (family_brand(F.col(f"{side}.brand")), family_model(F.col(f"{side}.model_name")), family_season(F.col(f"{side}.season_label")))
    joined = families.alias("f").join(candidates.alias("c"), F.col("f.identity_key") == F.col("c.identity_key"))
    logical = F.length(F.trim("f.identity_key")) > 0
    for a, b in zip(text("f"), text("c"), strict=True):
        logical = logical & F.coalesce((a == b) & (F.length(a) > 0), F.lit(False))
    exact = logical & F.coalesce((F.col("f.slug") == F.col("c.slug")) & (F.length(F.trim("f.slug")) > 0), F.lit(False))
    return joined.select(F.col("f.identity_key").alias("identity_key"), logical.alias("logical"), exact.alias("exact"))


def metadata_changes(families: DataFrame, candidates: DataFrame, fields: list[str] = METADATA) -> DataFrame:
    """identity_key, field, before and after (texts) of families whose metadata comes from a member and is no longer the candidate's."""
    text = lambda side, f: F.col(f"{side}.{f}").cast("string")
    joined = families.where(F.col("source_kind") == FROM_MEMBER).alias("f").join(candidates.alias("c"), F.col("f.identity_key") == F.col("c.identity_key"))
    each = F.array_compact(F.array(*[F.when(~F.col(f"f.{x}").eqNullSafe(F.col(f"c.{x}")), F.struct(F.lit(x).alias("field"), text("f", x).alias("before"), text("c", x).alias("after"))) for x in fields]))
    return joined.select(F.col("f.identity_key").alias("identity_key"), F.explode(each).alias("x")).select("identity_key", "x.*")


def stored_state(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: status (EMPTY, NOOP or CONFLICT), reasons (codes with how many rows they hold for) and the shared matched_at.

    Families are compared by identity_key and their members' product, slug and role.
    """
    core = lambda m: F.array_sort(F.transform(m, lambda x: F.struct(x["product_id"].alias("p"), x["slug"].alias("s"), x["role"].alias("r"))))
    w = wanted.select(F.col("identity_key").alias("_k"), core(F.col("members")).alias("_m"))
    j = stored.select("identity_key", "members").join(w, F.col("identity_key") == F.col("_k"), "full_outer")
    have = F.col("identity_key").isNotNull()
    bare = F.filter("members", lambda m: F.length(F.trim(F.coalesce(m["matched_at"].cast("string"), F.lit("")))) == 0)
    counts = j.agg(
        F.count_if(have).alias("stored"),
        F.count_if(F.col("_k").isNull()).alias("unexpected"),
        F.count_if(~have).alias("absent"),
        F.count_if(have & F.col("_k").isNotNull() & ~core(F.col("members")).eqNullSafe(F.col("_m"))).alias("different"),
        F.coalesce(F.sum(F.size(bare)), F.lit(0)).alias("undated"),
        F.min(F.array_min(F.transform("members", lambda m: m["matched_at"]))).alias("first"),
        F.max(F.array_max(F.transform("members", lambda m: m["matched_at"]))).alias("last"),
    )
    one = F.col("first").isNotNull() & (F.col("first") == F.col("last"))
    reason = lambda c: F.when(F.col(c) > 0, F.concat_ws(":", F.lit(c), F.col(c).cast("string")))
    reasons = F.array_compact(F.array(*[reason(c) for c in ("unexpected", "absent", "different", "undated")], F.when(~one, "matched_at")))
    empty = F.col("stored") == 0
    return counts.select(F.when(empty, "EMPTY").when(F.size(reasons) == 0, "NOOP").otherwise("CONFLICT").alias("status"), F.when(empty, F.array().cast("array<string>")).otherwise(reasons).alias("reasons"), F.when(one & ~empty, F.col("first")).alias("matched_at"))


def approved_entries(proposed: DataFrame) -> DataFrame:
    """entry (JSON) of each proposed family (identity_key, base, wide), by which a reviewed plan is known again."""
    return proposed.select("identity_key", F.to_json(F.struct("identity_key", F.col("base").alias("base_slug"), F.col("wide").alias("wide_slug"))).alias("entry"))


def fingerprint(plan: DataFrame, key: str) -> DataFrame:
    """rows and md5 of a plan: equal plans have equal ones in whatever order their rows come."""
    return checksum(plan, key)


def entry_hashes(plan: DataFrame, entry: str = "entry") -> DataFrame:
    """The plan with the canonical hash of each entry: the parts of a plan that a review has seen."""
    return plan.withColumn("entry_hash", plan_hash(F.col(entry)))


def reviewed(plan: DataFrame, approved: DataFrame) -> DataFrame:
    """Entries of a plan with whether just that entry was approved (identity_key and entry_hash)."""
    a = approved.select(F.col("identity_key").alias("_k"), F.col("entry_hash").alias("_h")).distinct()
    return entry_hashes(plan).join(a, (F.col("identity_key") == F.col("_k")) & (F.col("entry_hash") == F.col("_h")), "left").withColumn("approved", F.col("_h").isNotNull()).drop("_k", "_h")


def mutation_counts(actions: DataFrame, expected: dict[str, int]) -> DataFrame:
    """action, n and expected of every action that is not made as often as it should be."""
    want = actions.sparkSession.createDataFrame(list(expected.items()) or [("", 0)], "_a string, expected long")
    got = actions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    joined = got.join(F.broadcast(want), F.col("action") == F.col("_a"), "full_outer")
    return joined.select(F.coalesce("action", "_a").alias("action"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected")).where("n <> expected")


def offer_evidence(offers: DataFrame, sizes: DataFrame) -> DataFrame:
    """slug and evidence (JSON): what is known of an offer, sizes in order, prices of nothing as null."""
    one = F.struct("size_cm", F.coalesce("size_label", F.lit("")).alias("size_label"), "waist_width_mm", "recommended_weight_min", "recommended_weight_max", "width_type", F.coalesce("is_available", F.lit(True)).alias("is_available"))
    nested = sizes.groupBy(F.col("product_id").alias("_p")).agg(F.array_sort(F.collect_list(one)).alias("sizes"))
    price = F.when(F.col("price_from") > 0, F.col("price_from")).alias("price_from")
    return offers.join(nested.hint("merge"), F.col("id") == F.col("_p"), "left").select("slug", F.to_json(F.struct("brand", "model_name", "season_label", "board_line", price, "affiliate_url", "is_active", "sizes")).alias("evidence"))


def repairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """slug of offers whose evidence is not what it was, or is new."""
    old = before.select(F.col("slug").alias("_s"), F.col("evidence").alias("_e"))
    return after.join(old.hint("merge"), F.col("slug") == F.col("_s"), "left").where(~F.col("evidence").eqNullSafe(F.col("_e"))).select("slug", F.col("_s").isNull().alias("is_new"))


def reason_histogram(decisions: DataFrame) -> DataFrame:
    """kind (decision or reason), value and n over groups with a decision and an array of reasons."""
    each = F.explode(F.concat(F.array(F.struct(F.lit("decision").alias("kind"), F.col("decision").alias("value"))), F.transform("reasons", lambda r: F.struct(F.lit("reason").alias("kind"), r.alias("value")))))
    return decisions.select(each.alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def import_summary(outcomes: DataFrame) -> DataFrame:
    """store, seen, resolved, safe, failed and complete (nothing failed, and something was seen) of an import's outcomes."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    g = outcomes.groupBy("store_code").agg(F.count(F.lit(1)).alias("seen"), is_("resolved").alias("resolved"), is_("safe_unimportable").alias("safe"))
    return g.withColumn("failed", F.col("seen") - F.col("resolved") - F.col("safe")).withColumn("complete", (F.col("failed") == 0) & (F.col("resolved") > 0))


def stale_allowed(decisions: DataFrame, summary: DataFrame) -> DataFrame:
    """Stale decisions with whether they may be carried out: only where the import of that store was complete."""
    ok = summary.select(F.col("store_code").alias("_s"), "complete")
    return decisions.join(ok, F.col("store") == F.col("_s"), "left").withColumn("allowed", (F.col("decision") != "stale") | (F.col("store") == "none") | F.coalesce("complete", F.lit(False))).drop("_s", "complete")


def stored_digest_problem(rows: DataFrame) -> DataFrame:
    """logical_id and problem of ledger rows whose stored digest (JSON) does not say what the row says; null if it does."""
    at = lambda path: F.get_json_object("digest", path)
    pairs = {"$.logicalId": "logical_id", "$.kind": "kind", "$.status": "digest_status", "$.delivery.contentHash": "content_hash", "$.sourceReport.evidenceHash": "evidence_hash"}
    same = F.lit(True)
    for path, c in pairs.items():
        same = same & at(path).eqNullSafe(F.col(c))
    broken = F.try_parse_json("digest").isNull()
    return rows.select("logical_id", F.when(broken, "stored_digest_invalid").when(~same, "stored_digest_hash_mismatch").alias("problem"))


def delivery_key(logical_id: Column, content_hash: Column, prefix: str) -> Column:
    """The idempotency key of a delivery; null where it would be over 256 characters."""
    key = F.concat_ws("/", F.lit(prefix), logical_id, content_hash)
    return F.when(F.length(key) <= 256, key)


def envelope(digests: DataFrame, name: str) -> DataFrame:
    """logical_id, subject, filename and key of digests (kind, logical_id, as_of, content_hash) under the name of the service."""
    week = F.regexp_replace("logical_id", "^weekly:", "")
    daily = F.col("kind") == "daily"
    label = F.when(daily, F.col("as_of")).otherwise(week)
    subject = F.concat(F.lit(f"{name} "), F.when(daily, "Daily").otherwise("Weekly"), F.lit(" Analytics — "), label, F.lit(" ["), F.col("logical_id"), F.lit("]"))
    filename = F.concat_ws("-", F.lit(name.lower()), F.when(daily, "daily").otherwise("weekly"), F.concat(label, F.lit(".json")))
    return digests.select("logical_id", subject.alias("subject"), filename.alias("filename"), delivery_key(F.col("logical_id"), F.col("content_hash"), name.lower()).alias("key"))
