"""Family, identity, ledger, merge, golden and text queries over the bound tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.functions import links
from firnline.functions import text as tx
from firnline.functions.jsons import merchant
from firnline.operators import authorization, decisions, digest, golden, identity, ledger
from firnline.operators import events as ev
from firnline.operators import families as fam
from firnline.operators import recommend as rec
from firnline.operators.recommend import with_profile
from firnline.plans import bindings as b
from firnline.sources import feeds, merge
from firnline.sources.rounds import Rounds

NOW = datetime(2024, 1, 20, 12, tzinfo=timezone.utc)


def _named(s: SparkSession, d: str) -> DataFrame:
    """Products named in threes: a base and two variants of one brand."""
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    ending = F.when(k % 3 == 1, " Wide").when((k % 3 == 2) & (k % 2 == 0), " W").when(k % 3 == 2, " Pro").otherwise("")
    p = b.products(s, d).withColumn("k", k)
    return p.withColumn("brand", F.concat(F.lit("Make "), F.floor(k / 30).cast("string"))).withColumn("model_name", F.concat(F.lit("Model "), F.floor(k / 3).cast("string"), ending)).withColumn("season_label", F.when(k % 8 == 0, None).when(k % 15 == 1, "23/24").otherwise("2024/2025")).withColumn("riding_style", F.when(k % 13 == 0, "park").otherwise("freeride")).withColumn("skill_level", F.lit("advanced")).withColumn("board_line", F.lit("men")).withColumn("shape_type", F.when(k % 4 != 0, b.pick(F.floor(k / 9), b.SHAPES))).withColumn("camber_profile", F.lit(None).cast("string"))


def family_pairs(s: SparkSession, d: str) -> DataFrame:
    return fam.width_pairs(_named(s, d), b.sizes(s, d)).select("base", "variant", "marker", "classification", "reason", F.array_join("conflicts", ",").alias("conflicts"))


def family_orphans(s: SparkSession, d: str) -> DataFrame:
    return fam.orphans(_named(s, d).where("k % 6 <> 0"))


def family_protected(s: SparkSession, d: str) -> DataFrame:
    return fam.protected_pairs(_named(s, d))


def family_duplicates(s: SparkSession, d: str) -> DataFrame:
    p = _named(s, d).withColumn("model_name", F.concat(F.lit("Model "), F.floor(F.col("k") / 3).cast("string")))
    return fam.duplicates(p).select("brand", "model", "season", F.array_join("slugs", ",").alias("slugs"), F.col("hosts"))


def family_proposals(s: SparkSession, d: str) -> DataFrame:
    return fam.proposals(fam.width_pairs(_named(s, d), b.sizes(s, d)))


def family_reconciliation(s: SparkSession, d: str) -> DataFrame:
    p = fam.proposals(fam.width_pairs(_named(s, d), b.sizes(s, d)))
    n = F.col("n")
    known = p.withColumn("n", F.regexp_extract("base", r"(\d+)$", 1).cast("long")).where(n % 5 != 0).select("identity_key", F.when(n % 11 == 0, "gone").otherwise(F.col("base")).alias("base"), F.when(n % 7 == 0, "gone").otherwise(F.col("wide")).alias("wide"), (n % 2 == 0).alias("manual_override"))
    return fam.reconcile(p, known)


def _offers(s: SparkSession, d: str, *more: str, part: DataFrame | None = None) -> DataFrame:
    """Offers of two stores in groups of four slugs, with more of the products' columns."""
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    g = F.floor(k / 4)
    url = F.when(k % 2 == 0, F.concat(F.lit("https://www.traektoria.ru/product/"), (k + 1000).cast("string"), F.lit("_x/"))).otherwise(F.concat(F.lit("https://trial-sport.ru/goods/51/"), (F.floor(k / 8) * 8 + 7).cast("string"), F.lit(".html")))
    p = b.products(s, d, b.dealt(s, d, "part") if part is None else part)
    return p.select("id", F.concat(F.lit("o-"), F.when(k % 9 == 0, k).otherwise(g).cast("string")).alias("slug"), F.concat(F.lit("Make "), F.floor(g / 5).cast("string")).alias("brand"), F.concat(F.lit("Model "), g.cast("string"), F.when((g % 6 == 0) & (k % 4 == 3), " Wide").otherwise("")).alias("model_name"), F.when(g % 3 == 0, b.pick(k, ["men", "women"])).when(g % 3 == 1, "men").otherwise("unisex").alias("board_line"), F.when(g % 5 == 0, b.pick(k, ["2023/2024", "2024/2025"])).otherwise("24/25").alias("season_label"), url.alias("affiliate_url"), F.lit(None).cast("string").alias("source_url"), "is_active", *more)


def _identities(tables: Rounds, d: str) -> DataFrame:
    """The offers' identities as a table: links and names are read once, not by each branch of a query."""
    return tables.put(identity.offer_identities(_offers(tables.spark, d)), "identities")


def offer_compatibility(s: SparkSession, d: str) -> DataFrame:
    return identity.pair_compatibility(_identities(Rounds(s, "compatibility"), d)).select("base_slug", "left", "right", F.array_join("reasons", ",").alias("reasons"))


def offer_clusters(s: SparkSession, d: str) -> DataFrame:
    return identity.clusters(_identities(Rounds(s, "clusters"), d))


def offer_classes(s: SparkSession, d: str) -> DataFrame:
    i = _identities(Rounds(s, "classes"), d)
    return identity.group_classes(i, identity.clusters(i))


def stale_offers(s: SparkSession, d: str) -> DataFrame:
    o = _offers(s, d).withColumn("slug", F.col("id"))
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    o = o.withColumn("affiliate_url", F.when(k % 10 == 9, "https://elsewhere.test/x").otherwise(F.col("affiliate_url")))
    resolved = o.where(k % 3 == 0)
    seen = o.withColumn("i", identity.store_identity(F.col("affiliate_url"))).where((k % 3 == 1) & F.col("i.source_product_id").isNotNull() & (k % 4 < 2)).select("i.store_code", "i.source_product_id", F.when(F.col("i.store_code") == "trial-sport", "available").otherwise(b.pick(F.floor(k / 4), ["available", "unavailable"])).alias("availability"), F.lit("safe_unimportable").alias("status"), F.when(F.col("i.store_code") == "trial-sport", "spec_missing").otherwise("size_table_missing").alias("reason")).distinct()
    checked = o.where(k % 5 < 3).select("slug", b.pick(k, ["unavailable", "available", "unknown"]).alias("status"))
    return identity.stale_decisions(o, resolved, seen, checked)


def _ledger(s: SparkSession, d: str) -> DataFrame:
    """A delivery for each order; every seventh is not known yet."""
    k = F.col("o_orderkey")
    h = lambda n: F.lit(NOW) - F.make_dt_interval(hours=n)
    status = F.when(k % 7 == 0, None).otherwise(b.pick(F.floor(k / 7), ["pending", "sending", "sent", "partial_sent", "failed", "conflict", "sending", "pending"]))
    return b.table(s, d, "orders").select(k.alias("logical_id"), status.alias("delivery_status"), F.lit("h").alias("content_hash"), F.when(k % 13 == 0, "other").otherwise("h").alias("new_hash"), F.when(k % 3 == 0, "provider_outcome_unknown").alias("last_error_category"), F.when(k % 4 < 2, h((k % 5).cast("int") - 2)).alias("lease_expires_at"), F.when(k % 6 != 0, h((k % 40).cast("int"))).alias("last_attempt_at"), (k % 7).cast("int").alias("attempt_count"), F.when(k % 5 == 0, h((k % 9).cast("int") - 4)).alias("next_attempt_at"), h((k % 200).cast("int") * 24).alias("created_at"), F.concat(F.lit("t"), (k % 3).cast("string")).alias("lease_token"), F.concat(F.lit("t"), (k % 2).cast("string")).alias("held_token"), F.when(k % 8 == 0, "m").alias("message_id"), (k % 16 == 1).alias("threw"), b.pick(k, ["invalid_idempotent_request", None, "concurrent_idempotent_requests", "other", "rate_limit_exceeded"]).alias("error_name"), F.when(k % 9 < 6, F.element_at(F.lit([429, 500, 400, 503, 422, 200]), (k % 9 + 1).cast("int"))).alias("status_code"), F.when(k % 2 == 0, "complete").otherwise("partial").alias("digest_status"))


def ledger_claims(s: SparkSession, d: str) -> DataFrame:
    return _ledger(s, d).select("logical_id", ledger.claim_decision(NOW).alias("c")).select("logical_id", "c.action", "c.category")


def ledger_outcomes(s: SparkSession, d: str) -> DataFrame:
    done = ledger.finished(_ledger(s, d).withColumn("outcome", ledger.provider_outcome()), NOW)
    return done.select("logical_id", "delivery_status", "category", F.unix_timestamp("next_attempt_at").cast("double").alias("next_attempt_epoch"))


def ledger_due(s: SparkSession, d: str) -> DataFrame:
    rows = ledger.due(_ledger(s, d), NOW)
    return rows.select("logical_id", "delivery_status")


def ledger_retained(s: SparkSession, d: str) -> DataFrame:
    return ledger.retained(_ledger(s, d), NOW).select("logical_id", "delivery_status")


def sweep_status(s: SparkSession, d: str) -> DataFrame:
    rows = _ledger(s, d).where("delivery_status in ('pending', 'sent', 'partial_sent', 'failed', 'conflict')")
    return ledger.sweep_status(rows.select((F.col("logical_id") % 50).alias("sweep"), F.col("delivery_status").alias("status"), F.col("logical_id").alias("position")))


def _leads(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = b.table(s, d, "customer")
    k = F.col("c_custkey")
    row = lambda src, q, consent: c.select(k.alias("email"), F.lit(src).alias("source"), q.alias("quiz_result_id"), consent.alias("consent"), F.lit(src + "-id").alias("id"))
    return row("old", F.when(k % 3 == 0, k * 10), k % 4 == 0).where("email % 5 <> 0"), row("new", F.when(k % 2 == 0, k * 100), k % 6 == 0).where("email % 3 <> 1")


def lead_upsert(s: SparkSession, d: str) -> DataFrame:
    return merge.upsert(*_leads(s, d), key="email", keep=["id"], coalesced=["quiz_result_id"], any_true=["consent"]).withColumn("quiz_result_id", F.col("quiz_result_id").cast("double"))


def size_replacement(s: SparkSession, d: str) -> DataFrame:
    old = b.sizes(s, d).select("id", "product_id", "size_cm")
    touched = b.products(s, d).where("data_status = 'draft'").select(F.col("id").alias("product_id"))
    new = touched.select(F.concat(F.lit("n-"), "product_id").alias("id"), "product_id", F.lit(150.0).alias("size_cm"))
    return merge.replace_children(old, new, "product_id", touched)


def guarded_update(s: SparkSession, d: str) -> DataFrame:
    p = b.products(s, d).select("slug", "family_id", "member_role")
    changes = p.where("family_id is not null").select("slug", F.lit("f-new").alias("family_id"), F.lit("other").alias("member_role")).unionByName(p.where("family_id is null").select("slug", F.lit("f-new").alias("family_id"), F.lit("base").alias("member_role")))
    return merge.update_where(p, changes, "slug", F.col("family_id").isNull(), ["family_id", "member_role"])


def latest_orders(s: SparkSession, d: str) -> DataFrame:
    o = b.table(s, d, "orders").groupBy(F.col("o_custkey").alias("session_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return o


def golden_cases(s: SparkSession, d: str) -> DataFrame:
    k = F.col("rider_id")
    cases = with_profile(b.riders(s, d)).withColumn("case_id", k).withColumns({"sane_min_cm": F.lit(140) + k % 20, "sane_max_cm": F.lit(152) + k % 18, "widths": F.when(k % 2 == 0, F.lit(["regular", "mid-wide"])).otherwise(F.lit(["mid-wide", "wide"])), "waist_min": F.lit(240) + k % 20, "waist_max": F.lit(255) + k % 25, "drag_risks": F.when(k % 3 == 0, F.lit(["low"])).otherwise(F.lit(["medium", "low"])), "primary_shapes": F.lit(["twin", "directional"])})
    return golden.audit_cases(cases)


def golden_invariants(s: SparkSession, d: str) -> DataFrame:
    p = with_profile(b.riders(s, d)).withColumnRenamed("rider_id", "case_id")
    rules = p.select(F.col("case_id").alias("rule_id"), b.pick(F.col("case_id"), ["length_not_shorter", "length_not_longer", "waist_not_narrower", "width_not_narrower", "boot_drag_not_lower", "same_physical_fit_expectation", "support_not_less_stable"]).alias("rule"), F.col("case_id").alias("left_id"), (F.col("case_id") + 1).alias("right_id"))
    return golden.audit_invariants(rules, p)


def page_hosts(s: SparkSession, d: str) -> DataFrame:
    return b.table(s, d, "pages").groupBy(merchant(F.col("url")).alias("merchant")).agg(F.count(F.lit(1)).alias("pages"))


def page_text(s: SparkSession, d: str) -> DataFrame:
    return b.table(s, d, "pages").select("page_id", F.md5(tx.strip_html(F.col("html")).cast("binary")).alias("text_md5"))


def name_slugs(s: SparkSession, d: str) -> DataFrame:
    p = b.table(s, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" & FW24 +2 Доска 2024/2025 snowboard's")).alias("n"))
    return p.select("p_partkey", tx.slug(F.col("n")).alias("slug"), tx.board_key(F.col("n")).alias("key"), tx.identity_text(F.col("n")).alias("identity"))


def season_labels(s: SparkSession, d: str) -> DataFrame:
    p = b.table(s, d, "part").select("p_partkey", b.pick(F.col("p_partkey"), ["2023/2024", "2024-25", "24/25", "FW 25", "сезон 2023", "fw'2024", "none", "", "25/24", " 2022 2023 "]).alias("t"))
    return p.select("p_partkey", tx.season_label(F.col("t")).alias("season"), tx.season_identity(F.col("t")).alias("identity"), tx.season_rank(tx.season_label(F.col("t"))).cast("double").alias("rank"), tx.family_season(F.col("t")).alias("family"))


def feed_numbers(s: SparkSession, d: str) -> DataFrame:
    p = b.table(s, d, "part").select("p_partkey", b.pick(F.col("p_partkey"), ["60+ кг", "60-80", "25,4 см", "255", "2540", "мягкая", "жесткая 8", "средняя", "", "55 – 70,5"]).alias("t"))
    w = tx.weight_range(F.col("t"))
    return p.select("p_partkey", tx.decimal_number(F.col("t")).alias("number"), tx.waist_mm(F.col("t")).cast("double").alias("waist"), tx.flex_number(F.col("t")).cast("long").alias("flex"), w["low"].cast("long").alias("low"), w["high"].cast("double").alias("high"), tx.size_cm(F.col("t")).alias("cm"), tx.size_key(F.col("t")).alias("size_key"))


QUERIES = [
    family_pairs, family_orphans, family_protected, family_duplicates, family_proposals, family_reconciliation, offer_compatibility, offer_clusters, offer_classes, stale_offers,
    ledger_claims, ledger_outcomes, ledger_due, ledger_retained, sweep_status, lead_upsert, size_replacement, guarded_update, latest_orders, golden_cases, golden_invariants,
    page_hosts, page_text, name_slugs, season_labels, feed_numbers,
]


def decision_guide(s: SparkSession, d: str) -> DataFrame:
    riders, p, z = b.riders(s, d), b.products(s, d), b.sizes(s, d)
    found = rec.recommend(riders, p, z).where("list = 'recommended'")
    size = z.select("product_id", F.col("size_cm").alias("_c"), F.coalesce("size_label", F.lit("")).alias("_l"), "waist_width_mm", "width_type")
    more = p.select(F.col("id").alias("product_id"), F.col("slug").alias("_s"), "riding_style").join(size, "product_id")
    width = with_profile(riders).select("rider_id", F.col("width_type").alias("rider_width"))
    full = found.join(more, (F.col("slug") == F.col("_s")) & (F.col("size_cm") == F.col("_c")) & (F.col("size_label") == F.col("_l"))).join(width, "rider_id")
    return decisions.decision_guide(full)


def report_warnings(s: SparkSession, d: str) -> DataFrame:
    e = b.events(s, d)
    return digest.warnings(ev.history(e, b.NOW), ev.funnel(e, b.NOW), ev.commerce(e, b.NOW), ev.top_items(e, b.NOW))


def store_links(s: SparkSession, d: str) -> DataFrame:
    p = b.products(s, d)
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://www.traektoria.ru/product/"), k.cast("string"), F.lit("_x"))).otherwise(F.col("affiliate_url"))
    to = links.destination(url, k % 7 == 0)
    href = links.redirect_href(F.col("slug"), source=F.when(k % 2 == 0, "catalog"), placement=F.when(k % 5 == 0, "top card"), size_label=F.concat((k % 20 + 140).cast("string"), F.lit("W")))
    return p.select("slug", to["mode"].alias("mode"), to["merchant"].alias("merchant"), links.store_url(url, F.col("brand"), F.lit("Pro 2024 snowboard x&y")).alias("url"), href.alias("href"), links.redirect_slug(href).alias("back"))


def size_tables(s: SparkSession, d: str) -> DataFrame:
    """Tables of both orientations made from product keys."""
    k = F.col("p_partkey")
    cell = lambda *xs: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in xs], F.lit("</tr>"))
    n = lambda x: x.cast("string")
    a, c = n(F.lit(140) + k % 20), n(F.lit(150) + k % 20)
    wide, narrow = n(F.lit(24) + k % 3), F.concat(n(F.lit(250) + k % 30), F.lit(" мм"))
    by_row = F.concat(cell(F.lit("Размер, см"), F.lit("Ширина талии"), F.lit("Вес райдера")), cell(a, wide, F.lit("50-70")), cell(c, narrow, F.lit("65+")), cell(F.lit("?"), F.lit("1"), F.lit("")))
    by_column = F.concat(cell(F.lit(""), a, c), cell(F.lit("<b>ширина&nbsp;талии</b>"), wide, narrow))
    pages = b.dealt(s, d, "part", "p_partkey").select("p_partkey", F.concat(F.lit("<table>"), F.when(k % 2 == 0, by_row).otherwise(by_column), F.lit("</table>")).alias("html"))
    return feeds.size_rows(pages, "p_partkey", "html").withColumn("recommended_weight_max", F.col("recommended_weight_max").cast("double"))


def table_checksum(s: SparkSession, d: str) -> DataFrame:
    return digest.checksum(b.table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey").select("rows")


def table_digest(s: SparkSession, d: str) -> DataFrame:
    """Rows and md5 over all columns."""
    return digest.checksum(b.table(s, d, "supplier"), "s_suppkey")


QUERIES += [decision_guide, report_warnings, store_links, size_tables, table_checksum, table_digest]


def offer_authorization(s: SparkSession, d: str) -> DataFrame:
    """Imported offers against stored ones of which every fifth has changed hands."""
    tables = Rounds(s, "authorization")
    i = _identities(tables, d)
    c = identity.clusters(i).select(F.col("id").alias("_id"), "cluster")
    members = i.join(c.hint("merge"), F.col("id") == F.col("_id")).withColumn("assigned", F.concat("base_slug", F.when(F.col("cluster") > 0, F.concat(F.lit("-"), F.col("cluster").cast("string"))).otherwise("")))
    members = tables.put(members, "members")
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    stored = members.where(k % 4 != 1).withColumn("n_model", F.when(k % 5 == 0, "another").otherwise(F.col("n_model"))).withColumn("slug", F.col("assigned")).withColumn("manual", k % 10 == 0)
    least = stored.groupBy("slug").agg(F.min("id").alias("_least"))
    stored = tables.put(stored.join(least.drop("slug").hint("merge"), F.col("id") == F.col("_least"), "left_semi"), "stored")
    return authorization.authorize(members, stored).select("base_slug", "decision", F.array_join("reasons", ",").alias("reasons"))


QUERIES += [offer_authorization]
