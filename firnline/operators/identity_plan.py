"""The plan that turns imported offers into products: clusters, their slugs, what each merges to, and an audit of it all.

Clusters come from ``identity.clusters``. Stored offers meet them by source key. Slugs are given by rounds: every cluster
asks for the first name on its list that it was not refused, and of those that ask for a name the first by base slug and
number has it; a round without refusals is the last. This gives the names that clusters served one by one would take,
while a round is a few joins over all clusters. What a round leaves open is a table, so plans do not grow.

Joins say ``merge``: all tables here grow with the offers, and Spark would send small-looking ones to every task through
the driver.

A cluster's offers are merged in their order, each with what the ones before it came to: one gives its description,
another sells. A plan is tables, and its hash one checksum over their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.functions.order import dictionary
from firnline.functions.text import blank_to_null, season_rank
from firnline.operators.digest import checksum
from firnline.operators.identity import clusters as clustered
from firnline.operators.identity import completeness, group_classes, offer_identities, unanimous
from firnline.sources.rounds import Rounds

CLUSTER = ["base_slug", "cluster"]


def cluster_identities(members: DataFrame) -> DataFrame:
    """base_slug, cluster, line, variant, season (each only if all members have it) and tokens (store and id of the members)."""
    token = F.when(F.col("store_code").isNotNull() & F.col("source_product_id").isNotNull(), F.concat_ws("-", "store_code", "source_product_id"))
    known = F.bool_and(F.col("line_evidence") == "known") if "line_evidence" in members.columns else F.lit(True)
    return members.groupBy(*CLUSTER).agg(F.when(known, unanimous("board_line")).alias("line"), unanimous("variant").alias("variant"), unanimous("season").alias("season"), F.array_sort(F.collect_set(token)).alias("tokens"))


def stored_matches(members: DataFrame, stored: DataFrame) -> DataFrame:
    """slug, base_slug, cluster: stored offers (slug, source_key, board_line, season, variant) that a cluster continues."""
    m, s = members.alias("m"), stored.alias("s")
    apart = F.coalesce(F.col("m.season") != F.col("s.season"), F.lit(False))
    same = (F.col("m.source_key") == F.col("s.source_key")) & F.col("m.board_line").eqNullSafe(F.col("s.board_line")) & F.col("m.variant").eqNullSafe(F.col("s.variant")) & ~apart
    return m.join(s.hint("merge"), same).select("s.slug", "m.base_slug", "m.cluster").distinct()


def base_choices(clusters: DataFrame, matches: DataFrame, stored: DataFrame, official: DataFrame) -> DataFrame:
    """base_slug, base (number of the cluster that keeps it, null if none may), why, and the stored owner's line, variant and season.

    A stored owner of the base slug decides; without one the official line (slug, board_line), if one cluster has it; or
    else the first cluster.
    """
    owners = stored.groupBy(F.col("slug").alias("_o")).agg(F.count(F.lit(1)).alias("owners"), F.max("source_key").alias("key"), F.max("board_line").alias("o_line"), F.max("variant").alias("o_variant"), F.max("season").alias("o_season"))
    continuing = matches.where("slug = base_slug").groupBy(F.col("base_slug").alias("_c")).agg(F.count(F.lit(1)).alias("n"), F.min("cluster").alias("which"))
    wanted = official.where("board_line is not null").select(F.col("slug").alias("_w"), F.col("board_line").alias("w_line"))
    lines = clusters.join(wanted.hint("merge"), F.col("base_slug") == F.col("_w")).where("line = w_line").groupBy(F.col("base_slug").alias("_l")).agg(F.count(F.lit(1)).alias("of_line"), F.min("cluster").alias("line_cluster"))
    j = clusters.select("base_slug").distinct()
    for other, key in ((owners, "_o"), (continuing, "_c"), (lines, "_l")):
        j = j.join(other.hint("merge"), F.col("base_slug") == F.col(key), "left")
    owned, one = F.col("owners").isNotNull(), (F.col("owners") == 1) & F.col("key").isNotNull() & (F.col("n") == 1)
    by_line = F.col("of_line") == 1
    base = F.when(owned, F.when(one, F.col("which"))).when(by_line, F.col("line_cluster")).otherwise(0)
    why = F.when(owned, F.when(one, "coherent-existing-base").otherwise("historical-base-reserved")).when(by_line, "official-spec-board-line").otherwise("deterministic-source-order")
    issue = F.when(F.col("owners") > 1, "multiple_owners").when(owned & F.col("key").isNull(), "owner_without_identity").when(owned & (F.col("n") > 1), "multiple_clusters")
    own = lambda c: F.when(F.col("owners") == 1, F.col(c)).alias(c)
    return j.select("base_slug", base.cast("int").alias("base"), why.alias("why"), issue.alias("issue"), own("o_line"), own("o_variant"), own("o_season"))


def _names(clusters: DataFrame, choices: DataFrame, matches: DataFrame, stored: DataFrame) -> DataFrame:
    """base_slug, cluster, place, slug, reason: the names that a cluster may have, in order; none for one that continues several."""
    prior = matches.where("slug <> base_slug").groupBy(*CLUSTER).agg(F.array_sort(F.collect_set("slug")).alias("prior"))
    base = clusters.select("base_slug", F.col("cluster").alias("_n"), F.col("line").alias("b_line"), F.col("variant").alias("b_variant"), F.col("season").alias("b_season"))
    same_line = clusters.where("line is not null").groupBy(F.col("base_slug").alias("_s"), F.col("line").alias("_line")).agg(F.count(F.lit(1)).alias("same_line"))
    j = clusters.join(choices.hint("merge"), "base_slug").join(base.hint("merge"), "base_slug", "left").where(F.coalesce("base", F.lit(0)) == F.col("_n")).join(prior.hint("merge"), CLUSTER, "left")
    j = j.join(same_line.hint("merge"), (F.col("base_slug") == F.col("_s")) & (F.col("line") == F.col("_line")), "left")
    against = lambda c: F.when(F.col("base").isNull(), F.col(f"o_{c}")).otherwise(F.col(f"b_{c}"))
    other = lambda c: F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(against(c)), F.col(c))
    endings = F.concat(F.array(F.when(F.col("same_line") == 1, other("line")), other("variant"), other("season")), F.col("tokens"))
    tokens = F.array_distinct(F.filter(F.transform(F.array_compact(endings), lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-|-$", "")), lambda x: F.length(x) > 0))
    name = lambda slug, reason: F.struct(slug.alias("slug"), reason.alias("reason"))
    n = F.coalesce(F.size("prior"), F.lit(0))
    old = F.when(n == 1, F.array(name(F.col("prior")[0], F.lit("stable-existing-source-slug")))).otherwise(F.array().cast("array<struct<slug:string,reason:string>>"))
    rest = F.when(F.col("cluster").eqNullSafe(F.col("base")), F.array(name(F.col("base_slug"), F.lit("base-source-offer")))).otherwise(F.transform(tokens, lambda x: name(F.concat_ws("-", "base_slug", x), F.concat(F.lit("collision-suffix:"), x))))
    listed = j.where(n <= 1).select(*CLUSTER, F.posexplode(F.concat(old, rest)).alias("place", "x")).select(*CLUSTER, "place", "x.*")
    foreign = stored.select(F.col("slug").alias("_f")).distinct()
    mine = matches.select(F.col("slug").alias("_m"), F.col("base_slug").alias("_b"), F.col("cluster").alias("_c"))
    kept = listed.join(foreign.hint("merge"), F.col("slug") == F.col("_f"), "left").join(mine.hint("merge"), (F.col("slug") == F.col("_m")) & (F.col("base_slug") == F.col("_b")) & (F.col("cluster") == F.col("_c")), "left")
    reserved = choices.where("base is null").select(F.col("base_slug").alias("_r"))
    free = ~F.startswith("reason", F.lit("collision")) | F.col("_f").isNull() | F.col("_m").isNotNull()
    # a base that nobody continues is taken from its group's turn on; groups go by base slug
    return kept.where(free).join(reserved.hint("merge"), (F.col("slug") == F.col("_r")) & (F.col("_r") <= F.col("base_slug")), "left_anti").select(*CLUSTER, "place", "slug", "reason")


def slug_plan(members: DataFrame, stored: DataFrame, official: DataFrame) -> DataFrame:
    """base_slug, cluster, slug and reason of every cluster; the slug is null, with what blocks it, where none is safe."""
    tables = Rounds(members.sparkSession, "slugs")
    clusters, matches = tables.put(cluster_identities(members), "clusters"), tables.put(stored_matches(members, stored), "matches")
    choices = tables.put(base_choices(clusters, matches, stored, official), "choices")
    left, at = tables.put(_names(clusters, choices, matches, stored), "names0"), 0
    while True:
        asked = tables.put(left.groupBy(*CLUSTER).agg(F.min(F.struct("place", "slug", "reason")).alias("x")).select(*CLUSTER, "x.slug", "x.reason"), f"asked{at}")
        first = asked.groupBy(F.col("slug").alias("_s")).agg(F.min(F.struct(*CLUSTER)).alias("w"))
        lost = tables.put(asked.join(first.hint("merge"), F.col("slug") == F.col("_s")).where(F.struct(*CLUSTER) != F.col("w")).select(*CLUSTER, "slug"), f"lost{at}")
        if lost.isEmpty():
            break
        left = tables.put(left.join(lost.hint("merge"), [*CLUSTER, "slug"], "left_anti"), f"names{at + 1}")
        tables.drop(f"names{at}", f"asked{at}", f"lost{at}")
        at += 1
    several = matches.where("slug <> base_slug").groupBy(*CLUSTER).agg(F.countDistinct("slug").alias("n")).where("n > 1").select(*CLUSTER, F.lit(True).alias("several"))
    why = F.coalesce("reason", F.when(F.col("several"), "blocking-existing-identity-duplication").otherwise("blocking-no-safe-slug"))
    return clusters.select(*CLUSTER).join(asked.hint("merge"), CLUSTER, "left").join(several.hint("merge"), CLUSTER, "left").select(*CLUSTER, "slug", why.alias("reason"))


def _media(image: Column, gallery: Column) -> Column:
    every = F.concat(F.array(image), F.coalesce(gallery, F.array().cast("array<string>")))
    return F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def _score(describes: Column, sells: Column) -> Column:
    return sells["of_sizes"] + describes["of_shape"] + sells["of_activity"]


def _sells_before(a: Column, b: Column, a_score: Column, b_score: Column) -> Column:
    """Whether a is the better seller: active, then priced, cheaper, more complete, and by store and number; a where all are equal."""
    key = lambda x, score: F.struct((~x["is_active"]).alias("i"), (~x["priced"]).alias("u"), F.when(x["priced"], x["price_from"]).otherwise(0).alias("p"), (-score).alias("s"), x["place"].alias("t"))
    return key(a, a_score) <= key(b, b_score)


def merged_offers(offers: DataFrame, by: list[str]) -> DataFrame:
    """One product of each group's offers: ``by``, base, seller, n_offers, n_sizes, season_label, price_from, affiliate_url, is_active, image_url, gallery_images.

    ``offers`` has id, place (their order in the group), season_label, price_from, affiliate_url, is_active, image_url,
    gallery_images, shape_type, flex, store_code, source_product_id and sizes (an array with recommended_weight_min and
    recommended_weight_max). The product so far and the next offer are compared: the newer season describes, or else the
    more complete one; the better seller gives price, link, sizes and activity; pictures are those of the one that
    describes, then the other's unless the seasons differ, each once. The result depends on the order, as it should.
    Rows equal in all columns count once. A group's offers meet in one array: those of one product, one store each.
    """
    active, sizes = F.coalesce("is_active", F.lit(False)), F.coalesce(F.col("sizes"), F.array().cast(offers.schema["sizes"].dataType))
    one = F.struct(
        F.col("place"),
        F.col("id"),
        F.col("season_label").alias("season"),
        season_rank(F.col("season_label")).alias("rank"),
        _media(F.col("image_url"), F.col("gallery_images")).alias("media"),
        F.struct("id", (F.when(F.length("shape_type") > 0, 4).otherwise(0) + F.when(F.coalesce(F.col("flex"), F.lit(0)) != 0, 3).otherwise(0)).alias("of_shape"), "image_url", "gallery_images").alias("describes"),
        F.struct(
            "id", active.alias("is_active"), F.coalesce(F.col("price_from") > 0, F.lit(False)).alias("priced"), "price_from", "affiliate_url", F.size(sizes).alias("n_sizes"),
            (completeness(sizes, F.lit(""), F.lit(0), F.lit(False))).alias("of_sizes"), F.when(active, 3).otherwise(0).alias("of_activity"), F.col("tie").alias("place"),
        ).alias("sells"),
    )
    tie = F.dense_rank().over(Window.partitionBy(*by).orderBy(dictionary(F.concat_ws("|", F.coalesce("store_code", F.lit("")), F.coalesce("source_product_id", F.lit(""))))))
    nested = offers.distinct().withColumn("tie", tie).groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("offers"))
    start = F.get("offers", F.lit(0))

    def step(acc: Column, r: Column) -> Column:
        left, right = _score(acc["describes"], acc["sells"]), _score(r["describes"], r["sells"])
        apart = F.coalesce(acc["rank"] != r["rank"], F.lit(False))
        newer = F.when(apart, r["rank"] > acc["rank"]).otherwise(right > left)
        pick = lambda f: F.when(newer, f(r)).otherwise(f(acc))
        other = lambda f: F.when(newer, f(acc)).otherwise(f(r))
        text = lambda x: blank_to_null(x["season"])
        season, rank = F.coalesce(pick(text), other(text)), F.when(pick(text).isNotNull(), pick(lambda x: x["rank"])).otherwise(other(lambda x: x["rank"]))
        more = F.when(apart, F.array().cast("array<string>")).otherwise(other(lambda x: x["media"]))
        keeps = _sells_before(acc["sells"], r["sells"], left, right)
        return F.struct(
            acc["place"].alias("place"), acc["id"].alias("id"), season.alias("season"), rank.alias("rank"), F.array_distinct(F.concat(pick(lambda x: x["media"]), more)).alias("media"),
            pick(lambda x: x["describes"]).alias("describes"), F.when(keeps, acc["sells"]).otherwise(r["sells"]).alias("sells"),
        )

    whole = nested.withColumn("x", F.aggregate(F.slice("offers", F.lit(2), F.size("offers")), start, step))
    n, x = F.size("offers"), lambda c: F.col(f"x.{c}")
    merged = n > 1  # a product of one offer keeps its pictures as they are
    return whole.select(
        *by, x("describes.id").alias("base"), x("sells.id").alias("seller"), n.cast("long").alias("n_offers"), x("sells.n_sizes").cast("long").alias("n_sizes"), x("season").alias("season_label"),
        x("sells.price_from").alias("price_from"), x("sells.affiliate_url").alias("affiliate_url"), x("sells.is_active").alias("is_active"),
        F.when(merged, F.coalesce(F.get("x.media", F.lit(0)), x("describes.image_url"))).otherwise(x("describes.image_url")).alias("image_url"),
        F.when(merged, F.slice("x.media", F.lit(2), F.size("x.media"))).otherwise(x("describes.gallery_images")).alias("gallery_images"),
    )


def _with_sizes(offers: DataFrame, sizes: DataFrame, ref: str) -> DataFrame:
    """Offers with the array of the sizes of the product that ``ref`` names, by length and label."""
    one = F.struct("size_cm", F.coalesce("size_label", F.col("size_cm").cast("string")).alias("size_label"), "recommended_weight_min", "recommended_weight_max", F.coalesce("is_available", F.lit(True)).alias("is_available"))
    nested = sizes.groupBy(F.col("product_id").alias("_p")).agg(F.array_sort(F.collect_list(one)).alias("sizes"))
    return offers.join(nested.hint("merge"), F.col(ref) == F.col("_p"), "left").drop("_p")


class Plan:
    """The plan's tables: assignments (a product for each cluster with a slug), groups (by base slug), issues (what blocks), members."""

    def __init__(self, assignments: DataFrame, groups: DataFrame, issues: DataFrame, members: DataFrame):
        self.assignments, self.groups, self.issues, self.members = assignments, groups, issues, members

    def hash(self) -> DataFrame:
        """rows and md5 over assignments, groups and issues: plans of equal inputs have equal ones, in whatever order these come."""
        rows = [df.select(F.lit(name).alias("part"), F.to_json(F.struct(*sorted(df.columns))).alias("row")) for name, df in (("assignment", self.assignments), ("group", self.groups), ("issue", self.issues))]
        return checksum(rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("key", F.concat_ws("|", "part", F.md5("row"))), "key")


def _needs_repair(members: DataFrame, slugs: DataFrame, stored: DataFrame) -> DataFrame:
    """base_slug and needs_repair: whether a slug of the group has no stored product, or one that its own offer no longer describes."""
    seen = lambda c: F.transform(c, lambda z: F.struct(z["size_label"], z["size_cm"], z["is_available"]))
    same = ["board_line", "season", "variant", "affiliate_url"]
    mine = members.select(*CLUSTER, F.col("source_key").alias("_key"), *[F.col(c).alias(f"_m_{c}") for c in same], seen(F.col("sizes")).alias("_m_sizes"))
    now = stored.select(F.col("slug").alias("_slug"), F.col("source_key").alias("_own"), *[F.col(c).alias(f"_s_{c}") for c in same], seen(F.col("sizes")).alias("_s_sizes"))
    fits = F.col("_m_sizes").eqNullSafe(F.col("_s_sizes"))
    for c in same:
        fits = fits & F.col(f"_m_{c}").eqNullSafe(F.col(f"_s_{c}"))
    met = slugs.where("slug is not null").join(now.hint("merge"), F.col("slug") == F.col("_slug"), "left").join(mine.hint("merge"), [*CLUSTER], "left")
    kept = met.groupBy(*CLUSTER).agg(F.bool_or(F.coalesce((F.col("_own") == F.col("_key")) & fits, F.lit(False))).alias("kept"))
    return kept.groupBy("base_slug").agg((~F.bool_and("kept")).alias("needs_repair"))


def identity_plan(offers: DataFrame, sizes: DataFrame, stored: DataFrame, official: DataFrame) -> Plan:
    """Imported offers to products, against the stored catalogue.

    ``offers`` are rows of ``identity.offer_identities`` with what ``merged_offers`` reads, but sizes, which come by id.
    ``stored`` has the same columns, slug and ref (the id by which its sizes are known); ``official`` slug and
    board_line. Offers without a store and a number of it are left out and named in the issues.
    """
    tables = Rounds(offers.sparkSession, "identity-plan")
    whole = tables.put(_with_sizes(offers, sizes, "id"), "offers")
    known = whole.where("source_key is not null")
    clusters = clustered(known).select(F.col("id").alias("_id"), F.col("base_slug").alias("_base"), "cluster", "clusters")
    members = tables.put(known.join(clusters.hint("merge"), (F.col("id") == F.col("_id")) & (F.col("base_slug") == F.col("_base"))).drop("_id", "_base"), "members")
    old = tables.put(_with_sizes(stored, sizes, "ref"), "stored")
    slugs = tables.put(slug_plan(members, old, official), "slugs")
    matches = stored_matches(members, old)
    choices = tables.put(base_choices(cluster_identities(members), matches, old, official), "choices")

    label = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("store_code", "source_product_id", "board_line", "season", "variant")])
    placed = members.withColumn("place", F.row_number().over(Window.partitionBy(*CLUSTER).orderBy(dictionary(label), "id")))
    fields = ["id", "place", "season_label", "price_from", "affiliate_url", "is_active", "image_url", "gallery_images", "shape_type", "flex", "store_code", "source_product_id", "sizes"]
    merged = merged_offers(placed.select(*CLUSTER, *fields), CLUSTER)
    ordered = F.array_sort(F.transform(F.collect_set("source_key"), lambda x: F.struct(dictionary(x).alias("o"), x.alias("k"))))
    keys = members.groupBy(*CLUSTER).agg(F.array_join(F.transform(ordered, lambda x: x["k"]), ",").alias("members"))
    why = choices.select("base_slug", F.col("base").alias("_base"), "why", "issue")
    reason = F.when(F.col("cluster").eqNullSafe(F.col("_base")), F.concat_ws(":", "reason", "why")).otherwise(F.col("reason"))
    assignments = slugs.where("slug is not null").join(why.hint("merge"), "base_slug").withColumn("reason", reason).drop("_base", "why", "issue").join(merged.hint("merge"), CLUSTER).join(keys.hint("merge"), CLUSTER)
    assignments = tables.put(assignments, "assignments")

    per = members.groupBy(*CLUSTER).agg(F.collect_set("board_line").alias("lines"))
    spec = official.select(F.col("slug").alias("base_slug"), F.col("board_line").alias("official_line")).distinct()
    applies = slugs.where("slug is not null").join(per.hint("merge"), CLUSTER).join(spec.hint("merge"), "base_slug")
    applies = applies.where(F.col("official_line").isNull() | (F.col("lines") == F.array("official_line"))).groupBy("base_slug").agg(F.array_join(F.array_sort(F.collect_list("slug")), ",").alias("official_slugs"))
    classes = group_classes(known, members)
    groups = classes.join(_needs_repair(members, slugs, old).hint("merge"), "base_slug", "left").join(spec.hint("merge"), "base_slug", "left").join(applies.hint("merge"), "base_slug", "left")
    groups = groups.select("base_slug", "class", "offers", "clusters", F.coalesce("needs_repair", F.lit(False)).alias("needs_repair"), "official_line", F.when(F.col("official_line").isNotNull(), F.coalesce("official_slugs", F.lit(""))).alias("official_slugs"))

    blocked = slugs.where("slug is null").select("base_slug", F.col("reason").alias("issue"))
    lost = whole.where("source_key is null").select(F.coalesce("base_slug", F.lit("")).alias("base_slug"), F.lit("missing-stable-source-identity").alias("issue"))
    issues = blocked.unionByName(lost).unionByName(why.where("issue is not null").select("base_slug", "issue")).distinct()
    return Plan(assignments, tables.put(groups, "groups"), tables.put(issues, "issues"), members)


def plan_operations(plan: Plan, stored: DataFrame) -> DataFrame:
    """slug, operation and class: what carrying the plan out would do.

    insert and update are slugs of groups in which names collide; inactivate are stored products of a managed store to
    which no cluster continues; rename is a stored product whose only offer would go on under another slug, which stops
    an audit.
    """
    a = plan.assignments.join(plan.groups.select("base_slug", "class").hint("merge"), "base_slug")
    known = stored.select(F.col("slug").alias("_s")).distinct()
    met = a.where("class <> 'NO_CONFLICT'").select("slug", "class").join(known.hint("merge"), F.col("slug") == F.col("_s"), "left")
    changes = met.select("slug", F.when(F.col("_s").isNull(), "insert").otherwise("update").alias("operation"), "class")
    gone = stored.where("store_code is not null").join(a.select(F.col("slug").alias("_a")).hint("merge"), F.col("slug") == F.col("_a"), "left_anti").select("slug", F.lit("inactivate").alias("operation"), F.lit(None).cast("string").alias("class")).distinct()
    single = a.where("class = 'NO_CONFLICT'").select(F.col("slug").alias("wanted"), F.col("members").alias("_key"), "class")
    same = stored.select(F.col("source_key").alias("_key"), F.col("slug").alias("have")).join(single.hint("merge"), "_key")
    renamed = same.groupBy("wanted", "class").agg(F.bool_or(F.col("have") == F.col("wanted")).alias("kept")).where("not kept").select(F.col("wanted").alias("slug"), F.lit("rename").alias("operation"), "class")
    return changes.unionByName(gone).unionByName(renamed)


def plan_signals(plan: Plan) -> DataFrame:
    """kind, value and n: groups by class, groups with a signal, and issues by kind."""
    m = plan.members.groupBy("base_slug").agg(
        F.countDistinct("board_line").alias("lines"), F.countDistinct("season").alias("seasons"),
        F.countDistinct(F.to_json(F.coalesce("sizes", F.array().cast(plan.members.schema["sizes"].dataType)))).alias("matrices"),
    )
    g = plan.groups.join(m.hint("merge"), "base_slug")
    several = F.col("official_slugs").isNotNull() & ((F.col("official_slugs") == "") | F.contains("official_slugs", F.lit(",")))
    signals = {
        "lines": F.col("lines") > 1, "shared_slug": (F.col("offers") > F.col("clusters")) | (F.col("clusters") > 1), "seasons": F.col("seasons") > 1, "sizes": F.col("matrices") > 1,
        "official_ambiguous": several, "unrepaired_collision": (F.col("class") == "CONFIRMED_IDENTITY_COLLISION") & F.col("needs_repair"),
    }
    each = F.array_compact(F.array(F.struct(F.lit("class").alias("kind"), F.col("class").alias("value")), *[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit("signal").alias("kind"), F.lit(name).alias("value"))) for name, when in signals.items()]))
    counted = g.select(F.explode(each).alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(plan.issues.groupBy(F.lit("issue").alias("kind"), F.col("issue").alias("value")).agg(F.count(F.lit(1)).alias("n")))


# The codes by which a gate refuses.
BLOCKED, REQUIRED, MISMATCH, STALE, MALFORMED, DIAGNOSTIC = (f"SOURCE_IDENTITY_{x}" for x in ("BLOCKED", "REVIEW_REQUIRED", "REVIEW_HASH_MISMATCH", "REVIEW_HASH_STALE", "REVIEW_HASH_MALFORMED", "DIAGNOSTIC_HASH_MISMATCH"))


def review_hash(decisions: DataFrame, plan: Plan) -> DataFrame:
    """hash (64 hexadecimal digits) of what a person has to look at: the groups to review and what the plan does with them."""
    wanted = decisions.where("decision = 'REVIEW'").select("base_slug", F.array_join(F.array_sort("reasons"), ",").alias("reasons"))
    seen = wanted.join(plan.assignments.hint("merge"), "base_slug", "left")
    rows = seen.select("base_slug", F.to_json(F.struct(*sorted(seen.columns))).alias("row"))
    return checksum(rows, "base_slug").select(F.sha2(F.coalesce("md5", F.lit("")), 256).alias("hash"))


def gate(decisions: DataFrame, plan: Plan, expected: str | None = None, expected_plan: str | None = None) -> str | None:
    """The code for which a plan may not be carried out, or None: blocked groups, a review that is missing, malformed, stale or of another plan."""
    expected = (expected or "").strip() or None
    if expected and not (len(expected) == 64 and all(c in "0123456789abcdef" for c in expected)):
        return MALFORMED
    counts = decisions.agg(F.count_if(F.col("decision") == "BLOCK").alias("blocks"), F.count_if(F.col("decision") == "REVIEW").alias("reviews")).first()
    if counts.blocks:
        return BLOCKED
    if counts.reviews and not expected:
        return REQUIRED
    if counts.reviews and expected != review_hash(decisions, plan).first().hash:
        return MISMATCH
    if expected and not counts.reviews:
        return STALE
    return DIAGNOSTIC if expected_plan and plan.hash().first().md5 != expected_plan else None
