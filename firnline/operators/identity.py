"""Resolving store offers to products: identities, compatibility, clusters, staleness."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.functions.order import dictionary
from firnline.functions.text import blank_to_null, identity_text, let, season_text, slug

LINES = ["men", "women", "unisex"]
#: Hosts of the managed stores and where their product ids stand in a path.
STORES = {"traektoria": (["traektoria.ru", "www.traektoria.ru"], r"/product/(\d+)_"), "trial-sport": (["trial-sport.ru", "www.trial-sport.ru"], r"/goods/\d+/(\d+)\.html$")}
EDGE_L, EDGE_R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def store_identity(url: Column) -> Column:
    """Struct of store_code and source_product_id."""

    def read(u: Column) -> Column:
        host, path = F.lower(F.try_parse_url(u, F.lit("HOST"))), F.try_parse_url(u, F.lit("PATH"))
        code, pid = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, (hosts, pattern) in STORES.items():
            code = F.when(host.isin(hosts), name).otherwise(code)
            pid = F.when(host.isin(hosts), F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))).otherwise(pid)
        return F.struct(code.alias("store_code"), pid.alias("source_product_id"))

    return let(blank_to_null(url), read)


def line_evidence(text: Column) -> Column:
    """Struct of board_line and evidence (known or missing); women's words are looked for first."""
    t = identity_text(text)
    words = lambda *w: f"{EDGE_L}(?:{'|'.join(w)}){EDGE_R}"
    women, men = t.rlike("жен|women|female"), t.rlike("муж|" + words("mens?", "male"))
    both = t.rlike("унисекс|мальчик|малыш|дет|" + words("unisex", "kids?", "junior", "youth"))
    return F.struct(F.when(women, "women").when(men, "men").otherwise("unisex").alias("board_line"), F.when(women | men | both, "known").otherwise("missing").alias("evidence"))


def variant_marker(model: Column) -> Column:
    t = identity_text(model)
    return F.when(t.rlike(r"(^| )mid wide$"), "mid-wide").when(t.rlike(r"(^| )wide(?: snowboard)?$"), "wide")


def offer_identities(offers: DataFrame) -> DataFrame:
    """Offers with store_code, source_product_id, source_key, base_slug, n_brand, n_model, line_evidence, season and variant.

    A men's or women's line counts as known; a missing slug is made from brand and model.
    """
    ident = store_identity(F.coalesce(blank_to_null(F.col("affiliate_url")), F.col("source_url")))
    out = offers.withColumn("_i", ident).withColumns({"store_code": F.col("_i.store_code"), "source_product_id": F.col("_i.source_product_id")}).drop("_i")
    line = F.when(F.col("board_line").isin(LINES), F.col("board_line")).otherwise("unisex")
    return out.withColumns(
        {
            "source_key": F.when(F.col("store_code").isNotNull() & F.col("source_product_id").isNotNull(), F.concat_ws("|", "store_code", "source_product_id")),
            "base_slug": F.coalesce(blank_to_null(F.col("slug")), slug(F.concat_ws(" ", "brand", "model_name"))),
            "n_brand": identity_text(F.col("brand")),
            "n_model": identity_text(F.col("model_name")),
            "board_line": line,
            "line_evidence": F.when(line.isin("men", "women"), "known").otherwise("missing"),
            "season": season_text(F.col("season_label")),
            "variant": variant_marker(F.col("model_name")),
        }
    )


def incompatibilities(left: str, right: str) -> Column:
    """Why two offers cannot be one product; empty if they can."""
    a, b = lambda c: F.col(f"{left}.{c}"), lambda c: F.col(f"{right}.{c}")
    other = lambda c: a(c).isNotNull() & b(c).isNotNull() & (a(c) != b(c))
    known = (a("line_evidence") == "known") & (b("line_evidence") == "known")
    lines = known & (a("board_line") != b("board_line"))
    return F.array_compact(
        F.array(
            F.when((a("n_brand") != b("n_brand")) | (a("n_model") != b("n_model")), "name"),
            F.when((a("store_code") == b("store_code")) & other("source_product_id"), "store id"),
            F.when(lines, "line").when(~known & ~a("source_key").eqNullSafe(b("source_key")), "line unknown"),
            F.when(other("season"), "season"),
            F.when(~a("variant").eqNullSafe(b("variant")), "variant"),
        )
    )


def pair_compatibility(identities: DataFrame) -> DataFrame:
    """left, right and reasons of the pairs of offers that share a base slug (few by nature)."""
    pairs = identities.alias("l").join(identities.alias("r"), (F.col("l.base_slug") == F.col("r.base_slug")) & (F.col("l.id") < F.col("r.id")))
    return pairs.select(F.col("l.base_slug").alias("base_slug"), F.col("l.id").alias("left"), F.col("r.id").alias("right"), incompatibilities("l", "r").alias("reasons"))


FIELDS = ["store_code", "source_product_id", "source_key", "n_brand", "n_model", "board_line", "line_evidence", "season", "variant"]


def _fits(a: dict, b: dict) -> bool:
    known = a["line_evidence"] == b["line_evidence"] == "known"
    apart = (
        (a["n_brand"], a["n_model"]) != (b["n_brand"], b["n_model"])
        or (a["store_code"] and a["store_code"] == b["store_code"] and a["source_product_id"] and b["source_product_id"] and a["source_product_id"] != b["source_product_id"])
        or (known and a["board_line"] != b["board_line"])
        or (not known and a["source_key"] != b["source_key"])
        or (a["season"] and b["season"] and a["season"] != b["season"])
        or a["variant"] != b["variant"]
    )
    return not apart


def clusters(identities: DataFrame) -> DataFrame:
    """id, base_slug, cluster (number in the slug), clusters: each offer joins the first cluster that it fits as a whole.

    Offers go by store, number, line, season and variant in dictionary order, then by id. Offers of one identity always
    meet in one cluster, so only distinct identities are compared; and as names and variants of a cluster are the same,
    those are compared within one slug, name and variant, one such group after the other.
    """
    own = F.md5(F.to_json(F.struct(*FIELDS)))
    label = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("store_code", "source_product_id", "board_line", "season", "variant")])
    marked = identities.withColumn("_i", own)
    kinds = marked.groupBy("base_slug", "_i", *FIELDS).agg(F.min("id").alias("_least"))
    ranked = kinds.withColumn("place", F.row_number().over(Window.partitionBy("base_slug").orderBy(dictionary(label), "_least")))

    names = ["base_slug", "n_brand", "n_model", "variant"]

    def run(frames):
        key, found = None, []
        for pdf in frames:
            out = []
            for r in ({k: (None if v is None or v != v else v) for k, v in r.items()} for r in pdf.to_dict("records")):
                if key != (now := tuple(r[n] for n in names)):
                    key, found = now, []
                k = next((i for i, c in enumerate(found) if all(_fits(m, r) for m in c)), len(found))
                if k == len(found):
                    found.append([])
                found[k].append(r)
                out.append((r["base_slug"], r["_i"], found[k][0]["place"]))
            if out:
                yield pd.DataFrame(out, columns=["base_slug", "_i", "lead"])

    # sorted rows of many slugs go through one Python call; only the group at hand is held
    led = ranked.select("base_slug", "_i", "place", *FIELDS).repartition(*names).sortWithinPartitions(*names, "place").mapInPandas(run, "base_slug string, _i string, lead int")
    number = F.dense_rank().over(Window.partitionBy("base_slug").orderBy("lead")) - 1
    numbered = led.withColumn("cluster", number).withColumn("clusters", F.max("cluster").over(Window.partitionBy("base_slug")) + 1)
    return marked.select("id", "base_slug", "_i").join(numbered.drop("lead").hint("merge"), ["base_slug", "_i"]).select("id", "base_slug", F.col("cluster").cast("int").alias("cluster"), F.col("clusters").cast("int").alias("clusters"))


def group_classes(identities: DataFrame, clustered: DataFrame) -> DataFrame:
    """base_slug and class of each group of offers."""
    g = identities.groupBy("base_slug").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("season").alias("seasons"),
        F.countDistinct(F.when(F.col("line_evidence") == "known", F.col("board_line"))).alias("lines"),
        (F.countDistinct("variant") + F.max(F.col("variant").isNull().cast("int"))).alias("variants"),
    )
    ids = identities.where("store_code is not null and source_product_id is not null").groupBy("base_slug", "store_code").agg(F.countDistinct("source_product_id").alias("k")).groupBy("base_slug").agg(F.max("k").alias("ids"))
    per = clustered.groupBy("base_slug").agg(F.max("clusters").alias("clusters"))
    hard = (F.col("lines") > 1) | (F.col("variants") > 1)
    kind = (
        F.when(F.col("n") <= 1, "NO_CONFLICT")
        .when(F.col("clusters") == 1, "SAFE_SAME_PRODUCT_MULTI_SOURCE")
        .when((F.col("seasons") > 1) & ~hard, "POTENTIAL_IDENTITY_COLLISION")
        .when(hard | (F.coalesce("ids", F.lit(0)) > 1), "CONFIRMED_IDENTITY_COLLISION")
        .otherwise("POTENTIAL_IDENTITY_COLLISION")
    )
    return g.join(per.hint("merge"), "base_slug").join(ids.hint("merge"), "base_slug", "left").select("base_slug", F.col("n").alias("offers"), F.col("clusters").cast("long").alias("clusters"), kind.alias("class"))


def unanimous(c: str) -> Column:
    """A group's value of a column if all its rows have that one (a null breaks it)."""
    return F.when((F.countDistinct(c) == 1) & (F.count(c) == F.count(F.lit(1))), F.min(c))


def completeness(sizes: Column, shape: Column, flex: Column, active: Column) -> Column:
    known = F.size(F.filter(sizes, lambda s: (s["recommended_weight_min"] > 0) | s["recommended_weight_max"].isNotNull()))
    return F.size(sizes) * 10 + known * 8 + F.when(F.length(shape) > 0, 4).otherwise(0) + F.when(flex != 0, 3).otherwise(0) + F.when(active, 3).otherwise(0)


def stale_decisions(existing: DataFrame, resolved: DataFrame, observed: DataFrame, checked: DataFrame) -> DataFrame:
    """slug and decision (stale, keep, block or revalidate) of active stored products that an import did not resolve.

    ``observed`` has store_code, source_product_id, availability, status, reason; ``checked`` slug and status.
    """
    live = lambda df: df.withColumn("_i", store_identity(F.col("affiliate_url"))).select("slug", F.col("_i.store_code").alias("store"), F.col("_i.source_product_id").alias("pid"))
    e = live(existing.where(F.coalesce("is_active", F.lit(True)))).join(resolved.select(F.col("slug").alias("_r")), F.col("slug") == F.col("_r"), "left_anti")
    again = live(resolved).where("pid is not null").select(F.col("store").alias("_s1"), F.col("pid").alias("_p1")).distinct()
    safe = observed.where("status = 'safe_unimportable'")
    a = safe.where("store_code = 'traektoria' and reason = 'size_table_missing' and availability in ('available', 'unavailable')")
    b = safe.where("store_code = 'trial-sport' and reason in ('spec_missing', 'spec_group_missing') and availability = 'available'")
    seen = a.unionByName(b).groupBy(F.col("store_code").alias("_s2"), F.trim("source_product_id").alias("_p2")).agg(F.max("availability").alias("seen"))
    out = e.join(again, (F.col("store") == F.col("_s1")) & (F.col("pid") == F.col("_p1")), "left").join(seen, (F.col("store") == F.col("_s2")) & (F.col("pid") == F.col("_p2")), "left")
    out = out.join(checked.select(F.col("slug").alias("_c"), F.col("status").alias("checked")), F.col("slug") == F.col("_c"), "left")
    decision = F.when(F.col("store").isNull(), "stale").when(F.col("_p1").isNotNull(), "stale").when(F.col("seen") == "available", "keep").when(F.col("seen") == "unavailable", "stale").when(F.col("checked") == "unavailable", "stale").when(F.col("checked") == "available", "keep").when(F.col("checked") == "unknown", "block").otherwise("revalidate")
    return out.select("slug", F.coalesce("store", F.lit("none")).alias("store"), decision.alias("decision"))
