"""Families against what the catalogue now says: a plan of actions, its next state, and runs that apply or undo it.

Candidates are the sure families of today's analysis: identity_key, slug, brand, model_name, season_label, members (array
of product_id, product_slug, role, reason) and the fields of ``FIELDS``. Families are stored: id, identity_key, slug,
brand, model_name, season_label, source_kind and the same fields. ``members`` are their memberships as stored
(family_id, product_id, product_slug, role, manual_override, match_method, confidence), products the catalogue (id, slug,
is_active, family_id, role, manual_override, match_method, confidence, reason, matched_at and whatever else).

Every family and every candidate comes to one decision by ordered rules over joined flags. Only changes that hold all
their guards are made, all of them or none.

Joins say ``merge``: candidates, families and products grow, and Spark guesses their sizes from compressed files and would
send them to every task through the driver.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.text import family_brand, family_model, family_season
from firnline.operators.changes import AUTOMATIC_CONFIDENCE, AUTOMATIC_RULE, FROM_MEMBER, METADATA
from firnline.operators.digest import checksum
from firnline.sources.rounds import Rounds
from firnline.sources.versions import Version, Versions

FIELDS = ["description_short", "description_full", *METADATA]
MEMBERSHIP = ["family_id", "role", "match_method", "confidence", "reason", "matched_at"]
# Why a membership was made.
MATCHED, REPLACED = "same name, season and make", "inactive base replaced by the current base of the same identity"


def _trimmed(x: Column) -> Column:
    return F.trim(F.coalesce(x.cast("string"), F.lit("")))


def _by_rule(p: str) -> Column:
    return (F.col(f"{p}.match_method") == AUTOMATIC_RULE) & (F.col(f"{p}.confidence") == AUTOMATIC_CONFIDENCE) & ~F.coalesce(F.col(f"{p}.manual_override"), F.lit(False))


def _yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _same_names(f: str, c: str) -> Column:
    """Whether brand, model and season agree once normalised, none of them empty."""
    same = F.length(F.trim(F.col(f"{f}.identity_key"))) > 0
    for name, read in (("brand", family_brand), ("model_name", family_model), ("season_label", family_season)):
        a, b = read(F.col(f"{f}.{name}")), read(F.col(f"{c}.{name}"))
        same = same & (a == b) & (F.length(a) > 0)
    return _yes(same)


def _other_fields(f: str, c: str) -> Column:
    """Names of the fields in which a family that takes them from its member is not like the candidate; else none."""
    each = F.array_compact(F.array(*[F.when(~F.col(f"{f}.{x}").eqNullSafe(F.col(f"{c}.{x}")), F.lit(x)) for x in FIELDS]))
    return F.when(_yes(F.col(f"{f}.source_kind") == FROM_MEMBER), each).otherwise(F.array().cast("array<string>"))


class Inputs(NamedTuple):
    candidates: DataFrame
    families: DataFrame
    members: DataFrame
    products: DataFrame


def _wanted(candidates: DataFrame) -> DataFrame:
    """identity_key, product_id, product_slug, role, reason: a row for each member of a candidate."""
    return candidates.select("identity_key", F.explode("members").alias("m")).select("identity_key", _trimmed(F.col("m.product_id")).alias("product_id"), "m.product_slug", "m.role", "m.reason")


def _claims(wanted: DataFrame) -> DataFrame:
    """product_id, claimed_by (the first candidate by key) and n, how often it is claimed."""
    return wanted.groupBy("product_id").agg(F.min("identity_key").alias("claimed_by"), F.count(F.lit(1)).alias("n"))


def _shape(pairs: Column) -> Column:
    return F.array_sort(F.transform(pairs, lambda m: F.concat_ws("|", m["role"], m["product_id"])))


def _family_flags(x: Inputs, claims: DataFrame) -> DataFrame:
    """What the rules ask of each family's members; families without members have no row."""
    p = x.products.select(_trimmed(F.col("id")).alias("_p"), F.col("is_active").alias("_active"))
    m = x.members.withColumn("product_id", _trimmed(F.col("product_id"))).join(p.hint("merge"), F.col("product_id") == F.col("_p"), "left").join(claims.select("product_id", "claimed_by").hint("merge"), "product_id", "left")
    one = F.struct("product_id", "product_slug", "role")
    manual = _yes(F.col("manual_override")) | _yes(F.col("match_method") == "manual")
    automatic = ~_yes(F.col("manual_override")) & _yes((F.col("match_method") == AUTOMATIC_RULE) & (F.col("confidence") == AUTOMATIC_CONFIDENCE))
    of = lambda role, c: F.min(F.when(F.col("role") == role, F.col(c)))
    return m.groupBy(F.col("family_id").alias("_f")).agg(
        F.count(F.lit(1)).alias("n_members"), F.bool_or(manual).alias("any_manual"), F.bool_and(automatic).alias("all_automatic"), F.array_sort(F.collect_list(F.coalesce("role", F.lit("")))).alias("roles"),
        F.min(F.when(F.col("_p").isNull(), F.col("product_id"))).alias("missing"), F.bool_or(_yes(~F.col("_active"))).alias("any_inactive"),
        F.array_join(F.array_sort(F.collect_set(F.when(_yes(~F.col("_active")), F.col("product_id")))), ",").alias("inactive"), F.array_sort(F.collect_set("claimed_by")).alias("claimed"),
        _shape(F.collect_list(one)).alias("shape"), of("base", "product_id").alias("base_id"), of("base", "product_slug").alias("base_slug"), of("wide", "product_id").alias("wide_id"), of("wide", "product_slug").alias("wide_slug"),
    )


def decisions(x: Inputs) -> DataFrame:
    """bucket, code, family_id, identity_key, detail and what the bucket needs to act: one row for each family and each open candidate.

    Memberships of a family meet in one group: families are of two products; one that is not is a conflict. A candidate
    whose key or products a family has is decided with that family. Products that several candidates claim are conflicts.
    """
    wanted = _wanted(x.candidates)
    claims = _claims(wanted)
    flags = _family_flags(x, claims)
    sides = wanted.groupBy(F.col("identity_key").alias("_k")).agg(
        F.count(F.lit(1)).alias("c_n"), _shape(F.collect_list(F.struct("product_id", "role"))).alias("c_shape"),
        *[F.min(F.when(F.col("role") == role, F.col(c))).alias(f"c_{role}_{c[8:]}") for role in ("base", "wide") for c in ("product_id", "product_slug")],
    )
    cand = x.candidates.join(sides.hint("merge"), F.col("identity_key") == F.col("_k"), "left").drop("_k")
    product = lambda a: x.products.select(F.struct(_trimmed(F.col("id")).alias("id"), *[c for c in ("slug", "is_active", "family_id", "role", "manual_override", "match_method", "confidence")]).alias(a))
    slugs = x.families.groupBy(F.col("slug").alias("_slug")).agg(F.count(F.lit(1)).alias("owners"), F.min("id").alias("owner"))

    j = x.families.alias("f").join(flags.hint("merge"), F.col("f.id") == F.col("_f"), "left").join(cand.alias("c").hint("merge"), F.col("f.identity_key") == F.col("c.identity_key"), "left")
    for alias, key in (("ob", "base_id"), ("w", "wide_id"), ("nb", "c.c_base_id"), ("cw", "c.c_wide_id")):
        j = j.join(product(alias).hint("merge"), F.col(key) == F.col(f"{alias}.id"), "left")
    j = j.join(slugs.hint("merge"), F.col("c.slug") == F.col("_slug"), "left")
    has, n = F.col("c.identity_key").isNotNull(), F.coalesce("n_members", F.lit(0))
    structure = F.when(n != 2, "members").when(~F.col("all_automatic"), "provenance").when(F.col("roles") != F.array(F.lit("base"), F.lit("wide")), "roles")
    same, family = _same_names("f", "c"), F.col("f.id").cast("string")
    elsewhere = (F.coalesce("owners", F.lit(0)) > 1) | ((F.col("owners") == 1) & (F.col("owner") != F.col("f.id")))
    unsafe = (
        F.when((F.col("c.c_n") != 2) | F.col("c.c_base_id").isNull() | F.col("c.c_wide_id").isNull(), "candidate is not a base and a wide")
        .when(F.col("ob.id").isNull() | F.col("w.id").isNull() | F.col("nb.id").isNull() | F.col("cw.id").isNull(), "product is missing")
        .when(~_yes(~F.col("ob.is_active")), "old base is not inactive")
        .when((F.col("c.c_wide_id") != F.col("wide_id")) | ~_yes(F.col("w.is_active")) | ~_yes(F.col("w.family_id") == family) | ~_yes(F.col("w.role") == "wide") | ~_yes(_by_rule("w")), "wide is not preserved")
        .when((F.col("ob.id") == F.col("nb.id")) | ~_yes(F.col("ob.family_id") == family) | ~_yes(F.col("ob.role") == "base") | ~_yes(_by_rule("ob")), "old base is not replaceable")
        .when(~_yes(F.col("nb.is_active")) | (_trimmed(F.col("nb.family_id")) != "") | _yes(F.col("nb.manual_override")) | _yes(F.col("nb.match_method") == "manual"), "new base is not free")
        .when(_trimmed(F.col("c.slug")) == "", "slug is empty")
        .when(elsewhere, "slug belongs to another family")
    )
    claimed = F.size(F.coalesce("claimed", F.array().cast("array<string>"))) > 0
    exact = same & _yes(F.col("f.slug") == F.col("c.slug")) & (_trimmed(F.col("f.slug")) != "")
    row = lambda bucket, code, detail: F.struct(F.lit(bucket).alias("bucket"), F.lit(code).cast("string").alias("code"), detail.cast("string").alias("detail"))
    text, other = F.lit, _other_fields("f", "c")
    verdict = (
        F.when(_yes(F.col("any_manual")), row("manual", None, text("membership")))
        .when(structure.isNotNull(), row("conflict", "AUTOMATIC_STRUCTURE_DRIFT", structure))
        .when(F.col("missing").isNotNull(), row("conflict", "MISSING_MEMBER", F.col("missing")))
        .when(F.col("any_inactive") & has & ~same, row("conflict", "IDENTITY_DRIFT", text("names")))
        .when(F.col("any_inactive") & has & unsafe.isNotNull(), row("conflict", "AUTOMATIC_CONTINUITY_UNSAFE", unsafe))
        .when(F.col("any_inactive") & has, row("continuity", None, F.concat_ws(">", "base_id", "c.c_base_id")))
        .when(F.col("any_inactive") & claimed, row("conflict", "IDENTITY_DRIFT", text("claimed")))
        .when(F.col("any_inactive"), row("retained", None, F.col("inactive")))
        .when(~has, row("conflict", "ACTIVE_FAMILY_NOT_HIGH", text("absent")))
        .when(~exact, row("conflict", "IDENTITY_DRIFT", text("display")))
        .when(F.col("shape") != F.col("c.c_shape"), row("conflict", "MEMBERSHIP_DRIFT", text("members")))
        .otherwise(row("compatible", None, F.array_join(other, ",")))
    )
    mine = j.select(
        F.col("f.id").alias("family_id"), F.col("f.identity_key").alias("identity_key"), verdict.alias("v"), F.col("f.slug").alias("old_slug"), F.col("c.slug").alias("new_slug"),
        "base_id", F.col("base_slug").alias("old_base_slug"), "wide_id", "wide_slug", F.col("c.c_base_id").alias("new_base_id"), F.col("c.c_base_slug").alias("new_base_slug"), F.array_join(other, ",").alias("fields"),
    )

    stored = flags.join(x.families.select(F.col("id").alias("_id")).hint("merge"), F.col("_f") == F.col("_id"), "left_semi")
    handled = x.families.select("identity_key").unionByName(stored.select(F.explode("claimed").alias("identity_key"))).distinct()
    p = x.products.select(_trimmed(F.col("id")).alias("_p"), F.col("family_id").alias("_family"), F.col("manual_override").alias("_manual"), F.col("match_method").alias("_method"))
    kept = wanted.join(handled.hint("merge"), "identity_key", "left_anti").join(p.hint("merge"), F.col("product_id") == F.col("_p"), "left")
    free = _trimmed(F.col("_family")) == ""
    open_flags = kept.groupBy(F.col("identity_key").alias("_k")).agg(
        F.bool_or(F.col("_p").isNull()).alias("absent"), F.bool_or(_yes(F.col("_manual")) & free).alias("blocked"), F.bool_or(_yes(F.col("_manual")) | _yes(F.col("_method") == "manual")).alias("by_hand"), F.bool_or(~free).alias("assigned"),
    )
    new = x.candidates.join(handled.hint("merge"), "identity_key", "left_anti").join(open_flags.hint("merge"), F.col("identity_key") == F.col("_k"), "left").join(slugs.hint("merge"), F.col("slug") == F.col("_slug"), "left")
    opened = (
        F.when(_yes(F.col("absent")), row("conflict", "MISSING_CANDIDATE_PRODUCT", text("product")))
        .when(_yes(F.col("blocked")), row("manual_blocked", None, text("block")))
        .when(_yes(F.col("by_hand")), row("manual", None, text("candidate")))
        .when(_yes(F.col("assigned")), row("conflict", "CANDIDATE_ALREADY_ASSIGNED", text("product")))
        .when(F.col("owners").isNotNull(), row("conflict", "FAMILY_COLLISION", F.col("owner")))
        .otherwise(row("new_family", None, F.col("slug")))
    )
    none = lambda c: F.lit(None).cast("string").alias(c)
    kind = dict(x.families.dtypes)["id"]
    rest = ["old_slug", "new_slug", "base_id", "old_base_slug", "wide_id", "wide_slug", "new_base_id", "new_base_slug", "fields"]
    fresh = new.select(F.lit(None).cast(kind).alias("family_id"), "identity_key", opened.alias("v"), *map(none, rest))
    twice = claims.where("n > 1").select(F.lit(None).cast(kind).alias("family_id"), F.col("claimed_by").alias("identity_key"), row("conflict", "DUPLICATE_HIGH_MEMBERSHIP", F.col("product_id")).alias("v"), *map(none, rest))
    return mine.unionByName(fresh).unionByName(twice).select("v.*", "family_id", "identity_key", *rest)


def plan(decided: DataFrame, candidates: DataFrame, review: DataFrame | None = None, separate: DataFrame | None = None) -> DataFrame:
    """bucket, code, family_id, identity_key, detail: all eleven buckets, with metadata and memberships as rows of their own.

    ``review`` and ``separate`` (identity_key) are families that the analysis leaves to people; they are only reported.
    """
    core = decided.select("bucket", "code", F.col("family_id").cast("string").alias("family_id"), "identity_key", F.when(F.col("bucket") != "compatible", F.col("detail")).alias("detail"))
    metadata = decided.where("bucket = 'compatible' and fields <> ''").select(F.lit("metadata").alias("bucket"), F.lit(None).cast("string").alias("code"), F.col("family_id").cast("string").alias("family_id"), "identity_key", F.col("fields").alias("detail"))
    fresh = decided.where("bucket = 'new_family'").select("identity_key")
    joined = _wanted(candidates).join(fresh.hint("merge"), "identity_key", "left_semi").select(F.lit("new_membership").alias("bucket"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("family_id"), "identity_key", F.concat_ws(":", "role", "product_id").alias("detail"))
    out = core.unionByName(metadata).unionByName(joined)
    for name, df in (("review", review), ("separate", separate)):
        if df is not None:
            out = out.unionByName(df.select(F.lit(name).alias("bucket"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("family_id"), "identity_key", F.lit(None).cast("string").alias("detail")))
    return out


#: Buckets whose rows change something.
MUTATIONS = ["new_family", "new_membership", "metadata", "continuity"]


def fingerprint(planned: DataFrame, candidates: DataFrame) -> str:
    """One hash of what a plan would change, to the value; plans that change the same have the same, whatever the row order."""
    target = candidates.select(F.col("identity_key").alias("_k"), F.to_json(F.struct("slug", "brand", "model_name", "season_label", *FIELDS)).alias("target"))
    changes = planned.where(F.col("bucket").isin(MUTATIONS)).join(target.hint("merge"), F.col("identity_key") == F.col("_k"), "left").drop("_k")
    rows = changes.withColumn("key", F.concat_ws("|", "bucket", "identity_key", "detail"))
    return checksum(rows, "key").select(F.sha2(F.coalesce("md5", F.lit("")), 256)).first()[0]


class Refused(Exception):
    """A run that has changed nothing, and why."""


def next_products(x: Inputs, decided: DataFrame, new_ids: DataFrame, matched_at: Column) -> DataFrame:
    """Products after the plan, with ``_wanted`` (a change is asked of the row) and ``_done`` (its guards hold)."""
    made = _wanted(x.candidates).join(new_ids.hint("merge"), "identity_key").select("product_id", F.lit("assign").alias("kind"), F.col("new_id").alias("to_family"), F.col("role").alias("to_role"), F.coalesce("reason", F.lit(MATCHED)).alias("to_reason"), F.lit(None).cast("string").alias("of_family"), F.col("product_slug").alias("of_slug"))
    c = decided.where("bucket = 'continuity'")
    family, no = F.col("family_id").cast("string"), F.lit(None).cast("string")
    cleared = c.select(F.col("base_id").alias("product_id"), F.lit("clear").alias("kind"), no.alias("to_family"), no.alias("to_role"), no.alias("to_reason"), family.alias("of_family"), F.col("old_base_slug").alias("of_slug"))
    replaced = c.select(F.col("new_base_id").alias("product_id"), F.lit("replace").alias("kind"), family.alias("to_family"), F.lit("base").alias("to_role"), F.lit(REPLACED).alias("to_reason"), no.alias("of_family"), F.col("new_base_slug").alias("of_slug"))
    kept = c.select(F.col("wide_id").alias("product_id"), F.lit("keep").alias("kind"), no.alias("to_family"), no.alias("to_role"), no.alias("to_reason"), family.alias("of_family"), F.col("wide_slug").alias("of_slug"))
    asked = made.unionByName(cleared).unionByName(replaced).unionByName(kept).withColumnRenamed("product_id", "_p")
    j = x.products.alias("p").join(asked.alias("a").hint("merge"), _trimmed(F.col("p.id")) == F.col("a._p"), "left")
    p, kind = lambda col: F.col(f"p.{col}"), F.col("a.kind")
    hand = _yes(p("manual_override"))
    theirs = lambda role, active: (p("slug") == F.col("a.of_slug")) & (p("family_id") == F.col("a.of_family")) & (p("role") == role) & _by_rule("p") & (p("is_active") == active)
    blank = p("family_id").isNull() & p("role").isNull() & p("match_method").isNull() & p("confidence").isNull() & p("reason").isNull() & p("matched_at").isNull()
    guard = F.when(kind == "assign", p("family_id").isNull() & ~hand).when(kind == "clear", theirs("base", False)).when(kind == "keep", theirs("wide", True)).when(kind == "replace", (p("slug") == F.col("a.of_slug")) & blank & ~hand & p("is_active"))
    done = kind.isNotNull() & _yes(guard)
    gets, loses = done & kind.isin("assign", "replace"), done & (kind == "clear")
    value = {"family_id": F.col("a.to_family"), "role": F.col("a.to_role"), "match_method": F.lit(AUTOMATIC_RULE), "confidence": F.lit(AUTOMATIC_CONFIDENCE), "reason": F.col("a.to_reason"), "matched_at": matched_at}
    kinds = dict(x.products.dtypes)
    out = [F.when(gets, value[col].cast(kinds[col])).when(loses, F.lit(None).cast(kinds[col])).otherwise(p(col)).alias(col) if col in MEMBERSHIP else p(col).alias(col) for col in x.products.columns]
    return j.select(*out, kind.alias("_wanted"), done.alias("_done"))


def next_families(x: Inputs, decided: DataFrame, new_ids: DataFrame) -> DataFrame:
    """Families after the plan, with ``_wanted`` and ``_done`` as in ``next_products``."""
    target = x.candidates.select(F.col("identity_key").alias("_k"), *[F.col(c).alias(f"_t_{c}") for c in FIELDS])
    asked = decided.where("bucket = 'continuity' or (bucket = 'compatible' and fields <> '')").select(F.col("family_id").alias("_f"), F.col("bucket").alias("_bucket"), F.col("old_slug").alias("_old"), F.col("new_slug").alias("_new"), F.col("identity_key").alias("_key"))
    j = x.families.join(asked.hint("merge"), F.col("id") == F.col("_f"), "left").join(target.hint("merge"), F.col("_key") == F.col("_k"), "left")
    moved, mine = F.col("_bucket") == "continuity", F.col("source_kind") == FROM_MEMBER
    done = F.col("_f").isNotNull() & _yes(F.when(moved, (F.col("identity_key") == F.col("_key")) & (F.col("slug") == F.col("_old"))).otherwise(mine))
    fields = [F.when(done & _yes(mine), F.col(f"_t_{c}").cast(dict(x.families.dtypes)[c])).otherwise(F.col(c)).alias(c) for c in FIELDS]
    old = j.select(*[F.when(done & moved, F.col("_new")).otherwise(F.col("slug")).alias("slug") if c == "slug" else F.col(c) for c in x.families.columns if c not in FIELDS], *fields, F.when(F.col("_f").isNotNull(), F.col("_bucket")).alias("_wanted"), done.alias("_done"))
    kinds = dict(x.families.dtypes)
    new = x.candidates.join(new_ids.hint("merge"), "identity_key").select(*[F.col("new_id").cast(kinds["id"]).alias("id") if c == "id" else F.lit(FROM_MEMBER).alias(c) if c == "source_kind" else F.col(c).cast(kinds[c]).alias(c) if c in x.candidates.columns else F.lit(None).cast(kinds[c]).alias(c) for c in x.families.columns], F.lit("new_family").alias("_wanted"), F.lit(True).alias("_done"))
    return old.select(*x.families.columns, "_wanted", "_done").unionByName(new.select(*x.families.columns, "_wanted", "_done"))


def memberships(products: DataFrame) -> DataFrame:
    """The members of families as the products have them."""
    return products.where("family_id is not null").select("family_id", F.col("id").alias("product_id"), F.col("slug").alias("product_slug"), "role", "manual_override", "match_method", "confidence")


def _sources(products: DataFrame) -> tuple:
    """What a run must leave as it is: all columns of products but their membership."""
    return tuple(checksum(products.select(*[c for c in products.columns if c not in MEMBERSHIP]), "id").first())


def _family_state(families: DataFrame, products: DataFrame) -> tuple:
    return tuple(checksum(families, "id").first()) + tuple(checksum(products.select("id", *MEMBERSHIP), "id").first())


def preview(store: Versions, candidates: DataFrame, version: Version | None = None) -> tuple[Inputs, DataFrame, DataFrame, str]:
    """Inputs, decisions, plan and its fingerprint against a version of the store; nothing is written."""
    at = version or store.version()
    families, products = (store.staged(at.tables[name]) for name in ("families", "products"))
    x, tables = Inputs(candidates, families, memberships(products), products), Rounds(store.spark, "reconcile")
    decided = tables.put(decisions(x), "decided")
    planned = tables.put(plan(decided, candidates), "planned")
    return x, decided, planned, fingerprint(planned, candidates)


def _counts(planned: DataFrame) -> dict[str, int]:
    found = {r.bucket: r["count"] for r in planned.where(F.col("bucket").isin([*MUTATIONS, "conflict"])).groupBy("bucket").count().collect()}
    return {name: found.get(name, 0) for name in [*MUTATIONS, "conflict"]}


def apply(store: Versions, candidates: DataFrame, expected: str, matched_at: str) -> Version:
    """Carries out the plan that was seen under the fingerprint ``expected``; returns the version, whose note is the receipt.

    The plan is made again from the store. Conflicts, another plan, a guard that does not hold, or a next state that
    would still change or would touch anything but families raise ``Refused``, and a writer that came first ``Conflict``;
    in each case readers see nothing. A plan that was applied before and still holds makes no new version.
    """
    base = store.version()
    x, decided, planned, seen = preview(store, candidates, base)
    counts = _counts(planned)
    if counts["conflict"]:
        raise Refused(f"{counts['conflict']} conflicts")
    if not any(counts[m] for m in MUTATIONS) and any(store.version(n).note.get("plan") == expected for n in store.numbers()):
        return base
    if seen != expected:
        raise Refused(f"the plan is {seen}, not {expected}")
    new_ids = decided.where("bucket = 'new_family'").select("identity_key", F.concat(F.lit("family:"), F.sha2("identity_key", 256)).alias("new_id"))
    tables = {}
    for name, frame in (("products", next_products(x, decided, new_ids, F.lit(matched_at))), ("families", next_families(x, decided, new_ids))):
        place = store.stage(f"{name}_marked", frame)
        marked = store.staged(place)
        if not marked.where("_wanted is not null and not _done").isEmpty():
            raise Refused(f"guards of {name} do not hold")
        made = {r["_wanted"]: r["count"] for r in marked.where("_done").groupBy("_wanted").count().collect()}
        want = {"assign": counts["new_membership"], "clear": counts["continuity"], "keep": counts["continuity"], "replace": counts["continuity"]} if name == "products" else {"new_family": counts["new_family"], "compatible": counts["metadata"], "continuity": counts["continuity"]}
        if made != {k: v for k, v in want.items() if v}:
            raise Refused(f"{name}: {made} instead of {want}")
        tables[name] = store.stage(name, marked.drop("_wanted", "_done"))
    families, products = store.staged(tables["families"]), store.staged(tables["products"])
    left = _counts(preview(store, candidates, Version(0, tables, {}))[2])
    if any(left.values()):
        raise Refused(f"the next state would change again: {left}")
    if _sources(x.products) != _sources(products):
        raise Refused("products have changed beyond their families")
    note = {"plan": seen, "matched_at": matched_at, "counts": counts, "before": list(_family_state(x.families, x.products)), "after": list(_family_state(families, products)), "base": base.number}
    return store.commit(base, tables, note)


def undo(store: Versions, receipt: Version) -> Version:
    """Takes back what a receipt's version did, if families still are as that version left them; products keep all else.

    If nothing has happened since, its base is taken again as it was. If products have changed otherwise, the new
    families' memberships are cleared one by one, each only if it still is the rule's own, and families without products
    go; a receipt that also changed stored families can then not be undone.
    """
    now = store.version()
    note = receipt.note
    families, products = store.staged(now.tables["families"]), store.staged(now.tables["products"])
    if list(_family_state(families, products)) != note["after"]:
        raise Refused("families are not as the receipt left them")
    if now.tables == receipt.tables:
        before = store.version(note["base"])
        return store.commit(now, before.tables, {"undone": receipt.number, "base": now.number})
    if note["counts"]["metadata"] or note["counts"]["continuity"]:
        raise Refused("stored families were changed, and products since")
    made = store.staged(receipt.tables["families"]).select("id").join(store.staged(store.version(note["base"]).tables["families"]).select("id").hint("merge"), "id", "left_anti").select(F.col("id").cast("string").alias("_made"))
    j = products.join(made.hint("merge"), F.col("family_id") == F.col("_made"), "left")
    hit = F.col("_made").isNotNull()
    odd = j.where(hit & ~_yes((F.col("match_method") == AUTOMATIC_RULE) & (F.col("confidence") == AUTOMATIC_CONFIDENCE) & ~_yes(F.col("manual_override"))))
    if not odd.isEmpty() or j.where(hit).count() != note["counts"]["new_membership"]:
        raise Refused("a membership is not the rule's own any more")
    cleared = j.select(*[F.when(~hit, F.col(c)).alias(c) if c in MEMBERSHIP else F.col(c) for c in products.columns])
    tables = {"products": store.stage("products", cleared), "families": store.stage("families", families.join(made.hint("merge"), F.col("id") == F.col("_made"), "left_anti"))}
    if list(_family_state(store.staged(tables["families"]), store.staged(tables["products"]))) != note["before"] or _sources(products) != _sources(store.staged(tables["products"])):
        raise Refused("the state before the receipt does not come back")
    return store.commit(now, tables, {"undone": receipt.number, "base": now.number})
