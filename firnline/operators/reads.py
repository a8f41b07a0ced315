"""Reading the stored catalogue: points, lists and pages, as an application asks for them.

Filters and columns reach the scan; orders that only a page needs are cut to the page (Spark keeps the first rows of
each task, not a sort of the whole).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.operators.catalogue import ROLES, order_in

NAMED = ["brand", "model_name"]


def with_sizes(products: DataFrame, sizes: DataFrame) -> DataFrame:
    """Products with their sizes as an array, in order of length, label and id; empty where a product has none."""
    own = [c for c in sizes.columns if c not in ("size_cm", "size_label", "id", "product_id")]
    nested = sizes.groupBy(F.col("product_id").alias("_p")).agg(F.array_sort(F.collect_list(F.struct("size_cm", "size_label", "id", *own))).alias("sizes"))
    kind = nested.schema["sizes"].dataType.simpleString()
    # a guess from compressed files would send all sizes to every task
    return products.join(nested.hint("merge"), F.col("id") == F.col("_p"), "left").drop("_p").withColumn("sizes", F.coalesce("sizes", F.array().cast(kind)))


def by_slug(products: DataFrame, sizes: DataFrame, slug: str) -> DataFrame:
    """The active product of a slug with its sizes: one row or none."""
    one = products.where((F.col("slug") == slug) & F.col("is_active")).limit(1)
    ids = one.select(F.col("id").alias("_id"))
    return with_sizes(one, sizes.join(F.broadcast(ids), F.col("product_id") == F.col("_id"), "left_semi"))


def slugs(products: DataFrame) -> DataFrame:
    """The slugs of active products in order of brand, model and slug; reads no other column."""
    return products.where("is_active").select("slug", *NAMED).orderBy(*NAMED, "slug").select("slug")


def family_by_slug(families: DataFrame, slug: str) -> DataFrame:
    return families.where(F.col("slug") == slug).limit(1)


def all_offers(products: DataFrame) -> DataFrame:
    """What the public catalogue is built from: family members of any state, and active products."""
    return products.where("family_id is not null or is_active")


def family_offers(products: DataFrame, family_id: str) -> DataFrame:
    return products.where(F.col("family_id") == family_id)


def single_offer(products: DataFrame, slug: str) -> DataFrame:
    return products.where((F.col("slug") == slug) & F.col("is_active") & F.col("family_id").isNull())


def offer_order() -> list[Column]:
    return [F.col("brand"), F.col("model_name"), order_in(F.col("member_role"), ROLES), F.col("slug"), F.col("id")]


def for_editor(products: DataFrame, sizes: DataFrame) -> DataFrame:
    """All products with sizes, inactive ones too; active ones first, then by brand, model and slug."""
    return with_sizes(products, sizes).orderBy(F.desc("is_active"), *NAMED, "slug")


def family_scan_order() -> list[Column]:
    """Brand and model in lower case, unknown seasons last, slug."""
    return [F.lower("brand"), F.lower("model_name"), F.asc_nulls_last("season_label"), F.col("slug")]


def families_with_members(families: DataFrame, products: DataFrame) -> DataFrame:
    """Families with their members (role, slug, id, active, match method where stored) as an array in order of role and slug."""
    known = [c for c in ("family_match_method", "family_manual_override") if c in products.columns]
    member = F.struct(order_in(F.col("member_role"), ROLES).alias("place"), "slug", F.col("id").alias("product_id"), F.col("member_role").alias("role"), "is_active", *known)
    nested = products.where("family_id is not null").groupBy(F.col("family_id").alias("_f")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    kind = nested.schema["members"].dataType.simpleString()
    return families.join(nested, F.col("id") == F.col("_f"), "left").drop("_f").withColumn("members", F.coalesce("members", F.array().cast(kind)))


def families_without_products(families: DataFrame, products: DataFrame) -> DataFrame:
    return families.join(products.select(F.col("family_id").alias("_f")).where("_f is not null").distinct(), F.col("id") == F.col("_f"), "left_anti")


def page(ordered: DataFrame, visible: int) -> DataFrame:
    """The first ``visible`` rows of an ordered list: pages grow from the start."""
    return ordered.limit(max(visible, 0))


def brands(products: DataFrame) -> DataFrame:
    return products.select("brand").where("brand is not null").distinct()


def size_total(products: DataFrame) -> DataFrame:
    """The number of sizes of products that hold them as arrays."""
    return products.agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0)).cast("long").alias("sizes"))


def snapshot(products: DataFrame, sizes: DataFrame, families: DataFrame, checked: str = "source_checked_at") -> DataFrame:
    """One row: products, active ones, sizes, families and the newest check; a changed table shows in it."""
    p = products.agg(F.count(F.lit(1)).alias("products"), F.count_if("is_active").alias("active_products"), F.max(checked).alias("newest"))
    return p.crossJoin(sizes.agg(F.count(F.lit(1)).alias("sizes"))).crossJoin(families.agg(F.count(F.lit(1)).alias("families")))  # one row each


def shared_images(left: Column, right: Column) -> Column:
    """How many different images two galleries share; blanks do not count."""
    clean = lambda x: F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: F.length(v) > 0)
    return F.size(F.array_intersect(clean(left), clean(right)))


def related_pages(pages: DataFrame) -> DataFrame:
    """slug and related (slugs): the listed pages that exist, without the page itself and repeats, in listed order."""
    listed = pages.select("slug", F.posexplode("related").alias("place", "other")).where("other <> slug")
    first = listed.groupBy("slug", "other").agg(F.min("place").alias("place"))
    known = first.join(pages.select(F.col("slug").alias("_k")), F.col("other") == F.col("_k"), "left_semi")
    nested = known.groupBy(F.col("slug").alias("_s")).agg(F.array_sort(F.collect_list(F.struct("place", "other"))).alias("r"))
    return pages.select("slug").join(nested, F.col("slug") == F.col("_s"), "left").select("slug", F.coalesce(F.transform("r", lambda x: x["other"]), F.array().cast("array<string>")).alias("related"))


# Facets of a browse request: parameters, not data ------------------------------------------------------------------
FACETS = {"style": ["all-mountain", "park", "freeride"], "skill": ["beginner", "intermediate", "advanced"], "shape": ["twin", "asym-twin", "directional-twin", "directional", "tapered-directional"], "line": ["men", "women", "unisex"], "width": ["regular", "mid-wide", "wide"]}
SORTS = ["featured", "price-asc", "price-desc"]


def parse_facets(params: dict[str, Iterable[str]], known_brands: Iterable[str]) -> dict:
    """Request parameters as arguments of ``catalogue.browse``: unknown values go, the rest is in the order of display."""
    first = lambda name: next(iter(params.get(name, [])), "").strip()
    chosen = {name: [v for v in values if v in set(params.get(name, []))] for name, values in FACETS.items()}
    brand, sort = first("brand"), first("sort")
    return {"query": first("q"), "brand": brand if brand in set(known_brands) else "all", "sort": sort if sort in SORTS[1:] else SORTS[0], "styles": chosen["style"], "skills": chosen["skill"], "shapes": chosen["shape"], "lines": chosen["line"], "widths": chosen["width"]}


def facet_params(state: dict) -> list[tuple[str, str]]:
    """The parameters that ``parse_facets`` reads back; defaults are left out."""
    out = [("q", state["query"])] if state["query"] else []
    out += [("brand", state["brand"])] if state["brand"] != "all" else []
    out += [(name, v) for name, values in FACETS.items() for v in values if v in state[f"{name}s"]]
    return out + ([("sort", state["sort"])] if state["sort"] != SORTS[0] else [])


def toggled(state: dict, name: str, value: str) -> dict:
    """The state with one value of a facet put in or taken out."""
    has = set(state[f"{name}s"]) ^ {value}
    return state | {f"{name}s": [v for v in FACETS[name] if v in has]}
