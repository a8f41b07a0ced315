"""The public catalogue: families and single offers as one table of items with nested offers and sizes.

Sizes are nested under offers and offers under items by aggregation on the item key alone, so that one shuffle
brings an item together; order inside arrays comes from sort keys in their structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Display order of widths and family roles.
WIDTHS = ["regular", "mid-wide", "wide"]
ROLES = ["base", "wide", "other"]
SPECS = ["riding_style", "skill_level", "flex", "board_line", "shape_type", "camber_profile", "data_status", "source_name", "source_url", "source_checked_at"]


def order_in(c: Column, values: list[str]) -> Column:
    """Position in the list; its length for null."""
    return F.coalesce(F.nullif(F.array_position(F.lit(values), c), F.lit(0)) - 1, F.lit(len(values))).cast("int")


def number_text(x: Column) -> Column:
    """A number without a trailing ``.0``."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def size_label(label: Column, cm: Column) -> Column:
    """The label without unit and spaces, or else the number."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(label), r"(?iu)\s*(cm|см)\.?$", ""), r"(?U)\s+", "")
    return F.when(F.length(bare) > 0, bare).otherwise(number_text(cm))


def display_label(label: Column, cm: Column, width: Column, role: Column, method: Column, manual: Column) -> Column:
    """Labels like 158w get a capital W; trusted wide members get one from their number."""
    plain = size_label(label, cm)
    trusted = (role == "wide") & (width == "wide") & ((method == "audit-high-v1") | ((method == "manual") & manual))
    return F.when(plain.rlike(r"(?i)^\d+(?:[.,]\d+)?w$"), F.concat(F.regexp_replace(plain, "(?i)w$", ""), F.lit("W"))).when(F.coalesce(trusted, F.lit(False)), F.concat(number_text(cm), F.lit("W"))).otherwise(plain)


def reliable(cm: Column, waist: Column) -> Column:
    return (cm >= 100) | (waist < 235)


def integrity_errors(families: DataFrame, offers: DataFrame) -> DataFrame:
    """problem and slug of offers and families that cannot be placed; empty for a sound catalogue."""
    ids = families.select(F.col("id").alias("_fid"))
    twice = ids.groupBy("_fid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate family").alias("problem"), F.col("_fid").alias("slug"))
    loose = offers.where("family_id is null and member_role is not null").select(F.lit("role without family").alias("problem"), "slug")
    lost = offers.where("family_id is not null").join(ids, F.col("family_id") == F.col("_fid"), "left_anti").select(F.lit("missing family").alias("problem"), "slug")
    role = offers.where(F.col("family_id").isNotNull() & ~F.coalesce(F.col("member_role").isin(ROLES), F.lit(False))).select(F.lit("no valid role").alias("problem"), "slug")
    items = families.join(offers.where("is_active").select(F.col("family_id").alias("_f")).distinct(), F.col("id") == F.col("_f"), "left_semi").select("slug").unionByName(offers.where("is_active and family_id is null").select("slug"))
    same = items.groupBy("slug").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate slug").alias("problem"), "slug")
    return twice.unionByName(loose).unionByName(lost).unionByName(role).unionByName(same)


def _blank(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def items(families: DataFrame, offers: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per catalogue item that has an active offer.

    family_id, slug, brand, model_name, season_label, the specs, offers, sizes, price_from, has_available_size, media,
    default_offer_slug. Sizes come from all offers of an item; price, media and default from its active ones.
    """
    o = offers.select("*", F.coalesce("family_id", F.concat(F.lit("offer:"), "id")).alias("item"), order_in(F.col("member_role"), ROLES).alias("ro"))
    if "family_match_method" not in offers.columns:
        o = o.withColumn("family_match_method", F.lit(None).cast("string")).withColumn("family_manual_override", F.lit(False))
    label = display_label(F.col("s.size_label"), F.col("s.size_cm"), F.col("s.width_type"), F.col("o.member_role"), F.col("o.family_match_method"), F.col("o.family_manual_override"))
    s = sizes.alias("s").where(reliable(F.col("size_cm"), F.col("waist_width_mm"))).join(o.alias("o").hint("merge"), F.col("s.product_id") == F.col("o.id"))  # guessed from compressed files, offers would go to every task
    s = s.select("o.item", F.col("o.id").alias("offer_id"), F.struct(F.col("s.size_cm"), label.alias("label"), order_in(F.col("s.width_type"), WIDTHS).alias("wo"), F.col("o.ro"), F.col("o.slug").alias("offer_slug"), F.col("s.id"), F.col("s.width_type"), F.col("s.waist_width_mm"), F.col("o.is_active").alias("offer_is_active"), F.coalesce("s.is_available", F.lit(True)).alias("is_available")).alias("size"))
    by_offer = s.groupBy("item", "offer_id").agg(F.collect_list("size").alias("ss"), F.bool_or("size.is_available").alias("any_free"))
    full = o.join(by_offer.drop("item").withColumnRenamed("offer_id", "id").hint("merge"), "id", "left")
    any_free = F.coalesce("any_free", F.lit(False))
    price = F.when(F.col("price_from") > 0, F.col("price_from").cast("double"))
    images = F.filter(F.transform(F.concat(F.array("image_url"), F.coalesce("gallery_images", F.array().cast("array<string>"))), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    offer = F.struct("ro", "slug", F.col("id").alias("offer_id"), "member_role", F.col("price_from"), "is_active", any_free.alias("has_available_size"), (F.col("is_active") & any_free).alias("is_fulfillable"), images.alias("images"))
    # least price, then role, then the newest check, then slug; unknown prices and dates come last
    choice = F.when(F.col("is_active") & any_free, F.struct(F.coalesce(price, F.lit(float("inf"))).alias("p"), F.col("ro"), F.coalesce(-F.unix_date("source_checked_at"), F.lit(2**31 - 1)).alias("c"), F.col("slug")))
    grouped = full.groupBy("item").agg(
        F.array_sort(F.collect_list(offer)).alias("offers"),
        F.array_sort(F.flatten(F.collect_list(F.coalesce("ss", F.array())))).alias("sizes"),
        F.min(F.when(F.col("is_active"), price)).alias("price_from"),
        F.bool_or("is_active").alias("is_active"),
        F.bool_or(F.col("is_active") & any_free).alias("has_available_size"),
        F.min(choice)["slug"].alias("default_offer_slug"),
    ).where("is_active")
    media = lambda live: F.array_distinct(F.flatten(F.transform(F.filter("offers", lambda x: x["is_active"] == live), lambda x: x["images"])))
    grouped = grouped.withColumn("media", F.when(F.size(media(True)) > 0, media(True)).otherwise(media(False)))
    named = ["slug", "brand", "model_name", "season_label", *SPECS]
    fam = families.select(F.col("id").alias("item"), F.col("id").alias("family_id"), *named)
    single = o.where("family_id is null").select("item", F.lit(None).cast("string").alias("family_id"), *named)
    heads = fam.unionByName(single)
    clean = {"season_label": _blank("season_label"), "data_status": F.coalesce("data_status", F.lit("draft")), "source_name": _blank("source_name"), "source_url": _blank("source_url")}
    return heads.join(grouped.hint("merge"), "item").withColumns(clean).drop("item")


def active_sizes(c: str = "sizes") -> Column:
    return F.filter(c, lambda s: s["offer_is_active"])


def available_sizes(c: str = "sizes") -> Column:
    return F.filter(c, lambda s: s["offer_is_active"] & s["is_available"])


def filter_sizes(c: str = "sizes") -> Column:
    """Available sizes, or all of active offers where none is."""
    return F.when(F.size(available_sizes(c)) > 0, available_sizes(c)).otherwise(active_sizes(c))


def width_types(c: str = "sizes") -> Column:
    have = F.transform(filter_sizes(c), lambda s: s["width_type"])
    return F.filter(F.lit(WIDTHS), lambda w: F.array_contains(have, w))


def width_summary(c: str = "sizes") -> Column:
    kinds = width_types(c)
    one = F.when(kinds[0] == "regular", "обычная ширина").otherwise(kinds[0])
    many = F.array_join(F.transform(kinds, lambda w: F.when(w == "regular", "обычная").otherwise(w)), " + ")
    return F.when(F.size(kinds) == 0, "ширина уточняется").when(F.size(kinds) == 1, one).otherwise(many)


def plural_size(n: Column) -> Column:
    one = (n % 10 == 1) & (n % 100 != 11)
    few = (n % 10).between(2, 4) & ~(n % 100).between(12, 14)
    return F.when(one, "размер").when(few, "размера").otherwise("размеров")


def availability_headline(c: str = "sizes") -> Column:
    n = F.size(available_sizes(c))
    return F.when(n == 0, "Сейчас нет доступных размеров").otherwise(F.concat_ws(" ", F.lit("В наличии"), n.cast("string"), plural_size(n)))


def availability_preview(c: str = "sizes", limit: int = 5) -> Column:
    labels = F.filter(F.transform(available_sizes(c), lambda s: F.trim(s["label"])), lambda x: F.length(x) > 0)
    shown, more = F.array_join(F.slice(labels, 1, limit), ", "), F.size(labels) - limit
    return F.when(F.size(labels) == 0, "Доступные размеры в магазине сейчас не подтверждены.").when(more > 0, F.concat(F.lit("Сейчас: "), shown, F.lit(" + ещё "), more.cast("string"), F.lit("."))).otherwise(F.concat(F.lit("Сейчас: "), shown, F.lit(".")))


def money(x: Column) -> Column:
    digits = F.floor(x + 0.5).cast("long").cast("string")
    return F.concat(F.regexp_replace(digits, r"\B(?=(\d{3})+(?!\d))", " "), F.lit(" ₽"))


def search_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[-_]+", " "), r"(?U)\s+", " "))


def matching(catalogue: DataFrame, query: str = "", brand: str = "all", styles=(), skills=(), shapes=(), lines=(), widths=()) -> DataFrame:
    """Items that match every facet; an empty facet passes all, a null attribute fails a set one."""
    out = catalogue
    text = " ".join(query.replace("-", " ").replace("_", " ").lower().split())
    if text:
        hay = search_text(F.concat_ws(" ", "brand", "model_name", "slug", F.array_join(F.transform("offers", lambda o: o["slug"]), " ")))
        out = out.where(F.contains(hay, F.lit(text)))
    if brand != "all":
        out = out.where(F.col("brand") == brand)
    for c, chosen in (("riding_style", styles), ("skill_level", skills), ("shape_type", shapes), ("board_line", lines)):
        if chosen:
            out = out.where(F.col(c).isin(*chosen))
    if widths:
        out = out.where(F.exists(filter_sizes(), lambda s: s["width_type"].isin(*widths)))
    return out


def browse(catalogue: DataFrame, sort: str = "featured", collation: str | None = None, **facets) -> DataFrame:
    """The items of ``matching`` in display order; names by code point, or by a collation such as ``ru``."""
    return matching(catalogue, **facets).orderBy(*sort_keys(sort, collation))


def with_places(found: DataFrame, sort: str = "featured", collation: str | None = None) -> DataFrame:
    """The items with their place (from 1) in display order.

    Items are numbered within groups of equal first sort keys; only the sizes of the groups are summed in one task.
    """
    price = F.col("price_from").cast("double")
    known = F.when(price > 0, price)
    free = F.least(F.size(available_sizes()), F.lit(999_999))
    group = {"price-asc": F.coalesce(known, F.lit(float("inf"))), "price-desc": F.coalesce(-known, F.lit(float("inf")))}.get(sort, F.when(F.col("data_status") == "verified", 0.0).otherwise(1e6) - free)
    rows = found.withColumn("_group", group)
    number = F.row_number().over(Window.partitionBy("_group").orderBy(*sort_keys(sort, collation)))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(F.col("_group").alias("_g")).agg(F.count(F.lit(1)).alias("n")).select("_g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_head"))
    return rows.withColumn("_number", number).join(heads, F.col("_group") == F.col("_g")).withColumn("place", F.col("_head") + F.col("_number")).drop("_group", "_g", "_head", "_number")


def sort_keys(sort: str, collation: str | None = None) -> list[Column]:
    """Unknown prices come last whichever way prices are sorted."""
    price = F.when(F.col("price_from") > 0, F.col("price_from"))
    named = [F.collate(c, collation) if collation else F.col(c) for c in ("brand", "model_name")]
    name = [*named, F.col("slug")]
    if sort == "price-asc":
        return [price.asc_nulls_last(), *name]
    if sort == "price-desc":
        return [price.desc_nulls_last(), *name]
    fresh = F.coalesce(F.unix_date("source_checked_at"), F.lit(0))
    return [F.desc(F.col("data_status") == "verified"), F.desc(F.size(available_sizes())), fresh.desc(), price.asc_nulls_last(), *name]


def related(catalogue: DataFrame, slug: str, limit: int = 3) -> DataFrame:
    """Other items that share style or line with the one named, best matches first."""
    one = catalogue.where(F.col("slug") == slug).select(F.col("riding_style").alias("_s"), F.col("board_line").alias("_l"), F.lit(1).alias("_k")).limit(1)
    rest = catalogue.where(F.col("slug") != slug).withColumn("_k", F.lit(1)).join(F.broadcast(one), "_k")
    same_style, same_line = F.coalesce(F.col("riding_style") == F.col("_s"), F.lit(False)), F.coalesce(F.col("board_line") == F.col("_l"), F.lit(False))
    return rest.where(same_style | same_line).orderBy(same_style.desc(), same_line.desc(), "brand", "model_name", "slug").limit(limit).drop("_s", "_l", "_k")


def resolve_slug(requests: DataFrame, catalogue: DataFrame, aliases: DataFrame, offers: DataFrame) -> DataFrame:
    """slug, canonical and kind (exact, alias, offer or none) of requested slugs.

    ``aliases`` has alias and slug; an offer's own slug leads to the item that holds it.
    """
    live = catalogue.select(F.col("slug").alias("_live"), F.explode("offers.slug").alias("_offer"))
    exact = live.select(F.col("_live").alias("_x")).distinct()
    named = aliases.join(exact, F.col("slug") == F.col("_x"), "left_semi").select(F.col("alias").alias("_a"), F.col("slug").alias("_as"))
    held = live.groupBy(F.col("_offer").alias("_o")).agg(F.min("_live").alias("_os"))
    out = requests.join(exact, F.col("slug") == F.col("_x"), "left").join(named, F.col("slug") == F.col("_a"), "left").join(held, F.col("slug") == F.col("_o"), "left")
    kind = F.when(F.col("_x").isNotNull(), "exact").when(F.col("_as").isNotNull(), "alias").when(F.col("_os").isNotNull(), "offer").otherwise("none")
    return out.select("slug", F.coalesce("_x", "_as", "_os").alias("canonical"), kind.alias("kind"))


#: Russian month names in the genitive.
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]


def long_date(text: Column) -> Column:
    """A date as day, month name and year; any other text as it is."""
    d = F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim(text).try_cast("date"))
    shown = F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.element_at(F.lit(MONTHS), F.month(d)), F.year(d).cast("string"), F.lit("г."))
    return F.when(d.isNotNull(), shown).otherwise(F.nullif(F.trim(text), F.lit("")))


def product_issues(products: DataFrame) -> DataFrame:
    """slug and issues (codes in order) of what keeps a product (with trust flags) from being ready."""
    rules = [
        ("not_verified", ~F.col("verified")),
        ("no_source", ~F.col("has_source")),
        ("no_shape", F.col("shape_type").isNull()),
        ("no_camber", F.col("camber_profile").isNull()),
        ("no_link", ~F.coalesce(F.length(F.trim("affiliate_url")) > 0, F.lit(False))),
        ("placeholder_link", F.col("placeholder_link")),
    ]
    return products.select("slug", F.array_compact(F.array(*[F.when(when, F.lit(code)) for code, when in rules])).alias("issues"))


def representative_width(sizes: DataFrame) -> DataFrame:
    """product_id and width_type: the widest that any of its sizes has."""
    return sizes.groupBy("product_id").agg(F.max_by("width_type", order_in(F.col("width_type"), WIDTHS)).alias("width_type"))


def family_key(family_id: Column, product_id: Column) -> Column:
    return F.when(F.length(F.trim(family_id)) > 0, F.concat(F.lit("family:"), family_id)).otherwise(F.concat(F.lit("product:"), product_id))


def board_details(catalogue: DataFrame) -> DataFrame:
    """slug, trust (verified, sourced or draft), flex shown only where it can be trusted, narrative offer, checked date."""
    store = F.lower(F.try_parse_url("source_url", F.lit("HOST"))).isin("trial-sport.ru", "www.trial-sport.ru", "traektoria.ru", "www.traektoria.ru")
    sourced = F.col("source_name").isNotNull() & F.col("source_url").isNotNull()
    verified = F.col("data_status") == "verified"
    trust = F.when(verified & sourced, "verified").when(sourced, "sourced").otherwise("draft")
    flex = F.when(verified & sourced & ~F.coalesce(store, F.lit(False)), F.col("flex").cast("double"))
    first = F.get(F.filter("offers", lambda o: o["is_active"]), F.lit(0))["slug"]
    return catalogue.select("slug", trust.alias("trust"), flex.alias("flex"), F.coalesce("default_offer_slug", first).alias("narrative_offer"), long_date(F.col("source_checked_at").cast("string")).alias("checked"))
