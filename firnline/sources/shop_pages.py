"""Product pages of a shop that have landed as HTML: listings, page data, and products with their spec sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions import text as tx
from firnline.operators import corrections as fix
from firnline.operators.checks import width_of
from firnline.operators.identity import line_evidence, store_identity, variant_marker
from firnline.operators.spec_match import matched_groups, protected_signature
from firnline.sources.rounds import Rounds

# What marks things on the shop's pages.
BASE, STORE, WORD = "https://trial-sport.ru", "trial-sport", "Сноуборд"
GOODS = r"/goods/51526/\d+\.html"


def absolute(path: Column) -> Column:
    return F.when(path.rlike("^[a-z]+://"), path).otherwise(F.concat(F.lit(BASE), path))


def listed_urls(html: Column) -> Column:
    """Addresses on a listing, each once: of what is marked as available, or else of all goods."""
    marked = F.regexp_extract_all(html, F.lit(f'(?is)class="available".*?<a href="({GOODS})"'), F.lit(1))
    return F.array_distinct(F.transform(F.when(F.size(marked) > 0, marked).otherwise(F.regexp_extract_all(html, F.lit(f"(?i)({GOODS})"), F.lit(1))), absolute))


def page_count(html: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(html, F.lit(r"(?i)&pg=(\d+)"), F.lit(1)), lambda n: n.try_cast("int"))), F.lit(1))


def json_array(html: Column, variable: str) -> Column:
    """The JSON array that a script on the page assigns to a variable, as a variant; null if there is none or it is broken.

    It goes from the first bracket to the one that closes it, brackets inside strings left aside, and must end its script.
    """
    tail = F.regexp_extract(html, rf"(?s)(?:const|let|var)\s+{variable}\s*=\s*(\[.*?\]\s*;?\s*</script>)", 1)
    pieces = F.regexp_extract_all(tail, F.lit(r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+"|\[|\]|[^"\[\]]++|")'), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        depth = acc["depth"] + F.when(x == "[", 1).when(x == "]", -1).otherwise(0)
        closes = (acc["end"] == 0) & (depth == 0)
        return F.struct(F.when(acc["end"] > 0, acc["depth"]).otherwise(depth).alias("depth"), (acc["seen"] + 1).alias("seen"), F.when(closes, acc["seen"] + 1).otherwise(acc["end"]).alias("end"))

    def cut(p: Column) -> Column:
        end = F.aggregate(p, start, step)["end"]
        body, after = F.array_join(F.slice(p, F.lit(1), end), ""), F.array_join(F.slice(p, end + 1, F.lit(2)), "")
        return F.when((end > 0) & after.rlike(r"^\s*;?\s*</script>"), F.try_parse_json(body))

    return tx.let(pieces, cut)


def _is(kind: str, v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == kind, F.lit(False))


def entries(array: Column) -> Column:
    """size and available of each entry of a page's stock list (a variant); null where it is no array."""

    def one(e: Column) -> Column:
        at = lambda name: F.try_variant_get(e, f"$.{name}", "variant")
        text = lambda name: F.when(_is("STRING", at(name)), tx.blank_to_null(F.try_variant_get(e, f"$.{name}", "string")))
        number = lambda name: F.coalesce(F.try_variant_get(e, f"$.{name}", "double"), F.lit(0.0))
        flag = _is("BOOLEAN", at("nalim")) & F.coalesce(F.try_variant_get(e, "$.nalim", "boolean"), F.lit(False))
        stores = F.coalesce(F.size(F.try_variant_get(e, "$.stores", "array<variant>")) > 0, F.lit(False))
        free = flag | F.coalesce(F.lower(text("nal")) == "store", F.lit(False)) | (number("im_cols_avail") - number("im_cols_reserved") > 0) | stores
        return F.struct(F.coalesce(text("size"), text("sizecolor")).alias("size"), free.alias("available"))

    return F.transform(F.try_variant_get(array, "$", "array<variant>"), one)


def _after(pattern: str, html: Column, group: int = 1) -> Column:
    return F.regexp_extract(html, pattern, group)


def _literal(x: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))


def page_fields(pages: DataFrame, years: bool = True) -> DataFrame:
    """url, source_product_id, brand, model_name, season_label, price, images, spec_url, description, entries of pages (url, html).

    What a page does not have is empty, 0 or null; ``entries`` is null where the stock list is missing or broken.
    Without ``years`` a season is two years with a stroke; one number like 2004 in a heading is none.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    brands = F.regexp_extract_all(html, F.lit(r'(?i)<a href="/gds\.php[^"]*brand=[^"]*"><span>([^<]+)</span></a>'), F.lit(1))
    head, title = tx.strip_html(_after(r"(?i)<h1[^>]*>\s*([^<]+)\s*</h1>", html)), tx.strip_html(_after(r"(?i)<title>([^<]+)</title>", html))
    p = pages.select("*", tx.strip_html(F.coalesce(F.try_element_at(brands, F.lit(-1)), F.lit(""))).alias("brand"), head.alias("_head"), title.alias("_title"))
    own = F.regexp_replace(F.col("_head"), rf"(?iu)^{WORD}\s+", "")
    own = F.regexp_replace(own, F.concat(F.lit("(?iu)^"), _literal(F.col("brand")), F.lit(r"\s+")), F.lit(""))
    model = tx.space(F.regexp_replace(own, r"\s+20\d{2}(?:/20\d{2})?$", ""))
    listed, shown = _after(r'"price":\s*(\d+)', html), _after(r'(?i)<div class="price(?:\s+price_disc)?">([\d&thinsp;\s]+)&#8381;</div>', html)
    price = F.coalesce(listed.try_cast("long"), F.regexp_replace(shown, r"[^\d]", "").try_cast("long"), F.lit(0))
    big = F.transform(F.regexp_extract_all(html, F.lit(r'"big":\s*"([^"]+)"'), F.lit(1)), lambda u: absolute(tx.decode_html(F.replace(u, F.lit(r"\/"), F.lit("/")))))
    spec = _after(r"(/svdownload\.php\?svid=\d+)", html)
    said = F.concat(F.lit(rf"(?isu){WORD}\s+"), _literal(F.col("brand")), F.lit(r'[^-]{0,120}-\s*(.{120,2200}?)<a href="javascript:void\(0\)" onclick="showBrand\(\);"'))
    heading = F.concat(F.lit(f"{WORD} "), F.col("brand"))
    snippet = F.when(F.instr(html, heading) > 0, F.substring(html, F.instr(html, heading), F.lit(5000)))
    season = lambda c: F.when(F.lit(years) | F.col(c).rlike(r"(?<!\d)20\d{2}\s*/\s*(?:20)?\d{2}(?!\d)"), tx.season_label(F.col(c), True))
    return p.select(
        "url", store_identity(F.col("url"))["source_product_id"].alias("source_product_id"), "brand", F.when(F.col("_head") == "", "").otherwise(model).alias("model_name"),
        F.coalesce(season("_head"), season("_title")).alias("season_label"), price.alias("price"), F.array_distinct(F.filter(big, lambda u: F.trim(u) != "")).alias("images"),
        F.when(spec != "", absolute(spec)).alias("spec_url"), tx.strip_html(F.coalesce(F.call_function("regexp_extract", snippet, said, F.lit(1)), F.lit(""))).alias("description"), entries(json_array(html, "icspJS")).alias("entries"),
    )


def _young(model: Column) -> Column:
    return model.rlike("(?i)kids?|junior|mini|youth|yuniorsk|yunior")


def _waist(model: Column, cm: Column, specs: Column) -> Column:
    """The waist of a size that the sheet does not have: that of the nearest length, but wide boards are wide."""
    exact = F.get(F.filter(specs, lambda s: s["size_cm"] == cm), F.lit(0))["waist_width_mm"]
    near = F.get(F.array_sort(F.transform(specs, lambda s: F.struct(F.abs(s["size_cm"] - cm).alias("d"), s["row"].alias("row"), s["waist_width_mm"].alias("mm")))), F.lit(0))["mm"]
    wide, middle = model.rlike(r"(?i)(?<![A-Za-z0-9_])(?:wide|w)(?![A-Za-z0-9_])"), model.rlike(r"(?i)mid[-\s]?wide")
    guess = F.when(wide, F.greatest(F.lit(264), F.coalesce(near, F.lit(264)))).when(middle, F.greatest(F.lit(257), F.coalesce(near, F.lit(257)))).otherwise(F.coalesce(near, F.lit(250)))
    return F.coalesce(exact, guess)


def merged_sizes(model: Column, listed: Column, specs: Column) -> Column:
    """Sizes of a page, each label once, the last standing, by length: waists from the sheet or estimated, free where any entry is.

    ``listed`` has size and available, ``specs`` row, size_cm, size_label, waist_width_mm and width_type. A page that
    lists no usable size has those of its sheet, all free.
    """
    known = F.coalesce(specs, F.array().cast("array<struct<row:int,size_cm:double,size_label:string,waist_width_mm:int,width_type:string>>"))
    named = F.transform(F.filter(listed, lambda e: e["size"].isNotNull()), lambda e: F.struct(tx.size_key(e["size"]).alias("key"), e["size"].alias("label"), tx.size_cm(e["size"]).alias("cm"), e["available"].alias("free")))
    good = F.filter(named, lambda e: F.coalesce((e["cm"] >= 100) | (_young(model) & (e["cm"] >= 70)), F.lit(False)))
    free = F.array_distinct(F.transform(F.filter(named, lambda e: e["free"]), lambda e: e["key"]))

    def size(key: Column) -> Column:
        last = F.try_element_at(F.filter(good, lambda e: e["key"] == key), F.lit(-1))
        spec = F.try_element_at(F.filter(known, lambda s: tx.size_key(s["size_label"]) == key), F.lit(-1))
        mm = F.coalesce(spec["waist_width_mm"], _waist(model, last["cm"], known)).cast("int")
        return F.struct(last["cm"].alias("size_cm"), F.array_position(F.array_distinct(F.transform(good, lambda e: e["key"])), key).alias("place"), last["label"].alias("size_label"), mm.alias("waist_width_mm"), width_of(mm).alias("width_type"), F.array_contains(free, key).alias("is_available"))

    ours = F.array_sort(F.transform(F.array_distinct(F.transform(good, lambda e: e["key"])), size))
    theirs = F.array_sort(F.transform(known, lambda s: F.struct(s["size_cm"].alias("size_cm"), s["row"].cast("long").alias("place"), s["size_label"].alias("size_label"), s["waist_width_mm"].alias("waist_width_mm"), s["width_type"].alias("width_type"), F.lit(True).alias("is_available"))))
    return F.when(F.size(ours) > 0, ours).otherwise(theirs)


def page_products(pages: DataFrame, specs: DataFrame, books: DataFrame, lines: DataFrame, widths: DataFrame, years: bool = True) -> DataFrame:
    """One row for each page (url, html): status, reason, and the product where it is resolved.

    ``specs`` are ``spec_sheets.spec_groups`` by the address of their book, ``books`` (book, readable) which sheets have
    landed, ``lines`` corrections of lines and ``widths`` (source_product_id, expected_brand, expected_model, widths: a
    map by length) of waists. Outcomes in order: a stock list that cannot be read, nothing in stock, no sheet named, a
    sheet that did not land or cannot be read, a page without brand, model or number, a correction that met another
    product, no group in the sheet, no size, and at last a product. Pages meet sheets on keys; a page is one row.
    Names whose numbers may look like years without being any need ``years=False``, here and in the keys of ``specs``.
    """
    board_key = lambda x: tx.board_key(x, years)
    p = Rounds(pages.sparkSession, "shop-pages").put(page_fields(pages, years), "pages")  # pages are read once, however often their fields are asked
    p = p.withColumn("availability", F.when(F.col("entries").isNull(), "unknown").when(F.exists("entries", lambda e: e["available"]), "available").otherwise("unavailable"))
    p = p.withColumns({"key": board_key(F.col("model_name")), "signature": protected_signature(F.col("model_name"))})
    groups = specs.withColumn("signature", protected_signature(F.col("model_name")))
    named = p.where("spec_url is not null and availability = 'available'").select(F.col("spec_url").alias("book"), "key", "signature")
    found = matched_groups(named, groups).select(F.col("book").alias("_book"), F.col("key").alias("_key"), F.col("signature").alias("_sig"), F.col("kind").alias("match_kind"), "group")
    g = groups.select(F.col("book").alias("_b"), F.col("key").alias("_g"), F.col("model_name").alias("matched_model"), "shape", "purpose", "flex", F.col("sizes").alias("spec_sizes"))
    w = widths.select(F.col("source_product_id").cast("string").alias("_w"), F.col("expected_brand").alias("_brand"), F.col("expected_model").alias("_model"), "widths")
    landed = books.select(F.col("book").alias("_l"), "readable")
    j = p.join(found, (F.col("spec_url") == F.col("_book")) & (F.col("key") == F.col("_key")) & (F.col("signature") == F.col("_sig")), "left")
    j = j.join(g, (F.col("_book") == F.col("_b")) & (F.col("group") == F.col("_g")), "left").join(landed, F.col("spec_url") == F.col("_l"), "left").join(w, F.col("source_product_id") == F.col("_w"), "left")
    line = line_evidence(F.col("description"))
    j = j.withColumn("_line", line).withColumns({"board_line": F.col("_line.board_line"), "line_evidence": F.col("_line.evidence")}).drop("_line")
    j = fix.corrected(j, lines, years)
    sizes = fix.corrected_widths(merged_sizes(F.col("model_name"), F.col("entries"), F.col("spec_sizes")), F.col("widths"))
    j = j.withColumn("sizes", F.when(F.col("availability") == "available", sizes))
    other = F.col("_w").isNotNull() & ((board := board_key(F.col("brand"))).isNull() | (board != board_key(F.col("_brand"))) | (F.col("key") != board_key(F.col("_model"))))
    nameless = (F.col("brand") == "") | (F.col("model_name") == "") | F.col("source_product_id").isNull()
    row = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))
    verdict = (
        F.when(F.col("availability") == "unknown", row("unsafe_failure", "availability_parse_failure"))
        .when(F.col("availability") == "unavailable", row("unavailable", None))
        .when(F.col("spec_url").isNull() & nameless, row("unsafe_failure", "product_parse_failure"))
        .when(F.col("spec_url").isNull(), row("safe_unimportable", "spec_missing"))
        .when(F.col("_l").isNull(), row("unsafe_failure", "spec_fetch_failure"))
        .when(~F.coalesce("readable", F.lit(False)), row("unsafe_failure", "spec_parse_failure"))
        .when(nameless, row("unsafe_failure", "product_parse_failure"))
        .when(other, row("unsafe_failure", "source_metadata_conflict"))
        .when(F.col("group").isNull() & F.col("widths").isNull(), row("safe_unimportable", "spec_group_missing"))
        .when(F.coalesce(F.size("sizes"), F.lit(0)) == 0, row("unsafe_failure", "product_parse_failure"))
        .when(F.col("correction") == "conflict", row("unsafe_failure", "source_metadata_conflict"))
        .otherwise(row("resolved", None))
    )
    flex = F.coalesce(F.nullif("flex", F.lit(0)), F.lit(5))
    return j.withColumn("v", verdict).select(
        "url", "v.status", "v.reason", "availability", F.lit(STORE).alias("store_code"), "source_product_id", "brand", "model_name", tx.slug(F.concat_ws(" ", "brand", "model_name"), years).alias("slug"), variant_marker(F.col("model_name")).alias("variant"), "season_label",
        F.col("price").alias("price_from"), "images", "board_line", "line_evidence", "correction", "match_kind", "matched_model", tx.riding_style(F.col("purpose")).alias("riding_style"), tx.shape(F.col("shape")).alias("shape_type"), flex.alias("flex"), tx.skill_level(F.lit(""), flex).alias("skill_level"),
        "description", "spec_url", "sizes",
    )
