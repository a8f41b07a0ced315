"""Store feeds that have landed as files: product JSON and HTML size tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions import text as tx
from firnline.operators.checks import width_of

SKU = "struct<size_title:string,color_title:string,is_available:boolean,quantity:double,shops_available:array<string>,stores_available:array<string>,retail_price:double>"
PRODUCT = f"struct<data:struct<MAIN:struct<content:struct<model:struct<brand:struct<name:string>,props:struct<name:string,model_name:string,thing_type:string,gender:string>,photo_list:array<struct<url:string,url_resize:string>>,sku_list:array<struct<sizes:array<{SKU}>>>>,filter_options:array<struct<code:string,value:string>>,descriptions:struct<features:string>,grid_size_html:string>>>>"
#: Words that head rows or columns of size tables.
SIZE_WORDS, WAIST_WORD, WEIGHT_WORD = ["ростов", "размер", "длина доск"], "ширина талии", "вес райдера"


def parsed_products(raw: DataFrame) -> DataFrame:
    """url and the product's content from raw rows (url, payload)."""
    return raw.select("url", F.from_json("payload", PRODUCT)["data"]["MAIN"]["content"].alias("c"))


def _free(sku: Column) -> Column:
    have = lambda a: F.coalesce(F.size(a) > 0, F.lit(False))
    return F.coalesce(sku["is_available"], F.lit(False)) | F.coalesce(sku["quantity"] > 0, F.lit(False)) | have(sku["shops_available"]) | have(sku["stores_available"])


def skus(content: str = "c") -> Column:
    """All SKUs; null where the list or one of its groups is broken."""
    groups = F.col(f"{content}.model.sku_list")
    broken = F.exists(groups, lambda g: g["sizes"].isNull() | F.exists(g["sizes"], lambda s: s.isNull()))
    return F.when(~broken, F.flatten(F.transform(groups, lambda g: g["sizes"])))


def availability(content: str = "c") -> Column:
    found = skus(content)
    return F.when(found.isNull(), "unknown").when(F.exists(found, _free), "available").otherwise("unavailable")


def lowest_price(content: str = "c") -> Column:
    return F.array_min(F.filter(F.transform(skus(content), lambda s: s["retail_price"]), lambda p: p > 0))


def images(base_url: str, content: str = "c") -> Column:
    urls = F.transform(f"{content}.model.photo_list", lambda p: F.trim(F.coalesce(F.nullif(p["url_resize"], F.lit("")), p["url"], F.lit(""))))
    whole = F.transform(F.filter(urls, lambda u: u != ""), lambda u: F.when(u.rlike("^[a-z]+://"), u).otherwise(F.concat(F.lit(base_url.rstrip("/")), u)))
    return F.array_distinct(whole)


def attribute(code: str, content: str = "c") -> Column:
    """The text of a filter option, the last of its code."""
    return tx.strip_html(F.try_element_at(F.filter(f"{content}.filter_options", lambda o: o["code"] == code), F.lit(-1))["value"])


def flex(content: str = "c") -> Column:
    named = F.nullif(F.regexp_extract(F.coalesce(F.col(f"{content}.descriptions.features"), F.lit("")), r"(?iu)Жесткость:\s*([0-9]+(?:[.,][0-9]+)?)\s*из\s*10", 1), F.lit(""))
    return tx.flex_number(F.coalesce(named, attribute("FLEX", content)))


def table_cells(html: Column) -> Column:
    """Rows of an HTML table as arrays of cell texts; rows without cells are left out."""
    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), lambda c: tx.strip_html(c)))
    return F.filter(cells, lambda r: F.size(r) > 0)


def _has(x: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(F.coalesce(x, F.lit(""))), F.lit(w))
    return out


def _position(cells: Column, word: str) -> Column:
    """Index of the first cell that holds a word, -1 if none."""
    return F.coalesce(F.array_position(F.transform(cells, lambda c: _has(c, word)), True), F.lit(0)).cast("int") - 1


def size_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, orientation, size_label, size_cm, waist_width_mm, weights and width_type of the sizes in each table.

    A table whose first head cell names sizes has a row for each size; one with a waist row has a column for each.
    Sizes without a plausible waist are left out.
    """
    t = pages.select(key, table_cells(F.col(html)).alias("rows")).where(F.size("rows") >= 2)
    head = F.col("rows")[0]
    t = t.withColumn("w", _position(head, WAIST_WORD)).withColumn("k", _position(head, WEIGHT_WORD))
    t = t.withColumn("orientation", F.when(_has(head[0], *SIZE_WORDS) & (F.col("w") >= 1), "row").otherwise("column"))
    named = lambda word: F.get(F.filter(F.slice("rows", 2, 10_000), lambda r: _has(r[0], word)), F.lit(0))
    t = t.withColumn("waists", named(WAIST_WORD)).withColumn("weights", named(WEIGHT_WORD))
    entry = lambda label, waist, weight: F.struct(label.alias("label"), waist.alias("waist"), weight.alias("weight"))
    by_row = F.transform(F.slice("rows", 2, 10_000), lambda r: entry(r[0], F.get(r, F.col("w")), F.when(F.col("k") >= 1, F.get(r, F.col("k")))))
    by_column = F.transform(F.slice(head, 2, 10_000), lambda c, i: entry(c, F.get("waists", i + 1), F.get("weights", i + 1)))
    found = F.when(F.col("orientation") == "row", by_row).when(F.col("waists").isNotNull(), by_column).otherwise(F.array())
    s = t.select(key, "orientation", F.explode_outer(found).alias("s")).where("s is not null")
    s = s.select(key, "orientation", tx.space(F.col("s.label")).alias("size_label"), tx.size_cm(F.col("s.label")).alias("size_cm"), tx.waist_mm(F.col("s.waist")).alias("waist_width_mm"), tx.weight_range(F.col("s.weight")).alias("r"))
    good = s.where(tx.plausible_waist(F.col("size_cm"), F.col("waist_width_mm")))
    return good.select(key, "orientation", "size_label", "size_cm", "waist_width_mm", F.col("r.low").alias("recommended_weight_min"), F.col("r.high").alias("recommended_weight_max"), width_of(F.col("waist_width_mm")).alias("width_type"))


def product_outcomes(raw: DataFrame) -> DataFrame:
    """url, status (resolved, safe_unimportable or unsafe_failure), availability, price, flex of each landed product."""
    p = parsed_products(raw)
    out = p.select("url", availability().alias("availability"), lowest_price().alias("price"), flex().alias("flex"), F.col("c.model.brand.name").alias("brand"), F.coalesce("c.model.props.model_name", "c.model.props.name").alias("model_name"), F.col("c.grid_size_html").alias("grid"), F.col("c").isNull().alias("broken"))
    sized = size_rows(out, "url", "grid").select("url").distinct().withColumn("sized", F.lit(True))
    out = out.join(sized, "url", "left")
    status = F.when(F.col("broken") | (F.col("availability") == "unknown") | F.col("brand").isNull() | F.col("model_name").isNull(), "unsafe_failure").when(F.col("sized"), "resolved").otherwise("safe_unimportable")
    return out.select("url", status.alias("status"), "availability", "price", "flex", "brand", "model_name")


def nearest_waist(sizes: DataFrame, spec: DataFrame) -> DataFrame:
    """Sizes (key, size_cm) with the waist of the spec size nearest in length; the earlier spec row wins a tie."""
    s = spec.select(F.col("key").alias("_k"), F.col("size_cm").alias("_c"), F.col("waist_width_mm").alias("_w"), F.col("position").alias("_p"))
    met = sizes.join(s, F.col("key") == F.col("_k"))
    return met.groupBy("key", "size_cm").agg(F.min_by("_w", F.struct(F.abs(F.col("size_cm") - F.col("_c")).alias("d"), F.col("_p").alias("p"))).alias("waist_width_mm"))


def forward_filled(sheet: DataFrame, by: str, position: str, columns: list[str]) -> DataFrame:
    """A spec sheet whose header cells stand once per group, filled downwards within each sheet (``by``)."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return sheet.withColumns({c: F.last(F.nullif(F.trim(F.col(c)), F.lit("")), ignorenulls=True).over(w) for c in columns})
