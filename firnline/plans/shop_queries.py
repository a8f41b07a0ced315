"""Pages of a shop, made by putting its markup before the supplied pages, against spec groups made from parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.functions import text as tx
from firnline.operators import corrections as fix
from firnline.plans import bindings as b
from firnline.sources import shop_pages
from firnline.sources.rounds import Rounds

BRANDS = ["Nitro", "Ride", "Bataleon", "Jones"]


def _text(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("string")


def _join(*parts) -> Column:
    return F.concat(*[_text(p) for p in parts])


def _names(s: SparkSession, d: str) -> DataFrame:
    """k, n, brand, model, number (at the shop) and body of each supplied page."""
    k = F.col("page_id")
    n = F.floor(k / 2)
    model = _join(F.when(n % 15 == 0, "Kids ").otherwise(""), "Board ", n, b.pick(k, ["", " Wide", " Pro", " Mid Wide", "", " Plus"]))
    return b.table(s, d, "pages").select(k.alias("k"), n.alias("n"), b.pick(F.floor(k / 3), BRANDS).alias("brand"), model.alias("model"), (k + 3130000).alias("number"), F.coalesce("html", F.lit("")).alias("body"))


def pages(s: SparkSession, d: str) -> DataFrame:
    k, n, brand, model = (F.col(c) for c in ("k", "n", "brand", "model"))
    first = 150 + k % 5
    usual = _join(
        '[{"size":"', first, '","nalim":', F.when(k % 3 == 0, "true").otherwise("false"), ',"note":"a ] b [ \\"q\\""},{"size":" ', 155 + k % 4, ' W","nal":"', F.when(k % 2 == 0, "STORE").otherwise("no"),
        '"},{"size":"95","stores":["x"]},{"sizecolor":"', first, ' см","im_cols_avail":"3","im_cols_reserved":', 2 + k % 2, ',"stores":[]}]',
    )
    sold = '[{"size":"150","nalim":"true","stores":[]},{"size":"151","im_cols_avail":2,"im_cols_reserved":2}]'
    stock = F.when(k % 11 == 0, '[{"size":"150"').when(k % 11 == 5, '{"a":1}').when(k % 13 == 0, sold).otherwise(usual)
    said = F.when(k % 9 == 0, "женский сноуборд для трассы ").otherwise("мужской сноуборд для трассы ")
    html = _join(
        "<h1 class='x'> Сноуборд ", brand, " ", model, F.when(k % 10 != 3, " 2024/2025").otherwise(""), " </h1>", F.when(k % 23 != 0, _join('<a href="/gds.php?s=1&brand=', k % 7, '"><span>', brand, "</span></a>")).otherwise(""),
        F.when(k % 5 == 0, _join('<div class="price price_disc">', 10 + k % 50, "&thinsp;", 100 + k % 900, "&#8381;</div>")).otherwise(_join('"price": ', 12000 + k)),
        '"big": "\\/img\\/', k, '.jpg" "big": "\\/img\\/', k + k % 2, '.jpg"', F.when(k % 7 != 0, _join("<a href='/svdownload.php?svid=", n % 6, "'>x</a>")).otherwise(""),
        F.when(k % 3 == 0, _join("<p>Сноуборд ", brand, " ", model, " - ", F.repeat(said, 6), '<a href="javascript:void(0)" onclick="showBrand();">')).otherwise(""),
        "<script>var icspJS = ", stock, ";</script>", F.col("body"),
    )
    return _names(s, d).select(_join("https://www.trial-sport.ru/goods/51526/", F.col("number"), ".html").alias("url"), html.alias("html"))


def _book(n: Column) -> Column:
    return _join("https://trial-sport.ru/svdownload.php?svid=", n % 6)


def specs(s: SparkSession, d: str) -> DataFrame:
    """Sheets of models: a board, and for some its wide, pro and children's kind."""
    k = F.col("p_partkey")
    n, r = F.floor(k / 4), k % 4
    name = F.when(r == 0, _join("Board ", n, F.when(n % 4 == 1, " New").otherwise(""))).when((r == 1) & (n % 3 == 0), _join("Board ", n, " Wide")).when((r == 2) & (n % 5 == 0), _join("Board ", n, " Pro")).when((r == 3) & (n % 15 == 0), _join("Kids Board ", n))
    size = lambda i, cm, label: F.struct((n * 2 + i).cast("int").alias("row"), F.lit(cm).alias("size_cm"), F.lit(label).alias("size_label"), (250 + (n + 9 * i) % 20).cast("int").alias("waist_width_mm"), F.when(250 + (n + 9 * i) % 20 >= 264, "wide").when(250 + (n + 9 * i) % 20 >= 257, "mid-wide").otherwise("regular").alias("width_type"))
    p = b.table(s, d, "part").select(_book(n).alias("book"), name.alias("model_name"), b.pick(n, ["Twin", "Directional Twin", "Направленный", ""]).alias("shape"), b.pick(n, ["фрирайд", "фристайл", "универсальный", "all mountain park", ""]).alias("purpose"), (n % 10 + 1).cast("int").alias("flex"), F.array(size(0, 152.0, "152"), size(1, 156.0, "156 W")).alias("sizes"))
    return p.where("model_name is not null and not endswith(book, '=5')").withColumn("key", tx.board_key(F.col("model_name"), years=False))


def books(s: SparkSession, d: str) -> DataFrame:
    """Five of six sheets have landed; one of them cannot be read."""
    n = F.col("p_partkey") % 5
    return b.table(s, d, "part").select(_book(n).alias("book"), (n != 4).alias("readable")).distinct()


def lines(s: SparkSession, d: str) -> DataFrame:
    p, k = _names(s, d), F.col("k")
    return p.where("k % 17 in (0, 1)").select(F.when(k % 17 == 1, _join(F.col("number"), "0")).otherwise(_text(F.col("number"))).alias("source_product_id"), F.when(k % 51 == 0, "Other").otherwise(F.col("brand")).alias("expected_brand"), F.col("model").alias("expected_model"), b.pick(k, ["men", "women"]).alias("corrected_line"))


def widths(s: SparkSession, d: str) -> DataFrame:
    p, k = _names(s, d), F.col("k")
    return p.where("k % 19 = 0").select(_text(F.col("number")).alias("source_product_id"), F.col("brand").alias("expected_brand"), F.when(k % 2 == 0, F.col("model")).otherwise("x").alias("expected_model"), F.create_map(F.lit(152), F.lit(300), F.lit(150), F.lit(301)).alias("widths"))


def _products(s: SparkSession, d: str) -> DataFrame:
    """The models are numbered, past 2000 too: Board 2004 is no board of that year."""
    return shop_pages.page_products(pages(s, d), specs(s, d), books(s, d), lines(s, d), widths(s, d), years=False)


def shop_products(s: SparkSession, d: str) -> DataFrame:
    p = _products(s, d)
    one = F.transform("sizes", lambda z: F.concat_ws(":", z["size_label"], z["size_cm"].cast("int").cast("string"), z["waist_width_mm"].cast("string"), z["width_type"], z["is_available"].cast("string")))
    fine = F.col("status") == "resolved"
    found = [F.when(fine, F.col(c)).alias(c) for c in ("board_line", "line_evidence", "correction", "riding_style", "shape_type", "flex", "skill_level")]
    return p.select(
        "url", "status", "reason", "availability", "brand", "model_name", "slug", "variant", "season_label", "price_from", F.array_join("images", ",").alias("images"), "match_kind", "matched_model", *found,
        F.when(fine, F.array_join(one, ",")).alias("sizes"), F.md5("description").alias("description_md5"),
    )


def shop_corrections(s: SparkSession, d: str) -> DataFrame:
    """Corrections of lines that were carried out, agreed, met another board, or met nothing."""
    met = Rounds(s, "shop").put(_products(s, d).where("spec_url is not null").select("source_product_id", "correction"), "met")
    return fix.correction_report(lines(s, d), met)


QUERIES = [shop_products, shop_corrections]
