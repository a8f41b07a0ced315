"""Landed shop pages, spec workbooks, containment matches and guarded corrections."""

import itertools
import json
import random
import zipfile

from firnline.operators import corrections as fix
from firnline.operators import spec_match
from firnline.sources import shop_pages, spec_sheets
from pyspark.sql import functions as F


def test_listings(spark):
    rows = [
        ('<div class="available"><a href="/goods/51526/2.html">x</a></div><a href="/goods/51526/9.html"><div class="available"> <a href="/goods/51526/2.html"></div>&pg=3&pg=12', ["https://trial-sport.ru/goods/51526/2.html"], 12),
        ('<a href="/goods/51526/9.html"><a href="/goods/51526/9.html"><a href="/goods/51526/8.html">', ["https://trial-sport.ru/goods/51526/9.html", "https://trial-sport.ru/goods/51526/8.html"], 1),
        ("", [], 1),
        (None, None, 1),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, html string")
    got = df.select(shop_pages.listed_urls(F.col("html")).alias("u"), shop_pages.page_count(F.col("html")).alias("n")).orderBy("i").collect()
    assert [(r.u, r.n) for r in got] == [(u, n) for _, u, n in rows]


def test_stock_lists(spark):
    inner = [{"size": "a ] \\ \" [ b", "nalim": True}, {"size": "152", "nalim": "true"}, {"size": 5, "sizecolor": "x", "stores": [[1], ["]"]]}, {"im_cols_avail": "4", "im_cols_reserved": 3}, {"nal": "Store"}, 7, None]
    good = f"<script>let icspJS = {json.dumps(inner)} ; </script>"
    broken = ["", None, "<script>var icspJS = [1, 2;</script>", "<script>var icspJS = [1] + 2;</script>", "<script>var icspJS = {};</script>", '<script>var icspJS = ["a];</script>', "<script>var icspJS = [{a:1}];</script>"]
    rows = [good, "<script>const icspJS=[]</script>", good.replace("icspJS", "other") + "<script>var icspJS = [[]];</script>", *broken, "<script>var icspJS = [" + ",".join(['{"size":"' + "x" * 50 + '"}'] * 20_000) + "];</script>"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(rows)], "i int, html string")
    got = [r[0] for r in df.select(shop_pages.entries(shop_pages.json_array(F.col("html"), "icspJS")).alias("e"), "i").orderBy("i").collect()]
    assert [(e.size, e.available) for e in got[0]] == [('a ] \\ " [ b', True), ("152", False), ("x", True), (None, True), (None, True), (None, False), (None, False)]
    assert got[1] == [] and [(e.size, e.available) for e in got[2]] == [(None, False)]
    assert got[3:-1] == [None] * len(broken) and len(got[-1]) == 20_000


def book(path, rows, strings, broken=False):
    """A workbook with shared strings in runs, merged heads and empty rows."""
    def cell(r, c, v):
        if v is None:
            return ""
        if isinstance(v, str) and v in strings:
            return f'<c r="{c}{r}" s="1" t="s"><v>{strings.index(v)}</v></c>'
        return f'<c r="{c}{r}"><v>{v}</v></c>' if v != "" else f'<c r="{c}{r}" s="2"/>'

    body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in row.items()) + "</row>" for r, row in enumerate(rows, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = "".join("<si>" + "".join(f"<r><rPr/><t>{p.replace('&', '&amp;')}</t></r>" for p in (s[:2], s[2:])) + "</si>" for s in strings)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{shared}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{body}</sheetData><mergeCells><mergeCell ref="A2:A4"/></mergeCells></worksheet>'[: -30 if broken else None])


def test_workbooks(spark, tmp_path):
    strings = ["Model", "Custom & X", "Twin", "фрирайд", "Sold", "152 W", "жесткий"]
    rows = [
        {"A": "Model", "B": "Shape"}, {"A": "Custom & X", "B": "Twin", "C": "фрирайд", "D": "150", "H": "25,2", "K": "жесткий"}, {}, {"A": "", "D": "152 W", "H": "264"}, {"D": "154", "H": "9"},
        {"A": "Sold", "K": "4"}, {"A": "156", "H": "2550"}, {"A": "Note only"}, {"A": "Custom & X", "C": "x", "K": "3"}, {"D": "158", "H": "258"},
    ]
    book(tmp_path / "one.xlsx", rows, strings)
    many = [{"A": "Head"}, *itertools.chain.from_iterable([{"A": f"Model x{i}", "B": "Twin"}, {"D": str(140 + i % 30), "H": "250"}] for i in range(3000))]
    book(tmp_path / "two.xlsx", many, ["Twin"])
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    book(tmp_path / "cut.xlsx", [{"A": "Head"}, {"A": "M", "B": "Twin"}, {"D": "150", "H": "250"}], ["Twin"], broken=True)
    (tmp_path / "other.txt").write_text("x")
    cells = spec_sheets.workbook_cells(spark, f"file://{tmp_path}")
    assert {spec_name(r.path) for r in cells.where("part = 'broken'").collect()} == {"bad", "cut"}
    named = spec_sheets.workbook_rows(cells, list("ABCDHK")).withColumn("book", spec_sheets.book_of(F.col("path")))
    groups = {(r.book, r.key): r for r in spec_sheets.spec_groups(named).collect()}
    assert {k for k in groups if k[0] == "one"} == {("one", "customandx"), ("one", "sold")}
    x, sold = groups[("one", "customandx")], groups[("one", "sold")]
    assert (x.model_name, x.shape, x.purpose, x.flex) == ("Custom & X", "", "x", 3) and [(s.size_label, s.waist_width_mm, s.width_type) for s in x.sizes] == [("158", 258, "mid-wide")]
    assert (sold.flex, [(s.size_label, s.size_cm, s.waist_width_mm) for s in sold.sizes]) == (4, [("156", 156.0, 255)])
    assert sum(k[0] == "two" for k in groups) == 3000 and all(len(g.sizes) == 1 for k, g in groups.items() if k[0] == "two")


def spec_name(path):
    return path.rsplit("/", 1)[1].split(".")[0]


def test_containment_is_the_theta_join(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
    names = [(b, word(), rng.choice("st")) for b in ("x", "y", "z") for _ in range(150)] + [("x", None, "s"), ("w", "abc", "s")]
    groups = list({(b, k): (b, k, rng.choice("st")) for b in ("x", "y") for k in {word() for _ in range(40)}}.values())
    n, g = (spark.createDataFrame(r, "book string, key string, signature string") for r in (names, groups))
    found = spec_match.matched_groups(n, g)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = set()
    for b, k, s in set(names):
        if k is None:
            continue
        here = {gk: gs for gb, gk, gs in groups if gb == b}
        hits = [gk for gk, gs in here.items() if (gk in k or k in gk) and gs == s]
        want.add((b, k, s, "exact", k, 1) if k in here else (b, k, s, "safe-partial" if len(hits) == 1 else "ambiguous" if hits else "none", hits[0] if len(hits) == 1 else None, len(hits)))
    assert {tuple(r) for r in found.collect()} == want and {w[3] for w in want} == {"exact", "safe-partial", "ambiguous", "none"}


def test_signatures(spark):
    names = ["Team Wide", "Team W", "Team Mid Wide Snowboard", "Team Pro", "Team Plus", "Team Plus Wide", "Plus Team", "Wmns Team LTD", "Kids Team", "Team Carbon Split", "", None]
    got = [json.loads(r[0]) for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(spec_match.protected_signature(F.col("n"))).collect()]
    assert [(g["width"], g["audience"], g["make"]) for g in got] == [
        ("wide", "adult", []), ("wide", "adult", []), ("mid-wide", "adult", []), ("base", "adult", ["pro"]), ("base", "adult", ["plus"]), ("wide", "adult", ["plus"]), ("base", "adult", []),
        ("base", "women", ["limited"]), ("base", "youth", []), ("base", "adult", ["carbon", "split"]), ("base", "adult", []), ("base", "adult", []),
    ]


def test_corrections(spark):
    products = spark.createDataFrame([("1", "Nitro", "Team", "unisex", "missing"), ("2", "Nitro", "Team", "unisex", "missing"), ("3", "RIDE", "War-pig", "men", "known"), ("4", "Ride", "Warpig", "women", "known"), ("6", "Any", "Any", "unisex", "missing")], "source_product_id string, brand string, model_name string, board_line string, line_evidence string")
    table = spark.createDataFrame([("1", "nitro", "team", "men"), ("2", "Nitro", "Other", "men"), ("3", "Ride", "Warpig", "men"), ("4", "Ride", "Warpig", "men"), ("5", "x", "y", "men"), ("6", None, None, "women")], "source_product_id string, expected_brand string, expected_model string, corrected_line string")
    out = fix.corrected(products, table)
    assert {r.source_product_id: (r.board_line, r.line_evidence, r.correction) for r in out.collect()} == {"1": ("men", "known", "applied"), "2": ("unisex", "missing", "conflict"), "3": ("men", "known", "agrees"), "4": ("women", "known", "conflict"), "6": ("women", "known", "applied")}
    assert {(r.source_product_id, r.outcome, r.n) for r in fix.correction_report(table, out).collect()} == {("1", "applied", 1), ("2", "conflict", 1), ("3", "agrees", 1), ("4", "conflict", 1), ("5", "unused", 0), ("6", "applied", 1)}
