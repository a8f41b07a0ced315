"""Single rules whose details matter."""

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from firnline.functions import num, text
from firnline.functions.jsons import field, is_invalid, is_legacy, merchant, payload_object
from firnline.functions.time import iso_week, report_windows
from firnline.operators import catalogue as cat
from firnline.operators import events as ev
from firnline.operators import identity
from firnline.sources import catalog_csv, merge

NOW = datetime(2024, 1, 20, 12, tzinfo=timezone.utc)


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_rounding_goes_up_at_halves(spark):
    assert values(spark, [(-9.5,), (2.5,), (-2.4,)], "x double", num.round_half_up(F.col("x"))) == [(-9.0,), (3.0,), (-2.0,)]


def test_rates(spark):
    got = values(spark, [(1, 3), (5, 4), (0, 0)], "a int, b int", num.rate(F.col("a"), F.col("b")), num.trend_percent(F.col("a"), F.col("b")))
    assert got == [(0.3333, -0.6667), (1.0, 0.25), (None, None)]


def test_windows():
    w = report_windows(datetime(2024, 1, 20, 22, tzinfo=timezone.utc))  # already the 21st in the reporting zone
    assert w["yesterday"] == (date(2024, 1, 20), date(2024, 1, 20))
    assert w["previous30Days"] == (date(2023, 11, 22), date(2023, 12, 21))


def test_iso_week_year(spark):
    assert values(spark, [(date(2027, 1, 3),)], "d date", iso_week(F.col("d"))) == [("2026-W53",)]


@pytest.mark.parametrize(
    "events, completed, clicked",
    [
        ([("quiz_completed", 0), ("quiz_started", 1)], False, False),
        ([("quiz_started", 0), ("quiz_completed", 0)], True, False),
        ([("product_clicked", 0), ("result_viewed", 1)], False, False),
        ([("result_viewed", 1), ("product_clicked", 1)], False, False),
        ([("result_viewed", 0), ("product_clicked", 1)], False, True),
    ],
)
def test_timeline(spark, events, completed, clicked):
    rows = [("s", n, datetime(2024, 1, 1, 10, m), None) for n, m in events]
    got = ev.session_timeline(spark.createDataFrame(rows, "session_id string, event_name string, created_at timestamp, payload string")).first()
    assert (got.has_ordered_quiz_completion, got.has_ordered_store_click) == (completed, clicked)


def test_payloads(spark):
    rows = [('{"source":" a "}',), ('"{\\"source\\":\\"b\\"}"',), ("{oops",), ('"text"',), ("[1]",), (None,)]
    got = values(spark, rows, "p string", field(payload_object(F.col("p")), "source"), is_legacy(F.col("p")), is_invalid(F.col("p")))
    assert got == [("a", False, False), ("b", True, False), (None, False, True), (None, True, True), (None, False, True), (None, False, True)]


def test_merchant_strips_before_lowering(spark):
    urls = ["https://www.A.test/x", "https://WWW.a.test", "ftp://b.test:21/", "no url", None]
    assert [r[0] for r in values(spark, [(u,) for u in urls], "u string", merchant(F.col("u")))] == ["a.test", "www.a.test", "b.test", None, None]


def test_empty_windows_have_rows(spark):
    none = spark.createDataFrame([], "session_id string, event_name string, created_at timestamp, payload string")
    assert [r.quiz_start_sessions for r in ev.funnel(none, NOW).collect()] == [0] * 5
    assert ev.commerce(none, NOW).count() == 5


def test_slugs(spark):
    got = values(spark, [("Щука FW25 & Co+ 2024/2025 Snowboard",), (None,)], "x string", text.slug(F.col("x")))
    assert got == [("schuka-and-co-plus",), ("",)]


def test_compatibility_form(spark):
    assert values(spark, [("Ｃａｐｉｔａ  ﬁne’s",), (None,)], "x string", text.identity_text(F.col("x"))) == [("capita fines",), ("",)]


def test_labels(spark):
    got = values(spark, [("158 см", 158.0), ("158w", 158.0), (None, 158.0), (" ", 157.5)], "l string, c double", cat.display_label(F.col("l"), F.col("c"), F.lit("wide"), F.lit("wide"), F.lit("none"), F.lit(False)), cat.display_label(F.col("l"), F.col("c"), F.lit("wide"), F.lit("wide"), F.lit("audit-high-v1"), F.lit(False)))
    assert got == [("158", "158W"), ("158W", "158W"), ("158", "158W"), ("157.5", "157.5W")]


def test_line_evidence(spark):
    got = values(spark, [("Women men",), ("Mens",), ("unisex",), ("cement",), (None,)], "x string", identity.line_evidence(F.col("x")).alias("e"))
    assert [tuple(r[0]) for r in got] == [("women", "known"), ("men", "known"), ("unisex", "known"), ("unisex", "missing"), ("unisex", "missing")]


def test_clusters_follow_order_not_closure(spark):
    offers = [(i, "s", "B", "M", "men", season, url, None) for i, season, url in [("1", "2023/2024", "https://traektoria.ru/product/1_a"), ("2", None, "https://trial-sport.ru/goods/1/2.html"), ("3", "2024/2025", "https://other.test/3")]]
    df = spark.createDataFrame(offers, "id string, slug string, brand string, model_name string, board_line string, season_label string, affiliate_url string, source_url string")
    got = {r.id: r.cluster for r in identity.clusters(identity.offer_identities(df)).collect()}
    assert got["2"] in (got["1"], got["3"]) and got["1"] != got["3"]


def test_integrity_errors(spark):
    fam = spark.createDataFrame([("f", "x"), ("f", "x")], "id string, slug string")
    off = spark.createDataFrame([("a", None, "base", True), ("b", "g", "base", True), ("c", "f", None, True)], "slug string, family_id string, member_role string, is_active boolean")
    assert {r.problem for r in cat.integrity_errors(fam, off).collect()} >= {"duplicate family", "role without family", "missing family", "no valid role", "duplicate slug"}


def test_upsert_null_keys_and_new_rows(spark):
    old = spark.createDataFrame([(1, "a", None), (None, "b", 1)], "k int, v string, w int")
    new = spark.createDataFrame([(1, "c", None), (2, "d", 5)], "k int, v string, w int")
    got = {(r.k, r.v, r.w) for r in merge.upsert(old, new, "k", coalesced=["w"]).collect()}
    assert got == {(1, "c", None), (None, "b", 1), (2, "d", 5)}


def test_csv_catalogue(spark, tmp_path):
    head = ";".join(catalog_csv.MODEL_COLUMNS)
    row = "p;B;M;s;f;park;beginner;4,5;100;i;a;да;men;;;;;;;x | y;"
    (tmp_path / "m.csv").write_text(f"﻿{head}\n{row}\n", encoding="utf-8")
    (tmp_path / "s.csv").write_text("product_slug,size_cm,size_label,waist_width_mm,recommended_weight_min,recommended_weight_max,width_type\np,152,,250,60,,regular\np,149,149,248,50,70,regular\n")
    r = catalog_csv.read_catalogue(spark, str(tmp_path / "m.csv"), str(tmp_path / "s.csv")).first()
    assert (r.flex, r.is_active, r.data_status, r.scenarios, [x.size_cm for x in r.sizes]) == (4.5, True, "draft", ["x", "y"], [149.0, 152.0])
    (tmp_path / "s.csv").write_text("product_slug;size_cm;width_type\nq;1;odd\n")
    with pytest.raises(Exception, match="width_type is not allowed"):
        catalog_csv.read_catalogue(spark, str(tmp_path / "m.csv"), str(tmp_path / "s.csv")).collect()


def test_authorization(spark):
    from firnline.operators.authorization import authorize

    schema = "base_slug string, assigned string, slug string, id string, model_name string, n_brand string, n_model string, board_line string, line_evidence string, season string, variant string, source_key string, manual boolean"
    row = lambda base, to, i, key, model="m", line="men", season="2024 2025": (base, to, to, i, model, "b", model, line, "known", season, None, key, False)
    members = [row("a", "a", "1", "t|1"), row("b", "b", "2", "t|2", "other"), row("c", "c", "3", None), row("d", "d", "4", "t|4"), row("d", "d", "5", "u|4"), row("e", "e", "6", "t|6", season=None), row("e", "e", "7", "u|6"), row("f", "f-2", "8", "t|8", line="women"), row("f", "f", "9", "t|9"), row("g", "g", "10", "t|10")]
    owners = [row("a", "a", "1", "t|1"), row("b", "b", "2", "t|2"), row("f", "f", "9", "t|9"), row("g", "g", "x", "t|99")]
    got = {r.base_slug: (r.decision, r.reasons) for r in authorize(spark.createDataFrame(members, schema), spark.createDataFrame(owners, schema)).collect()}
    assert got["a"] == ("AUTO", ["STABLE_PROTECTED_IDENTITIES"])
    assert got["b"] == ("BLOCK", ["SOURCE_ID_REUSE_MODEL_CONFLICT"])
    assert got["c"] == ("BLOCK", ["MISSING_STABLE_SOURCE_IDENTITY"])
    assert got["d"] == ("AUTO", ["NEW_CLEAN_MULTI_SOURCE"])
    assert got["e"] == ("REVIEW", ["INCOMPLETE_CROSS_STORE_EVIDENCE_REVIEW"])
    assert got["f"] == ("AUTO", ["NEW_PROTECTED_IDENTITY_SUFFIX", "STABLE_PROTECTED_IDENTITIES"])
    assert got["g"] == ("BLOCK", ["HISTORICAL_BASE_TAKEOVER"])
