"""Facet parameters, canonical forms, snapshots and reads on rare rows."""

import pytest
from pyspark.sql import functions as F

from firnline.functions import report_text as rt
from firnline.operators import catalogue, digest, reads, validation
from firnline.sources import merge


def test_facets_go_round():
    params = {"q": ["  fast "], "brand": ["Nobody"], "style": ["park", "odd", "all-mountain", "park"], "width": ["wide"], "sort": ["price-desc"]}
    state = reads.parse_facets(params, ["Make"])
    assert state == {"query": "fast", "brand": "all", "sort": "price-desc", "styles": ["all-mountain", "park"], "skills": [], "shapes": [], "lines": [], "widths": ["wide"]}
    back: dict[str, list[str]] = {}
    for k, v in reads.facet_params(state):
        back.setdefault(k, []).append(v)
    assert reads.parse_facets(back, ["Make"]) == state and reads.facet_params(reads.parse_facets({}, [])) == []
    assert reads.toggled(reads.toggled(state, "style", "freeride"), "style", "park")["styles"] == ["all-mountain", "freeride"]


def test_numbers_as_ecmascript_writes_them():
    cases = {1.0: "1", -0.0: "0", 1.5: "1.5", 1e21: "1e+21", 123456789012345680000.0: "123456789012345680000", 1e-6: "0.000001", 1e-7: "1e-7", -1.25e-9: "-1.25e-9", 5e-324: "5e-324", 1.7976931348623157e308: "1.7976931348623157e+308", 100: "100", 0.1: "0.1", 1234.5678: "1234.5678"}
    assert {k: digest.canonical(k) for k in cases} == cases
    assert digest.canonical({"\U0001f600": 1, "￮": [True, None, "é"]}) == '{"\U0001f600":1,"￮":[true,null,"é"]}'
    assert digest.canonical({"B": 1, "a": 2, "_": 3, "b": 4, "1": 5}, digest.by_letters) == '{"_":3,"1":5,"a":2,"b":4,"B":1}'


def test_malformed_texts_do_not_fail_the_job(spark):
    df = spark.createDataFrame([("{broken",), (None,), ('{"a":NaN}',), ('{"b":1.0,"a":2}',), ('{"a":2,"b":1}',)], "j string")
    hashes = [r[0] for r in df.select(digest.canonical_hash("j")).collect()]
    assert hashes[:3] == [None, None, None] and hashes[3] == hashes[4] is not None
    assert [r[0] for r in df.select(digest.privacy_violations("j")).collect()][:2] == [["privacy:$:not_json"], None]


def test_a_checksum_of_many_groups_is_still_one(spark, monkeypatch):
    df = spark.range(500).select("id", F.md5(F.col("id").cast("string")).alias("v"))
    assert digest.checksum(df, "id").collect() == digest.checksum(df.repartition(7), "id").collect()
    monkeypatch.setattr(digest, "GROUP_ROWS", 0.01)
    a = digest.checksum(df, "id").collect()
    assert a == digest.checksum(df.repartition(5), "id").collect() and a[0].rows == 500
    assert a != digest.checksum(df.withColumn("v", F.when(F.col("id") == 77, "x").otherwise(F.col("v"))), "id").collect()


def test_snapshots(spark):
    good = '[{"place":1,"slug":"a","size_cm":150.0,"size_label":"150","score":70,"role":"stable","confidence":"high"}]'
    rows = [(1, good), (2, "[]"), (3, "{broken"), (4, good.replace("stable", "odd")), (5, good.replace('"place":1,', "")), (6, good.replace("}]", ',"more":1}]')), (7, None)]
    got = {r.rider_id: r.problem for r in validation.snapshot_problems(spark.createDataFrame(rows, "rider_id int, snapshot string")).collect()}
    assert got == {1: None, 2: None, 3: "not_a_list", 4: "values", 5: "keys", 6: "keys", 7: "not_a_list"}


def test_places_follow_the_order(spark):
    rows = [(f"s{i}", f"m{i % 3}", "x", None if i % 4 == 0 else float(i % 5), "verified" if i % 2 else "draft", None, [(True, True)] * (i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "slug string, brand string, model_name string, price_from double, data_status string, source_checked_at date, sizes array<struct<offer_is_active:boolean,is_available:boolean>>").repartition(5)
    for sort in ("featured", "price-asc", "price-desc"):
        want = [r.slug for r in df.orderBy(*catalogue.sort_keys(sort)).collect()]
        got = {r.slug: r.place for r in catalogue.with_places(df, sort).collect()}
        assert [got[s] for s in want] == list(range(1, 41))


def test_names_by_a_collation(spark):
    df = spark.createDataFrame([("a", "Älpen"), ("b", "Zeta"), ("c", "alpen"), ("d", "beta")], "slug string, brand string").selectExpr("*", "'m' AS model_name", "1.0 AS price_from")
    assert [r.slug for r in df.orderBy(*catalogue.sort_keys("price-asc", "de")).collect()] == ["c", "a", "d", "b"]


def test_galleries_and_deletes(spark):
    df = spark.createDataFrame([(1, '["a"," b ",""]'), (2, '["a"]'), (3, None)], "id int, gallery_images string")
    assert [(r.id, r.gallery_images) for r in merge.normalized_galleries(df).orderBy("id").collect()] == [(1, ["a", "b"]), (3, [])]
    stay, gone = merge.delete_where(df, df.where("id < 3"), "id", unless=df.where("id = 2"))
    assert {r.id for r in stay.collect()} == {2, 3} and {r.id for r in gone.collect()} == {1}


@pytest.mark.parametrize(("header", "wait"), [("3", 3000), (" 99999 ", 10_000), ("Mon, 01 Jan 2024 00:00:04 GMT", 4000), ("Sun, 31 Dec 2023 00:00:00 GMT", 0), ("soon", None), (None, None)])
def test_retry_after(spark, header, wait):
    row = spark.range(1).select(rt.retry_after_ms(F.lit(header).cast("string"), F.timestamp_millis(F.lit(1704067200000).cast("long"))).alias("w")).first()
    assert row.w == wait
