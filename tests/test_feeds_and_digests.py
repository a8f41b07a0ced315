"""Landed feeds, traffic payloads, digests and the event stream."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnline.functions import links
from firnline.operators import digest
from firnline.sources import feeds, traffic
from firnline.streaming import event_stream


def payload(**model):
    content = {"model": {"brand": {"name": "B"}, "props": {"name": "N"}, **model}, "filter_options": [{"code": "FLEX", "value": "<b>мягкая</b>"}], "descriptions": {"features": "Жесткость: 6,5 из 10"}, "grid_size_html": model.pop("grid", None)}
    return json.dumps({"data": {"MAIN": {"content": content}}})


def test_product_outcomes(spark):
    table = "<table><tr><th>Размер</th><th>Ширина талии</th></tr><tr><td>152</td><td>25,1</td></tr></table>"
    skus = [{"sizes": [{"size_title": "152", "is_available": False, "quantity": 2, "retail_price": 0}, {"size_title": "155", "retail_price": 990.0}]}]
    rows = [("a", payload(sku_list=skus, grid=table)), ("b", payload(sku_list=[{"sizes": []}])), ("c", payload(sku_list=[{"sizes": None}])), ("d", "{"), ("e", None)]
    got = {r.url: r for r in feeds.product_outcomes(spark.createDataFrame(rows, "url string, payload string")).collect()}
    assert [got[k].status for k in "abcde"] == ["resolved", "safe_unimportable", "unsafe_failure", "unsafe_failure", "unsafe_failure"]
    assert (got["a"].availability, got["a"].price, got["a"].flex) == ("available", 990.0, 7)


def test_nearest_waist_and_forward_fill(spark):
    spec = spark.createDataFrame([("k", 150.0, 250, 0), ("k", 154.0, 254, 1)], "key string, size_cm double, waist_width_mm int, position int")
    sizes = spark.createDataFrame([("k", 152.0), ("k", 153.0)], "key string, size_cm double")
    assert {(r.size_cm, r.waist_width_mm) for r in feeds.nearest_waist(sizes, spec).collect()} == {(152.0, 250), (153.0, 254)}
    sheet = spark.createDataFrame([("s", 1, "M"), ("s", 2, ""), ("s", 3, None), ("s", 4, "N")], "sheet string, row int, model string")
    assert [r.model for r in feeds.forward_filled(sheet, "sheet", "row", ["model"]).orderBy("row").collect()] == ["M", "M", "M", "N"]


def test_traffic(spark):
    good = json.dumps({"totals": [10, 20, 150, 1.5, 60], "data": [{"dimensions": [{"id": "organic", "name": "РџРѕРёСЃРє"}], "metrics": [3, 2]}, {"dimensions": [{"id": " ad ", "name": "Реклама"}], "metrics": [1, 1]}, {"dimensions": [{"id": "x"}], "metrics": [1]}]})
    raw = spark.createDataFrame([("w", good), ("v", '{"totals":[1,null,2,3,4]}'), ("u", "oops")], "window_key string, response string")
    assert {r.window_key: (r.users, r.bounce_rate) for r in traffic.totals(raw).collect()} == {"w": (10.0, 1.0), "v": (None, None), "u": (None, None)}
    assert {(r.source, r.label, r.share) for r in traffic.sources(raw).collect()} == {("organic", "Переходы из поисковых систем", 0.75), ("ad", "Реклама", 0.25)}
    paths = spark.createDataFrame([("/a",), ("//a",), ("/a?b",), ("a",)], "p string")
    assert [r[0] for r in paths.select(traffic.safe_landing(F.col("p"))).collect()] == [True, False, False, False]


def test_hashes_ignore_key_order(spark):
    df = spark.createDataFrame([('{"b":[1,2],"a":"é"}',), ('{ "a":"é", "b":[1,2] }',), ('{"a":"é","b":[2,1]}',), (None,)], "j string")
    a, b, c, d = (r[0] for r in df.select(digest.canonical_hash("j")).collect())
    assert a == b != c and d is None and a.startswith("sha256:")
    with pytest.raises(ValueError):
        digest.canonical({"x": float("nan")})


def test_privacy(spark):
    found = digest.violations_of({"a": ["ok", "https://x.test"], "User-ID": 1, "deep": {"v": "Bearer abc", "m": "a@b.co"}})
    assert found == ["privacy:$.a[1]:full_url", "privacy:$.User-ID:forbidden_key", "privacy:$.deep.v:authorization_value", "privacy:$.deep.m:email_value"]
    df = spark.createDataFrame([('{"email":"x"}',), ("{}",), (None,)], "j string")
    assert [r[0] for r in df.select(digest.privacy_violations("j")).collect()] == [["privacy:$.email:forbidden_key"], [], None]


def test_checksum_does_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", (F.col("id") * 3).alias("v"))
    one, other = digest.checksum(df.repartition(7), "id").first(), digest.checksum(df.orderBy(F.desc("id")), "id").first()
    assert one == other and one.rows == 500
    assert digest.checksum(df.withColumn("v", F.when(F.col("id") == 9, 0).otherwise(F.col("v"))), "id").first().md5 != one.md5


def test_schema_gaps(spark):
    want = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    df = spark.range(1).select(F.col("id").alias("a"), F.lit(1).alias("c"))
    assert digest.schema_gaps(df, want) == ["missing:b", "unknown:c"]
    assert digest.with_optional_columns(df, want).dtypes == [("a", "bigint"), ("b", "string")]


def test_links(spark):
    df = spark.createDataFrame([("/go/a%20b?x=1",), ("/go/a/b",), ("https://x.test/go/a",), (None,)], "h string")
    assert [r[0] for r in df.select(links.redirect_slug(F.col("h"))).collect()] == ["a b", None, None, None]
    made = df.limit(1).select(links.click_payload(board_slug=F.lit("b"))).first()[0]
    assert json.loads(made)["source"] == "unknown" and json.loads(made)["width_type"] is None


def test_stream(spark, tmp_path):
    rows = [("s", "home_viewed", datetime(2024, 1, 1, 22), None), ("s", "home_viewed", datetime(2024, 1, 1, 20), None), ("", "home_viewed", datetime(2024, 1, 1, 20), None)]
    spark.createDataFrame(rows, event_stream.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = event_stream.append(event_stream.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(60)
    assert {str(r.day) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"2024-01-01", "2024-01-02"}
    counts = event_stream.daily_counts(event_stream.valid(event_stream.read_events(spark, str(tmp_path / "in"))))
    q = counts.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {(str(r.day), r.event_count) for r in spark.sql("SELECT * FROM daily").collect()} == {("2024-01-01", 1), ("2024-01-02", 1)}
