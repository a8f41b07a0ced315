"""Dictionary order against the ICU collator that comes with Spark."""

import functools

from firnline.functions.order import by_number, dictionary
from pyspark.sql import functions as F

WORDS = [
    "a", "A", "ä", "Ä", "á", "b", "B", "z", "Z", "é", "e", "E", "ё", "е", "Ё", "я", "Я", "а", "Б", "б", "ü", "u", "ß", "ss", "10", "9", "010", "9a", "10a", "a10", "a9", "a09b", "a9c", "", " ", "-", "_", "|", "a-b", "a b", "a_b", "ab",
    "traektoria|1004", "traektoria|999", "trial-sport|7", "2 0", "2.0", "x2y10", "x2y9", "x10y1", "日本", "ａ", "Éa", "eb", "côte", "coté", "cote", "côté", "1000000000000000000000000000001", "1000000000000000000000000000000", "snowboard 155W", "Snowboard 155", "snowboard 99",
]


def icu(spark):
    jvm = spark._jvm
    collator = jvm.com.ibm.icu.text.Collator.getInstance(jvm.com.ibm.icu.util.ULocale("en"))
    collator.setNumericCollation(True)
    return collator


def test_same_order_as_icu(spark):
    collator = icu(spark)
    df = spark.createDataFrame([(w,) for w in WORDS], "w string").repartition(3)
    got = [r.w for r in df.orderBy(dictionary(F.col("w")), F.col("w")).collect()]
    want = sorted(sorted(WORDS), key=functools.cmp_to_key(collator.compare))
    assert len(got) == len(WORDS) and all(collator.compare(a, b) <= 0 for a, b in zip(got, got[1:], strict=False))
    assert got == want


def test_inside_arrays_and_windows(spark):
    df = spark.createDataFrame([(1, ["a10", "A9", "a9", "б", "ä"]), (2, [])], "k int, w array<string>")
    order = F.array_sort(F.transform("w", lambda x: F.struct(dictionary(x).alias("o"), x.alias("x"))))
    assert df.select(F.transform(order, lambda s: s["x"])).orderBy("k").collect()[0][0] == ["ä", "a9", "A9", "a10", "б"]


def test_numbers(spark):
    got = spark.createDataFrame([("a007b",), ("0",), ("000",), ("x",), (None,)], "t string").select(by_number(F.col("t"))).collect()
    assert [r[0] for r in got] == ["a00017b", "00010", "00010", "x", None]
