"""Rows repeated very often, the pipeline on rare tables, and the shared folder."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from firnline.llm import copies, decontamination, mixing, sharding, storage, suffix

SF = "/root/testdata/sf0.001"


def test_copies_are_numbered(spark):
    df = spark.createDataFrame([("a", 1), ("b", 9000), ("c", 4096), ("d", 4097)], "k string, n long")
    got = copies.numbered_copies(df, "n", "i").groupBy("k").agg(F.count("i").alias("c"), F.min("i").alias("a"), F.max("i").alias("b")).collect()
    assert {r.k: (r.c, r.a, r.b) for r in got} == {"a": (1, 0, 0), "b": (9000, 0, 8999), "c": (4096, 0, 4095), "d": (4097, 0, 4096)}


def test_rows_repeated_often(spark):
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"))
    placed = sharding.shard_documents(docs)
    assert placed.count() == 20_000 and placed.select("slot").distinct().count() == 20_000
    assert mixing.mixture(docs).select("start").distinct().count() == 20_000
    bench = spark.createDataFrame([("i", "same text")], "item_id string, text string")
    assert decontamination.mark_contamination(docs, bench).where("contaminated").count() == 20_000


def test_no_documents_to_place(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_documents(empty).count() == 0


def test_shuffled_sources(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i % 300, " ".join(["w"] * rng.randint(1, 9)), f"s{rng.randrange(12)}" if i % 11 else None) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = Counter(map(tuple, mixing.mixture(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert Counter(map(tuple, mixing.mixture(docs).collect())) == want


def test_stages_on_rare_rows(spark):
    rng = random.Random(4)
    text = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row long, score double, m map<string,int>, `a.b` int, shard string, content string"
    rows = [(None, text[0]), (None, text[1]), (3, text[2]), (3, text[3]), (4, None), (5, ""), (6, text[4]), (6, text[4]), (7, "word " * 250_000)]
    docs = spark.createDataFrame([(d, t, None, f"s{i % 2}", 1, i, 0.5, {"x": i}, i, "here", "c") for i, (d, t) in enumerate(rows)], schema).repartition(3)
    empty = spark.createDataFrame([], schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, SF).count() == 0
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(docs.columns), k
        got = Counter((r.doc_id, (r.text or "")[:50]) for r in out.collect())
        if k in (0, 2, 4):
            assert got == Counter((d, (t or "")[:50]) for d, t in rows)
        else:
            assert set(got) >= {(d, (t or "")[:50]) for d, t in rows if d not in (4, 5)}


def test_a_long_text_repeats(spark):
    rng = random.Random(6)
    body = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    docs = spark.createDataFrame([(1, body), (2, "x" + body[400_000:]), (3, None)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.suffix_report(docs).collect()}
    assert got == {1: (900_000, 1), 2: (900_000, 1), 3: (0, 0)}


def test_no_private_folder_on_a_cluster():
    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "a"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
