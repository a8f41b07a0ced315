"""The pipeline's stages, one by one against brute force on each stage's own input."""

from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from firnline.llm import queries, sql, toxicity
from test_similar import components
from tests_llm_help import hits

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(toxicity.labelled(docs, labels))
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    scored = {r.doc_id for r in toxicity.score(docs, model).where(f"score < {toxicity.THRESHOLD}").collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == scored
    one = corpus_pipeline.drop_near_copies(spark, clean, SF)
    rows = sorted((r.doc_id, r.text) for r in clean.collect())
    want, _ = components([t for _, t in rows])  # five words and a similarity of 0.8 or more
    assert one.columns == columns and Counter(r.doc_id for r in one.collect()) == Counter(rows[i][0] for i in set(want))
    fresh = corpus_pipeline.drop_contaminated(spark, one, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert fresh.columns == columns and {r.doc_id for r in fresh.collect()} == {r.doc_id for r in one.collect() if not hits(r.text, items)[-1]}
    mixed = corpus_pipeline.mix(spark, fresh, SF)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in fresh.collect()}
    placed = corpus_pipeline.shard(spark, mixed, SF)
    assert Counter(r.doc_id for r in placed.collect()) == Counter(r.doc_id for r in mixed.collect()) and {r.shard for r in placed.collect()} <= set(range(8))


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("shard is null").count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert Counter(map(tuple, got.select(*sorted(got.columns)).collect())) == Counter(con.sql(f"SELECT {', '.join(sorted(want.columns))} FROM ({queries.oracle_sql()[name]})").fetchall())
    assert sql.DECONTAMINATION
