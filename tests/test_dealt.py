"""Small files of many rows are dealt out before work that is long for each row, and nothing that grows goes through the driver."""

import pytest

from firnline.operators import identity_plan, json_tree, reconcile
from firnline.plans import bindings as b
from firnline.plans import digest_queries, domain_queries, family_queries, identity_queries
from firnline.sources.rounds import dealt

DATA = "/root/testdata/sf0.001"


def _files(df) -> str:
    return " ".join(df.inputFiles())


def test_dealt_rows_are_the_same_in_several_parts(spark):
    part = b.table(spark, DATA, "part")
    parts = dealt(part, 50)
    assert part.rdd.getNumPartitions() == 1
    assert parts.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, part.collect()))
    assert dealt(part.limit(0), 50).collect() == []


def test_offers_are_worked_on_in_dealt_parts(spark):
    assert "part.parquet" not in _files(domain_queries._offers(spark, DATA))


def test_size_tables_are_parsed_in_dealt_parts(spark):
    assert "part.parquet" not in _files(domain_queries.size_tables(spark, DATA))


@pytest.mark.parametrize("query", [domain_queries.offer_authorization, domain_queries.offer_classes])
def test_offers_are_parsed_once_and_joined_by_merge(spark, query):
    made = query(spark, DATA)
    shown = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in shown and "Broadcast" not in shown
    assert "try_parse_url" not in shown and "parse_url" not in shown


@pytest.mark.parametrize("query", [digest_queries.digest_faults, digest_queries.report_digests])
def test_documents_are_walked_in_dealt_parts(spark, query):
    assert "supplier.parquet" not in _files(query(spark, DATA))


def test_forbidden_keys_in_wide_letters_are_found(spark):
    docs = spark.createDataFrame([("a", '{"ｅmail":1,"Email":2,"ok":3}'), ("b", "{"), ("c", None)], "id string, json string")
    got = {r.id: r.faults for r in json_tree.faults(docs, {"object": {"ok": "number", "ｅmail?": "number", "Email?": "number"}}).collect()}
    assert got == {"a": ["privacy:$.Email:forbidden_key", "privacy:$.ｅmail:forbidden_key"], "b": ["schema:$:invalid_json"], "c": ["schema:$:invalid_json"]}


def test_plan_of_identities_reads_stored_tables_only(spark):
    plan, stored = identity_queries._plan(spark, DATA)
    made = identity_plan.plan_operations(plan, stored)
    assert "part.parquet" not in _files(made)
    shown = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in shown and "Broadcast" not in shown


def test_families_are_decided_without_broadcasts(spark):
    x = reconcile.Inputs(*[f(spark, DATA) for f in (family_queries.candidates, family_queries.families, family_queries.members, family_queries.products)])
    shown = reconcile.decisions(x)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in shown and "Broadcast" not in shown
