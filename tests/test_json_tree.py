"""JSON trees: canonical texts and hashes, number texts, schema walks, digests."""

import json
import random

from firnline.operators import digest, json_tree, report_digest
from firnline.plans import digest_queries as made
from firnline.sources.rounds import Rounds
from pyspark.sql import functions as F


def docs(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, json string").repartition(3)


def random_value(rng, depth):
    kind = rng.choice(["object", "array"] if depth == 4 else ["object", "array", "number", "string", "null", "bool"]) if depth else rng.choice(["number", "string", "null", "bool"])
    if kind == "object":
        return {rng.choice(["a", "B", "é", "a.b", "[]", "я", "", "z9", "x\"y"]): random_value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    if kind == "array":
        return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    if kind == "number":
        return rng.choice([0, -0.0, 5, 5.0, -17.25, 0.1, 1e-7, 1.5e-6, 123456789.125, 2**53, 1e21, 1e22, 0.30000000000000004, -3e-9, 12345678901234567])
    return {"string": rng.choice(["", "plain", "tab\tq\"uote\\", "é я 日", "line\nend", "/slash"]), "null": None, "bool": rng.random() < 0.5}[kind]


def test_hashes_are_those_of_the_canonical_text(spark):
    rng = random.Random(6)
    values = [random_value(rng, 4) for _ in range(120)] + [{}, [], {"a": {}}, 7, "x", None]
    texts = [json.dumps(v, ensure_ascii=bool(i % 2), indent=i % 3 or None) for i, v in enumerate(values)]
    texts += ["", "{", None, '{"a":1e999}', '{"a":1,"a":2}']
    got = {int(r.id): r.hash for r in json_tree.canonical_hashes(docs(spark, texts)).collect()}
    import hashlib

    for i, v in enumerate(values):
        assert got[i] == "sha256:" + hashlib.sha256(digest.canonical(v).encode()).hexdigest(), (v, texts[i])
    n = len(values)
    assert [got[n + i] for i in range(4)] == [None] * 4 and len(got) == len(texts)


def test_letters(spark):
    value = {"b": 1, "B": 2, "a": 3, "é": 4, "e": 5, "f": 6, "я": 7, "Z": 8, "_": 9}
    tables = Rounds(spark, "test")
    found = json_tree.written(json_tree.walk(docs(spark, [json.dumps(value)]), tables), tables, "letters").first().json
    assert list(json.loads(found)) == ["_", "a", "b", "B", "e", "é", "f", "Z", "я"]


def test_numbers(spark):
    xs = [0.0, -0.0, 1.0, -2.5, 1e20, 1e21, 1.5e300, 1e-6, 9.5e-7, 2.5e-300, 0.1, 1 / 3, 123456.789, float("nan"), float("inf")]
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in xs], "x double").coalesce(1).select(json_tree.number_text(F.col("x"))).collect()]
    assert got[:-2] == [digest._number(x) for x in xs[:-2]] and got[-2:] == [None, None]


def slow_faults(value, schema, path="$"):
    """The rules of a schema in plain Python; checks by name are left to the other tests."""
    if isinstance(schema, dict) and "null" in schema:
        return [] if value is None else slow_faults(value, schema["null"], path)
    kind = schema if isinstance(schema, str) else next(iter(schema))
    kinds = {"object": dict, "array": list, "string": str, "number": (int, float), "boolean": bool}
    if not isinstance(value, kinds[kind]) or (kind == "number" and isinstance(value, bool)):
        return [f"schema:{path}:invalid_{kind}"]
    if kind == "string" and isinstance(schema, dict) and value not in schema["string"].get("values", [value]):
        return [f"schema:{path}:invalid_string"]
    out = []
    if kind == "array":
        for i, v in enumerate(value):
            out += slow_faults(v, schema["array"], f"{path}[{i}]")
    if kind == "object":
        fields = {k.removesuffix("?"): (v, k.endswith("?")) for k, v in schema["object"].items()}
        out += [f"schema:{path}.{k}:unknown_key" for k in value if k not in fields]
        for k, (inner, optional) in fields.items():
            out += slow_faults(value[k], inner, f"{path}.{k}") if k in value else [] if optional else [f"schema:{path}.{k}:missing_key"]
    return out


SCHEMA = {"object": {"a": {"array": {"object": {"x": "number", "y?": {"null": "string"}}}}, "b.c": {"object": {"d": "boolean"}}, "e?": {"null": {"array": {"array": {"string": {"values": ["p", "q"]}}}}}}}


def test_faults_at_any_depth(spark):
    rng = random.Random(8)
    leaf = lambda: rng.choice([1, 2.5, "p", "zz", None, True, [], {}])
    values = [{"a": [{"x": 1, "y": None}, {"x": 2.5}], "b.c": {"d": False}}, {"a": [], "b.c": {"d": True}, "e": [["p"], ["q", "r"], 3]}, {"a": 1, "b": {"c": {"d": 1}}, "b.c": []}, [], "x", {}]
    values += [{k: rng.choice([leaf(), [{"x": leaf(), "y": leaf(), "z": leaf()}, leaf()], {"d": leaf(), "deep": {"x": 1}}, [[leaf()], leaf()]]) for k in rng.sample(["a", "b.c", "e", "b", "other"], 4)} for _ in range(80)]
    got = {int(r.id): r.faults for r in json_tree.faults(docs(spark, [json.dumps(v) for v in values] + ["{", None]), SCHEMA).collect()}
    for i, v in enumerate(values):
        assert got[i] == sorted(set(slow_faults(v, SCHEMA))), v
    assert got[len(values)] == got[len(values) + 1] == ["schema:$:invalid_json"]


def test_digests_keep_what_is_listed(spark):
    """The made report gives the made digest, key for key; a window without figures is null on both sides."""
    report = made.report_sample()
    other = json.loads(json.dumps(report))
    other["traffic"]["yesterday"], other["acquisition"]["last30Days"] = None, None
    other["acquisition"]["sourceStatus"] = {"status": "not_configured"}
    other["generatedAt"] = "2024-02-01T00:00:00.000Z"
    again = json.loads(json.dumps(report)) | {"generatedAt": "2024-03-01T00:00:00.000Z", "more": 1}
    rows = [("a", "weekly", json.dumps(report)), ("b", "daily", json.dumps(other)), ("c", "weekly", json.dumps(again, indent=1)), ("d", "daily", "{"), ("e", "daily", None), ("f", "daily", json.dumps(report | {"timezone": "UTC"})), ("g", "daily", json.dumps({k: v for k, v in report.items() if k != "funnel"}))]
    got = {r.id: r for r in report_digests(spark, rows)}
    assert (got["a"].status, got["a"].logical_id, got["a"].problem) == ("complete", "weekly:2024-W02", None)
    want = made.digest_sample() | {"kind": "weekly", "logicalId": "weekly:2024-W02", "sourceReport": {"version": "report-v3", "evidenceHash": got["a"].evidence_hash}, "delivery": {"contentHash": got["a"].content_hash}}
    assert json.loads(got["a"].digest) == want and got["a"].digest == digest.canonical(want)
    assert (got["c"].evidence_hash, got["c"].content_hash) == (got["a"].evidence_hash, got["a"].content_hash) and got["c"].digest != got["a"].digest
    b = json.loads(got["b"].digest)
    assert got["b"].status == "partial" and b["traffic"]["yesterday"] is b["sampling"]["traffic"]["yesterday"] is b["sampling"]["acquisition"]["last30Days"] is b["sampling"]["acquisition"]["sources30Days"] is None
    assert [got[k].problem for k in "defg"] == ["digest_schema_invalid"] * 4 and all(got[k].digest is None for k in "defg")


def report_digests(spark, rows):
    return report_digest.build_digests(spark.createDataFrame(rows, "id string, kind string, json string")).collect()


def test_nodes_meet_nodes_by_merge(spark):
    from firnline.operators import json_tree

    nodes = spark.createDataFrame([("a", 0, "$", None, "$", None, None, 0, "object", None)], "id string, depth int, path string, parent string, pattern string, parent_pattern string, key string, place int, kind string, text string")
    found = json_tree.schema_faults(nodes, json_tree.schema_table(spark, {"object": {"x": "number"}}))
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert [r.fault for r in found.collect()] == ["schema:$.x:missing_key"]
