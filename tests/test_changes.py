"""Stored families against wanted ones, evidence, summaries and deliveries."""

from pyspark.sql import functions as F

from firnline.operators import changes as ch

MEMBERS = "array<struct<product_id:string,slug:string,role:string,manual_override:boolean,match_method:string,confidence:string,matched_at:string>>"


def family(key, *members, at="t1", **marks):
    m = {"manual_override": False, "match_method": ch.AUTOMATIC_RULE, "confidence": ch.AUTOMATIC_CONFIDENCE} | marks
    return (key, [(f"id-{s}", s, r, m["manual_override"], m["match_method"], m["confidence"], at) for s, r in members])


def frame(spark, rows):
    return spark.createDataFrame(rows, f"identity_key string, members {MEMBERS}")


def test_stored_state(spark):
    two = [("a", "base"), ("b", "wide")]
    wanted = frame(spark, [family("k1", *two), family("k2", ("c", "base"), ("d", "wide"))])
    state = lambda rows: ch.stored_state(wanted, frame(spark, rows)).first()
    assert tuple(state([])) == ("EMPTY", [], None)
    assert tuple(state([family("k2", ("d", "wide"), ("c", "base")), family("k1", *two)])) == ("NOOP", [], "t1")
    r = state([family("k1", ("a", "base"), ("x", "wide"), at=None), family("k9", *two, at="t2")])
    assert r.status == "CONFLICT" and r.reasons == ["unexpected:1", "absent:1", "different:1", "undated:2"] and r.matched_at == "t2"
    assert state([family("k1", *two, at="t1"), family("k2", ("c", "base"), ("d", "wide"), at="t2")]).reasons == ["matched_at"]


def test_structure(spark):
    rows = [family("ok", ("a", "base"), ("b", "wide")), family("one", ("a", "base")), family("same", ("a", "base"), ("b", "base")), family("hand", ("a", "base"), ("b", "wide"), manual_override=True), family("none", ("a", None), ("b", "wide"))]
    got = {r.identity_key: r.p for r in frame(spark, rows).select("identity_key", ch.structural_problem(F.col("members")).alias("p")).collect()}
    assert got == {"ok": None, "one": "members", "same": "roles", "hand": "provenance", "none": "roles"}


def test_identity_and_metadata(spark):
    schema = "identity_key string, slug string, brand string, model_name string, season_label string, source_kind string, flex int, shape_type string"
    f = spark.createDataFrame([("k1", "s1", "Make", "Model A", "2024/2025", ch.FROM_MEMBER, 5, "twin"), ("k2", "s2", "Make", "Model B", "2024/2025", "manual", 5, None), ("k3", "s3", "Make", "Model C", None, ch.FROM_MEMBER, None, None)], schema)
    c = spark.createDataFrame([("k1", "s1", "MAKE ", "model a", "2024/2025", None, 6, None), ("k2", "other", "Make", "Model B", "2024/2025", None, 7, None), ("k3", "s3", "Make", "Model C", None, None, None, None)], schema)
    got = {r.identity_key: (r.logical, r.exact) for r in ch.same_identity(f, c).collect()}
    assert got["k1"] == (True, True) and got["k2"] == (True, False) and got["k3"] == (False, False)
    assert {tuple(r) for r in ch.metadata_changes(f, c, ["flex", "shape_type"]).collect()} == {("k1", "flex", "5", "6"), ("k1", "shape_type", "twin", None)}


def test_reviewed_entries_and_counts(spark):
    plan = ch.approved_entries(spark.createDataFrame([("k1", "a", "b"), ("k2", "c", "d")], "identity_key string, base string, wide string"))
    approved = ch.entry_hashes(plan.where("identity_key = 'k1'")).select("identity_key", "entry_hash")
    assert {r.identity_key: r.approved for r in ch.reviewed(plan, approved).collect()} == {"k1": True, "k2": False}
    assert ch.fingerprint(plan, "identity_key").collect() == ch.fingerprint(plan.repartition(3), "identity_key").collect()
    actions = spark.createDataFrame([("create",), ("create",), ("noop",)], "action string")
    assert {tuple(r) for r in ch.mutation_counts(actions, {"create": 2, "replace_base": 1}).collect()} == {("noop", 1, 0), ("replace_base", 0, 1)}


def test_import_outcomes(spark):
    outcomes = spark.createDataFrame([("a", "resolved"), ("a", "safe_unimportable"), ("b", "resolved"), ("b", "failed")], "store_code string, status string")
    summary = ch.import_summary(outcomes)
    assert {r.store_code: (r.seen, r.failed, r.complete) for r in summary.collect()} == {"a": (2, 0, True), "b": (2, 1, False)}
    decisions = spark.createDataFrame([("x", "a", "stale"), ("y", "b", "stale"), ("z", "b", "keep"), ("w", "none", "stale")], "slug string, store string, decision string")
    assert {r.slug: r.allowed for r in ch.stale_allowed(decisions, summary).collect()} == {"x": True, "y": False, "z": True, "w": True}
    groups = spark.createDataFrame([("BLOCK", ["r1", "r2"]), ("AUTO", [])], "decision string, reasons array<string>")
    assert {tuple(r) for r in ch.reason_histogram(groups).collect()} == {("decision", "BLOCK", 1), ("decision", "AUTO", 1), ("reason", "r1", 1), ("reason", "r2", 1)}


def test_evidence(spark):
    offers = spark.createDataFrame([("id-1", "s1", "b", "m", None, "men", 0, "u", True)], "id string, slug string, brand string, model_name string, season_label string, board_line string, price_from int, affiliate_url string, is_active boolean")
    sizes = spark.createDataFrame([("id-1", 155.0, None, 250, 50, None, "regular", None), ("id-1", 150.0, "150", 248, 45, 60, "regular", True)], "product_id string, size_cm double, size_label string, waist_width_mm int, recommended_weight_min int, recommended_weight_max int, width_type string, is_available boolean")
    e = ch.offer_evidence(offers, sizes)
    assert ch.repairs(e, ch.offer_evidence(offers, sizes.repartition(3))).count() == 0
    assert [tuple(r) for r in ch.repairs(e, ch.offer_evidence(offers.withColumn("price_from", F.lit(5)), sizes)).collect()] == [("s1", False)]


def test_deliveries(spark):
    d = '{"logicalId":"daily:1","kind":"daily","status":"ok","delivery":{"contentHash":"h"},"sourceReport":{"evidenceHash":"e"}}'
    rows = spark.createDataFrame([("daily:1", "daily", "ok", "h", "e", d), ("daily:2", "daily", "ok", "h", "e", d), ("daily:1", "daily", "ok", "h", "e", "{broken"), ("daily:1", "daily", "ok", "other", "e", d)], "logical_id string, kind string, digest_status string, content_hash string, evidence_hash string, digest string")
    assert [r.problem for r in ch.stored_digest_problem(rows).collect()] == [None, "stored_digest_hash_mismatch", "stored_digest_invalid", "stored_digest_hash_mismatch"]
    e = ch.envelope(spark.createDataFrame([("daily", "daily:2024-01-02", "2024-01-02", "h"), ("weekly", "weekly:2024-W01", "2024-01-08", "h" * 300)], "kind string, logical_id string, as_of string, content_hash string"), "Name").collect()
    assert e[0].subject == "Name Daily Analytics — 2024-01-02 [daily:2024-01-02]" and e[0].filename == "name-daily-2024-01-02.json" and e[0].key == "name/daily:2024-01-02/h"
    assert e[1].filename == "name-weekly-2024-W01.json" and e[1].key is None


def test_no_families(spark):
    none = frame(spark, [])
    assert ch.stored_state(none, none).first().status == "EMPTY"


def test_evidence_is_not_sent_to_every_task(spark):
    from firnline.plans.registry import queries

    for name in ("offer_repairs", "editor_products", "size_total", "catalogue_items"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, name
