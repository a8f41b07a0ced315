"""Runs over a versioned store: applied once, refused, interrupted, contended, undone."""

import pytest

from firnline.operators import reconcile
from firnline.sources.versions import Conflict, Versions

FIELD = ", ".join(f"{c} string" for c in reconcile.FIELDS)
CAND = f"identity_key string, slug string, brand string, model_name string, season_label string, members array<struct<product_id:string,product_slug:string,role:string,reason:string>>, {FIELD}"
FAM = f"id string, identity_key string, slug string, brand string, model_name string, season_label string, source_kind string, {FIELD}"
PROD = "id string, slug string, is_active boolean, family_id string, role string, manual_override boolean, match_method string, confidence string, reason string, matched_at string, price int"
AT = "2024-05-01T00:00:00Z"


def member(i, role):
    return (i, f"s{i}", role, "seen")


def cand(key, base, wide, value="x", slug=None):
    return (key, slug or f"f-{key}", "Make", f"Model {key}", "2024/2025", [member(base, "base"), member(wide, "wide")], *[value] * len(reconcile.FIELDS))


def fam(i, key, value="x", slug=None):
    return (i, key, slug or f"f-{key}", "make", f"model {key}", "24/25", "fallback-member", *[value] * len(reconcile.FIELDS))


def free(i, active=True, price=1):
    return (i, f"s{i}", active, None, None, False, None, None, None, None, price)


def held(i, family, role, active=True):
    return (i, f"s{i}", active, family, role, False, "audit-high-v1", "high", "before", "2023", 1)


@pytest.fixture
def store(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/store")
    products = [free("1"), free("2"), held("3", "F3", "base", False), held("4", "F3", "wide"), free("5"), held("6", "F6", "base"), held("7", "F6", "wide"), free("8")]
    families = [fam("F3", "c"), fam("F6", "m", "old")]
    v.commit(v.version(), {"products": v.stage("products", spark.createDataFrame(products, PROD)), "families": v.stage("families", spark.createDataFrame(families, FAM))}, {})
    return v


@pytest.fixture
def wanted(spark):
    return spark.createDataFrame([cand("a", "1", "2"), cand("c", "5", "4", slug="f-c2"), cand("m", "6", "7")], CAND)


def state(v):
    return {r.id: (r.family_id and r.family_id[:3], r.role, r.reason, r.matched_at) for r in v.read("products").collect()}


def test_apply_again_and_undo(spark, store, wanted):
    before = state(store)
    _, _, planned, seen = reconcile.preview(store, wanted)
    assert {(r.bucket, r.identity_key) for r in planned.collect()} == {("new_family", "a"), ("new_membership", "a"), ("continuity", "c"), ("compatible", "m"), ("metadata", "m")}
    with pytest.raises(reconcile.Refused, match="not 0"):
        reconcile.apply(store, wanted, "0" * 64, AT)
    done = reconcile.apply(store, wanted, seen, AT)
    assert done.number == 2 and done.note["counts"] == {"new_family": 1, "new_membership": 2, "metadata": 1, "continuity": 1, "conflict": 0}
    after = state(store)
    assert after["1"] == ("fam", "base", "seen", AT) and after["2"] == ("fam", "wide", "seen", AT) and after["3"] == (None, None, None, None)
    assert after["5"] == ("F3", "base", reconcile.REPLACED, AT) and after["4"] == before["4"] and after["8"] == before["8"]
    slugs = {r.identity_key: (r.slug, r.flex) for r in store.read("families").collect()}
    assert slugs == {"a": ("f-a", "x"), "c": ("f-c2", "x"), "m": ("f-m", "x")}
    assert reconcile.apply(store, wanted, seen, "later") == done and store.numbers() == [1, 2]
    back = reconcile.undo(store, done)
    assert back.number == 3 and state(store) == before and back.tables == store.version(1).tables
    with pytest.raises(reconcile.Refused, match="as the receipt left them"):
        reconcile.undo(store, done)


def test_a_crash_before_the_exchange_and_another_writer(spark, store, wanted, monkeypatch):
    before, seen = state(store), reconcile.preview(store, wanted)[3]
    commit = Versions.commit

    def dies(self, base, tables, note):
        raise RuntimeError("killed")

    monkeypatch.setattr(Versions, "commit", dies)
    with pytest.raises(RuntimeError):
        reconcile.apply(store, wanted, seen, AT)
    assert store.numbers() == [1] and state(store) == before

    def late(self, base, tables, note):
        if "plan" in note:  # another writer takes the version while this one has written its files
            commit(self, base, {}, {"other": True})
        return commit(self, base, tables, note)

    monkeypatch.setattr(Versions, "commit", late)
    with pytest.raises(Conflict):
        reconcile.apply(store, wanted, seen, AT)
    assert store.numbers() == [1, 2] and store.version().note == {"other": True} and state(store) == before


def test_undo_after_other_changes(spark, store):
    only = spark.createDataFrame([cand("a", "1", "2")], CAND)
    base = store.version()
    # the two stored families are out of the way, so that nothing conflicts
    products, none = spark.createDataFrame([free("1"), free("2"), free("8")], PROD), spark.createDataFrame([], FAM)
    store.commit(base, {"products": store.stage("products", products), "families": store.stage("families", none)}, {})
    done = reconcile.apply(store, only, reconcile.preview(store, only)[3], AT)
    repriced = store.read("products").replace(1, 5, "price")
    store.commit(store.version(), {"products": store.stage("products", repriced)}, {"prices": True})
    reconcile.undo(store, done)
    assert store.read("families").count() == 0
    assert {(r.id, r.family_id, r.match_method, r.price) for r in store.read("products").collect()} == {("1", None, None, 5), ("2", None, None, 5), ("8", None, None, 5)}


def test_conflicts_refuse(spark, store):
    drifted = spark.createDataFrame([cand("m", "6", "8")], CAND)
    with pytest.raises(reconcile.Refused, match="1 conflicts"):
        reconcile.apply(store, drifted, reconcile.preview(store, drifted)[3], AT)
