"""Merging offers, the plan, its audit and its gate."""

import functools
import itertools
import random

from firnline.operators import identity, identity_plan
from firnline.sources.rounds import Rounds
from pyspark.sql import functions as F

OFFER = "g string, id string, place int, season_label string, price_from int, affiliate_url string, is_active boolean, image_url string, gallery_images array<string>, shape_type string, flex int, store_code string, source_product_id string, sizes array<struct<recommended_weight_min:int,recommended_weight_max:int>>"
NAMES = [c.strip().split(" ")[0] for c in "g string|id|place|season_label|price_from|affiliate_url|is_active|image_url|gallery_images|shape_type|flex|store_code|source_product_id|sizes".split("|")]


def rank(label):
    label = (label or "").strip()
    if "/" in label:
        a, b = label.split("/")
        return int(b) * 10000 + int(a)
    return int(label) if label else None


def score(p):
    sizes = p["sizes"] or []
    return 10 * len(sizes) + 8 * sum((a or 0) > 0 or b is not None for a, b in sizes) + 4 * bool(p["shape_type"]) + 3 * bool(p["flex"]) + 3 * bool(p["is_active"])


def better(a, b):
    """Whether a sells rather than b; both carry the score of the whole product."""
    def key(p):
        priced = (p["price_from"] or 0) > 0
        return (not p["is_active"], not priced, p["price_from"] if priced else 0, -score(p), p["store_code"], int(p["source_product_id"]))
    return key(a) <= key(b)


def fold(a, b):
    ra, rb = rank(a["season_label"]), rank(b["season_label"])
    apart = ra is not None and rb is not None and ra != rb
    newer = rb > ra if apart else score(b) > score(a)
    base, other = (b, a) if newer else (a, b)
    media = lambda p: [x.strip() for x in [p["image_url"], *(p["gallery_images"] or [])] if x and x.strip()]
    seller = a if better(a, b) else b
    every = list(dict.fromkeys(media(base) + ([] if apart else media(other))))
    out = dict(base, season_label=(base["season_label"] or "").strip() or (other["season_label"] or "").strip() or None)
    out |= {k: seller[k] for k in ("sizes", "price_from", "affiliate_url", "is_active", "store_code", "source_product_id")}
    return out | {"seller": seller.get("seller", seller["id"]), "image_url": (every or [base["image_url"] or other["image_url"]])[0], "gallery_images": every[1:]}


def offers(rng, groups):
    for g in range(groups):
        for place in range(1, rng.randint(1, 5) + 1):
            size = [(rng.choice([0, 40, None]), rng.choice([None, 70])) for _ in range(rng.randint(0, 3))]
            yield (f"g{g}", f"id-{g}-{place}", place, rng.choice([None, " ", "2023/2024", "2024/2025", "2025"]), rng.choice([None, 0, 100, 200]), f"u{place}", rng.choice([True, False]),
                   rng.choice(["i1", " i2 ", "i3"]), rng.choice([None, [], ["i1", " ", "g1"], ["g2", "i3"]]), rng.choice([None, "", "twin"]), rng.choice([None, 0, 5]), rng.choice(["a", "b"]), str(rng.randint(1, 20)), rng.choice([None, size, size]))


def test_merge_is_the_fold(spark):
    rows = list(offers(random.Random(7), 120))
    df = spark.createDataFrame(rows + rows[:9], OFFER).repartition(4)
    got = {r.g: r for r in identity_plan.merged_offers(df, ["g"]).collect()}
    for g, own in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[2])), key=lambda r: r[0]):
        own = [dict(zip(NAMES, r, strict=True)) for r in own]
        want = functools.reduce(fold, own)
        assert (got[g].base, got[g].n_offers, got[g].season_label, got[g].price_from, got[g].affiliate_url, got[g].is_active, got[g].n_sizes) == (want["id"], len(own), want["season_label"], want["price_from"], want["affiliate_url"], want["is_active"], len(want["sizes"] or [])), g
        assert got[g].seller == want.get("seller", want["id"]) and got[g].image_url == want["image_url"] and got[g].gallery_images == want["gallery_images"], g


IMPORT = "id string, slug string, brand string, model_name string, board_line string, season_label string, affiliate_url string, source_url string, is_active boolean, price_from int, image_url string, gallery_images array<string>, shape_type string, flex int"
SIZE = "product_id string, size_cm double, size_label string, recommended_weight_min int, recommended_weight_max int, is_available boolean"
STORED = "slug string, id string, ref string, store_code string, source_product_id string, source_key string, board_line string, season string, variant string, affiliate_url string"


def imported(n, line="men", slug="boards-one", season="2024/2025", active=True, price=100, model="One"):
    store = "https://www.traektoria.ru/product/%d_x/" if n < 100 else "https://trial-sport.ru/goods/51/%d.html"
    return (f"i{n}", slug, "Boards", model, line, season, store % n if n else "https://elsewhere.test/", None, active, price, f"img{n}", [f"img{n}", "shared"], "twin", 5)


def plan_of(spark, offers, stored=(), official=()):
    o = identity.offer_identities(spark.createDataFrame(offers, IMPORT))
    sizes = spark.createDataFrame([(r[0], 150.0 + i, None, 50, None, True) for r in offers for i in range(2)], SIZE)
    return identity_plan.identity_plan(o, sizes, spark.createDataFrame(list(stored), STORED), spark.createDataFrame(list(official), "slug string, board_line string"))


def test_a_plan_of_two_stores(spark):
    plan = plan_of(spark, [imported(1), imported(101, price=90), imported(2, "women"), imported(0)], [("boards-one", "s1", "i1", "traektoria", "1", "traektoria|1", "men", "2024 2025", None, "https://www.traektoria.ru/product/1_x/")])
    got = {r.slug: r for r in plan.assignments.collect()}
    assert set(got) == {"boards-one", "boards-one-women"}
    one = got["boards-one"]
    assert (one.reason, one.members, one.seller, one.price_from, one.n_offers, one.gallery_images) == ("base-source-offer:coherent-existing-base", "traektoria|1,trial-sport|101", "i101", 90, 2, ["shared", "img101"])
    group = plan.groups.collect()[0]
    assert (group["class"], group.offers, group.clusters, group.needs_repair) == ("CONFIRMED_IDENTITY_COLLISION", 3, 2, True)
    assert [(r.base_slug, r.issue) for r in plan.issues.collect()] == [("boards-one", "missing-stable-source-identity")]
    stored = spark.createDataFrame([("boards-one", "traektoria", "traektoria|1"), ("left", "traektoria", "traektoria|9")], "slug string, store_code string, source_key string")
    assert {(r.slug, r.operation) for r in identity_plan.plan_operations(plan, stored).collect()} == {("boards-one", "update"), ("boards-one-women", "insert"), ("left", "inactivate")}


def test_gate(spark):
    plan = plan_of(spark, [imported(1), imported(2, "women")])
    again = plan_of(spark, [imported(2, "women"), imported(1)])
    assert plan.hash().first() == again.hash().first() != plan_of(spark, [imported(1), imported(2, "men")]).hash().first()
    d = lambda *rows: spark.createDataFrame(list(rows), "base_slug string, decision string, reasons array<string>")
    review, auto, block = d(("boards-one", "REVIEW", ["X"])), d(("boards-one", "AUTO", ["Y"])), d(("boards-one", "BLOCK", ["Z"]))
    seen = identity_plan.review_hash(review, plan).first().hash
    other = identity_plan.review_hash(d(("boards-one", "REVIEW", ["W"])), plan).first().hash
    assert identity_plan.gate(block, plan) == identity_plan.BLOCKED
    assert identity_plan.gate(review, plan) == identity_plan.REQUIRED
    assert identity_plan.gate(review, plan, "F" * 64) == identity_plan.MALFORMED
    assert identity_plan.gate(review, plan, other) == identity_plan.MISMATCH
    assert identity_plan.gate(auto, plan, seen) == identity_plan.STALE
    assert identity_plan.gate(review, plan, seen) is None and identity_plan.gate(auto, plan) is None
    assert identity_plan.gate(review, plan, seen, "0" * 32) == identity_plan.DIAGNOSTIC


def test_rounds_do_not_grow_the_plan(spark, monkeypatch):
    """Twelve clusters ask for the same names one after the other."""
    sizes = []
    put = Rounds.put

    def seen(self, df, name):
        if name.startswith("names"):
            sizes.append(len(df._jdf.queryExecution().analyzed().toString()))
        return put(self, df, name)

    monkeypatch.setattr(Rounds, "put", seen)
    schema = "id string, base_slug string, cluster int, store_code string, source_product_id string, source_key string, board_line string, season string, variant string"
    stored = [(f"taken-{k}", f"shop:{k}", "men", None, None) for k in range(1)]
    members = spark.createDataFrame([(f"a-{k}", "a", k, "shop", str(k), f"shop:{k}", "men", f"s{k // 2}", None) for k in range(12)], schema)
    plan = identity_plan.slug_plan(members, spark.createDataFrame(stored, "slug string, source_key string, board_line string, season string, variant string"), spark.createDataFrame([], "slug string, board_line string"))
    assert len({r.slug for r in plan.collect()}) == 12 and len(sizes) > 1 and max(sizes[1:]) < 3000


def test_clusters_of_copies(spark):
    """Copies of an offer share its cluster however many there are; a first fit over all of them gives the same."""
    rng = random.Random(2)
    rows = [imported(rng.choice([1, 2, 3, 101, 102]), rng.choice(["men", "women", "unisex"]), season=rng.choice(["2024/2025", "2023/2024", None]), model=rng.choice(["One", "One Wide"])) for _ in range(60)]
    rows = [(f"{r[0]}-{i:03}", *r[1:]) for i, r in enumerate(rows)]
    i = identity.offer_identities(spark.createDataFrame(rows, IMPORT))
    every = [r.asDict() for r in i.collect()]
    order = lambda r: (r["store_code"], int(r["source_product_id"]), r["board_line"], r["season"] or "", r["variant"] or "", r["id"])
    found = []
    for r in sorted(every, key=order):
        k = next((k for k, c in enumerate(found) if all(identity._fits(m, r) for m in c)), len(found))
        if k == len(found):
            found.append([])
        found[k].append(r)
    want = {r["id"]: k for k, c in enumerate(found) for r in c}
    assert {r.id: r.cluster for r in identity.clusters(i).collect()} == want and len(found) > 4
    assert identity.clusters(i).where(F.col("clusters") != len(found)).isEmpty()
