"""Slugs of clusters: base choice, endings, and names asked for by several."""

from firnline.operators import identity_plan as plan

MEMBER = "id string, base_slug string, cluster int, store_code string, source_product_id string, source_key string, board_line string, season string, variant string"
STORED = "slug string, source_key string, board_line string, season string, variant string"


def member(base, cluster, key, line="men", season=None, variant=None):
    return (f"{base}-{key}", base, cluster, "shop", key, f"shop:{key}", line, season, variant)


def slugs(spark, members, stored=(), official=()):
    m = spark.createDataFrame(members, MEMBER)
    s, o = spark.createDataFrame(list(stored), STORED), spark.createDataFrame(list(official), "slug string, board_line string")
    return {(r.base_slug, r.cluster): (r.slug, r.reason) for r in plan.slug_plan(m, s, o).collect()}


def test_without_stored_offers(spark):
    got = slugs(spark, [member("a", 0, "1"), member("a", 1, "2", "women"), member("a", 2, "3", "men", "2024"), member("b", 0, "4")])
    assert got == {("a", 0): ("a", "base-source-offer"), ("a", 1): ("a-women", "collision-suffix:women"), ("a", 2): ("a-2024", "collision-suffix:2024"), ("b", 0): ("b", "base-source-offer")}


def test_official_line_keeps_the_base(spark):
    got = slugs(spark, [member("a", 0, "1"), member("a", 1, "2", "women")], official=[("a", "women")])
    assert got[("a", 1)] == ("a", "base-source-offer") and got[("a", 0)] == ("a-men", "collision-suffix:men")


def test_stored_owner_keeps_the_base(spark):
    stored = [("a", "shop:2", "women", None, None), ("old", "shop:3", "men", None, None)]
    got = slugs(spark, [member("a", 0, "1"), member("a", 1, "2", "women"), member("a", 2, "3")], stored)
    assert got[("a", 1)] == ("a", "base-source-offer") and got[("a", 2)] == ("old", "stable-existing-source-slug")
    assert got[("a", 0)] == ("a-shop-1", "collision-suffix:shop-1")


def test_a_base_that_nobody_continues_is_reserved(spark):
    got = slugs(spark, [member("a", 0, "1"), member("a", 1, "2", "women")], [("a", "shop:9", "men", None, None)])
    assert got[("a", 0)] == ("a-shop-1", "collision-suffix:shop-1") and got[("a", 1)] == ("a-women", "collision-suffix:women")


def test_names_that_several_ask_for(spark):
    got = slugs(spark, [member("a", 0, "1"), member("a", 1, "2", season="s"), member("a", 2, "3", season="s"), member("a", 3, "4", season="s")])
    assert [got[("a", k)][0] for k in range(4)] == ["a", "a-s", "a-shop-3", "a-shop-4"]
    taken = slugs(spark, [member("a", 0, "1"), member("a", 1, "2", season="s")], [("a-s", "shop:77", "men", None, None)])
    assert taken[("a", 1)] == ("a-shop-2", "collision-suffix:shop-2")


def test_a_cluster_that_continues_two_is_blocked(spark):
    stored = [("x", "shop:2", "men", None, None), ("y", "shop:3", "men", None, None)]
    got = slugs(spark, [member("a", 0, "1"), member("a", 1, "2"), member("a", 1, "3")], stored)
    assert got[("a", 1)] == (None, "blocking-existing-identity-duplication") and slugs(spark, []) == {}
