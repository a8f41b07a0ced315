"""DuckDB SQL of the identity queries: offers, clusters and names one by one, by recursion over lists."""

from firnline.plans.oracle_catalog import PROD


def _off(foreign: bool) -> str:
    store = "CASE WHEN k % 41 = 0 THEN NULL WHEN k % 2 = 0 THEN 'traektoria' ELSE 'trial-sport' END" if foreign else "CASE WHEN k % 2 = 0 THEN 'traektoria' ELSE 'trial-sport' END"
    return f"""raw AS (
  SELECT k, g, 'id-' || k AS id, 'o-' || CASE WHEN k % 9 = 0 THEN k ELSE g END AS base_slug, 'make ' || (g // 5) AS n_brand, g % 6 = 0 AND k % 4 = 3 AS is_wide,
    CASE g % 3 WHEN 0 THEN CASE k % 2 WHEN 0 THEN 'men' ELSE 'women' END WHEN 1 THEN 'men' ELSE 'unisex' END AS line,
    CASE WHEN g % 5 <> 0 THEN '24/25' WHEN k % 2 = 0 THEN '2023/2024' ELSE '2024/2025' END AS season_label, {store} AS store,
    CASE WHEN k % 2 = 0 THEN k + 1000 ELSE k // 8 * 8 + 7 END AS num
  FROM (SELECT p_partkey AS k, p_partkey // 4 AS g FROM part)),
off AS (
  SELECT *, 'model ' || g || CASE WHEN is_wide THEN ' wide' ELSE '' END AS n_model, CASE WHEN is_wide THEN 'wide' END AS variant, store || '|' || num AS key, line IN ('men', 'women') AS known,
    CASE season_label WHEN '2023/2024' THEN '2023 2024' ELSE '2024 2025' END AS season,
    CASE store WHEN 'traektoria' THEN 'https://www.traektoria.ru/product/' || num || '_x/' WHEN 'trial-sport' THEN 'https://trial-sport.ru/goods/51/' || num || '.html' ELSE 'https://elsewhere.test/x' END AS url
  FROM raw)"""


#: An offer joins the first cluster of which it fits every member.
CLUSTERS = """ord AS (SELECT *, row_number() OVER (PARTITION BY base_slug ORDER BY store, num, line, season, coalesce(variant, ''), id) AS pos FROM off WHERE store IS NOT NULL),
cl AS (
  SELECT base_slug, CAST(0 AS BIGINT) AS pos, CAST([] AS STRUCT(c BIGINT, id VARCHAR, n_brand VARCHAR, n_model VARCHAR, variant VARCHAR, store VARCHAR, num BIGINT, key VARCHAR, line VARCHAR, known BOOLEAN, season VARCHAR)[]) AS st FROM (SELECT DISTINCT base_slug FROM ord)
  UNION ALL
  SELECT o.base_slug, o.pos, list_append(st, {'c': list_filter(range(0, len(st) + 1), lambda i: len(list_filter(st, lambda m: m.c = i AND NOT (
      m.n_brand = o.n_brand AND m.n_model = o.n_model AND m.variant IS NOT DISTINCT FROM o.variant AND NOT (m.store = o.store AND m.num <> o.num)
      AND CASE WHEN m.known AND o.known THEN m.line = o.line ELSE m.key = o.key END AND m.season = o.season))) = 0)[1],
    'id': o.id, 'n_brand': o.n_brand, 'n_model': o.n_model, 'variant': o.variant, 'store': o.store, 'num': o.num, 'key': o.key, 'line': o.line, 'known': o.known, 'season': o.season})
  FROM cl JOIN ord o ON o.base_slug = cl.base_slug AND o.pos = cl.pos + 1),
mem AS (SELECT o.*, x.c FROM (SELECT base_slug, unnest(arg_max(st, pos)) AS x FROM cl GROUP BY base_slug) u JOIN ord o ON o.base_slug = u.base_slug AND o.id = x.id)"""

CLASSES = """gc AS (SELECT base_slug, count(*) AS offers, max(c) + 1 AS clusters, count(DISTINCT season) AS seasons, count(DISTINCT line) FILTER (WHERE known) AS lines, count(DISTINCT coalesce(variant, '')) AS variants FROM mem GROUP BY 1),
ids AS (SELECT base_slug, max(n) AS ids FROM (SELECT base_slug, store, count(DISTINCT num) AS n FROM mem GROUP BY 1, 2) GROUP BY 1),
classes AS (SELECT base_slug, offers, clusters, CASE WHEN offers <= 1 THEN 'NO_CONFLICT' WHEN clusters = 1 THEN 'SAFE_SAME_PRODUCT_MULTI_SOURCE' WHEN seasons > 1 AND NOT (lines > 1 OR variants > 1) THEN 'POTENTIAL_IDENTITY_COLLISION'
  WHEN lines > 1 OR variants > 1 OR ids > 1 THEN 'CONFIRMED_IDENTITY_COLLISION' ELSE 'POTENTIAL_IDENTITY_COLLISION' END AS class FROM gc JOIN ids USING (base_slug))"""

STORED = """st AS (
  SELECT slug, id, CASE WHEN g % 2 = 0 THEN 'id-' || (k + 1) ELSE id END AS ref, CASE WHEN linked THEN store END AS store, CASE WHEN linked THEN store || '|' || CASE WHEN starts_with(slug, 'gone-') THEN '9' || num ELSE CAST(num AS VARCHAR) END END AS key,
    CASE WHEN g % 7 = 3 AND g % 2 = 0 THEN 'women' ELSE line END AS line, season, variant, CASE WHEN linked THEN url ELSE 'https://elsewhere.test/x' END AS url
  FROM (
    SELECT off.*, 'o-' || g AS slug, TRUE AS linked FROM off WHERE store IS NOT NULL AND ((g % 7 = 1 AND k % 4 = 2) OR (g % 7 = 5 AND k % 4 IN (0, 2)))
    UNION ALL SELECT off.*, 'o-' || g, FALSE FROM off WHERE store IS NOT NULL AND g % 7 = 2 AND k % 4 = 0
    UNION ALL SELECT off.*, 'old-' || g, TRUE FROM off WHERE store IS NOT NULL AND g % 7 IN (3, 6) AND k % 4 = 0
    UNION ALL SELECT off.*, 'older-' || g, TRUE FROM off WHERE store IS NOT NULL AND g % 7 = 6 AND k % 4 = 0
    UNION ALL SELECT off.*, 'o-' || g || '-traektoria-' || (k + 1002), TRUE FROM off WHERE store IS NOT NULL AND g % 7 = 4 AND k % 4 = 0
    UNION ALL SELECT off.*, 'gone-' || g, TRUE FROM off WHERE store IS NOT NULL AND g % 11 = 0 AND k % 4 = 2)),
spec AS (SELECT DISTINCT 'o-' || (p_partkey // 4) AS slug, CASE WHEN p_partkey // 4 % 3 = 0 THEN 'women' ELSE 'men' END AS line FROM part WHERE p_partkey // 4 % 4 = 0)"""

NAMES = """ci AS (SELECT base_slug, c, CASE WHEN bool_and(known) AND count(DISTINCT line) = 1 THEN min(line) END AS line, CASE WHEN count(variant) = count(*) AND count(DISTINCT variant) = 1 THEN min(variant) END AS variant,
  CASE WHEN count(DISTINCT season) = 1 THEN min(season) END AS season, list_sort(list(DISTINCT store || '-' || num)) AS tokens FROM mem GROUP BY 1, 2),
hit AS (SELECT DISTINCT s.slug, m.base_slug, m.c FROM mem m JOIN st s ON m.key = s.key AND m.line = s.line AND m.variant IS NOT DISTINCT FROM s.variant AND m.season = s.season),
own AS (SELECT slug AS base_slug, count(*) AS owners, max(key) AS key, max(line) AS line, max(variant) AS variant, max(season) AS season FROM st GROUP BY 1),
cont AS (SELECT base_slug, count(*) AS n, min(c) AS which FROM hit WHERE slug = base_slug GROUP BY 1),
ofl AS (SELECT ci.base_slug, count(*) AS n, min(c) AS which FROM ci JOIN spec ON spec.slug = ci.base_slug AND spec.line = ci.line GROUP BY 1),
ch AS (SELECT b.base_slug, own.owners, own.line AS o_line, own.variant AS o_variant, own.season AS o_season,
    CASE WHEN own.owners IS NOT NULL THEN CASE WHEN own.owners = 1 AND own.key IS NOT NULL AND cont.n = 1 THEN cont.which END WHEN ofl.n = 1 THEN ofl.which ELSE 0 END AS base,
    CASE WHEN own.owners IS NOT NULL THEN CASE WHEN own.owners = 1 AND own.key IS NOT NULL AND cont.n = 1 THEN 'coherent-existing-base' ELSE 'historical-base-reserved' END WHEN ofl.n = 1 THEN 'official-spec-board-line' ELSE 'deterministic-source-order' END AS why,
    CASE WHEN own.owners > 1 THEN 'multiple_owners' WHEN own.owners IS NOT NULL AND own.key IS NULL THEN 'owner_without_identity' WHEN cont.n > 1 AND own.owners IS NOT NULL THEN 'multiple_clusters' END AS issue
  FROM (SELECT DISTINCT base_slug FROM mem) b LEFT JOIN own USING (base_slug) LEFT JOIN cont USING (base_slug) LEFT JOIN ofl USING (base_slug)),
prior AS (SELECT base_slug, c, list_sort(list(DISTINCT slug)) AS old FROM hit WHERE slug <> base_slug GROUP BY 1, 2),
j AS (SELECT ci.*, ch.base, ch.why, coalesce(old, []) AS old, (SELECT count(*) FROM ci x WHERE x.base_slug = ci.base_slug AND x.line = ci.line) AS same_line,
    CASE WHEN ch.base IS NULL THEN CASE WHEN ch.owners = 1 THEN ch.o_line END ELSE r.line END AS r_line, CASE WHEN ch.base IS NULL THEN CASE WHEN ch.owners = 1 THEN ch.o_variant END ELSE r.variant END AS r_variant,
    CASE WHEN ch.base IS NULL THEN CASE WHEN ch.owners = 1 THEN ch.o_season END ELSE r.season END AS r_season
  FROM ci JOIN ch USING (base_slug) LEFT JOIN prior USING (base_slug, c) LEFT JOIN ci r ON r.base_slug = ci.base_slug AND r.c = ch.base),
j2 AS (SELECT *, list_transform(list_filter(list_concat([CASE WHEN same_line = 1 AND line IS DISTINCT FROM r_line THEN line END, CASE WHEN variant IS DISTINCT FROM r_variant THEN variant END, CASE WHEN season IS DISTINCT FROM r_season THEN replace(season, ' ', '-') END], tokens), lambda x: x IS NOT NULL), lambda x: {'slug': base_slug || '-' || x, 'reason': 'collision-suffix:' || x}) AS ends,
    (SELECT coalesce(list(slug), []) FROM st) AS taken, coalesce(mine, []) AS mine FROM j LEFT JOIN (SELECT base_slug, c, list(slug) AS mine FROM hit GROUP BY 1, 2) USING (base_slug, c)),
j3 AS (SELECT *, row_number() OVER (ORDER BY base_slug, c) AS i, CASE WHEN len(old) > 1 THEN [] ELSE list_concat(
    CASE WHEN len(old) = 1 THEN [{'slug': old[1], 'reason': 'stable-existing-source-slug'}] ELSE [] END,
    CASE WHEN c = base THEN [{'slug': base_slug, 'reason': 'base-source-offer'}] ELSE list_filter(ends, lambda e: NOT list_contains(taken, e.slug) OR list_contains(mine, e.slug)) END) END AS cands FROM j2),
given AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS STRUCT(slug VARCHAR, reason VARCHAR)) AS x
  UNION ALL
  SELECT n.i, list_append(held, y.slug), y FROM (SELECT i, held, list_filter(cands, lambda e: NOT list_contains(held, e.slug))[1] AS y FROM (
    SELECT j3.i, cands, CASE WHEN j3.c = 0 AND j3.base IS NULL THEN list_append(used, j3.base_slug) ELSE used END AS held FROM given JOIN j3 ON j3.i = given.i + 1)) n),
slugs AS (SELECT j3.base_slug, j3.c, base, why, x.slug AS slug, coalesce(x.reason, CASE WHEN len(old) > 1 THEN 'blocking-existing-identity-duplication' ELSE 'blocking-no-safe-slug' END) AS reason FROM j3 JOIN given USING (i))"""

SIZES = """sz AS (SELECT product_id, count(*) AS n, 10 * count(*) + 8 * count(*) FILTER (WHERE wmin > 0 OR wmax IS NOT NULL) AS pts,
  list({'l': coalesce(size_label, CAST(size_cm AS VARCHAR)), 'c': size_cm, 'a': is_available} ORDER BY size_cm, coalesce(size_label, CAST(size_cm AS VARCHAR)), wmin, wmax, is_available) AS seen,
  to_json(list({'l': coalesce(size_label, CAST(size_cm AS VARCHAR)), 'c': size_cm, 'x': wmin, 'y': wmax, 'a': is_available} ORDER BY size_cm, coalesce(size_label, CAST(size_cm AS VARCHAR)), wmin, wmax, is_available)) AS matrix FROM siz GROUP BY 1)"""

#: The product so far meets the next offer: the more complete one describes, the better seller sells.
MERGE = """mo AS (
  SELECT m.base_slug, m.c, m.id, m.season_label, p.is_active AS act, p.price_from > 0 AS priced, p.price_from, coalesce(sz.n, 0) AS n_sizes, coalesce(sz.pts, 0) AS s_pts, CASE WHEN p.is_active THEN 3 ELSE 0 END AS a_pts,
    CASE WHEN length(p.shape_type) > 0 THEN 4 ELSE 0 END + CASE WHEN p.flex <> 0 THEN 3 ELSE 0 END AS d_pts, p.image_url, p.gallery2, m.num, m.store,
    row_number() OVER (PARTITION BY m.base_slug, m.c ORDER BY m.store, m.num, m.line, m.season, coalesce(m.variant, ''), m.id) AS pos, dense_rank() OVER (PARTITION BY m.base_slug, m.c ORDER BY m.store, m.num) AS tie
  FROM mem m JOIN prod p ON p.id = m.id LEFT JOIN sz ON sz.product_id = m.id),
fold AS (
  SELECT base_slug, c, pos, id AS base_id, id AS seller, season_label, act, priced, price_from, n_sizes, s_pts, a_pts, d_pts, tie, [image_url, gallery2] AS media, image_url || ', , ' || gallery2 AS gallery, image_url FROM mo WHERE pos = 1
  UNION ALL
  SELECT f.base_slug, f.c, r.pos, CASE WHEN newer THEN r.id ELSE f.base_id END, CASE WHEN keeps THEN f.seller ELSE r.id END, CASE WHEN newer THEN r.season_label ELSE f.season_label END,
    CASE WHEN keeps THEN f.act ELSE r.act END, CASE WHEN keeps THEN f.priced ELSE r.priced END, CASE WHEN keeps THEN f.price_from ELSE r.price_from END, CASE WHEN keeps THEN f.n_sizes ELSE r.n_sizes END, CASE WHEN keeps THEN f.s_pts ELSE r.s_pts END, CASE WHEN keeps THEN f.a_pts ELSE r.a_pts END,
    CASE WHEN newer THEN r.d_pts ELSE f.d_pts END, CASE WHEN keeps THEN f.tie ELSE r.tie END, med, array_to_string(med[2:], ','), med[1]
  FROM (SELECT f AS f, r AS r, newer, row(NOT f.act, NOT f.priced, CASE WHEN f.priced THEN f.price_from ELSE 0 END, -(f.d_pts + f.s_pts + f.a_pts), f.tie) <= row(NOT r.act, NOT r.priced, CASE WHEN r.priced THEN r.price_from ELSE 0 END, -(r.d_pts + r.s_pts + r.a_pts), r.tie) AS keeps,
      CASE WHEN newer THEN list_concat([r.image_url, r.gallery2], list_filter(f.media, lambda x: NOT list_contains([r.image_url, r.gallery2], x))) ELSE list_concat(f.media, list_filter([r.image_url, r.gallery2], lambda x: NOT list_contains(f.media, x))) END AS med
    FROM (SELECT f, r, r.d_pts + r.s_pts + r.a_pts > f.d_pts + f.s_pts + f.a_pts AS newer FROM fold f JOIN mo r ON r.base_slug = f.base_slug AND r.c = f.c AND r.pos = f.pos + 1))),
merged AS (SELECT base_slug, c, arg_max(fold, pos) AS x, max(pos) AS n FROM fold GROUP BY 1, 2),
keys AS (SELECT base_slug, c, string_agg(key, ',' ORDER BY store, num) AS members FROM (SELECT DISTINCT base_slug, c, key, store, num FROM mem) GROUP BY 1, 2),
asg AS (SELECT s.base_slug, s.c, s.slug, CASE WHEN s.c = s.base THEN s.reason || ':' || s.why ELSE s.reason END AS reason, x, n, members FROM slugs s JOIN merged m ON m.base_slug = s.base_slug AND m.c = s.c JOIN keys k ON k.base_slug = s.base_slug AND k.c = s.c WHERE s.slug IS NOT NULL)"""

GROUPS = """rep AS (
  SELECT a.base_slug, a.c, bool_or(coalesce(s.key = m.key AND s.line = m.line AND s.season = m.season AND s.variant IS NOT DISTINCT FROM m.variant AND s.url = m.url AND to_json(s1.seen) IS NOT DISTINCT FROM to_json(s2.seen), FALSE)) AS kept
  FROM asg a JOIN mem m ON m.base_slug = a.base_slug AND m.c = a.c LEFT JOIN st s ON s.slug = a.slug LEFT JOIN sz s1 ON s1.product_id = m.id LEFT JOIN sz s2 ON s2.product_id = s.ref GROUP BY 1, 2),
app AS (SELECT a.base_slug, string_agg(a.slug, ',' ORDER BY a.slug) AS s FROM asg a JOIN spec ON spec.slug = a.base_slug WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.base_slug = a.base_slug AND m.c = a.c AND m.line <> spec.line) GROUP BY 1),
grp AS (SELECT base_slug, class, offers, clusters, coalesce((SELECT NOT bool_and(kept) FROM rep WHERE rep.base_slug = classes.base_slug), FALSE) AS needs_repair, spec.line AS official_line, CASE WHEN spec.slug IS NOT NULL THEN coalesce(app.s, '') END AS official_slugs
  FROM classes LEFT JOIN spec ON spec.slug = classes.base_slug LEFT JOIN app USING (base_slug)),
iss AS (SELECT base_slug, reason AS issue FROM slugs WHERE slug IS NULL UNION SELECT base_slug, 'missing-stable-source-identity' FROM off WHERE store IS NULL UNION SELECT base_slug, issue FROM ch WHERE issue IS NOT NULL),
ops AS (
  SELECT a.slug, CASE WHEN EXISTS (SELECT 1 FROM st WHERE st.slug = a.slug) THEN 'update' ELSE 'insert' END AS operation, class FROM asg a JOIN classes USING (base_slug) WHERE class <> 'NO_CONFLICT'
  UNION ALL SELECT DISTINCT slug, 'inactivate', NULL FROM st WHERE store IS NOT NULL AND NOT EXISTS (SELECT 1 FROM asg WHERE asg.slug = st.slug)
  UNION ALL SELECT a.slug, 'rename', class FROM asg a JOIN classes USING (base_slug) JOIN st ON st.key = a.members WHERE class = 'NO_CONFLICT' GROUP BY 1, 3 HAVING NOT bool_or(st.slug = a.slug))"""

PLAN = f"WITH RECURSIVE {PROD}, {_off(True)}, {CLUSTERS}, {CLASSES}, {STORED}, {NAMES}, {SIZES}, {MERGE}, {GROUPS}"
PLAIN = f"WITH RECURSIVE {_off(False)}, {CLUSTERS}, {CLASSES}"

AUDIT = f"""{PLAN}, sig AS (SELECT base_slug, count(DISTINCT line) > 1 AS lines, count(DISTINCT season) > 1 AS seasons, count(DISTINCT coalesce(matrix, '[]')) > 1 AS sizes FROM mem LEFT JOIN sz ON sz.product_id = mem.id GROUP BY 1),
flags AS (SELECT grp.*, sig.lines, sig.seasons, sig.sizes FROM grp JOIN sig USING (base_slug))
SELECT 'class' AS kind, class AS value, count(*) AS n FROM grp GROUP BY 2
UNION ALL SELECT 'signal', s, count(*) FROM (SELECT unnest(list_filter([CASE WHEN lines THEN 'lines' END, CASE WHEN offers > clusters OR clusters > 1 THEN 'shared_slug' END, CASE WHEN seasons THEN 'seasons' END, CASE WHEN sizes THEN 'sizes' END,
    CASE WHEN official_slugs = '' OR contains(official_slugs, ',') THEN 'official_ambiguous' END, CASE WHEN class = 'CONFIRMED_IDENTITY_COLLISION' AND needs_repair THEN 'unrepaired_collision' END], lambda x: x IS NOT NULL)) AS s FROM flags) GROUP BY 2
UNION ALL SELECT 'issue', issue, count(*) FROM iss GROUP BY 2
UNION ALL SELECT operation, coalesce(class, 'none'), count(*) FROM ops GROUP BY 1, 2"""

#: Stored offers, every fifth under another name now; flags of offers and of slugs, of which the gravest decide.
AUTHORIZE = f"""{PLAIN},
me AS (SELECT *, base_slug || CASE WHEN c > 0 THEN '-' || c ELSE '' END AS assigned FROM mem),
o0 AS (SELECT id, assigned AS slug, n_brand, CASE WHEN k % 5 = 0 THEN 'another' ELSE n_model END AS n_model, variant, line, known, season, key, k % 10 = 0 AS manual FROM me WHERE k % 4 <> 1),
ow AS (SELECT * FROM o0 WHERE id IN (SELECT min(id) FROM o0 GROUP BY slug)),
us AS (SELECT key, count(DISTINCT assigned) AS uses FROM me GROUP BY 1), cm AS (SELECT key, count(*) AS claims FROM ow GROUP BY 1),
blocks AS (
  SELECT me.base_slug, unnest(list_filter([CASE WHEN uses > 1 THEN 'DUPLICATE_SOURCE_KEY_PROPOSAL' END, CASE WHEN claims > 1 THEN 'MULTIPLE_CLUSTERS_CLAIM_HISTORICAL_IDENTITY' END, CASE WHEN w.n_brand <> me.n_brand THEN 'SOURCE_ID_REUSE_BRAND_CONFLICT' END, CASE WHEN w.n_model <> me.n_model THEN 'SOURCE_ID_REUSE_MODEL_CONFLICT' END,
    CASE WHEN w.known AND me.known AND w.line <> me.line THEN 'SOURCE_ID_REUSE_BOARD_LINE_CONFLICT' END, CASE WHEN w.season <> me.season THEN 'SOURCE_ID_REUSE_SEASON_CONFLICT' END, CASE WHEN w.id IS NOT NULL AND w.variant IS DISTINCT FROM me.variant THEN 'SOURCE_ID_REUSE_VARIANT_CONFLICT' END], lambda x: x IS NOT NULL)) AS reason, 2 AS level
  FROM me LEFT JOIN ow w ON w.key = me.key LEFT JOIN us ON us.key = me.key LEFT JOIN cm ON cm.key = me.key),
fi AS (SELECT base_slug, assigned, count(*) AS n, arg_min(me, id) AS f, list(DISTINCT key) AS keys, bool_and(known) AND count(DISTINCT row(n_brand, n_model, line, season, coalesce(variant, ''))) = 1 AS complete FROM me GROUP BY 1, 2),
x AS (
  SELECT fi.*, w.slug IS NOT NULL AS owned, coalesce(list_contains(keys, w.key), FALSE) AS exact, w.manual, w.n_brand = f.n_brand AS same_brand, assigned <> fi.base_slug AND h.slug IS NOT NULL AS suffixed,
    coalesce(h.n_brand = f.n_brand AND trim(regexp_replace(h.n_model, '( ?mid)? ?wide$', '')) = trim(regexp_replace(f.n_model, '( ?mid)? ?wide$', '')) AND ((h.known AND f.known AND h.line <> f.line) OR h.season <> f.season OR h.variant IS DISTINCT FROM f.variant), FALSE) AS kin,
    coalesce(h.n_brand = f.n_brand AND h.n_model = f.n_model AND NOT (h.known AND f.known AND h.line <> f.line) AND h.season = f.season AND h.variant IS NOT DISTINCT FROM f.variant, FALSE) AS public
  FROM fi LEFT JOIN ow w ON w.slug = fi.assigned LEFT JOIN ow h ON h.slug = fi.base_slug),
y AS (SELECT *, suffixed AND n = 1 AND kin AS sibling FROM x),
planned AS (
  SELECT base_slug, unnest(list_filter([CASE WHEN owned AND NOT exact AND manual THEN 'MANUAL_IDENTITY_REASSIGNMENT' END, CASE WHEN owned AND NOT exact AND NOT same_brand THEN 'CROSS_BRAND_SLUG_COLLISION' END, CASE WHEN owned AND NOT exact AND same_brand THEN 'HISTORICAL_BASE_TAKEOVER' END], lambda r: r IS NOT NULL)) AS reason, 2 AS level FROM y
  UNION ALL SELECT base_slug, CASE WHEN n > 1 THEN 'INCOMPLETE_CROSS_STORE_EVIDENCE_REVIEW' ELSE 'COLLISION_SUFFIX_REVIEW' END, 1 FROM y WHERE NOT owned AND ((n > 1 AND NOT sibling AND NOT complete) OR (n = 1 AND suffixed AND public))
  UNION ALL SELECT base_slug, CASE WHEN owned THEN 'STABLE_PROTECTED_IDENTITIES' WHEN sibling THEN 'NEW_PROTECTED_IDENTITY_SUFFIX' WHEN n > 1 THEN 'NEW_CLEAN_MULTI_SOURCE' ELSE 'NEW_CLEAN_SINGLE_SOURCE' END, 0 FROM y
    WHERE (owned AND exact) OR (NOT owned AND (sibling OR (n > 1 AND complete) OR (n = 1 AND NOT (suffixed AND public))))),
every AS (SELECT * FROM blocks UNION ALL SELECT * FROM planned),
worst AS (SELECT base_slug, max(level) AS level FROM every GROUP BY 1)
SELECT base_slug, CASE level WHEN 2 THEN 'BLOCK' WHEN 1 THEN 'REVIEW' ELSE 'AUTO' END AS decision, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM every JOIN worst USING (base_slug, level) GROUP BY 1, level"""

ORACLE = {
    "offer_authorization": AUTHORIZE,
    "offer_clusters": f"{PLAIN} SELECT id, base_slug, CAST(c AS INTEGER) AS cluster, CAST(clusters AS INTEGER) AS clusters FROM mem JOIN gc USING (base_slug)",
    "offer_classes": f"{PLAIN} SELECT base_slug, offers, clusters, class FROM classes",
    "identity_plan_products": f"""{PLAN} SELECT base_slug, CAST(c AS INTEGER) AS cluster, slug, reason, x.base_id AS base, x.seller AS seller, n AS n_offers, x.n_sizes AS n_sizes, x.season_label AS season_label, x.price_from AS price_from, x.act AS is_active, x.image_url AS image_url, x.gallery AS gallery, members FROM asg""",
    "identity_groups": f"{PLAN} SELECT * FROM grp",
    "identity_operations": f"{PLAN} SELECT * FROM ops",
    "identity_audit": AUDIT,
}
