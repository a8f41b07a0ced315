"""DuckDB SQL of reconciliation: the rules over plain rows."""

from firnline.plans.oracle_catalog import _pick

TABLES = f"""g4 AS (SELECT p_partkey AS k, p_partkey // 4 AS g, p_partkey % 4 AS r, p_partkey // 4 % 20 AS c FROM part),
p AS (
  SELECT 'id-' || k AS id, 'p-' || k AS slug, NOT (c BETWEEN 6 AND 10 AND r = 0) AS act, CASE WHEN held OR (c = 19 AND r = 3) THEN 'fam-' || g WHEN c = 18 AND r = 0 THEN 'lost-' || g END AS fam, CASE WHEN held THEN CASE r WHEN 0 THEN 'base' ELSE 'wide' END END AS role,
    (c IN (2, 16) AND r = 0) OR (c = 19 AND r = 3) OR (c = 8 AND r = 2 AND g % 3 = 1) AS hand, CASE WHEN c = 17 AND r = 0 THEN 'manual' WHEN c = 4 AND r = 1 THEN 'other' WHEN held THEN 'audit-high-v1' END AS method, CASE WHEN held THEN 'high' END AS conf,
    CASE WHEN held THEN 'before' END AS reason, CASE WHEN held THEN '2023-01-01T00:00:00Z' END AS matched, g, c
  FROM (SELECT *, c <= 13 AND (r = 0 OR (r = 1 AND c <> 3)) AS held FROM g4)),
m AS (SELECT fam, CASE WHEN c = 5 AND role = 'wide' THEN 'gone-' || g ELSE id END AS pid, slug AS pslug, role, hand, method, conf FROM p WHERE fam IS NOT NULL),
vals AS (SELECT g, c, 'v1|make ' || (g // 5) || '|model ' || g || '|2024/2025' AS key, 'short ' || g AS ds, {_pick('g', ['camber', 'hybrid-camber', None, 'rocker', 'hybrid-rocker', 'flat'])} AS camber, CAST(g % 10 AS INTEGER) AS flex, DATE '2024-01-01' + CAST(g % 28 AS INTEGER) AS checked FROM g4 WHERE r = 0),
f AS (
  SELECT 'fam-' || g AS id, CASE WHEN c = 19 THEN 'held-' || g ELSE key END AS key, CASE WHEN c = 19 THEN 'new-' || g ELSE 'family-' || g END AS slug, 'make ' || (g // 5) AS brand, CASE WHEN g % 60 = 41 THEN 'editorial' ELSE 'fallback-member' END AS kind,
    CASE WHEN c = 1 AND g % 3 <> 0 THEN 'old words' ELSE ds END AS ds, CASE WHEN c = 1 THEN flex + 1 ELSE flex END AS flex, CASE WHEN c = 1 AND g % 3 = 1 THEN NULL ELSE camber END AS camber, CASE WHEN c = 1 AND g % 2 = 1 THEN checked + 1 ELSE checked END AS checked, g, c
  FROM vals WHERE c <= 13 OR c = 19),
cand AS (
  SELECT CASE WHEN c = 9 THEN 'other-' || g ELSE key END AS key, CASE WHEN c = 6 THEN 'next-' || g WHEN c = 12 THEN 'else-' || g WHEN c >= 14 THEN 'new-' || g WHEN c = 8 AND g % 3 = 2 THEN 'family-' || (g + 1) ELSE 'family-' || g END AS slug,
    CASE WHEN c = 7 THEN 'other ' ELSE 'make ' END || (g // 5) AS brand, CASE WHEN c IN (6, 7, 8, 9) THEN 2 ELSE 0 END AS b, CASE WHEN c = 13 OR (c = 8 AND g % 3 = 0) THEN '3' WHEN c = 15 THEN 'gone' ELSE '1' END AS w, ds, flex, camber, checked, g, c FROM vals WHERE c NOT IN (10, 11)
  UNION ALL SELECT 'w-dup-' || g, 'dup-' || g, 'make ' || (g // 5), 0, '3', ds, flex, camber, checked, g, c FROM vals WHERE c = 14 AND g % 40 = 34)"""

RULES = """cm AS (SELECT key, 'id-' || (4 * g + b) AS pid, 'base' AS role FROM cand UNION ALL SELECT key, CASE w WHEN 'gone' THEN 'gone-' || g ELSE 'id-' || (4 * g + CAST(w AS BIGINT)) END, 'wide' FROM cand),
claim AS (SELECT pid, min(key) AS owner, count(*) AS n FROM cm GROUP BY 1),
shape AS (SELECT key, list_sort(list(role || '|' || pid)) AS s, min(pid) FILTER (WHERE role = 'base') AS b, min(pid) FILTER (WHERE role = 'wide') AS w FROM cm GROUP BY 1),
ff AS (SELECT m.fam, count(*) AS n, bool_or(m.hand OR coalesce(m.method = 'manual', FALSE)) AS hand, bool_and(coalesce(NOT m.hand AND m.method = 'audit-high-v1' AND m.conf = 'high', FALSE)) AS auto, list_sort(list(coalesce(m.role, ''))) AS roles, min(m.pid) FILTER (WHERE p.id IS NULL) AS missing,
    bool_or(coalesce(NOT p.act, FALSE)) AS gone, string_agg(m.pid, ',' ORDER BY m.pid) FILTER (WHERE NOT p.act) AS inactive, bool_or(claim.owner IS NOT NULL) AS claimed, list(DISTINCT claim.owner) FILTER (WHERE claim.owner IS NOT NULL) AS owners, list_sort(list(m.role || '|' || m.pid)) AS s,
    min(m.pid) FILTER (WHERE m.role = 'base') AS b, min(m.pid) FILTER (WHERE m.role = 'wide') AS w
  FROM m LEFT JOIN p ON p.id = m.pid LEFT JOIN claim ON claim.pid = m.pid GROUP BY 1),
j AS (SELECT f.*, ff.n, ff.hand, ff.auto, ff.roles, ff.missing, ff.gone, ff.inactive, ff.claimed, ff.s, ff.b, ff.w, c.key AS ckey, c.slug AS cslug, c.brand = f.brand AS same, sh.s AS cs, sh.b AS cb, sh.w AS cw,
    ob.act AS ob_act, nb.id IS NOT NULL AND ob.id IS NOT NULL AND wp.id IS NOT NULL AND cwp.id IS NOT NULL AS all_there, wp.act AS w_act, nb.act AS nb_act, nb.fam AS nb_fam, nb.hand AS nb_hand, coalesce(nb.method, '') = 'manual' AS nb_manual,
    EXISTS (SELECT 1 FROM f o WHERE o.slug = c.slug AND o.id <> f.id) AS taken,
    CASE WHEN f.kind = 'fallback-member' AND c.key IS NOT NULL THEN array_to_string(list_filter([CASE WHEN f.ds <> c.ds THEN 'description_short' END, CASE WHEN f.flex <> c.flex THEN 'flex' END, CASE WHEN f.camber IS DISTINCT FROM c.camber THEN 'camber_profile' END, CASE WHEN f.checked <> c.checked THEN 'source_checked_at' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS fields
  FROM f LEFT JOIN ff ON ff.fam = f.id LEFT JOIN cand c ON c.key = f.key LEFT JOIN shape sh ON sh.key = c.key LEFT JOIN p ob ON ob.id = ff.b LEFT JOIN p wp ON wp.id = ff.w LEFT JOIN p nb ON nb.id = sh.b LEFT JOIN p cwp ON cwp.id = sh.w),
mine AS (SELECT j.*, CASE WHEN hand THEN ['manual', NULL, 'membership'] WHEN coalesce(n, 0) <> 2 THEN ['conflict', 'AUTOMATIC_STRUCTURE_DRIFT', 'members'] WHEN NOT auto THEN ['conflict', 'AUTOMATIC_STRUCTURE_DRIFT', 'provenance'] WHEN roles <> ['base', 'wide'] THEN ['conflict', 'AUTOMATIC_STRUCTURE_DRIFT', 'roles']
    WHEN missing IS NOT NULL THEN ['conflict', 'MISSING_MEMBER', missing]
    WHEN gone AND ckey IS NOT NULL THEN CASE WHEN NOT same THEN ['conflict', 'IDENTITY_DRIFT', 'names'] WHEN NOT all_there THEN ['conflict', 'AUTOMATIC_CONTINUITY_UNSAFE', 'product is missing'] WHEN ob_act THEN ['conflict', 'AUTOMATIC_CONTINUITY_UNSAFE', 'old base is not inactive']
      WHEN cw <> w OR NOT w_act THEN ['conflict', 'AUTOMATIC_CONTINUITY_UNSAFE', 'wide is not preserved'] WHEN b = cb THEN ['conflict', 'AUTOMATIC_CONTINUITY_UNSAFE', 'old base is not replaceable'] WHEN NOT nb_act OR nb_fam IS NOT NULL OR nb_hand OR nb_manual THEN ['conflict', 'AUTOMATIC_CONTINUITY_UNSAFE', 'new base is not free']
      WHEN taken THEN ['conflict', 'AUTOMATIC_CONTINUITY_UNSAFE', 'slug belongs to another family'] ELSE ['continuity', NULL, b || '>' || cb] END
    WHEN gone AND claimed THEN ['conflict', 'IDENTITY_DRIFT', 'claimed'] WHEN gone THEN ['retained', NULL, inactive] WHEN ckey IS NULL THEN ['conflict', 'ACTIVE_FAMILY_NOT_HIGH', 'absent'] WHEN NOT same OR slug <> cslug THEN ['conflict', 'IDENTITY_DRIFT', 'display']
    WHEN s <> cs THEN ['conflict', 'MEMBERSHIP_DRIFT', 'members'] ELSE ['compatible', NULL, NULL] END AS v FROM j),
handled AS (SELECT key FROM f UNION SELECT unnest(owners) FROM ff JOIN f ON f.id = ff.fam),
opened AS (SELECT cm.key, bool_or(p.id IS NULL) AS absent, bool_or(p.hand AND p.fam IS NULL) AS blocked, bool_or(p.hand OR coalesce(p.method = 'manual', FALSE)) AS by_hand, bool_or(p.fam IS NOT NULL) AS assigned FROM cm LEFT JOIN p ON p.id = cm.pid GROUP BY 1),
holder AS (SELECT slug, min(id) AS id FROM f GROUP BY 1),
fresh AS (SELECT cand.*, CASE WHEN absent THEN ['conflict', 'MISSING_CANDIDATE_PRODUCT', 'product'] WHEN blocked THEN ['manual_blocked', NULL, 'block'] WHEN by_hand THEN ['manual', NULL, 'candidate'] WHEN assigned THEN ['conflict', 'CANDIDATE_ALREADY_ASSIGNED', 'product']
    WHEN holder.id IS NOT NULL THEN ['conflict', 'FAMILY_COLLISION', holder.id] ELSE ['new_family', NULL, cand.slug] END AS v
  FROM cand JOIN opened USING (key) LEFT JOIN holder ON holder.slug = cand.slug WHERE cand.key NOT IN (SELECT key FROM handled))"""

PLAN = f"""WITH {TABLES}, {RULES}
SELECT v[1] AS bucket, v[2] AS code, id AS family_id, key AS identity_key, v[3] AS detail FROM mine
UNION ALL SELECT v[1], v[2], NULL, key, v[3] FROM fresh
UNION ALL SELECT 'conflict', 'DUPLICATE_HIGH_MEMBERSHIP', NULL, owner, pid FROM claim WHERE n > 1
UNION ALL SELECT 'metadata', NULL, id, key, fields FROM mine WHERE v[1] = 'compatible' AND fields <> ''
UNION ALL SELECT 'new_membership', NULL, NULL, cm.key, role || ':' || pid FROM cm JOIN fresh ON fresh.key = cm.key WHERE fresh.v[1] = 'new_family'
UNION ALL SELECT 'review', NULL, NULL, 'aside-' || g, NULL FROM g4 WHERE c = 3 AND r = 0
UNION ALL SELECT 'separate', NULL, NULL, 'aside-' || g, NULL FROM g4 WHERE c = 7 AND r = 0"""

#: Only cases without conflicts: what each action leaves.
POST = f"""WITH {TABLES}, {RULES}, ok AS (SELECT DISTINCT g FROM g4 WHERE c IN (0, 1, 2, 6, 10, 14, 16, 17) AND g % 40 <> 34),
act AS (
  SELECT cm.pid, 'new' AS fam, role, 'seen' AS reason, '2024-01-20T12:00:00Z' AS matched FROM cm JOIN fresh ON fresh.key = cm.key WHERE fresh.v[1] = 'new_family'
  UNION ALL SELECT b, NULL, NULL, NULL, NULL FROM mine WHERE v[1] = 'continuity'
  UNION ALL SELECT cb, id, 'base', 'inactive base replaced by the current base of the same identity', '2024-01-20T12:00:00Z' FROM mine WHERE v[1] = 'continuity')
SELECT 'product' AS kind, p.id, CASE WHEN act.pid IS NULL THEN p.fam ELSE act.fam END AS "of", CASE WHEN act.pid IS NULL THEN p.role ELSE act.role END AS role, CASE WHEN act.pid IS NULL THEN p.reason ELSE act.reason END AS reason, CASE WHEN act.pid IS NULL THEN p.matched ELSE act.matched END AS matched_at
FROM p JOIN ok USING (g) LEFT JOIN act ON act.pid = p.id
UNION ALL
SELECT 'family', mine.id, CASE WHEN v[1] = 'continuity' THEN cslug ELSE mine.slug END, concat_ws('|', mine.key, CASE WHEN up THEN c.flex ELSE mine.flex END, CASE WHEN up THEN c.ds ELSE mine.ds END, CASE WHEN up THEN c.camber ELSE mine.camber END), kind, CAST(CASE WHEN up THEN c.checked ELSE mine.checked END AS VARCHAR)
FROM (SELECT *, kind = 'fallback-member' AND (v[1] = 'continuity' OR (v[1] = 'compatible' AND fields <> '')) AS up FROM mine) mine JOIN ok USING (g) LEFT JOIN cand c ON c.key = mine.key
UNION ALL
SELECT 'family', 'new', fresh.slug, concat_ws('|', fresh.key, flex, ds, camber), 'fallback-member', CAST(checked AS VARCHAR) FROM fresh JOIN ok USING (g) WHERE v[1] = 'new_family'"""

ORACLE = {"family_plan": PLAN, "family_post_state": POST}
