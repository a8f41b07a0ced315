"""DuckDB SQL for reads, validation, imports and report texts."""

from firnline.plans.oracle_catalog import ITEMS_CTE, PROD, RIDERS
from firnline.plans.oracle_domain import PAIRS

K = "CAST(regexp_extract(id, '(\\d+)$', 1) AS BIGINT)"
URL = "regexp_matches(trim({0}), '^[a-z]+://[^/]+')"

ORACLE = {
    "product_by_slug": f"WITH {PROD} SELECT slug, brand, coalesce((SELECT string_agg(s.id, ',' ORDER BY size_cm, size_label NULLS FIRST, s.id) FROM siz s WHERE s.product_id = prod.id), '') AS size_ids FROM prod WHERE slug = 'p-4' AND is_active",
    "product_slugs": f"WITH {PROD} SELECT slug FROM prod WHERE is_active",
    "offer_scans": f"WITH {PROD} SELECT 'all' AS mode, slug FROM prod WHERE family_id IS NOT NULL OR is_active UNION ALL SELECT 'family', slug FROM prod WHERE family_id = 'f-2' UNION ALL SELECT 'single', slug FROM prod WHERE slug = 'p-4' AND is_active AND family_id IS NULL",
    "editor_products": f"WITH {PROD} SELECT slug, is_active, (SELECT count(*) FROM siz s WHERE s.product_id = prod.id) AS n_sizes FROM prod",
    "catalogue_page": f"WITH {ITEMS_CTE} SELECT slug FROM (SELECT slug FROM items ORDER BY price_from NULLS LAST, brand, model_name, slug LIMIT 24)",
    "family_members": f"WITH {PROD} SELECT fam.id, (SELECT string_agg(member_role || ':' || slug, ',' ORDER BY CASE member_role WHEN 'base' THEN 0 WHEN 'wide' THEN 1 ELSE 3 END, slug) FROM prod p WHERE p.family_id = fam.id) AS members FROM fam",
    "catalogue_snapshot": f"WITH {PROD} SELECT (SELECT count(*) FROM prod) AS products, (SELECT count(*) FROM prod WHERE is_active) AS active_products, (SELECT CAST(max(source_checked_at) AS VARCHAR) FROM prod) AS newest, (SELECT count(*) FROM siz) AS sizes, (SELECT count(*) FROM fam) AS families",
    "catalogue_brands": f"WITH {PROD} SELECT DISTINCT brand FROM prod",
    "size_total": f"WITH {PROD} SELECT count(*) AS sizes FROM siz",
    "related_pages": """WITH p AS (SELECT n_nationkey AS k, 'page-' || n_nationkey AS slug FROM nation),
l AS (SELECT slug, i, 'page-' || ((k * 7 + i * i) % 40) AS other FROM p, range(0, 6) t(i)),
f AS (SELECT slug, other, min(i) AS i FROM l WHERE other <> slug AND other IN (SELECT slug FROM p) GROUP BY 1, 2)
SELECT slug, coalesce((SELECT string_agg(other, ',' ORDER BY i) FROM f WHERE f.slug = p.slug), '') AS related FROM p""",
    "shared_images": f"WITH {PROD} SELECT slug, CAST((({K} % 40) = ({K} % 8)) AS BIGINT) + CAST(gallery2 = 'g-1' AS BIGINT) AS n FROM prod",
    "import_changes": f"""WITH {PROD}, n AS (SELECT CASE WHEN {K} % 10 = 1 THEN 'new-' || slug ELSE slug END AS slug FROM prod WHERE {K} % 3 <> 0)
SELECT slug, 'insert' AS kind FROM n WHERE slug NOT IN (SELECT slug FROM prod) UNION ALL SELECT slug, 'update' FROM n WHERE slug IN (SELECT slug FROM prod)
UNION ALL SELECT slug, 'inactivate' FROM prod WHERE is_active AND slug NOT IN (SELECT slug FROM n)""",
    "import_counts": f"""WITH {PROD}, n AS (SELECT CASE WHEN {K} % 10 = 1 THEN 'new-' || slug ELSE slug END AS slug FROM prod WHERE {K} % 3 <> 0)
SELECT (SELECT count(*) FROM n WHERE slug LIKE 'new-%') AS inserted, (SELECT count(*) FROM n WHERE slug NOT LIKE 'new-%') AS updated, (SELECT count(*) FROM prod WHERE slug NOT IN (SELECT slug FROM n)) AS kept""",
    "merged_imports": f"""WITH {PROD}, n AS (SELECT {K} AS k, * FROM prod WHERE {K} % 6 <> 5),
m AS (SELECT slug, data_status = 'verified' AS v, board_line AS o_line, season_label AS o_season, price_from AS o_price, affiliate_url, CASE WHEN k % 4 = 0 THEN 'unisex' ELSE board_line END AS line, CASE WHEN k % 5 = 0 THEN ' ' ELSE season_label END AS season,
  CASE WHEN k % 7 = 0 THEN 0 ELSE price_from + 10 END AS price, k % 8 <> 0 AS live, k % 2 = 0 AS missing FROM n),
w AS (SELECT *, v AND line = o_line AND NOT coalesce(nullif(trim(season), '') <> o_season, FALSE) AS keep FROM m)
SELECT slug, CASE WHEN NOT v AND missing AND o_line IN ('men', 'women') THEN o_line ELSE line END AS board_line,
  CASE WHEN NOT v THEN coalesce(nullif(trim(season), ''), o_season) WHEN keep THEN coalesce(o_season, nullif(trim(season), '')) ELSE season END AS season_label,
  CASE WHEN keep AND price <= 0 THEN o_price ELSE price END AS price_from, affiliate_url, live AS is_active FROM w""",
    "changed_rows": f"""WITH {PROD}, b AS (SELECT slug, {K} AS k, brand, price_from FROM prod)
SELECT slug, CASE WHEN k % 12 = 0 THEN 'removed' ELSE 'changed' END AS kind, concat_ws(',', CASE WHEN k % 4 = 0 THEN 'brand' END, CASE WHEN k % 3 = 0 THEN 'price_from' END) AS columns FROM b WHERE k % 4 = 0 OR k % 3 = 0""",
    "gallery_rewrites": f"WITH {PROD} SELECT slug, image_url || ',' || gallery2 AS gallery FROM prod WHERE {K} % 2 = 1",
    "deleted_sizes": f"WITH {PROD} SELECT s.id FROM siz s JOIN prod p ON p.id = s.product_id WHERE size_cm < 100 AND is_available AND NOT (p.is_active AND wmin = 0)",
    "contested_families": f"WITH q0 AS ({PAIRS}), q AS (SELECT base, variant, classification FROM q0 UNION ALL SELECT base, 'again-' || variant, classification FROM q0 WHERE CAST(regexp_extract(base, '(\\d+)$', 1) AS BIGINT) % 4 = 0), e AS (SELECT base, variant AS wide, unnest([base, variant]) AS slug FROM q WHERE classification = 'HIGH_CONFIDENCE_WIDTH_FAMILY') SELECT * FROM e WHERE slug IN (SELECT slug FROM e GROUP BY 1 HAVING count(*) > 1)",
    "priority_impacts": f"""WITH {RIDERS} SELECT rider_id,
  CASE terrain WHEN 'switch-freestyle' THEN 'чуть короче и живее' WHEN 'groomers-carving' THEN 'чуть собраннее' WHEN 'soft-snow' THEN 'длиннее с запасом' ELSE 'без лишнего сдвига' END AS length,
  CASE shape_first WHEN 'twin' THEN 'твин' WHEN 'asym-twin' THEN 'асимметричный твин' WHEN 'directional-twin' THEN 'направленный твин' WHEN 'directional' THEN 'направленная' ELSE 'направленная с тейпером' END AS shape,
  CASE terrain WHEN 'switch-freestyle' THEN 'живее под ногами' WHEN 'groomers-carving' THEN 'стабильнее в дуге' WHEN 'soft-snow' THEN 'спокойнее вне трассы' ELSE 'максимально универсально' END AS feel,
  lo || '-' || hi || ' см' AS span FROM rider""",
    "report_texts": f"""WITH {PROD}, q AS (SELECT *, CAST(split_part(id, '-', 2) AS INTEGER) AS k, CAST(split_part(id, '-', 3) AS INTEGER) AS n FROM siz)
SELECT id, CASE WHEN wmin <= 0 AND wmax IS NULL THEN 'нет данных' WHEN wmax IS NULL THEN 'от ' || wmin || ' кг' ELSE wmin || '-' || wmax || ' кг' END AS weights,
  '&lt;b&gt;&quot;&#39;&amp;' || coalesce(size_label, '') AS html, CAST(try_cast('2024-0' || (k % 9 + 1) || '-' || lpad(CAST(k % 33 + 1 AS VARCHAR), 2, '0') AS DATE) AS VARCHAR) AS day, k % 5 <> 0 AS week, 'shop-' || k || '.example' AS host,
  CASE WHEN n * 100 >= 150 AND k <> n * 100 AND abs(k - n * 100) / (n * 100) >= 0.25 THEN CASE WHEN k > n * 100 THEN 'up' ELSE 'down' END END AS moved,
  CASE WHEN n < 3 THEN 'x_product_clicked' || CASE WHEN k % 2 = 0 THEN ',x_product_clicked_board_page' ELSE '' END ELSE '' END AS goals,
  CASE WHEN k % 40 IN (1, 3) THEN 'authentication' WHEN k % 40 = 29 THEN 'rate_limited' ELSE 'upstream' END AS failure, k % 120 = 29 OR k % 120 >= 100 AS again, CASE WHEN k % 2 = 0 THEN least(k % 30 * 1000, 10000) END AS wait FROM q""",
    "stored_family_state": f"""WITH {PROD}, f AS (SELECT CAST(substr(id, 3) AS BIGINT) AS k, (SELECT count(*) FROM prod WHERE family_id = fam.id AND member_role = 'wide') AS w FROM fam)
SELECT 'CONFLICT' AS status, 'absent:' || count(*) FILTER (k % 7 = 0) || ',different:' || count(*) FILTER (k % 7 <> 0 AND k % 5 = 1 AND w > 0) AS reasons, 't1' AS matched_at FROM f""",
    "family_structure": f"""WITH {PROD}, f AS (SELECT id, CAST(substr(id, 3) AS BIGINT) AS k, (SELECT count(*) FROM prod WHERE family_id = fam.id) AS n FROM fam)
SELECT 'v1|' || id AS identity_key, CASE WHEN n <> 2 OR k % 4 = 0 THEN 'members' WHEN k % 3 = 0 THEN 'roles' END AS problem FROM f""",
    "offer_repairs": f"""WITH {PROD} SELECT slug, FALSE AS is_new FROM prod WHERE ({K} % 3 = 0 AND price_from > 0) OR id IN (SELECT product_id FROM siz WHERE size_cm = 95)""",
    "digest_rows": """SELECT CAST(o_orderkey AS VARCHAR) AS logical_id, CASE WHEN o_orderkey % 11 = 0 THEN 'stored_digest_invalid' WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'stored_digest_hash_mismatch' END AS problem FROM orders""",
}

_ODD = {"height_cm": (11, "h", "139.5"), "weight_kg": (9, "kg", "20"), "boot_size_eu": (13, "boot", "52.5"), "board_line_preference": (17, "line", "'kids'"), "skill_level": (19, "skill", "'expert'"), "riding_style": (23, "style", "'moguls'"), "terrain_priority": (29, "terrain", "'ice'"), "aggressiveness": (31, "temper", "'wild'"), "stance_type": (7, "stance", "'goofy'")}
_ASKED = ", ".join(f"CASE WHEN rider_id % {n} = 0 THEN {v} WHEN rider_id % {n} = 1 THEN NULL ELSE {c} END AS {name}" for name, (n, c, v) in _ODD.items())
_LIMITS = {"height_cm": "BETWEEN 140 AND 210", "weight_kg": "BETWEEN 35 AND 150", "boot_size_eu": "BETWEEN 34 AND 52", "board_line_preference": "IN ('men', 'women', 'any')", "skill_level": "IN ('beginner', 'intermediate', 'advanced')", "riding_style": "IN ('all-mountain', 'park', 'freeride')",
    "terrain_priority": "IN ('balanced', 'switch-freestyle', 'groomers-carving', 'soft-snow')", "aggressiveness": "IN ('relaxed', 'balanced', 'aggressive')", "stance_type": "IN ('standard', 'duck', 'unknown')"}


def _say(rules: dict[str, str]) -> str:
    return ", ".join(f"CASE WHEN {when} THEN '{name}' END" for name, when in rules.items())


_URL = "coalesce(regexp_matches(trim({0}), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+'), FALSE)"
_SIZE = {
    "sizes.recommended_weight_max": "wx < 30 OR wx > 180 OR wx < wmin", "sizes.recommended_weight_min": "wmin IS NULL OR wmin NOT BETWEEN 30 AND 180", "sizes.size_cm": "size_cm IS NULL OR size_cm NOT BETWEEN 120 AND 200", "sizes.size_label": "length(lab) > 24",
    "sizes.waist_width_mm": "waist_width_mm IS NULL OR waist_width_mm NOT BETWEEN 220 AND 300", "sizes.width_type": "wt NOT IN ('regular', 'mid-wide', 'wide')",
}
_PRODUCT = {
    "slug": "NOT regexp_matches(trim(s), '^[a-z0-9]+(-[a-z0-9]+)*$') OR length(trim(s)) < 2", "brand": "trim(coalesce(br, '')) = ''", "model_name": "trim(coalesce(mo, '')) = ''", "flex": "fl NOT BETWEEN 1 AND 10", "price_from": "pr NOT BETWEEN 0 AND 500000",
    "riding_style": "rs NOT IN ('all-mountain', 'park', 'freeride')", "skill_level": "sk IS NULL OR sk NOT IN ('beginner', 'intermediate', 'advanced')", "board_line": "bl NOT IN ('men', 'women', 'unisex')", "data_status": "ds NOT IN ('draft', 'verified')",
    "shape_type": "sh NOT IN ('twin', 'asym-twin', 'directional-twin', 'directional', 'tapered-directional')", "camber_profile": "ca NOT IN ('camber', 'rocker', 'flat', 'hybrid-camber', 'hybrid-rocker')", "image_url": f"NOT (starts_with(im, '/') OR {_URL.format('im')})", "affiliate_url": f"NOT {_URL.format('affiliate_url')}",
    "source_name": "length(coalesce(sn, '')) > 160 OR (ds = 'verified' AND trim(coalesce(sn, '')) = '')", "source_url": f"(trim(coalesce(source_url, '')) <> '' AND NOT {_URL.format('source_url')}) OR (ds = 'verified' AND trim(coalesce(source_url, '')) = '')", "sizes": "coalesce(n, 0) < 1 OR n > 20",
}
_META = ["riding_style", "skill_level", "flex", "board_line", "shape_type", "camber_profile", "data_status", "source_name", "source_url", "source_checked_at"]

ORACLE |= {
    "empty_families": f"WITH {PROD} SELECT id FROM fam WHERE id NOT IN (SELECT family_id FROM prod WHERE family_id IS NOT NULL AND {K} // 5 % 3 <> 0)",
    "rider_problems": f"WITH {RIDERS}, a AS (SELECT rider_id, {_ASKED} FROM rid) SELECT rider_id, concat_ws(',', {_say({c: f'{c} IS NULL OR {c} NOT {rule}' for c, rule in _LIMITS.items()})}) AS problems FROM a",
    "product_problems": f"""WITH {PROD}, q AS (SELECT *, CAST(regexp_extract(product_id, '(\\d+)$', 1) AS BIGINT) AS k FROM siz),
z AS (SELECT *, CASE WHEN k % 19 = 0 THEN repeat('y', 25) ELSE size_label END AS lab, CASE WHEN k % 23 = 0 THEN 20 WHEN k % 23 = 1 THEN wmin - 1 ELSE wmax END AS wx, CASE WHEN k % 27 = 0 THEN 'slim' ELSE width_type END AS wt, CASE WHEN k % 33 = 0 THEN 6 ELSE 1 END AS copies FROM q),
per AS (SELECT product_id, sum(copies) AS n, concat_ws(',', {_say({name: f'bool_or({when})' for name, when in _SIZE.items()})}) AS of_sizes FROM z GROUP BY 1),
p0 AS (SELECT *, CAST(substr(id, 4) AS BIGINT) AS k FROM prod),
p AS (SELECT *, CASE WHEN k % 31 = 0 THEN 'P_' || k WHEN k % 37 = 0 THEN 'x' ELSE slug END AS s, CASE WHEN k % 29 = 3 THEN ' ' ELSE brand END AS br, CASE WHEN k % 41 = 0 THEN NULL ELSE model_name END AS mo, CASE WHEN k % 17 = 0 THEN 0 WHEN k % 17 = 1 THEN 11 ELSE flex END AS fl, CASE WHEN k % 43 = 0 THEN -1 WHEN k % 43 = 1 THEN 600000 ELSE price_from END AS pr,
  CASE WHEN k % 47 = 0 THEN 'moguls' ELSE riding_style END AS rs, CASE WHEN k % 53 = 0 THEN NULL ELSE skill_level END AS sk, CASE WHEN k % 59 = 0 THEN 'kids' ELSE board_line END AS bl, CASE WHEN k % 61 = 0 THEN 'new' ELSE data_status END AS ds, CASE WHEN k % 67 = 0 THEN 'odd' ELSE shape_type END AS sh, CASE WHEN k % 71 = 0 THEN 'odd' ELSE camber_profile END AS ca,
  CASE k % 3 WHEN 0 THEN '/i.jpg' WHEN 1 THEN 'https://img.example/i.jpg' ELSE 'img' END AS im, CASE WHEN k % 73 = 0 THEN repeat('x', 161) ELSE source_name END AS sn FROM p0)
SELECT s AS slug, concat_ws(',', {_say(_PRODUCT)}, nullif(of_sizes, '')) AS problems FROM p LEFT JOIN per ON per.product_id = p.id""",
    "metadata_changes": f"""WITH {PROD}, b AS (SELECT *, CAST(substr(family_id, 3) AS BIGINT) AS k FROM prod WHERE member_role = 'base'),
x AS (SELECT k, family_id, unnest([{', '.join(f"{{'field': '{c}', 'before': CAST({'nullif(flex, 5)' if c == 'flex' else c} AS VARCHAR), 'after': CASE WHEN k % 10 = {i} THEN NULL ELSE CAST({c} AS VARCHAR) END}}" for i, c in enumerate(_META))}]) AS e FROM b WHERE k % 7 <> 0)
SELECT 'v1|' || family_id AS identity_key, e.field AS field, e.before AS before, e.after AS after FROM x WHERE e.before IS DISTINCT FROM e.after""",
}
