"""DuckDB SQL for recommendation, catalogue and data-quality queries."""


def _pick(x: str, values: list) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE ({x}) % {len(values)} {arms} END"


PROD = f"""prod AS (
  SELECT 'id-' || k AS id, 'p-' || k AS slug, p_brand AS brand, p_name AS model_name, {_pick('k', ['2023/2024', None, '2024/2025'])} AS season_label,
    {_pick('k', ['all-mountain', 'park', 'freeride'])} AS riding_style, {_pick('k // 3', ['beginner', 'intermediate', 'advanced'])} AS skill_level,
    CAST(p_size % 10 + 1 AS INTEGER) AS flex, CASE WHEN k % 19 = 0 THEN 0 ELSE CAST(floor(p_retailprice) AS INTEGER) END AS price_from,
    {_pick('k // 2', ['men', 'women', 'unisex'])} AS board_line, {_pick('k // 5', ['twin', 'directional-twin', 'directional', None, 'tapered-directional', 'asym-twin'])} AS shape_type,
    {_pick('k // 7', ['camber', 'hybrid-camber', None, 'rocker', 'hybrid-rocker', 'flat'])} AS camber_profile, {_pick('k', ['verified', 'draft', 'verified'])} AS data_status,
    CASE WHEN k % 23 <> 0 THEN 'maker' END AS source_name,
    {_pick('k // 3', ['https://maker.example/specs', 'https://trial-sport.ru/p', None, ' ', 'https://maker.example/b', 'https://WWW.Traektoria.ru/x'])} AS source_url,
    CASE WHEN k % 4 <> 0 THEN DATE '2024-01-01' + CAST(k % 28 AS INTEGER) END AS source_checked_at,
    {_pick('k // 11', ['https://shop.example.net/x', 'https://store-a.test/p', '', 'https://store-b.test/q', 'https://store-c.test/r'])} AS affiliate_url,
    k % 11 <> 0 AS is_active, CASE WHEN k % 5 < 2 THEN 'f-' || (k // 5) END AS family_id, CASE k % 5 WHEN 0 THEN 'base' WHEN 1 THEN 'wide' END AS member_role,
    'img-' || (k % 40) AS image_url, 'g-' || (k % 7) AS gallery2
  FROM (SELECT *, p_partkey AS k FROM part)),
siz AS (
  SELECT 's-' || k || '-' || n AS id, 'id-' || k AS product_id, CASE WHEN (k + n) % 37 = 0 THEN 95.0 ELSE CAST(138 + (k * 7 + n * 4) % 30 AS DOUBLE) END AS size_cm,
    CASE WHEN n = 4 THEN (138 + (k * 7 + n * 4) % 30) || 'w' END AS size_label, CAST(238 + (k * 5 + n * 3) % 40 AS INTEGER) AS waist_width_mm,
    CASE WHEN (k + n) % 13 = 0 THEN 0 ELSE CAST(40 + (k * 3 + n * 7) % 40 AS INTEGER) END AS wmin,
    CASE WHEN (k + n) % 13 = 0 OR (k + n) % 5 = 0 THEN NULL ELSE CAST(60 + (k * 3 + n * 7) % 40 AS INTEGER) END AS wmax,
    CASE WHEN 238 + (k * 5 + n * 3) % 40 >= 264 THEN 'wide' WHEN 238 + (k * 5 + n * 3) % 40 >= 257 THEN 'mid-wide' ELSE 'regular' END AS width_type,
    (k + n) % 3 <> 0 AS is_available
  FROM (SELECT p_partkey AS k, unnest(range(1, 5)) AS n FROM part) WHERE k % 29 <> 0),
fam AS (
  SELECT family_id AS id, 'fam-' || family_id AS slug, brand, model_name, season_label, riding_style, skill_level, nullif(flex, 5) AS flex, board_line, shape_type, camber_profile, data_status, source_name, source_url, source_checked_at
  FROM prod WHERE member_role = 'base')"""

RIDERS = f"""rid AS (
  SELECT k AS rider_id, CAST(150 + (k * 11) % 45 AS DOUBLE) AS h, CAST(42 + (k * 7) % 60 AS DOUBLE) AS kg, 36 + (k % 26) / 2 AS boot,
    {_pick('k // 2', ['men', 'women', 'any'])} AS line, {_pick('k // 5', ['beginner', 'intermediate', 'advanced'])} AS skill, {_pick('k', ['all-mountain', 'park', 'freeride'])} AS style,
    {_pick('k // 3', ['balanced', 'switch-freestyle', 'groomers-carving', 'soft-snow'])} AS terrain, {_pick('k // 7', ['relaxed', 'balanced', 'aggressive'])} AS temper, {_pick('k // 11', ['standard', 'duck', 'unknown'])} AS stance
  FROM (SELECT c_custkey AS k FROM customer)),
r1 AS (
  SELECT *, terrain = 'groomers-carving' AS carve, terrain = 'soft-snow' AS soft, style = 'park' OR terrain = 'switch-freestyle' AS free, style = 'freeride' OR terrain IN ('groomers-carving', 'soft-snow') AS direct,
    CASE WHEN h <= 160 THEN -1 WHEN h >= 186 THEN 2 WHEN h >= 179 THEN 1 ELSE 0 END AS dh,
    CASE WHEN kg BETWEEN 35 AND 44.99 THEN 138 WHEN kg BETWEEN 45 AND 54.99 THEN 142 WHEN kg BETWEEN 55 AND 64.99 THEN 147 WHEN kg BETWEEN 65 AND 74.99 THEN 152 WHEN kg BETWEEN 75 AND 84.99 THEN 155 WHEN kg BETWEEN 85 AND 94.99 THEN 158 WHEN kg BETWEEN 95 AND 150 THEN 161 ELSE 152 END AS b0,
    CASE WHEN kg BETWEEN 35 AND 44.99 THEN 142 WHEN kg BETWEEN 45 AND 54.99 THEN 147 WHEN kg BETWEEN 55 AND 64.99 THEN 152 WHEN kg BETWEEN 65 AND 74.99 THEN 156 WHEN kg BETWEEN 75 AND 84.99 THEN 159 WHEN kg BETWEEN 85 AND 94.99 THEN 162 WHEN kg BETWEEN 95 AND 150 THEN 166 ELSE 156 END AS b1
  FROM rid),
r2 AS (
  SELECT *, least(greatest(b0 + dh + CASE style WHEN 'park' THEN -2 WHEN 'freeride' THEN 1 ELSE 0 END + CASE terrain WHEN 'switch-freestyle' THEN -1 WHEN 'soft-snow' THEN 1 ELSE 0 END + CASE temper WHEN 'relaxed' THEN -1 WHEN 'aggressive' THEN 1 ELSE 0 END, 138), 166) AS lo,
    least(greatest(b1 + dh + CASE style WHEN 'park' THEN -1 WHEN 'freeride' THEN 3 ELSE 0 END + CASE terrain WHEN 'groomers-carving' THEN 1 WHEN 'soft-snow' THEN 2 ELSE 0 END + CASE temper WHEN 'aggressive' THEN 1 ELSE 0 END, 141), 168) AS hi0 FROM r1),
r3 AS (
  SELECT *, CASE WHEN hi0 - lo < 2 THEN lo + 2 ELSE hi0 END AS hi, carve AND boot >= 43 AND boot < 43.5 AS edge, stance = 'unknown' AND boot >= 43.5 AS unsure FROM r2),
r4 AS (
  SELECT *, least(greatest((lo + hi) / 2 + CASE style WHEN 'park' THEN -0.5 WHEN 'freeride' THEN 0.75 ELSE 0 END + CASE terrain WHEN 'switch-freestyle' THEN -0.5 WHEN 'groomers-carving' THEN 0.25 WHEN 'soft-snow' THEN 0.75 ELSE 0 END + CASE temper WHEN 'relaxed' THEN -0.25 WHEN 'aggressive' THEN 0.25 ELSE 0 END, lo), hi) AS target,
    CASE WHEN boot >= 45.5 THEN 'wide' WHEN boot >= 43.5 OR edge THEN 'mid-wide' ELSE 'regular' END AS width_type,
    CASE WHEN edge THEN 258 ELSE CASE WHEN boot >= 48 THEN 272 WHEN boot >= 45.5 THEN 264 WHEN boot >= 43.5 THEN 257 WHEN boot <= 38 THEN 240 ELSE 250 END + CASE WHEN carve THEN 3 ELSE 0 END END - CASE WHEN stance = 'duck' THEN 2 ELSE 0 END + CASE WHEN unsure THEN 1 ELSE 0 END AS waist,
    CASE WHEN boot >= 48 THEN 3 WHEN boot >= 45.5 THEN 2 WHEN boot >= 43.5 THEN 1 ELSE 0 END + CASE WHEN unsure THEN 1 ELSE 0 END AS d0,
    CASE WHEN terrain = 'switch-freestyle' THEN 'twin' WHEN carve THEN CASE WHEN style = 'park' THEN 'directional-twin' ELSE 'directional' END WHEN soft THEN CASE WHEN style = 'all-mountain' AND temper = 'relaxed' THEN 'directional' ELSE 'tapered-directional' END
      WHEN style = 'park' THEN 'twin' WHEN style = 'freeride' THEN CASE WHEN temper = 'relaxed' THEN 'directional' ELSE 'tapered-directional' END WHEN temper = 'aggressive' THEN 'directional' ELSE 'directional-twin' END AS shape_first,
    CASE WHEN terrain = 'switch-freestyle' THEN ['asym-twin', 'directional-twin'] WHEN carve THEN CASE WHEN style = 'park' THEN ['twin', 'directional'] ELSE ['directional-twin', 'tapered-directional'] END WHEN soft THEN ['directional', 'directional-twin']
      WHEN style = 'park' THEN ['asym-twin', 'directional-twin'] WHEN style = 'freeride' THEN CASE WHEN temper = 'relaxed' THEN ['tapered-directional', 'directional-twin'] ELSE ['directional', 'directional-twin'] END WHEN temper = 'aggressive' THEN ['directional-twin', 'tapered-directional'] ELSE ['twin', 'asym-twin', 'directional'] END AS shape_others,
    CASE WHEN free THEN -1 ELSE 0 END + CASE WHEN direct THEN 1 ELSE 0 END + CASE temper WHEN 'relaxed' THEN -1 WHEN 'aggressive' THEN 1 ELSE 0 END AS df,
    CASE skill WHEN 'advanced' THEN 2 ELSE 0 END + CASE temper WHEN 'aggressive' THEN 3 ELSE 0 END + CASE WHEN direct THEN 2 ELSE 0 END AS soft_boost,
    CASE skill WHEN 'beginner' THEN 3 ELSE 0 END + CASE temper WHEN 'relaxed' THEN 2 ELSE 0 END + CASE WHEN free THEN 2 ELSE 0 END AS stiff_boost,
    least(greatest(4.0 - CASE WHEN free THEN 1.5 ELSE 0 END + CASE WHEN direct THEN 1.5 ELSE 0 END + CASE temper WHEN 'relaxed' THEN -0.5 WHEN 'aggressive' THEN 0.5 ELSE 0 END, 2), 7) AS over_width,
    CASE WHEN soft THEN 1 WHEN carve THEN 2 WHEN free AND skill = 'advanced' AND temper = 'aggressive' THEN 3 WHEN free OR skill = 'beginner' OR temper = 'relaxed' THEN 4 WHEN style = 'freeride' THEN 5 ELSE 6 END AS cam,
    CASE style WHEN 'park' THEN ['park', 'all-mountain'] WHEN 'freeride' THEN ['freeride', 'all-mountain'] ELSE CASE terrain WHEN 'switch-freestyle' THEN ['all-mountain', 'park'] WHEN 'balanced' THEN ['all-mountain'] ELSE ['all-mountain', 'freeride'] END END AS styles
  FROM r3),
r5 AS (
  SELECT *, least(greatest(4 + CASE skill WHEN 'beginner' THEN -2 WHEN 'advanced' THEN 1 ELSE 0 END + df, 1), 9) AS flex_lo, d0 - CASE WHEN (stance = 'duck' OR width_type = 'wide') AND d0 > 0 THEN 1 ELSE 0 END AS drag FROM r4),
rider AS (
  SELECT *, least(greatest(6 + CASE skill WHEN 'beginner' THEN -1 WHEN 'advanced' THEN 2 ELSE 0 END + df, flex_lo + 1), 10) AS flex_hi, CASE WHEN drag <= 0 THEN 'low' WHEN drag = 1 THEN 'medium' ELSE 'high' END AS boot_drag_risk FROM r5)"""

PROFILE = f"WITH {RIDERS} SELECT rider_id, lo, hi, target, width_type, waist, boot_drag_risk, shape_first, array_to_string(shape_others, ',') AS shape_others, flex_lo, flex_hi, over_width FROM rider"

TRUST = """trust AS (
  SELECT *, coalesce(length(trim(source_name)) > 0, FALSE) AND coalesce(length(trim(source_url)) > 0, FALSE) AS has_source, data_status = 'verified' AS verified,
    coalesce(lower(regexp_extract(trim(source_url), '^[a-zA-Z]+://([^/:?#]+)', 1)) IN ('trial-sport.ru', 'www.trial-sport.ru', 'traektoria.ru', 'www.traektoria.ru'), FALSE) AS store_source,
    coalesce(regexp_matches(affiliate_url, 'example\\.(com|org|net)', 'i'), FALSE) AS placeholder_link FROM prod),
ready AS (
  SELECT *, verified AND has_source AND NOT store_source AS flex_trusted, verified AND has_source AND shape_type IS NOT NULL AND camber_profile IS NOT NULL AND coalesce(length(trim(affiliate_url)) > 0, FALSE) AND NOT placeholder_link AS ready FROM trust)"""

READY = f"WITH {PROD}, {TRUST} SELECT slug, verified, has_source, flex_trusted, placeholder_link, ready FROM ready"

MATCHES = f"""WITH {PROD}, {TRUST}, {RIDERS},
boards AS (SELECT * FROM ready WHERE is_active AND id IN (SELECT product_id FROM siz WHERE is_available)),
pool1 AS (SELECT r.*, (SELECT count(*) FROM boards b WHERE list_contains(r.styles, b.riding_style)) >= 3 AS focused FROM rider r),
n AS (SELECT riding_style, count(*) FILTER (ready) AS nr, count(*) FILTER (verified) AS nv FROM boards GROUP BY 1),
pool AS (SELECT *, (SELECT sum(nr) FROM n WHERE NOT focused OR list_contains(styles, n.riding_style)) >= 3 AS g1, (SELECT sum(nv) FROM n WHERE NOT focused OR list_contains(styles, n.riding_style)) >= 3 AS g2 FROM pool1),
met AS (
  SELECT r.*, b.*, s.size_cm, coalesce(s.size_label, '') AS label, s.waist_width_mm - r.waist AS spare, s.wmin, s.wmax, (s.wmin > 0 OR s.wmax IS NOT NULL) AS known,
    CASE WHEN size_cm < lo THEN lo - size_cm WHEN size_cm > hi THEN size_cm - hi ELSE 0 END AS lo_off,
    CASE WHEN s.wmin > 0 OR s.wmax IS NOT NULL THEN CASE WHEN kg < s.wmin THEN s.wmin - kg WHEN s.wmax IS NOT NULL AND kg > s.wmax THEN kg - s.wmax ELSE 0 END ELSE 0 END AS w_off
  FROM pool r JOIN boards b ON (NOT r.focused OR list_contains(r.styles, b.riding_style)) AND CASE WHEN g1 THEN b.ready WHEN g2 THEN b.verified ELSE TRUE END
    JOIN siz s ON s.product_id = b.id AND s.is_available AND s.size_cm > r.lo - 12 AND s.size_cm < r.hi + 12),
g AS (
  SELECT *, CASE WHEN lo_off = 0 THEN 0 WHEN lo_off <= 2.5 THEN 1 ELSE 2 END AS ga, CASE WHEN w_off = 0 THEN 0 WHEN w_off <= 5 THEN 1 ELSE 2 END AS gb,
    CASE WHEN spare >= CASE WHEN stance = 'duck' THEN -1.5 ELSE -1 END THEN 0 WHEN spare >= -3 THEN 1 ELSE 2 END AS gc FROM met WHERE lo_off < 12 AND spare > -12 AND w_off < 20),
e AS (SELECT *, CAST(ga = 2 AS INT) + CAST(gb = 2 AS INT) + CAST(gc = 2 AS INT) AS hard, CAST(ga = 1 AS INT) + CAST(gb = 1 AS INT) + CAST(gc = 1 AS INT) AS mild,
  CASE WHEN flex < flex_lo THEN flex_lo - flex WHEN flex > flex_hi THEN flex - flex_hi ELSE 0 END AS f_off FROM g),
sc AS (
  SELECT *,
    CASE WHEN lo_off = 0 THEN floor(20 + least(greatest(1 - abs(size_cm - target) / (greatest((hi - lo) / 2, 1.5) + 0.75), 0), 1) * 16 + 0.5) WHEN lo_off <= 2.5 THEN floor(10 - lo_off * 2 + 0.5) ELSE -14 END
    + CASE WHEN NOT known THEN -4 WHEN w_off = 0 THEN floor(14 + least(greatest(1 - abs(kg - CASE WHEN wmax IS NULL THEN wmin + 8 ELSE (wmin + wmax) / 2 END) / CASE WHEN wmax IS NULL THEN 12 ELSE greatest((wmax - wmin) / 2, 8) END, 0), 1) * 10 + 0.5) WHEN w_off <= 5 THEN 6 ELSE -8 END
    + CASE WHEN riding_style = style THEN 18 WHEN style = 'all-mountain' THEN CASE WHEN terrain = 'switch-freestyle' AND riding_style = 'park' THEN 4 WHEN terrain IN ('soft-snow', 'groomers-carving') AND riding_style = 'freeride' THEN 3 ELSE -8 END WHEN riding_style = 'all-mountain' THEN 8 ELSE -12 END
    + CASE WHEN shape_type IS NULL THEN 0 WHEN shape_type = shape_first THEN 10 WHEN list_contains(shape_others, shape_type) THEN 6 ELSE -6 END
    + CASE list_position(['beginner', 'intermediate', 'advanced'], skill_level) - list_position(['beginner', 'intermediate', 'advanced'], skill) WHEN 0 THEN 16 WHEN -1 THEN 12 WHEN -2 THEN 6 WHEN 1 THEN 4 ELSE -14 END
    + CASE WHEN NOT flex_trusted THEN 0 WHEN f_off = 0 THEN floor(12 + least(greatest(1 - abs(flex - (flex_lo + flex_hi) / 2) / greatest((flex_hi - flex_lo) / 2, 1), 0), 1) * 6 + 0.5)
        WHEN flex < flex_lo THEN CASE WHEN f_off <= 0.5 THEN floor(4 - soft_boost * 0.5 + 0.5) WHEN f_off <= 1 THEN 1 - soft_boost WHEN f_off <= 2 THEN floor(-5 - soft_boost * 1.5 + 0.5) ELSE -10 - soft_boost * 2 END
        ELSE CASE WHEN f_off <= 1 THEN 6 - stiff_boost WHEN f_off <= 2 THEN floor(-stiff_boost * 1.5 + 0.5) ELSE -6 - stiff_boost * 2 END END
    + CASE WHEN line = 'any' THEN 0 WHEN board_line = 'unisex' THEN 6 WHEN board_line = line THEN 10 ELSE -12 END
    + CASE terrain
        WHEN 'balanced' THEN CASE WHEN riding_style = 'all-mountain' THEN 8 ELSE -3 END + CASE WHEN shape_type = 'directional-twin' THEN 4 WHEN shape_type IN ('directional', 'twin', 'asym-twin') THEN 1 WHEN shape_type = 'tapered-directional' THEN -3 ELSE 0 END
        WHEN 'switch-freestyle' THEN CASE riding_style WHEN 'park' THEN 8 WHEN 'all-mountain' THEN 3 ELSE -8 END + CASE WHEN shape_type IN ('twin', 'asym-twin') THEN 6 WHEN shape_type = 'directional-twin' THEN 3 WHEN shape_type IS NULL THEN 0 ELSE -6 END
        WHEN 'groomers-carving' THEN CASE riding_style WHEN 'freeride' THEN 7 WHEN 'all-mountain' THEN 5 ELSE -6 END + CASE shape_type WHEN 'directional' THEN 6 WHEN 'tapered-directional' THEN 5 WHEN 'directional-twin' THEN 4 ELSE CASE WHEN shape_type IS NULL THEN 0 ELSE -4 END END + CASE WHEN flex >= 6 THEN 2 WHEN flex <= 4 THEN -2 ELSE 0 END
        ELSE CASE riding_style WHEN 'freeride' THEN 9 WHEN 'all-mountain' THEN 3 ELSE -8 END + CASE shape_type WHEN 'tapered-directional' THEN 8 WHEN 'directional' THEN 5 WHEN 'directional-twin' THEN 1 ELSE CASE WHEN shape_type IS NULL THEN 0 ELSE -6 END END + CASE WHEN flex >= 6 THEN 2 ELSE 0 END END
    + CASE WHEN camber_profile IS NULL THEN 0 ELSE CASE cam
        WHEN 1 THEN CASE WHEN camber_profile IN ('hybrid-rocker', 'rocker') THEN 8 WHEN camber_profile = 'hybrid-camber' THEN 3 ELSE -6 END
        WHEN 2 THEN CASE WHEN camber_profile IN ('camber', 'hybrid-camber') THEN 8 WHEN camber_profile = 'flat' THEN 3 ELSE -6 END
        WHEN 3 THEN CASE WHEN camber_profile IN ('camber', 'hybrid-camber') THEN 8 WHEN camber_profile IN ('flat', 'hybrid-rocker') THEN 3 ELSE -6 END
        WHEN 4 THEN CASE WHEN camber_profile IN ('flat', 'hybrid-rocker') THEN 8 WHEN camber_profile IN ('rocker', 'hybrid-camber') THEN 3 ELSE -6 END
        WHEN 5 THEN CASE WHEN camber_profile IN ('camber', 'hybrid-camber') THEN 8 WHEN camber_profile = 'hybrid-rocker' THEN 3 ELSE -6 END
        ELSE CASE WHEN camber_profile = 'hybrid-camber' THEN 8 WHEN camber_profile IN ('camber', 'flat') THEN 3 ELSE -6 END END END
    + CASE WHEN spare >= 0 AND spare <= over_width THEN floor(12 + least(greatest(1 - spare / greatest(over_width, 1), 0), 1) * 8 + 0.5) WHEN spare > over_width AND spare <= over_width + 4 THEN floor(6 - (spare - over_width) * 1.5 + 0.5)
        WHEN spare >= CASE WHEN stance = 'duck' THEN -1.5 ELSE -1 END THEN 0 WHEN spare >= -3 THEN -8 - CASE WHEN temper = 'aggressive' OR carve THEN 4 ELSE 0 END ELSE -24 - CASE WHEN temper = 'aggressive' OR carve THEN 4 ELSE 0 END END
    + CASE WHEN hard >= 2 THEN -18 WHEN hard = 1 AND mild >= 1 THEN -10 WHEN hard = 1 AND skill = 'beginner' THEN -6 ELSE 0 END
    + CASE WHEN ready THEN 10 WHEN verified THEN 4 ELSE 0 END - CASE WHEN placeholder_link THEN 12 ELSE 0 END AS score
  FROM e WHERE hard < 2),
best AS (SELECT *, row_number() OVER (PARTITION BY rider_id, coalesce('family:' || family_id, 'product:' || id) ORDER BY score DESC, slug, size_cm, label, id) AS f FROM sc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rider_id ORDER BY score DESC, slug, size_cm, label, id) AS place FROM best WHERE f = 1),
named AS (SELECT *, place <= 4 AND score >= 56 AS chosen, count(*) FILTER (place <= 4 AND score >= 56) OVER (PARTITION BY rider_id) AS nc FROM ranked)
SELECT rider_id, CASE WHEN chosen THEN 'recommended' ELSE 'alternative' END AS list, CASE WHEN chosen THEN place ELSE place - nc END AS place, slug, size_cm, label AS size_label, CAST(score AS BIGINT) AS score,
  CASE WHEN spare >= 6 THEN 'width-safe' WHEN size_cm <= target - 0.75 THEN 'playful' WHEN size_cm >= target + 0.75 THEN 'stable' ELSE 'best-overall' END AS role,
  CASE WHEN score >= 78 AND ready THEN 'high' WHEN score >= 64 THEN 'medium' ELSE 'careful' END AS confidence
FROM named WHERE chosen OR (place <= nc + 3 AND score >= 40)"""

_RANKED = MATCHES[: MATCHES.index("SELECT rider_id, CASE WHEN chosen")]

REASONS = _RANKED + """, why AS (SELECT *, abs(size_cm - target) AS near, greatest(flex_lo - flex, flex - flex_hi, 0) AS f_out,
  CASE terrain
    WHEN 'balanced' THEN riding_style = 'all-mountain' AND shape_type IS DISTINCT FROM 'tapered-directional'
    WHEN 'switch-freestyle' THEN (riding_style = 'park' AND (shape_type IS NULL OR shape_type IN ('twin', 'asym-twin', 'directional-twin'))) OR (riding_style = 'all-mountain' AND coalesce(shape_type IN ('twin', 'asym-twin'), FALSE))
    WHEN 'groomers-carving' THEN CASE riding_style WHEN 'freeride' THEN 7 WHEN 'all-mountain' THEN 5 ELSE -6 END + CASE shape_type WHEN 'directional' THEN 6 WHEN 'tapered-directional' THEN 5 WHEN 'directional-twin' THEN 4 ELSE CASE WHEN shape_type IS NULL THEN 0 ELSE -4 END END + CASE WHEN flex >= 6 THEN 2 WHEN flex <= 4 THEN -2 ELSE 0 END >= 8
    ELSE CASE riding_style WHEN 'freeride' THEN 9 WHEN 'all-mountain' THEN 3 ELSE -8 END + CASE shape_type WHEN 'tapered-directional' THEN 8 WHEN 'directional' THEN 5 WHEN 'directional-twin' THEN 1 ELSE CASE WHEN shape_type IS NULL THEN 0 ELSE -6 END END + CASE WHEN flex >= 6 THEN 2 ELSE 0 END >= 8 END AS t8
  FROM named WHERE chosen OR (place <= nc + 3 AND score >= 40))
SELECT rider_id, CASE WHEN chosen THEN 'recommended' ELSE 'alternative' END AS list, CASE WHEN chosen THEN place ELSE place - nc END AS place, slug, array_to_string(list_filter([
  CASE WHEN hard = 1 AND mild >= 1 THEN 'compromise' END,
  CASE WHEN lo_off = 0 THEN CASE WHEN near <= 0.75 THEN 'length-ideal' WHEN size_cm < target THEN 'length-lively' ELSE 'length-stable' END WHEN lo_off <= 2.5 THEN 'length-near' END,
  CASE WHEN known AND w_off = 0 THEN 'weight' END,
  CASE WHEN riding_style = style OR riding_style = 'all-mountain' OR (style = 'all-mountain' AND (terrain = 'switch-freestyle' AND riding_style = 'park' OR terrain IN ('soft-snow', 'groomers-carving') AND riding_style = 'freeride')) THEN 'style' END,
  CASE WHEN shape_type = shape_first THEN 'shape-first' WHEN list_contains(shape_others, shape_type) THEN 'shape-other' END,
  CASE WHEN list_position(['beginner', 'intermediate', 'advanced'], skill_level) - list_position(['beginner', 'intermediate', 'advanced'], skill) < 2 THEN 'skill' END,
  CASE WHEN flex_trusted THEN CASE WHEN f_out = 0 THEN 'flex' WHEN flex < flex_lo THEN CASE WHEN f_out > 2 THEN 'flex-too-soft' WHEN f_out > 1 AND soft_boost >= 4 THEN 'flex-soft' END ELSE CASE WHEN f_out > 2 THEN 'flex-too-stiff' WHEN f_out > 1 AND stiff_boost >= 4 THEN 'flex-stiff' END END END,
  CASE WHEN t8 THEN 'terrain' END,
  CASE WHEN camber_profile IN ('hybrid-rocker', 'rocker') AND cam = 1 OR camber_profile IN ('camber', 'hybrid-camber') AND cam IN (2, 3, 5) OR camber_profile IN ('flat', 'hybrid-rocker') AND cam = 4 OR camber_profile = 'hybrid-camber' AND cam = 6 THEN 'camber' END,
  CASE WHEN spare >= 0 AND spare <= over_width THEN 'width' WHEN spare > over_width AND spare <= over_width + 4 THEN 'width-over' WHEN spare >= CASE WHEN stance = 'duck' THEN -1.5 ELSE -1 END THEN NULL WHEN spare >= -3 THEN 'width-edge' ELSE 'width-risk' END
  ], lambda x: x IS NOT NULL)[1:3], ',') AS reasons
FROM why"""

COMPARISON = _RANKED + """
SELECT rider_id, place AS rank, brand || ' ' || model_name AS title,
  CASE role WHEN 'width-safe' THEN 'больше запаса по ширине' WHEN 'playful' THEN 'более живой вариант' WHEN 'stable' THEN 'более стабильный вариант' ELSE 'лучший общий вариант' END AS role_label,
  CASE WHEN size_cm <= lo + 1 THEN 'нижней' WHEN size_cm >= hi - 1 THEN 'верхней' ELSE 'центральный' END AS length_word,
  'Талия ' || CAST(spare + waist AS INT) || ' мм ' || CASE WHEN spare >= 4 THEN 'даёт заметный запас относительно целевой ширины ' || waist || ' мм.' WHEN spare >= 1 THEN 'даёт небольшой запас относительно целевой ширины ' || waist || ' мм.'
    WHEN spare >= 0 THEN 'почти точно попадает в целевую ширину ' || waist || ' мм.' ELSE 'чуть уже целевой ширины ' || waist || ' мм, поэтому вариант ближе к границе.' END AS width_line,
  CASE WHEN riding_style = style THEN 'совпадает' WHEN riding_style = 'all-mountain' THEN 'универсальный' WHEN style = 'all-mountain' THEN 'смещена' ELSE 'компромиссный' END AS style_word,
  CASE WHEN shape_type IS NULL THEN 'не уточнена' WHEN shape_type = shape_first THEN 'попадание' WHEN list_contains(shape_others, shape_type) THEN 'рабочий' ELSE 'смещена' END AS shape_word, ready
FROM (SELECT *, CASE WHEN spare >= 6 THEN 'width-safe' WHEN size_cm <= target - 0.75 THEN 'playful' WHEN size_cm >= target + 0.75 THEN 'stable' ELSE 'best-overall' END AS role FROM named WHERE chosen AND place <= 3)"""

ORACLE = {"rider_profiles": PROFILE, "product_readiness": READY, "recommendations": MATCHES, "match_reasons": REASONS, "match_comparison": COMPARISON}

ITEMS_CTE = f"""{PROD},
off AS (SELECT *, coalesce(family_id, 'offer:' || id) AS item, CASE member_role WHEN 'base' THEN 0 WHEN 'wide' THEN 1 ELSE 3 END AS ro FROM prod),
ss AS (
  SELECT o.item, o.id AS offer_id, o.slug AS offer_slug, o.is_active AS oa, o.ro, s.id AS sid, s.size_cm, s.width_type, s.waist_width_mm, s.is_available,
    CASE s.width_type WHEN 'regular' THEN 0 WHEN 'mid-wide' THEN 1 ELSE 2 END AS wo,
    CASE WHEN s.size_label IS NOT NULL THEN upper(s.size_label) ELSE CAST(CAST(s.size_cm AS INTEGER) AS VARCHAR) END AS label
  FROM off o JOIN siz s ON s.product_id = o.id WHERE s.size_cm >= 100 OR s.waist_width_mm < 235),
free AS (SELECT offer_id, bool_or(is_available) AS f FROM ss GROUP BY 1),
o2 AS (SELECT o.*, coalesce(f, FALSE) AS f FROM off o LEFT JOIN free ON free.offer_id = o.id),
g AS (
  SELECT item, min(price_from) FILTER (is_active AND price_from > 0) AS price_from, bool_or(is_active AND f) AS has_available_size, count(*) AS n_offers,
    first(slug ORDER BY CASE WHEN price_from > 0 THEN price_from ELSE 1e300 END, ro, source_checked_at DESC NULLS LAST, slug) FILTER (is_active AND f) AS default_offer_slug
  FROM o2 GROUP BY item HAVING bool_or(is_active)),
gs AS (SELECT item, string_agg(label, ',' ORDER BY size_cm, label, wo, ro, offer_slug, sid) AS labels, count(*) AS n_sizes FROM ss GROUP BY 1),
img AS (SELECT item, is_active, u, row_number() OVER (PARTITION BY item, is_active ORDER BY ro, slug, j) AS r FROM (
  SELECT item, is_active, ro, slug, id, 1 AS j, image_url AS u FROM off UNION ALL SELECT item, is_active, ro, slug, id, 2, gallery2 FROM off)),
med AS (SELECT item, is_active, string_agg(u, ',' ORDER BY r) AS media FROM (SELECT item, is_active, u, min(r) AS r FROM img GROUP BY 1, 2, 3) GROUP BY 1, 2),
h AS (
  SELECT id AS item, id AS family_id, slug, brand, model_name, season_label, riding_style, skill_level, flex, board_line, shape_type, camber_profile, data_status, nullif(trim(source_url), '') AS source_url, source_checked_at FROM fam
  UNION ALL SELECT item, NULL, slug, brand, model_name, season_label, riding_style, skill_level, flex, board_line, shape_type, camber_profile, data_status, nullif(trim(source_url), ''), source_checked_at FROM off WHERE family_id IS NULL),
items AS (
  SELECT h.*, g.price_from, g.has_available_size, g.n_offers, g.default_offer_slug, coalesce(gs.labels, '') AS labels, coalesce(gs.n_sizes, 0) AS n_sizes, coalesce(m1.media, m2.media) AS media,
    (SELECT count(*) FROM ss WHERE ss.item = h.item AND oa AND is_available) AS n_free,
    (SELECT count(*) FROM ss WHERE ss.item = h.item AND oa) AS n_active
  FROM h JOIN g USING (item) LEFT JOIN gs USING (item) LEFT JOIN med m1 ON m1.item = h.item AND m1.is_active LEFT JOIN med m2 ON m2.item = h.item AND NOT m2.is_active),
wid AS (SELECT DISTINCT s.item, s.width_type, s.wo FROM ss s JOIN items i USING (item) WHERE s.oa AND (s.is_available OR i.n_free = 0))"""

ITEMS = f"WITH {ITEMS_CTE} SELECT slug, family_id, brand, season_label, riding_style, CAST(flex AS DOUBLE) AS flex, source_url, CAST(price_from AS DOUBLE) AS price_from, has_available_size, n_offers, n_sizes, default_offer_slug, labels, media FROM items"

PRESENTATION = f"""WITH {ITEMS_CTE}
SELECT slug, coalesce((SELECT string_agg(width_type, ',' ORDER BY wo) FROM wid w WHERE w.item = i.item), '') AS widths,
  CASE (SELECT count(*) FROM wid w WHERE w.item = i.item) WHEN 0 THEN 'ширина уточняется' WHEN 1 THEN (SELECT min(CASE width_type WHEN 'regular' THEN 'обычная ширина' ELSE width_type END) FROM wid w WHERE w.item = i.item)
    ELSE (SELECT string_agg(CASE width_type WHEN 'regular' THEN 'обычная' ELSE width_type END, ' + ' ORDER BY wo) FROM wid w WHERE w.item = i.item) END AS width_summary,
  CASE WHEN n_free = 0 THEN 'Сейчас нет доступных размеров' ELSE 'В наличии ' || n_free || ' ' || CASE WHEN n_free % 10 = 1 AND n_free % 100 <> 11 THEN 'размер' WHEN n_free % 10 BETWEEN 2 AND 4 AND n_free % 100 NOT BETWEEN 12 AND 14 THEN 'размера' ELSE 'размеров' END END AS headline,
  CASE WHEN n_free = 0 THEN 'Доступные размеры в магазине сейчас не подтверждены.' ELSE 'Сейчас: ' || (SELECT string_agg(label, ', ' ORDER BY r) FROM (SELECT label, row_number() OVER (ORDER BY size_cm, label, wo, ro, offer_slug, sid) AS r FROM ss WHERE ss.item = i.item AND oa AND is_available) WHERE r <= 5) || CASE WHEN n_free > 5 THEN ' + ещё ' || (n_free - 5) ELSE '' END || '.' END AS preview
FROM items i"""

FACETS = f"""WITH {ITEMS_CTE}
SELECT slug, row_number() OVER (ORDER BY CAST(data_status = 'verified' AS INT) DESC, n_free DESC, coalesce(source_checked_at - DATE '1970-01-01', 0) DESC, price_from NULLS LAST, brand, model_name, slug) AS place
FROM items i WHERE riding_style IN ('park', 'all-mountain') AND board_line IN ('men', 'unisex') AND EXISTS (SELECT 1 FROM wid w WHERE w.item = i.item AND w.width_type IN ('wide', 'mid-wide'))
  AND contains(lower(concat_ws(' ', brand, model_name, replace(slug, '-', ' '))), 'brand#1')"""

BY_PRICE = f"""WITH {ITEMS_CTE}
SELECT slug, row_number() OVER (ORDER BY price_from DESC NULLS LAST, brand, model_name, slug) AS place FROM items"""

CHECKS = f"""WITH {PROD}, p AS (SELECT *, id IN (SELECT product_id FROM siz) AS hs, id IN (SELECT product_id FROM siz WHERE is_available) AS hf FROM prod WHERE is_active),
c(name, severity, failures) AS (
  SELECT 'without_sizes', 'error', count(*) FROM p WHERE NOT hs UNION ALL SELECT 'without_available_size', 'warning', count(*) FROM p WHERE NOT hf
  UNION ALL SELECT 'price_not_positive', 'error', count(*) FROM p WHERE price_from <= 0 UNION ALL SELECT 'missing_image', 'warning', count(*) FROM p WHERE trim(coalesce(image_url, '')) = ''
  UNION ALL SELECT 'placeholder_image', 'warning', count(*) FROM p WHERE image_url LIKE '/boards/%' UNION ALL SELECT 'not_a_store_link', 'warning', count(*) FROM p WHERE affiliate_url NOT LIKE 'https://trial-sport.ru/goods/%'
  UNION ALL SELECT 'untrusted_flex', 'warning', count(*) FROM p WHERE NOT coalesce(data_status = 'verified' AND trim(coalesce(source_url, '')) <> '' AND source_url NOT LIKE 'https://trial-sport.ru/%', FALSE)
  UNION ALL SELECT 'incomplete_specs', 'warning', count(*) FROM p WHERE shape_type IS NULL OR camber_profile IS NULL
  UNION ALL SELECT 'short_adult_size', 'error', count(*) FROM siz WHERE size_cm < 100 AND waist_width_mm >= 235
  UNION ALL SELECT 'implausible_waist', 'error', count(*) FROM siz s JOIN p ON p.id = s.product_id WHERE waist_width_mm <= 0 OR waist_width_mm >= 400 OR (size_cm >= 140 AND (waist_width_mm < 200 OR waist_width_mm > 340)) OR (size_cm >= 100 AND size_cm < 140 AND (waist_width_mm < 170 OR waist_width_mm > 340)) OR (size_cm < 100 AND (waist_width_mm < 120 OR waist_width_mm > 240)))
SELECT *, failures = 0 AS passed FROM c"""

REPAIR = f"""WITH {PROD}, w AS (SELECT id, size_cm, CASE CAST(split_part(id, '-', 2) AS INTEGER) % 4 WHEN 0 THEN waist_width_mm * 10 + 5 WHEN 1 THEN waist_width_mm // 10 WHEN 2 THEN waist_width_mm - 100 ELSE waist_width_mm END AS o FROM siz),
n AS (SELECT *, CAST(CASE WHEN o BETWEEN 1000 AND 4000 THEN floor(o / 10 + 0.5) WHEN o > 0 AND o < 100 THEN o * 10 WHEN size_cm >= 140 AND o BETWEEN 100 AND 199 THEN o + 100 ELSE o END AS INTEGER) AS w2 FROM w)
SELECT id, size_cm, o AS old_waist_width_mm, w2 AS waist_width_mm, CASE WHEN w2 >= 264 THEN 'wide' WHEN w2 >= 257 THEN 'mid-wide' ELSE 'regular' END AS width_type FROM n WHERE o <> w2"""

SOURCES = f"WITH {PROD} SELECT coalesce(nullif(trim(source_name), ''), 'unknown') AS source_name, count(*) AS total_products, count(*) FILTER (is_active) AS active_products FROM prod GROUP BY 1"

BAD_FAMILIES = f"WITH {PROD} SELECT family_id, count(*) AS members, count(*) FILTER (member_role = 'base') AS bases, count(*) FILTER (member_role = 'wide') AS wides FROM prod WHERE family_id IS NOT NULL AND is_active GROUP BY 1 HAVING count(*) <> 2 OR count(*) FILTER (member_role = 'base') <> 1 OR count(*) FILTER (member_role = 'wide') <> 1"

FAILING = f"""WITH {PROD}, p AS (SELECT * FROM prod WHERE is_active), f AS (
  SELECT 'without_sizes' AS name, slug, brand, model_name FROM p WHERE id NOT IN (SELECT product_id FROM siz) UNION ALL SELECT 'without_available_size', slug, brand, model_name FROM p WHERE id NOT IN (SELECT product_id FROM siz WHERE is_available)
  UNION ALL SELECT 'price_not_positive', slug, brand, model_name FROM p WHERE price_from <= 0 UNION ALL SELECT 'not_a_store_link', slug, brand, model_name FROM p WHERE affiliate_url NOT LIKE 'https://trial-sport.ru/goods/%'
  UNION ALL SELECT 'untrusted_flex', slug, brand, model_name FROM p WHERE NOT coalesce(data_status = 'verified' AND trim(coalesce(source_url, '')) <> '' AND source_url NOT LIKE 'https://trial-sport.ru/%', FALSE) UNION ALL SELECT 'incomplete_specs', slug, brand, model_name FROM p WHERE shape_type IS NULL OR camber_profile IS NULL)
SELECT name, slug, brand, model_name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY brand, model_name, slug) AS r FROM f) WHERE r <= 50"""

RELATED = f"""WITH {ITEMS_CTE}, one AS (SELECT riding_style AS s, board_line AS l FROM items WHERE slug = 'p-4')
SELECT slug, row_number() OVER (ORDER BY coalesce(riding_style = s, FALSE) DESC, coalesce(board_line = l, FALSE) DESC, brand, model_name, slug) AS place FROM items, one
WHERE slug <> 'p-4' AND (coalesce(riding_style = s, FALSE) OR coalesce(board_line = l, FALSE)) ORDER BY place LIMIT 3"""

ROUTES = f"""WITH {ITEMS_CTE}, a AS (SELECT 'old-' || slug AS alias, slug FROM prod WHERE family_id IS NULL),
req AS (SELECT slug FROM prod UNION ALL SELECT alias FROM a UNION ALL SELECT 'nowhere-' || id FROM fam)
SELECT r.slug, coalesce(x.slug, y.slug, z.slug) AS canonical, CASE WHEN x.slug IS NOT NULL THEN 'exact' WHEN y.slug IS NOT NULL THEN 'alias' WHEN z.slug IS NOT NULL THEN 'offer' ELSE 'none' END AS kind
FROM req r LEFT JOIN items x ON x.slug = r.slug LEFT JOIN a ON a.alias = r.slug LEFT JOIN items y ON y.slug = a.slug LEFT JOIN off o ON o.slug = r.slug LEFT JOIN items z ON z.item = o.item"""

ORACLE |= {
    "catalogue_items": ITEMS, "catalogue_presentation": PRESENTATION, "catalogue_browse": FACETS, "catalogue_by_price": BY_PRICE, "catalogue_related": RELATED, "catalogue_routes": ROUTES,
    "quality_audit": CHECKS, "waist_repair": REPAIR, "source_counts": SOURCES, "invalid_families": BAD_FAMILIES, "failing_products": FAILING,
}

ISSUES = f"""WITH {PROD}, {TRUST} SELECT slug, concat_ws(',', CASE WHEN NOT verified THEN 'not_verified' END, CASE WHEN NOT has_source THEN 'no_source' END, CASE WHEN shape_type IS NULL THEN 'no_shape' END, CASE WHEN camber_profile IS NULL THEN 'no_camber' END,
  CASE WHEN NOT coalesce(length(trim(affiliate_url)) > 0, FALSE) THEN 'no_link' END, CASE WHEN placeholder_link THEN 'placeholder_link' END) AS issues FROM ready"""
WIDEST = f"WITH {PROD} SELECT product_id, CASE max(CASE width_type WHEN 'wide' THEN 2 WHEN 'mid-wide' THEN 1 ELSE 0 END) WHEN 2 THEN 'wide' WHEN 1 THEN 'mid-wide' ELSE 'regular' END AS width_type FROM siz GROUP BY 1"
DETAILS = f"""WITH {ITEMS_CTE}, x AS (SELECT i.*, (SELECT source_name FROM fam WHERE fam.id = i.item UNION ALL SELECT source_name FROM off WHERE off.item = i.item AND off.family_id IS NULL) AS source_name,
  (SELECT slug FROM off WHERE off.item = i.item AND is_active ORDER BY ro, slug LIMIT 1) AS first_offer FROM items i)
SELECT slug, CASE WHEN source_name IS NULL OR source_url IS NULL THEN 'draft' WHEN data_status = 'verified' THEN 'verified' ELSE 'sourced' END AS trust,
  CASE WHEN data_status = 'verified' AND source_name IS NOT NULL AND source_url IS NOT NULL AND source_url NOT LIKE 'https://trial-sport.ru%' AND source_url NOT LIKE 'https://WWW.Traektoria.ru%' THEN CAST(flex AS DOUBLE) END AS flex, coalesce(default_offer_slug, first_offer) AS narrative_offer,
  day(source_checked_at) || ' ' || ['января', 'февраля', 'марта', 'апреля', 'мая', 'июня', 'июля', 'августа', 'сентября', 'октября', 'ноября', 'декабря'][month(source_checked_at)] || ' ' || year(source_checked_at) || ' г.' AS checked FROM x"""
MATCH_TRUST = f"""WITH {PROD}, {TRUST}, f AS (SELECT * FROM ({MATCHES}) WHERE list = 'recommended')
SELECT rider_id, count(*) AS boards, count(*) FILTER (ready) AS ready, count(*) FILTER (verified) AS verified, CAST(max(source_checked_at) AS VARCHAR) AS last_checked FROM f JOIN ready r ON r.slug = f.slug GROUP BY 1"""
SNAPSHOTS = f"SELECT rider_id, string_agg(place || ':' || slug || ':' || score, ',' ORDER BY place) AS boards FROM ({MATCHES}) WHERE list = 'recommended' GROUP BY 1"

ORACLE |= {"product_issues": ISSUES, "representative_widths": WIDEST, "board_details": DETAILS, "match_trust": MATCH_TRUST, "result_snapshots": SNAPSHOTS}
