"""DuckDB SQL of the shop queries: the same markup, read again with regular expressions and JSON functions."""

from firnline.plans.oracle_catalog import _pick

MARKUP = f"""nm AS (
  SELECT k, k // 2 AS n, {_pick('k // 3', ['Nitro', 'Ride', 'Bataleon', 'Jones'])} AS brand, CASE WHEN k // 2 % 15 = 0 THEN 'Kids ' ELSE '' END || 'Board ' || (k // 2) || {_pick('k', ['', ' Wide', ' Pro', ' Mid Wide', '', ' Plus'])} AS model, k + 3130000 AS number, body
  FROM (SELECT page_id AS k, coalesce(html, '') AS body FROM pages)),
pg AS (
  SELECT k, number, brand AS b0, model AS m0, 'https://www.trial-sport.ru/goods/51526/' || number || '.html' AS url,
    '<h1 class=''x''> Сноуборд ' || brand || ' ' || model || CASE WHEN k % 10 <> 3 THEN ' 2024/2025' ELSE '' END || ' </h1>' || CASE WHEN k % 23 <> 0 THEN '<a href="/gds.php?s=1&brand=' || (k % 7) || '"><span>' || brand || '</span></a>' ELSE '' END ||
    CASE WHEN k % 5 = 0 THEN '<div class="price price_disc">' || (10 + k % 50) || '&thinsp;' || (100 + k % 900) || '&#8381;</div>' ELSE '"price": ' || (12000 + k) END ||
    '"big": "\\/img\\/' || k || '.jpg" "big": "\\/img\\/' || (k + k % 2) || '.jpg"' || CASE WHEN k % 7 <> 0 THEN '<a href=''/svdownload.php?svid=' || (n % 6) || '''>x</a>' ELSE '' END ||
    CASE WHEN k % 3 = 0 THEN '<p>Сноуборд ' || brand || ' ' || model || ' - ' || repeat(CASE WHEN k % 9 = 0 THEN 'женский сноуборд для трассы ' ELSE 'мужской сноуборд для трассы ' END, 6) || '<a href="javascript:void(0)" onclick="showBrand();">' ELSE '' END ||
    '<script>var icspJS = ' || CASE WHEN k % 11 = 0 THEN '[{{"size":"150"' WHEN k % 11 = 5 THEN '{{"a":1}}' WHEN k % 13 = 0 THEN '[{{"size":"150","nalim":"true","stores":[]}},{{"size":"151","im_cols_avail":2,"im_cols_reserved":2}}]'
      ELSE '[{{"size":"' || (150 + k % 5) || '","nalim":' || CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END || ',"note":"a ] b [ \\"q\\""}},{{"size":" ' || (155 + k % 4) || ' W","nal":"' || CASE WHEN k % 2 = 0 THEN 'STORE' ELSE 'no' END || '"}},{{"size":"95","stores":["x"]}},{{"sizecolor":"' || (150 + k % 5) || ' см","im_cols_avail":"3","im_cols_reserved":' || (2 + k % 2) || ',"stores":[]}}]' END
    || ';</script>' || body AS html
  FROM nm)"""

READ = r"""raw AS (
  SELECT *, coalesce(regexp_extract_all(html, '(?i)<a href="/gds\.php[^"]*brand=[^"]*"><span>([^<]+)</span></a>', 1)[-1], '') AS brand, trim(regexp_extract(html, '(?i)<h1[^>]*>\s*([^<]+)\s*</h1>', 1)) AS head,
    regexp_extract(html, '(?s)(?:const|let|var)\s+icspJS\s*=\s*(\[.*?\])\s*;?\s*</script>', 1) AS stock, regexp_extract(html, '(/svdownload\.php\?svid=\d+)', 1) AS spec FROM pg),
f AS (
  SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(head, '^Сноуборд\s+', ''), '^' || brand || '\s+', ''), '\s+20\d{2}(/20\d{2})?$', '')) AS model, CASE WHEN head LIKE '%2024/2025' THEN '2024/2025' END AS season,
    coalesce(try_cast(nullif(regexp_extract(html, '"price":\s*(\d+)', 1), '') AS BIGINT), try_cast(regexp_replace(regexp_extract(html, '(?i)<div class="price(?:\s+price_disc)?">([\d&thinsp;\s]+)&#8381;</div>', 1), '[^\d]', '', 'g') AS BIGINT), 0) AS price,
    [('https://trial-sport.ru' || replace(u, '\/', '/')) FOR u IN regexp_extract_all(html, '"big":\s*"([^"]+)"', 1)] AS imgs, CASE WHEN stock <> '' AND json_valid(stock) THEN stock END AS js, CASE WHEN spec <> '' THEN 'https://trial-sport.ru' || spec END AS book,
    coalesce(regexp_extract(html, '(?s)Сноуборд\s+' || CASE WHEN brand = '' THEN '[^ -]{0,0}' ELSE brand END || '[^-]{0,120}-\s*(.*?)<a href="javascript:void\(0\)" onclick="showBrand\(\);"', 1), '') AS words
  FROM raw),
en AS (
  SELECT k, i, trim(coalesce(e->>'size', e->>'sizecolor')) AS label, coalesce(json_type(e, '$.nalim') = 'BOOLEAN' AND (e->>'nalim') = 'true', FALSE) OR coalesce(lower(e->>'nal') = 'store', FALSE)
      OR coalesce(try_cast(e->>'im_cols_avail' AS DOUBLE), 0) - coalesce(try_cast(e->>'im_cols_reserved' AS DOUBLE), 0) > 0 OR coalesce(json_array_length(e, '$.stores'), 0) > 0 AS free
  FROM (SELECT k, unnest(from_json(js, '["JSON"]')) AS e, generate_subscripts(from_json(js, '["JSON"]'), 1) AS i FROM f WHERE js IS NOT NULL)),
av AS (SELECT k, bool_or(free) AS any_free FROM en GROUP BY 1),
g AS (
  SELECT *, regexp_replace(lower(model), '[^a-z0-9]+', '', 'g') AS key, CASE WHEN regexp_matches(lower(model), '\bmid wide\b') THEN 'mid-wide' WHEN regexp_matches(lower(model), '\b(wide|w)\b') THEN 'wide' ELSE 'base' END || CASE WHEN regexp_matches(lower(model), '\bkids\b') THEN 'youth' ELSE 'adult' END
      || CASE WHEN regexp_matches(lower(model), '\bpro\b') THEN 'pro' ELSE '' END || CASE WHEN regexp_matches(lower(model), ' plus$') THEN 'plus' ELSE '' END AS sig,
    CASE WHEN js IS NULL THEN 'unknown' WHEN av.any_free THEN 'available' ELSE 'unavailable' END AS availability
  FROM f LEFT JOIN av USING (k))"""

SPECS = f"""sp0 AS (
  SELECT n, 'https://trial-sport.ru/svdownload.php?svid=' || (n % 6) AS book, CASE WHEN r = 0 THEN 'Board ' || n || CASE WHEN n % 4 = 1 THEN ' New' ELSE '' END WHEN r = 1 AND n % 3 = 0 THEN 'Board ' || n || ' Wide' WHEN r = 2 AND n % 5 = 0 THEN 'Board ' || n || ' Pro' WHEN r = 3 AND n % 15 = 0 THEN 'Kids Board ' || n END AS name,
    {_pick('n', ['twin', 'directional-twin', 'directional', None])} AS shape, {_pick('n', ['freeride', 'park', 'all-mountain', 'all-mountain', 'all-mountain'])} AS style, n % 10 + 1 AS flex, 250 + n % 20 AS w152, 250 + (n + 9) % 20 AS w156
  FROM (SELECT p_partkey // 4 AS n, p_partkey % 4 AS r FROM part)),
sp AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key, CASE WHEN name LIKE '% Wide' THEN 'wide' ELSE 'base' END || CASE WHEN name LIKE 'Kids%' THEN 'youth' ELSE 'adult' END || CASE WHEN name LIKE '% Pro' THEN 'pro' ELSE '' END AS sig FROM sp0 WHERE name IS NOT NULL AND n % 6 <> 5),
ask AS (SELECT DISTINCT book, key, sig FROM g WHERE book IS NOT NULL AND availability = 'available'),
ma AS (SELECT a.book, a.key, a.sig, CASE WHEN bool_or(sp.key = a.key) THEN 'exact' WHEN count(sp.key) = 1 THEN 'safe-partial' WHEN count(sp.key) > 1 THEN 'ambiguous' ELSE 'none' END AS kind,
    CASE WHEN bool_or(sp.key = a.key) THEN a.key WHEN count(sp.key) = 1 THEN min(sp.key) END AS grp
  FROM ask a LEFT JOIN sp ON sp.book = a.book AND (sp.key = a.key OR ((contains(sp.key, a.key) OR contains(a.key, sp.key)) AND sp.sig = a.sig)) GROUP BY 1, 2, 3),
li AS (SELECT CASE WHEN k % 17 = 1 THEN number || '0' ELSE CAST(number AS VARCHAR) END AS pid, CASE WHEN k % 51 = 0 THEN 'Other' ELSE brand END AS eb, model AS em, CASE k % 2 WHEN 0 THEN 'men' ELSE 'women' END AS line FROM nm WHERE k % 17 IN (0, 1)),
wi AS (SELECT CAST(number AS VARCHAR) AS pid, brand AS eb, CASE WHEN k % 2 = 0 THEN model ELSE 'x' END AS em FROM nm WHERE k % 19 = 0),
x AS (
  SELECT g.*, ma.kind, ma.grp, sp.name, sp.shape, sp.style, sp.flex, sp.w152, sp.w156, li.line AS want, li.pid IS NOT NULL AND (li.eb <> g.brand OR li.em <> g.model) AS li_other, wi.pid IS NOT NULL AS wid, wi.pid IS NOT NULL AND (wi.eb <> g.brand OR wi.em <> g.model) AS wi_other,
    CASE WHEN length(words) BETWEEN 120 AND 2200 THEN trim(words) ELSE '' END AS said
  FROM g LEFT JOIN ma ON ma.book = g.book AND ma.key = g.key AND ma.sig = g.sig AND g.availability = 'available' LEFT JOIN sp ON sp.book = g.book AND sp.key = ma.grp LEFT JOIN li ON li.pid = CAST(g.number AS VARCHAR) LEFT JOIN wi ON wi.pid = CAST(g.number AS VARCHAR)),
y AS (SELECT *, CASE WHEN said LIKE '%жен%' THEN 'women' WHEN said LIKE '%муж%' THEN 'men' ELSE 'unisex' END AS line0, said LIKE '%жен%' OR said LIKE '%муж%' AS known FROM x),
z AS (SELECT *, CASE WHEN want IS NULL THEN 'none' WHEN li_other THEN 'conflict' WHEN known AND line0 <> want THEN 'conflict' WHEN known THEN 'agrees' ELSE 'applied' END AS corr FROM y)"""

SIZES = """key AS (
  SELECT en.k, regexp_replace(replace(regexp_replace(lower(label), '\\s+', '', 'g'), 'см', 'cm'), 'cm$', '') AS key, label, i, free, CAST(regexp_extract(label, '(\\d+)', 1) AS INTEGER) AS cm FROM en WHERE label <> ''),
si AS (
  SELECT z.k, key.key, arg_max(key.label, i) FILTER (WHERE cm >= 100 OR (z.model LIKE '%Kids%' AND cm >= 70)) AS label, arg_max(cm, i) FILTER (WHERE cm >= 100 OR (z.model LIKE '%Kids%' AND cm >= 70)) AS cm, min(i) AS place, bool_or(free) AS free, any_value(w152) AS w152, any_value(w156) AS w156, any_value(wid) AS wid, any_value(z.model) AS model
  FROM z JOIN key USING (k) GROUP BY 1, 2 HAVING label IS NOT NULL),
mm AS (
  SELECT *, CASE WHEN key.key = '152' THEN w152 WHEN key.key = '156w' THEN w156 END AS spec, CASE WHEN cm = 152 THEN w152 WHEN cm = 156 THEN w156 END AS same, CASE WHEN abs(cm - 152) <= abs(cm - 156) THEN w152 ELSE w156 END AS near FROM si key),
fin AS (SELECT k, label, cm, place, free, CASE WHEN wid AND cm = 152 THEN 300 WHEN wid AND cm = 150 THEN 301 ELSE coalesce(spec, same, CASE WHEN regexp_matches(model, '(?i)\\b(wide|w)\\b') THEN greatest(264, coalesce(near, 264)) ELSE coalesce(near, 250) END) END AS mm FROM mm),
ag AS (SELECT k, string_agg(label || ':' || cm || ':' || mm || ':' || CASE WHEN mm >= 264 THEN 'wide' WHEN mm >= 257 THEN 'mid-wide' ELSE 'regular' END || ':' || CASE WHEN free THEN 'true' ELSE 'false' END, ',' ORDER BY cm, place) AS sizes FROM fin GROUP BY 1),
v AS (
  SELECT z.*, ag.sizes, CASE WHEN availability = 'unknown' THEN ['unsafe_failure', 'availability_parse_failure'] WHEN availability = 'unavailable' THEN ['unavailable', NULL] WHEN book IS NULL AND (brand = '' OR model = '') THEN ['unsafe_failure', 'product_parse_failure'] WHEN book IS NULL THEN ['safe_unimportable', 'spec_missing']
    WHEN book LIKE '%=5' THEN ['unsafe_failure', 'spec_fetch_failure'] WHEN book LIKE '%=4' THEN ['unsafe_failure', 'spec_parse_failure'] WHEN brand = '' OR model = '' THEN ['unsafe_failure', 'product_parse_failure'] WHEN wi_other THEN ['unsafe_failure', 'source_metadata_conflict']
    WHEN grp IS NULL AND NOT wid THEN ['safe_unimportable', 'spec_group_missing'] WHEN ag.sizes IS NULL THEN ['unsafe_failure', 'product_parse_failure'] WHEN corr = 'conflict' THEN ['unsafe_failure', 'source_metadata_conflict'] ELSE ['resolved', NULL] END AS o
  FROM z LEFT JOIN ag USING (k))"""

WITH = f"WITH {MARKUP}, {READ}, {SPECS}, {SIZES}"

ORACLE = {
    "shop_products": f"""{WITH}
SELECT url, o[1] AS status, o[2] AS reason, availability, brand, model AS model_name, trim(regexp_replace(lower(brand || ' ' || model), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN model LIKE '% Mid Wide' THEN 'mid-wide' WHEN model LIKE '% Wide' THEN 'wide' END AS variant, season AS season_label,
  price AS price_from, array_to_string(CASE WHEN imgs[1] = imgs[2] THEN imgs[:1] ELSE imgs END, ',') AS images, kind AS match_kind, name AS matched_model, CASE WHEN o[1] = 'resolved' THEN CASE WHEN corr IN ('applied', 'agrees') THEN want ELSE line0 END END AS board_line,
  CASE WHEN o[1] = 'resolved' THEN CASE WHEN known OR corr = 'applied' THEN 'known' ELSE 'missing' END END AS line_evidence, CASE WHEN o[1] = 'resolved' THEN corr END AS correction, CASE WHEN o[1] = 'resolved' THEN coalesce(style, 'all-mountain') END AS riding_style, CASE WHEN o[1] = 'resolved' THEN shape END AS shape_type,
  CASE WHEN o[1] = 'resolved' THEN CAST(coalesce(flex, 5) AS INTEGER) END AS flex, CASE WHEN o[1] = 'resolved' THEN CASE WHEN coalesce(flex, 5) >= 8 THEN 'advanced' WHEN coalesce(flex, 5) <= 4 THEN 'beginner' ELSE 'intermediate' END END AS skill_level, CASE WHEN o[1] = 'resolved' THEN sizes END AS sizes, md5(said) AS description_md5
FROM v""",
    "shop_corrections": f"""{WITH}
SELECT li.pid AS source_product_id, coalesce(corr, 'unused') AS outcome, count(z.k) AS n FROM li LEFT JOIN (SELECT * FROM z WHERE book IS NOT NULL) z ON CAST(z.number AS VARCHAR) = li.pid GROUP BY 1, 2""",
}
