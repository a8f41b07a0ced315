"""DuckDB SQL for family, identity, ledger, merge, golden and text queries."""

from firnline.plans.oracle_catalog import MATCHES, PROD, RIDERS, _pick
from firnline.plans.oracle_events import CLICKS, FUNNEL, HISTORY

NAMED = f"""{PROD},
nm0 AS (SELECT *, CAST(substr(id, 4) AS BIGINT) AS k FROM prod),
nm AS (
  SELECT id, slug, k, source_url, is_active, 'make ' || (k // 30) AS brand, 'model ' || (k // 3) AS stem,
    CASE WHEN k % 3 = 1 THEN ' wide' WHEN k % 3 = 2 AND k % 2 = 0 THEN ' w' WHEN k % 3 = 2 THEN ' pro' ELSE '' END AS ending,
    CASE WHEN k % 8 = 0 THEN NULL WHEN k % 15 = 1 THEN '2023/2024' ELSE '2024/2025' END AS season, CASE WHEN k % 13 = 0 THEN 'park' ELSE 'freeride' END AS style,
    CASE WHEN k % 4 <> 0 THEN {_pick('k // 9', ['twin', 'directional-twin', 'directional', None, 'tapered-directional', 'asym-twin'])} END AS shape FROM nm0),
ev AS (SELECT product_id, count(*) AS n, bool_or(coalesce(regexp_matches(size_label, '[0-9]+w$'), FALSE) OR width_type <> 'regular') AS e FROM siz GROUP BY 1),
pairs AS (
  SELECT b.slug AS base, v.slug AS variant, CASE v.ending WHEN ' wide' THEN 'explicit-wide' ELSE 'ambiguous-single-w' END AS marker, b.season AS bs, v.season AS vs,
    concat_ws(',', CASE WHEN b.style <> v.style THEN 'riding_style' END, CASE WHEN b.shape <> v.shape THEN 'shape_type' END) AS conflicts, coalesce(eb.n, 0) AS nb, coalesce(ev.n, 0) AS nv, coalesce(ev.e, FALSE) AS e, b.brand, b.stem
  FROM nm v JOIN nm b ON b.brand = v.brand AND b.stem = v.stem AND b.ending = '' LEFT JOIN ev eb ON eb.product_id = b.id LEFT JOIN ev ON ev.product_id = v.id WHERE v.ending IN (' wide', ' w')),
classed AS (
  SELECT *, CASE WHEN bs <> vs THEN 'KEEP_SEPARATE|seasons differ' WHEN marker <> 'explicit-wide' THEN 'REVIEW_WIDTH_FAMILY|marker is ambiguous' WHEN bs IS NULL OR vs IS NULL THEN 'REVIEW_WIDTH_FAMILY|season is missing' WHEN conflicts <> '' THEN 'REVIEW_WIDTH_FAMILY|fields conflict'
    WHEN nb = 0 OR nv = 0 THEN 'REVIEW_WIDTH_FAMILY|no sizes' WHEN NOT e THEN 'REVIEW_WIDTH_FAMILY|no wide sizes' ELSE 'HIGH_CONFIDENCE_WIDTH_FAMILY|same name, season and make' END AS c FROM pairs),
sure AS (SELECT concat_ws('|', 'v1', brand, stem, bs) AS identity_key, base, variant AS wide FROM classed WHERE c LIKE 'HIGH%')"""

PAIRS = f"WITH {NAMED} SELECT base, variant, marker, split_part(c, '|', 1) AS classification, split_part(c, '|', 2) AS reason, conflicts FROM classed"
ORPHANS = f"""WITH {NAMED}, q AS (SELECT * FROM nm WHERE k % 6 <> 0)
SELECT slug, CASE ending WHEN ' wide' THEN 'explicit-wide' ELSE 'ambiguous-single-w' END AS marker FROM q v WHERE ending IN (' wide', ' w') AND NOT EXISTS (SELECT 1 FROM q b WHERE b.brand = v.brand AND b.stem = v.stem AND b.ending = '')"""
PROTECTED = f"WITH {NAMED} SELECT b.slug AS base, v.slug AS variant, 'pro' AS suffix FROM nm v JOIN nm b ON b.brand = v.brand AND b.stem = v.stem AND b.ending = '' WHERE v.ending = ' pro'"
DUPLICATES = f"""WITH {NAMED} SELECT brand, stem AS model, season, string_agg(slug, ',' ORDER BY slug) AS slugs, count(DISTINCT nullif(lower(regexp_extract(trim(source_url), '^[a-zA-Z]+://([^/]+)', 1)), '')) AS hosts FROM nm GROUP BY 1, 2, 3 HAVING count(*) > 1"""
PROPOSALS = f"WITH {NAMED} SELECT * FROM sure"
RECONCILE = f"""WITH {NAMED}, x AS (SELECT *, CAST(substr(base, 3) AS BIGINT) AS n FROM sure)
SELECT identity_key, CASE WHEN n % 5 = 0 THEN 'create' WHEN n % 2 = 0 THEN 'keep_manual' WHEN n % 7 <> 0 AND n % 11 <> 0 THEN 'noop' WHEN n % 11 <> 0 THEN 'replace_wide' WHEN n % 7 <> 0 THEN 'replace_base' ELSE 'conflict' END AS action FROM x"""

OFFERS = f"""{PROD},
of0 AS (SELECT id, is_active, CAST(substr(id, 4) AS BIGINT) AS k, CAST(substr(id, 4) AS BIGINT) // 4 AS g FROM prod),
offers AS (
  SELECT id, k, is_active, 'o-' || CASE WHEN k % 9 = 0 THEN k ELSE g END AS base_slug, 'make ' || (g // 5) AS brand, 'model ' || g || CASE WHEN g % 6 = 0 AND k % 4 = 3 THEN ' wide' ELSE '' END AS model, CASE WHEN g % 6 = 0 AND k % 4 = 3 THEN 'wide' END AS variant,
    CASE g % 3 WHEN 0 THEN CASE k % 2 WHEN 0 THEN 'men' ELSE 'women' END WHEN 1 THEN 'men' ELSE 'unisex' END AS line, CASE WHEN g % 5 = 0 THEN CASE k % 2 WHEN 0 THEN '2023 2024' ELSE '2024 2025' END ELSE '2024 2025' END AS season,
    CASE k % 2 WHEN 0 THEN 'traektoria' ELSE 'trial-sport' END AS store, CASE k % 2 WHEN 0 THEN k + 1000 ELSE (k // 8) * 8 + 7 END AS pid FROM of0)"""

COMPATIBLE = f"""WITH {OFFERS}
SELECT l.base_slug, l.id AS left, r.id AS right, concat_ws(',', CASE WHEN l.brand <> r.brand OR l.model <> r.model THEN 'name' END, CASE WHEN l.store = r.store AND l.pid <> r.pid THEN 'store id' END,
  CASE WHEN l.line <> 'unisex' AND r.line <> 'unisex' AND l.line <> r.line THEN 'line' WHEN (l.line = 'unisex' OR r.line = 'unisex') AND (l.store <> r.store OR l.pid <> r.pid) THEN 'line unknown' END,
  CASE WHEN l.season <> r.season THEN 'season' END, CASE WHEN l.variant IS DISTINCT FROM r.variant THEN 'variant' END) AS reasons
FROM offers l JOIN offers r ON l.base_slug = r.base_slug AND l.id < r.id"""

STALE = f"""WITH {OFFERS}, e AS (SELECT id AS slug, k, CASE WHEN k % 10 <> 9 THEN store END AS store, CASE WHEN k % 10 <> 9 THEN pid END AS pid FROM offers WHERE is_active AND k % 3 <> 0),
res AS (SELECT DISTINCT store, pid FROM offers WHERE k % 3 = 0 AND k % 10 <> 9),
seen AS (SELECT store, pid, max(CASE WHEN store = 'trial-sport' OR (k // 4) % 2 = 0 THEN 'available' ELSE 'unavailable' END) AS a FROM offers WHERE k % 3 = 1 AND k % 4 < 2 AND k % 10 <> 9 GROUP BY 1, 2)
SELECT e.slug, coalesce(e.store, 'none') AS store, CASE WHEN e.store IS NULL OR res.pid IS NOT NULL THEN 'stale' WHEN a = 'available' THEN 'keep' WHEN a = 'unavailable' THEN 'stale' WHEN k % 5 < 3 THEN CASE k % 3 WHEN 0 THEN 'stale' WHEN 1 THEN 'keep' ELSE 'block' END ELSE 'revalidate' END AS decision
FROM e LEFT JOIN res ON res.store = e.store AND res.pid = e.pid LEFT JOIN seen ON seen.store = e.store AND seen.pid = e.pid"""

LEDGER = f"""led AS (
  SELECT k AS id, CASE WHEN k % 7 <> 0 THEN {_pick('k // 7', ['pending', 'sending', 'sent', 'partial_sent', 'failed', 'conflict', 'sending', 'pending'])} END AS st, k % 13 = 0 AS other, CASE WHEN k % 3 = 0 THEN 'provider_outcome_unknown' END AS cat,
    CASE WHEN k % 4 < 2 THEN -(k % 5 - 2) END AS lease, CASE WHEN k % 6 <> 0 THEN -(k % 40) END AS last, k % 7 AS tries, CASE WHEN k % 5 = 0 THEN -(k % 9 - 4) END AS next, -(k % 200) * 24 AS made, k % 3 = k % 2 AS held,
    k % 8 = 0 AS msg, k % 16 = 1 AS threw, {_pick('k', ['invalid_idempotent_request', None, 'concurrent_idempotent_requests', 'other', 'rate_limit_exceeded'])} AS err, CASE k % 9 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 400 WHEN 3 THEN 503 WHEN 4 THEN 422 WHEN 5 THEN 200 END AS code, k % 2 = 0 AS complete, k
  FROM (SELECT o_orderkey AS k FROM orders))"""

CLAIMS = f"""WITH {LEDGER},
c AS (SELECT id, CASE WHEN st IS NULL THEN 'create_and_claim|' WHEN other THEN 'conflict|logical_id_content_conflict' WHEN st IN ('sent', 'partial_sent') THEN 'noop|' WHEN st = 'conflict' THEN 'conflict|' || coalesce(cat, 'delivery_conflict') WHEN st = 'failed' THEN 'fail|' || coalesce(cat, 'delivery_failed')
  WHEN st = 'sending' AND lease > 0 THEN 'busy|' WHEN st = 'sending' AND last <= -23 THEN 'fail|provider_outcome_unknown_expired' WHEN tries >= 5 THEN 'fail|delivery_attempts_exhausted' WHEN next > 0 THEN 'busy|' WHEN cat IS NOT NULL AND last <= -23 THEN 'fail|provider_outcome_unknown_expired' ELSE 'claim_stored|' END AS c FROM led)
SELECT id AS logical_id, split_part(c, '|', 1) AS action, nullif(split_part(c, '|', 2), '') AS category FROM c"""

OUTCOMES = f"""WITH {LEDGER},
o AS (SELECT *, CASE WHEN msg THEN 'success|' WHEN threw OR (err IS NULL AND code IS NULL) THEN 'retry|provider_outcome_unknown' WHEN err = 'invalid_idempotent_request' THEN 'conflict|provider_idempotency_conflict' WHEN err = 'concurrent_idempotent_requests' THEN 'retry|provider_concurrent_request'
  WHEN code = 429 OR err = 'rate_limit_exceeded' THEN 'retry|provider_rate_limited' WHEN code IS NULL THEN 'retry|provider_outcome_unknown' WHEN code >= 500 THEN 'retry|provider_unavailable' ELSE 'failed|provider_request_rejected' END AS oc, coalesce(st = 'sending', FALSE) AND held AS mine FROM led),
n AS (SELECT *, split_part(oc, '|', 1) AS kind, CASE WHEN oc LIKE 'success%' THEN CASE WHEN complete THEN 'sent' ELSE 'partial_sent' END WHEN oc LIKE 'conflict%' THEN 'conflict' WHEN oc LIKE 'failed%' OR tries >= 5 THEN 'failed' ELSE 'pending' END AS ns FROM o)
SELECT id AS logical_id, CASE WHEN mine THEN ns ELSE st END AS delivery_status, CASE WHEN NOT mine THEN 'delivery_lease_lost' WHEN kind <> 'success' THEN split_part(oc, '|', 2) END AS category,
  CASE WHEN mine THEN CASE WHEN ns = 'pending' THEN CAST(1705752000 + 60 * CASE greatest(least(tries, 4), 1) WHEN 1 THEN 15 WHEN 2 THEN 60 WHEN 3 THEN 360 ELSE 720 END AS DOUBLE) END ELSE CAST(1705752000 + next * 3600 AS DOUBLE) END AS next_attempt_epoch FROM n"""

DUE = f"WITH {LEDGER} SELECT id AS logical_id, st AS delivery_status FROM led WHERE (st = 'pending' AND (next IS NULL OR next <= 0)) OR (st = 'sending' AND lease <= 0) ORDER BY coalesce(next, lease, made), id LIMIT 10"
RETAINED = f"WITH {LEDGER}, old AS (SELECT id FROM led WHERE st IN ('sent', 'partial_sent', 'failed', 'conflict') AND made <= -90 * 24 ORDER BY made, id LIMIT 100) SELECT id AS logical_id, st AS delivery_status FROM led WHERE id NOT IN (SELECT id FROM old)"
SWEEP = f"WITH {LEDGER} SELECT id % 50 AS sweep, first(st ORDER BY CASE st WHEN 'failed' THEN 0 WHEN 'conflict' THEN 1 WHEN 'pending' THEN 2 ELSE 3 END, id) AS status FROM led WHERE st IN ('pending', 'sent', 'partial_sent', 'failed', 'conflict') GROUP BY 1"

LEADS = """WITH o AS (SELECT c_custkey AS e, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 10 END AS q, c_custkey % 4 = 0 AS c FROM customer WHERE c_custkey % 5 <> 0),
n AS (SELECT c_custkey AS e, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 100 END AS q, c_custkey % 6 = 0 AS c FROM customer WHERE c_custkey % 3 <> 1)
SELECT coalesce(o.e, n.e) AS email, CASE WHEN n.e IS NOT NULL THEN 'new' ELSE 'old' END AS source, CAST(coalesce(n.q, o.q) AS DOUBLE) AS quiz_result_id, coalesce(n.c, FALSE) OR coalesce(o.c, FALSE) AS consent, CASE WHEN o.e IS NOT NULL THEN 'old-id' ELSE 'new-id' END AS id FROM o FULL JOIN n ON n.e = o.e"""
CHILDREN = f"WITH {PROD} SELECT s.id, s.product_id, s.size_cm FROM siz s JOIN prod p ON p.id = s.product_id WHERE p.data_status <> 'draft' UNION ALL SELECT 'n-' || id, id, 150.0 FROM prod WHERE data_status = 'draft'"
GUARDED = f"WITH {PROD} SELECT slug, CASE WHEN family_id IS NULL THEN 'f-new' ELSE family_id END AS family_id, CASE WHEN family_id IS NULL THEN 'base' ELSE member_role END AS member_role FROM prod"
LATEST = "SELECT o_custkey AS session_id, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS latest FROM orders GROUP BY 1"

GOLDEN = f"""WITH {RIDERS}, c AS (SELECT *, rider_id AS k, 140 + rider_id % 20 AS s0, 152 + rider_id % 18 AS s1, 240 + rider_id % 20 AS w0, 255 + rider_id % 25 AS w1 FROM rider)
SELECT k AS case_id, 'length' AS "check", CASE WHEN lo >= s0 AND hi <= s1 THEN 'PASS' ELSE 'REVIEW' END AS status, CASE WHEN lo >= s0 AND hi <= s1 THEN NULL ELSE 'P1-fit' END AS priority FROM c
UNION ALL SELECT k, 'width', CASE WHEN (k % 2 = 0 AND width_type <> 'wide') OR (k % 2 = 1 AND width_type <> 'regular') THEN 'PASS' WHEN k % 2 = 1 THEN 'FAIL' ELSE 'REVIEW' END, CASE WHEN (k % 2 = 0 AND width_type <> 'wide') OR (k % 2 = 1 AND width_type <> 'regular') THEN NULL WHEN k % 2 = 1 THEN 'P0-safety' ELSE 'P2-profile' END FROM c
UNION ALL SELECT k, 'waist', CASE WHEN waist BETWEEN w0 AND w1 THEN 'PASS' WHEN waist < w0 THEN 'FAIL' ELSE 'REVIEW' END, CASE WHEN waist BETWEEN w0 AND w1 THEN NULL WHEN waist < w0 THEN 'P0-safety' ELSE 'P2-profile' END FROM c
UNION ALL SELECT k, 'boot_drag', CASE WHEN boot_drag_risk = 'low' OR (k % 3 <> 0 AND boot_drag_risk = 'medium') THEN 'PASS' ELSE 'REVIEW' END, CASE WHEN boot_drag_risk = 'low' OR (k % 3 <> 0 AND boot_drag_risk = 'medium') THEN NULL ELSE 'P2-profile' END FROM c
UNION ALL SELECT k, 'shape', CASE WHEN shape_first IN ('twin', 'directional') THEN 'PASS' ELSE 'REVIEW' END, CASE WHEN shape_first IN ('twin', 'directional') THEN NULL ELSE 'P2-profile' END FROM c"""

INVARIANTS = f"""WITH {RIDERS}, n AS (SELECT *, CASE width_type WHEN 'regular' THEN 0 WHEN 'mid-wide' THEN 1 ELSE 2 END AS wr, CASE boot_drag_risk WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS br FROM rider),
j AS (SELECT a.rider_id AS k, CASE a.rider_id % 7 WHEN 0 THEN b.lo >= a.lo AND b.hi >= a.hi WHEN 1 THEN b.lo <= a.lo AND b.hi <= a.hi WHEN 2 THEN b.waist >= a.waist WHEN 3 THEN b.wr >= a.wr WHEN 4 THEN b.br >= a.br WHEN 5 THEN b.lo = a.lo AND b.hi = a.hi AND b.wr = a.wr AND b.waist = a.waist AND b.br = a.br AND b.shape_first = a.shape_first END AS ok,
  b.wr <> a.wr OR b.waist <> a.waist OR b.br <> a.br AS safety, b.lo <> a.lo OR b.hi <> a.hi AS len FROM n a JOIN n b ON b.rider_id = a.rider_id + 1)
SELECT k AS rule_id, CASE WHEN ok IS NULL THEN 'NOT_OBSERVABLE' WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN ok IS NULL THEN 'P3-observability' WHEN ok THEN NULL WHEN k % 7 < 2 THEN 'P1-fit' WHEN k % 7 = 5 THEN CASE WHEN safety THEN 'P0-safety' WHEN len THEN 'P1-fit' ELSE 'P2-profile' END ELSE 'P0-safety' END AS priority FROM j"""

HOSTS = r"SELECT nullif(lower(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1), '^www\.', '')), '') AS merchant, count(*) AS pages FROM pages GROUP BY 1"
PAGE_TEXT = r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&quot;', '"'), '&#039;', ''''), '&lt;', '<'), '&gt;', '>', 'g'), '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'))) AS text_md5 FROM pages"""

SEASONS = f"""WITH t AS (SELECT p_partkey, p_partkey % 10 AS i FROM part)
SELECT p_partkey, CASE i WHEN 0 THEN '2023/2024' WHEN 1 THEN '2024/2025' WHEN 2 THEN '2024/2025' WHEN 3 THEN '2024/2025' WHEN 4 THEN '2023' WHEN 5 THEN '2023/2024' WHEN 9 THEN '2022' END AS season,
  CASE i WHEN 0 THEN '2023/2024' WHEN 1 THEN '2024/2025' WHEN 2 THEN '2024/2025' WHEN 3 THEN '2024/2025' WHEN 4 THEN '2022/2023' WHEN 5 THEN '2023/2024' WHEN 6 THEN 'none' WHEN 8 THEN '25/24' WHEN 9 THEN '2022/2023' END AS identity,
  CASE i WHEN 0 THEN 20242023 WHEN 1 THEN 20252024 WHEN 2 THEN 20252024 WHEN 3 THEN 20252024 WHEN 4 THEN 2023 WHEN 5 THEN 20242023 WHEN 9 THEN 2022 END::DOUBLE AS rank,
  CASE i WHEN 0 THEN '2023/2024' WHEN 1 THEN '2024/2025' WHEN 2 THEN '2024/2025' WHEN 3 THEN 'fw 25' WHEN 4 THEN 'сезон 2023' WHEN 5 THEN 'fw''2024' WHEN 6 THEN 'none' WHEN 8 THEN '2025/2024' WHEN 9 THEN '2022 2023' END AS family FROM t"""

NUMBERS = """WITH t AS (SELECT p_partkey, p_partkey % 10 AS i FROM part)
SELECT p_partkey, CASE i WHEN 0 THEN 60 WHEN 1 THEN 60 WHEN 2 THEN 25.4 WHEN 3 THEN 255 WHEN 4 THEN 2540 WHEN 6 THEN 8 WHEN 9 THEN 5570.5 END::DOUBLE AS number,
  CASE i WHEN 0 THEN 600 WHEN 1 THEN 600 WHEN 2 THEN 254 WHEN 3 THEN 255 WHEN 4 THEN 254 WHEN 6 THEN 80 WHEN 9 THEN 5571 END::DOUBLE AS waist,
  CASE i WHEN 5 THEN 3 WHEN 6 THEN 8 WHEN 7 THEN 5 WHEN 8 THEN 5 ELSE 10 END::BIGINT AS flex, CASE i WHEN 0 THEN 60 WHEN 1 THEN 60 WHEN 2 THEN 25 WHEN 3 THEN 255 WHEN 4 THEN 2540 WHEN 6 THEN 8 WHEN 9 THEN 55 ELSE 0 END::BIGINT AS low, CASE i WHEN 1 THEN 80 WHEN 9 THEN 71 END::DOUBLE AS high,
  CASE i WHEN 0 THEN 60 WHEN 1 THEN 60 WHEN 2 THEN 25.4 WHEN 3 THEN 255 WHEN 4 THEN 2540 WHEN 6 THEN 8 WHEN 9 THEN 55 END::DOUBLE AS cm,
  CASE i WHEN 0 THEN '60+кг' WHEN 1 THEN '60-80' WHEN 2 THEN '25,4' WHEN 3 THEN '255' WHEN 4 THEN '2540' WHEN 5 THEN 'мягкая' WHEN 6 THEN 'жесткая8' WHEN 7 THEN 'средняя' WHEN 8 THEN '' ELSE '55–70,5' END AS size_key FROM t"""

SLUGS = r"""SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-and-plus-2-doska-s' AS slug, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') || 'andplus2doskas' AS key,
  trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' and fw24 plus 2 доска 2024 2025 snowboards' AS identity FROM part"""

ORACLE = {
    "family_pairs": PAIRS, "family_orphans": ORPHANS, "family_protected": PROTECTED, "family_duplicates": DUPLICATES, "family_proposals": PROPOSALS, "family_reconciliation": RECONCILE, "offer_compatibility": COMPATIBLE, "stale_offers": STALE,
    "ledger_claims": CLAIMS, "ledger_outcomes": OUTCOMES, "ledger_due": DUE, "ledger_retained": RETAINED, "sweep_status": SWEEP, "lead_upsert": LEADS, "size_replacement": CHILDREN, "guarded_update": GUARDED, "latest_orders": LATEST,
    "golden_cases": GOLDEN, "golden_invariants": INVARIANTS, "page_hosts": HOSTS, "page_text": PAGE_TEXT, "season_labels": SEASONS, "feed_numbers": NUMBERS, "name_slugs": SLUGS,
}

WARNINGS = f"""WITH h AS ({HISTORY}), f AS ({FUNNEL}), c AS (WITH {CLICKS} SELECT * FROM report), t AS (SELECT coalesce(sum(n), 0) AS exact FROM (WITH {CLICKS} SELECT count(*) AS n FROM c30 WHERE offer_slug IS NOT NULL GROUP BY offer_slug ORDER BY 1 DESC, offer_slug LIMIT 10)),
x AS (SELECT max(event_count) FILTER (kind = 'total' AND window_key = 'last30Days') AS clicks, max(event_count) FILTER (kind = 'merchant' AND group_value IS NULL) AS unk FROM c)
SELECT 'legacy_payload_string_encoding' AS code, 'info' AS severity FROM h WHERE legacy_payload_rows > 0 UNION ALL SELECT 'invalid_payload_rows', 'warning' FROM h WHERE invalid_payload_rows > 0 UNION ALL SELECT 'insufficient_history', 'warning' FROM h WHERE history_days < 60
UNION ALL SELECT 'quiz_completion_exceeds_starts', 'warning' WHERE EXISTS (SELECT 1 FROM f WHERE quiz_completed_sessions > quiz_start_sessions) UNION ALL SELECT 'result_to_store_exceeds_views', 'warning' WHERE EXISTS (SELECT 1 FROM f WHERE result_to_store_sessions > result_viewed_sessions)
UNION ALL SELECT 'incomplete_exact_offer_provenance', 'info' FROM x, t WHERE clicks > 0 AND exact < clicks UNION ALL SELECT 'unknown_merchant_dominance', 'warning' FROM x WHERE unk / nullif(clicks, 0) >= 0.5"""

LINKS = f"""WITH {PROD}, l AS (SELECT *, CAST(substr(id, 4) AS BIGINT) AS k FROM prod)
SELECT slug, CASE WHEN k % 7 = 0 THEN 'saved' WHEN k % 3 = 0 THEN 'direct' ELSE 'fallback-search' END AS mode, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN 'Траектория' ELSE 'Trial Sport' END AS merchant,
  CASE WHEN k % 3 = 0 THEN 'https://www.traektoria.ru/product/' || k || '_x' ELSE 'https://trial-sport.ru/search/?q=' || replace(replace(brand, '#', '%23'), ' ', '+') || '+Pro+x%26y' END AS url,
  '/go/' || slug || '?' || CASE WHEN k % 2 = 0 THEN 'from=catalog&' ELSE '' END || CASE WHEN k % 5 = 0 THEN 'placement=top+card&' ELSE '' END || 'sizeLabel=' || (k % 20 + 140) || 'W' AS href, slug AS back FROM l"""

TABLES = """WITH t AS (SELECT p_partkey, p_partkey AS k, CASE p_partkey % 2 WHEN 0 THEN 'row' ELSE 'column' END AS orientation FROM part),
s AS (SELECT p_partkey, orientation, CAST(140 + k % 20 AS VARCHAR) AS size_label, CAST(140 + k % 20 AS DOUBLE) AS size_cm, CAST((24 + k % 3) * 10 AS INTEGER) AS w, CASE k % 2 WHEN 0 THEN 50 ELSE 0 END AS lo, CASE k % 2 WHEN 0 THEN 70 END AS hi FROM t
  UNION ALL SELECT p_partkey, orientation, CAST(150 + k % 20 AS VARCHAR), 150 + k % 20, CAST(250 + k % 30 AS INTEGER), CASE k % 2 WHEN 0 THEN 65 ELSE 0 END, NULL FROM t)
SELECT p_partkey, orientation, size_label, size_cm, w AS waist_width_mm, CAST(lo AS INTEGER) AS recommended_weight_min, CAST(hi AS DOUBLE) AS recommended_weight_max, CASE WHEN w >= 264 THEN 'wide' WHEN w >= 257 THEN 'mid-wide' ELSE 'regular' END AS width_type FROM s"""

GUIDE = f"""WITH {PROD}, {RIDERS}, f AS (SELECT * FROM ({MATCHES}) WHERE list = 'recommended'),
m AS (SELECT f.*, s.waist_width_mm AS w, s.width_type = r.width_type AS fits, p.riding_style = 'park' AS park FROM f JOIN prod p ON p.slug = f.slug JOIN siz s ON s.product_id = p.id AND s.size_cm = f.size_cm AND coalesce(s.size_label, '') = f.size_label JOIN rider r ON r.rider_id = f.rider_id),
a AS (SELECT rider_id, first(slug ORDER BY CASE WHEN role IN ('best-overall', 'stable') THEN 0 ELSE 1 END, CASE WHEN role IN ('best-overall', 'stable') THEN -score END, place) AS s1 FROM m GROUP BY 1),
b AS (SELECT a.*, s2 FROM a LEFT JOIN (SELECT m.rider_id, first(slug ORDER BY CASE WHEN role = 'width-safe' OR fits THEN 0 ELSE 1 END, CASE WHEN role = 'width-safe' OR fits THEN -w END, place) AS s2 FROM m JOIN a ON a.rider_id = m.rider_id AND a.s1 <> m.slug GROUP BY 1) USING (rider_id)),
c AS (SELECT b.*, s3 FROM b LEFT JOIN (SELECT m.rider_id, first(slug ORDER BY CASE WHEN role = 'playful' OR park THEN 0 ELSE 1 END, CASE WHEN role = 'playful' OR park THEN m.size_cm END, place) AS s3 FROM m JOIN b ON b.rider_id = m.rider_id AND b.s1 <> m.slug AND b.s2 IS DISTINCT FROM m.slug GROUP BY 1) USING (rider_id)),
top AS (SELECT rider_id, slug AS best FROM m WHERE place = 1)
SELECT rider_id, choice, slug FROM (SELECT rider_id, 'steady-choice' AS choice, s1 AS slug FROM c UNION ALL SELECT c.rider_id, 'width-choice', coalesce(s2, best) FROM c JOIN top USING (rider_id) UNION ALL SELECT c.rider_id, 'playful-choice', coalesce(s3, best) FROM c JOIN top USING (rider_id))"""

ORACLE |= {"report_warnings": WARNINGS, "store_links": LINKS, "size_tables": TABLES, "decision_guide": GUIDE, "table_checksum": "SELECT count(*) AS rows FROM supplier"}

ORACLE |= {
    "table_digest": """WITH r AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, md5(to_json({'s_acctbal': s_acctbal, 's_name': s_name, 's_nationkey': s_nationkey, 's_suppkey': s_suppkey})) AS h FROM supplier),
p AS (SELECT substr(md5(k), 1, 3) AS p, md5(string_agg(h, '' ORDER BY k, h)) AS h FROM r GROUP BY 1)
SELECT (SELECT count(*) FROM r) AS rows, md5(string_agg(h, '' ORDER BY p, h)) AS md5 FROM p"""
}
