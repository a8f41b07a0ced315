"""DuckDB SQL for the event reports."""

EV = r"""
raw AS (
  SELECT *, event_id AS i,
    CASE i % 5 WHEN 0 THEN 'catalog' WHEN 1 THEN 'result' WHEN 2 THEN ' ' WHEN 4 THEN 'quiz' END AS so,
    CASE i % 4 WHEN 0 THEN 'card' WHEN 1 THEN 'hero' WHEN 2 THEN '' ELSE 'list' END AS pl,
    CASE WHEN i % 13 <> 0 THEN 'b-' || (i % 37) END AS bo,
    CASE WHEN i % 7 <> 0 THEN 'o-' || (i % 53) END AS ofr,
    (150 + i % 9) || CASE i % 2 WHEN 0 THEN '' ELSE 'W' END AS si,
    CASE i % 6 WHEN 0 THEN 'https://www.shop-a.example/x' WHEN 1 THEN 'http://Shop-B.example:8080/p?q=1' WHEN 2 THEN 'https://WWW.shop-c.example#f' WHEN 3 THEN 'not a url' WHEN 4 THEN 'https://shop-d.example/' END AS ur
  FROM (SELECT * FROM events)),
ev AS (
  SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS session_id,
    CASE event_type WHEN 'signup' THEN 'quiz_started' WHEN 'purchase' THEN 'quiz_completed' WHEN 'view' THEN 'result_viewed' WHEN 'click' THEN 'product_clicked' WHEN 'error' THEN 'home_viewed' END AS event_name,
    ts AS created_at, i % 101 = 0 AS broken, i % 101 <> 0 AND i % 17 = 0 AS legacy,
    CASE WHEN i % 101 <> 0 THEN nullif(trim(so), '') END AS source, CASE WHEN i % 101 <> 0 THEN nullif(trim(pl), '') END AS placement,
    CASE WHEN i % 101 <> 0 THEN bo END AS board_slug, CASE WHEN i % 101 <> 0 THEN ofr END AS offer_slug, CASE WHEN i % 101 <> 0 THEN si END AS size_label,
    CASE WHEN i % 101 <> 0 THEN nullif(lower(regexp_replace(regexp_extract(ur, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1), '^www\.', '')), '') END AS merchant
  FROM raw),
win(window_key, a, b) AS (VALUES
  ('yesterday', DATE '2024-01-19', DATE '2024-01-19'), ('last7Days', DATE '2024-01-13', DATE '2024-01-19'),
  ('previous7Days', DATE '2024-01-06', DATE '2024-01-12'), ('last30Days', DATE '2023-12-21', DATE '2024-01-19'),
  ('previous30Days', DATE '2023-11-21', DATE '2023-12-20')),
inw AS (
  SELECT w.window_key, e.* FROM win w JOIN ev e
    ON e.created_at >= w.a - INTERVAL 3 HOUR AND e.created_at < w.b + INTERVAL 1 DAY - INTERVAL 3 HOUR)"""

COUNTS = f"""WITH {EV},
names(event_name) AS (VALUES ('home_viewed'), ('quiz_started'), ('quiz_completed'), ('result_viewed'), ('product_clicked'), ('email_submitted'))
SELECT w.window_key, n.event_name, count(e.session_id) AS event_count, count(DISTINCT e.session_id) AS unique_sessions
FROM win w CROSS JOIN names n LEFT JOIN inw e ON e.window_key = w.window_key AND e.event_name = n.event_name GROUP BY 1, 2"""

ROUND4 = "floor(({0} + 2.220446049250313e-16) * 10000.0 + 0.5) / 10000.0"

FUNNEL = f"""WITH {EV},
rel AS (SELECT * FROM inw WHERE event_name IN ('quiz_started', 'quiz_completed', 'result_viewed', 'product_clicked')),
s AS (SELECT window_key, session_id, min(created_at) FILTER (event_name = 'quiz_started') AS q, min(created_at) FILTER (event_name = 'result_viewed') AS v, bool_or(event_name = 'product_clicked') AS c FROM rel GROUP BY 1, 2),
f AS (SELECT w.window_key,
  count(*) FILTER (s.q IS NOT NULL) AS quiz_start_sessions,
  count(*) FILTER (s.q IS NOT NULL AND EXISTS (SELECT 1 FROM rel r WHERE r.window_key = s.window_key AND r.session_id = s.session_id AND r.event_name = 'quiz_completed' AND r.created_at >= s.q)) AS quiz_completed_sessions,
  count(*) FILTER (s.v IS NOT NULL) AS result_viewed_sessions,
  count(*) FILTER (s.v IS NOT NULL AND EXISTS (SELECT 1 FROM rel r WHERE r.window_key = s.window_key AND r.session_id = s.session_id AND r.event_name = 'product_clicked' AND r.created_at > s.v)) AS result_to_store_sessions,
  count(*) FILTER (s.c) AS store_click_sessions
  FROM win w LEFT JOIN s ON s.window_key = w.window_key GROUP BY 1)
SELECT *, CASE WHEN quiz_start_sessions > 0 THEN {ROUND4.format('least(quiz_completed_sessions / quiz_start_sessions, 1)')} END AS quiz_completion_rate,
  CASE WHEN result_viewed_sessions > 0 THEN {ROUND4.format('least(result_to_store_sessions / result_viewed_sessions, 1)')} END AS result_to_store_rate FROM f"""

TIMELINE = f"""WITH {EV},
s AS (SELECT session_id, min(created_at) FILTER (event_name = 'quiz_started') AS q, min(created_at) FILTER (event_name = 'result_viewed') AS v FROM ev GROUP BY 1)
SELECT session_id, q IS NOT NULL AS has_quiz_start,
  EXISTS (SELECT 1 FROM ev r WHERE r.session_id = s.session_id AND r.event_name = 'quiz_completed' AND r.created_at >= s.q) AS has_ordered_quiz_completion,
  v IS NOT NULL AS has_result_view,
  EXISTS (SELECT 1 FROM ev r WHERE r.session_id = s.session_id AND r.event_name = 'product_clicked' AND r.created_at > s.v) AS has_ordered_store_click FROM s"""

CLICKS = f"""{EV},
clicks AS (SELECT * FROM ev WHERE event_name = 'product_clicked'),
c30 AS (SELECT * FROM inw WHERE event_name = 'product_clicked' AND window_key = 'last30Days'),
items AS (
  SELECT 'merchant_board' AS kind, merchant, board_slug AS item, session_id FROM c30 UNION ALL
  SELECT 'merchant_offer', merchant, offer_slug, session_id FROM c30 UNION ALL
  SELECT 'merchant_size', merchant, size_label, session_id FROM c30),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY merchant, kind ORDER BY n DESC, item) AS place
  FROM (SELECT kind, merchant, item, count(*) AS n, count(DISTINCT session_id) AS s FROM items WHERE merchant IS NOT NULL AND item IS NOT NULL GROUP BY 1, 2, 3)),
report AS (
  SELECT 'total' AS kind, w.window_key, NULL::VARCHAR AS group_value, NULL::VARCHAR AS item_value, count(c.session_id) AS event_count, count(DISTINCT c.session_id) AS unique_sessions
  FROM win w LEFT JOIN inw c ON c.window_key = w.window_key AND c.event_name = 'product_clicked' GROUP BY 2
  UNION ALL SELECT 'source', 'last30Days', source, NULL, count(*), count(DISTINCT session_id) FROM c30 GROUP BY 3
  UNION ALL SELECT 'placement', 'last30Days', placement, NULL, count(*), count(DISTINCT session_id) FROM c30 GROUP BY 3
  UNION ALL SELECT 'size', 'last30Days', size_label, NULL, count(*), count(DISTINCT session_id) FROM c30 GROUP BY 3
  UNION ALL SELECT 'merchant', 'last30Days', merchant, NULL, count(*), count(DISTINCT session_id) FROM c30 GROUP BY 3
  UNION ALL SELECT kind, 'last30Days', merchant, item, n, s FROM ranked WHERE place <= 5)"""

COMMERCE = f"WITH {CLICKS} SELECT * FROM report"

SHARES = f"""WITH {CLICKS}
SELECT kind, group_value AS value, event_count AS click_events, unique_sessions AS unique_click_sessions, {ROUND4.format('event_count / whole')} AS share_of_clicks
FROM report, (SELECT event_count AS whole FROM report WHERE kind = 'total' AND window_key = 'last30Days') WHERE kind IN ('source', 'placement', 'size', 'merchant')"""

EVIDENCE = f"""WITH {CLICKS}
SELECT m.group_value AS merchant, m.event_count AS click_events,
  coalesce((SELECT string_agg(item_value || ':' || event_count, ',' ORDER BY event_count DESC, item_value) FROM report r WHERE r.kind = 'merchant_board' AND r.group_value = m.group_value), '') AS boards,
  coalesce((SELECT string_agg(item_value || ':' || event_count, ',' ORDER BY event_count DESC, item_value) FROM report r WHERE r.kind = 'merchant_offer' AND r.group_value = m.group_value), '') AS offers,
  coalesce((SELECT string_agg(item_value || ':' || event_count, ',' ORDER BY event_count DESC, item_value) FROM report r WHERE r.kind = 'merchant_size' AND r.group_value = m.group_value), '') AS sizes
FROM report m WHERE m.kind = 'merchant'"""

TOP = f"""WITH {CLICKS},
boards AS (SELECT 'board' AS kind, board_slug AS identity, count(*) AS event_count, count(DISTINCT session_id) AS unique_sessions, NULL::VARCHAR AS source, NULL::VARCHAR AS merchant
  FROM c30 WHERE board_slug IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10),
offers AS (SELECT 'offer' AS kind, offer_slug AS identity, count(*) AS event_count, count(DISTINCT session_id) AS unique_sessions,
  CASE WHEN count(DISTINCT source) = 1 THEN min(source) END AS source, CASE WHEN count(DISTINCT merchant) = 1 THEN min(merchant) END AS merchant
  FROM c30 WHERE offer_slug IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
SELECT * FROM boards UNION ALL SELECT * FROM offers"""

HISTORY = f"""WITH {EV}
SELECT CAST(greatest(DATE '2024-01-19' - CAST(min(created_at) + INTERVAL 3 HOUR AS DATE) + 1, 0) AS BIGINT) AS history_days,
  count(*) FILTER (legacy) AS legacy_payload_rows, count(*) FILTER (broken) AS invalid_payload_rows FROM ev"""

TRENDS = f"""WITH f AS ({FUNNEL}),
m AS (SELECT window_key, metric, v FROM f UNPIVOT (v FOR metric IN (quiz_completed_sessions, result_viewed_sessions, store_click_sessions))),
p(period, now_key, old_key) AS (VALUES ('week', 'last7Days', 'previous7Days'), ('month', 'last30Days', 'previous30Days'))
SELECT p.period, a.metric, a.v AS current, b.v AS previous, a.v - b.v AS absolute, CASE WHEN b.v <> 0 THEN {ROUND4.format('(a.v - b.v) / b.v')} END AS percent
FROM p JOIN m a ON a.window_key = p.now_key JOIN m b ON b.window_key = p.old_key AND b.metric = a.metric"""

READINESS = f"""WITH f AS (SELECT * FROM ({FUNNEL}) WHERE window_key = 'last30Days'), h AS ({HISTORY}),
x AS (SELECT CAST(quiz_start_sessions AS DOUBLE) AS u, CAST(quiz_completed_sessions AS DOUBLE) AS q, CAST(store_click_sessions AS DOUBLE) AS c, result_to_store_rate AS r, CAST(history_days AS DOUBLE) AS d FROM f, h),
y AS (SELECT *, floor((least(u / 10000, 1) * 25 + 2.220446049250313e-16) * 10 + 0.5) / 10 + floor((least(q / 1000, 1) * 20 + 2.220446049250313e-16) * 10 + 0.5) / 10 + floor((least(c / 300, 1) * 25 + 2.220446049250313e-16) * 10 + 0.5) / 10
  + floor((least(r / 0.1, 1) * 20 + 2.220446049250313e-16) * 10 + 0.5) / 10 + floor((least(d / 60, 1) * 10 + 2.220446049250313e-16) * 10 + 0.5) / 10 AS total FROM x)
SELECT floor((total + 2.220446049250313e-16) * 10 + 0.5) / 10 AS score,
  concat_ws(',', CASE WHEN u IS NULL OR u < 10000 THEN 'traffic_users_30d' END, CASE WHEN q < 1000 THEN 'quiz_completed_sessions_30d' END, CASE WHEN c < 300 THEN 'store_click_sessions_30d' END, CASE WHEN r IS NULL OR r < 0.1 THEN 'result_to_store_rate_30d' END, CASE WHEN d < 60 THEN 'analytics_history_days' END) AS failing_metrics,
  CASE WHEN total IS NULL THEN 'insufficient_data' WHEN u >= 10000 AND q >= 1000 AND c >= 300 AND r >= 0.1 AND d >= 60 THEN 'metric_ready' WHEN total < 40 THEN 'early' WHEN total < 70 THEN 'building_evidence' ELSE 'approaching' END AS status FROM y"""

ORACLE = {
    "event_counts": COUNTS, "streamed_event_counts": COUNTS, "event_funnel": FUNNEL, "session_timeline": TIMELINE, "commerce_report": COMMERCE, "commerce_shares": SHARES, "merchant_evidence": EVIDENCE,
    "top_items": TOP, "event_history": HISTORY, "event_trends": TRENDS, "partner_readiness": READINESS,
}
