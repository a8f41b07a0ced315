"""DuckDB SQL of the digest queries: faults by its walk over JSON, hashes over the canonical text of the made reports."""

from firnline.operators import digest as rules
from firnline.operators import json_tree, report_digest
from firnline.plans import digest_queries as q


def _lit(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    return f"[{', '.join(map(_lit, x))}]" if isinstance(x, list) else "'" + x.replace("'", "''") + "'"


SCHEMA = ", ".join(f"({', '.join(map(_lit, row))})" for row in json_tree.schema_rows(report_digest.digest_schema()))
DOC = _lit(q._text(q.digest_sample()))
CASES = " ".join(f"WHEN {i} THEN replace({DOC}, {_lit(old)}, {_lit(new)})" for i, (old, new) in enumerate(q.FAULTS) if old)

FAULTS = f"""WITH sc(pattern, parent, key, kind, nullable, optional, vals, rule) AS (VALUES {SCHEMA}),
docs AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, replace(CASE s_suppkey % {len(q.FAULTS)} {CASES} ELSE {DOC} END, '{q.MARK}', CAST(s_suppkey AS VARCHAR)) AS j FROM supplier),
n AS (
  SELECT d.id, t.fullkey AS path, t.path AS parent, regexp_replace(t.fullkey, '\\[\\d+\\]', '[]', 'g') AS pattern, regexp_replace(t.path, '\\[\\d+\\]', '[]', 'g') AS pp, CASE WHEN ends_with(t.fullkey, ']') OR t.fullkey = '$' THEN NULL ELSE t.key END AS key,
    CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, CASE WHEN t.type = 'VARCHAR' THEN t.atom->>'$' END AS text
  FROM (SELECT id, CASE WHEN json_valid(j) THEN j ELSE '{{}}' END AS j FROM docs) d, json_tree(d.j) t),
typed AS (SELECT n.*, sc.kind AS want, nullable, vals, rule FROM n JOIN sc USING (pattern)),
bad AS (
  SELECT id, 'schema:' || path || ':invalid_' || want AS f FROM typed WHERE NOT (nullable AND kind = 'null') AND (kind <> want OR (vals IS NOT NULL AND NOT list_contains(vals, text)) OR CASE rule WHEN 'date' THEN NOT regexp_matches(text, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') OR try_cast(text AS DATE) IS NULL
    WHEN 'hash' THEN NOT regexp_matches(text, '^sha256:[a-f0-9]{{64}}$') WHEN 'path' THEN NOT (text LIKE '/%' AND text NOT LIKE '//%' AND text NOT LIKE '%?%' AND text NOT LIKE '%#%') WHEN 'instant' THEN try_cast(text AS TIMESTAMP) IS NULL ELSE FALSE END)
  UNION SELECT n.id, 'schema:' || n.path || ':unknown_key' FROM n JOIN sc p ON p.pattern = n.pp AND p.kind = 'object' WHERE n.key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sc WHERE sc.pattern = n.pattern)
  UNION SELECT n.id, 'schema:' || n.path || '.' || sc.key || ':missing_key' FROM n JOIN sc ON sc.parent = n.pattern AND sc.key IS NOT NULL AND NOT sc.optional WHERE n.kind = 'object' AND NOT EXISTS (SELECT 1 FROM n m WHERE m.id = n.id AND m.parent = n.path AND m.key = sc.key)
  UNION SELECT id, 'privacy:' || path || ':forbidden_key' FROM n WHERE regexp_replace(lower(key), '[^a-z0-9]', '', 'g') IN ({', '.join(map(_lit, sorted(rules.FORBIDDEN)))})
  {' '.join(f"UNION SELECT id, 'privacy:' || path || ':{name}' FROM n WHERE kind = 'string' AND regexp_matches(trim(text), {_lit(p)})" for name, p in rules.LEAKS.items())})
SELECT docs.id, coalesce(string_agg(DISTINCT CASE WHEN json_valid(j) THEN f ELSE 'schema:$:invalid_json' END, ',' ORDER BY CASE WHEN json_valid(j) THEN f ELSE 'schema:$:invalid_json' END), '') AS faults FROM docs LEFT JOIN bad ON bad.id = docs.id GROUP BY 1"""


def _digest(full: bool) -> tuple[str, str, str, str]:
    """Canonical texts of evidence, of content around the evidence hash, and of the digest around both, with @ marks."""
    d = q.digest_sample()
    evidence = {k: d[k] for k in report_digest.EVIDENCE}
    if not full:
        evidence["sourceStatus"]["metrika"]["status"] = "unavailable"
        evidence["sampling"]["traffic"]["sources30Days"] = None
    content = evidence | {"version": q.VERSION, "kind": "@K", "logicalId": "@L", "status": "complete" if full else "partial", "sourceReport": {"version": "report-v3", "evidenceHash": "@E"}}
    whole = content | {"generatedAt": q.TEXTS["instant"], "delivery": {"contentHash": "@C"}}
    return tuple(_lit(rules.canonical(x)) for x in (evidence | {"sourceReportVersion": "report-v3"}, content, whole)) + ("complete" if full else "partial",)


def _by_source(i: int) -> str:
    return f"CASE WHEN k % 5 = 0 THEN {_digest(False)[i]} ELSE {_digest(True)[i]} END"


DIGESTS = f"""WITH a AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'weekly' ELSE 'daily' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN 'weekly:2024-W02' ELSE 'daily:2024-01-14' END AS logical_id FROM supplier),
b AS (SELECT *, {', '.join(f"replace(CASE WHEN k % 7 = 0 THEN replace({_by_source(i)}, '2024-01-07', '2024-01-06') ELSE {_by_source(i)} END, '{q.MARK}', CAST(k AS VARCHAR)) AS t{i}" for i in range(3))} FROM a),
c AS (SELECT *, 'sha256:' || sha256(t0) AS e, CASE WHEN k % 2 = 0 AND k % 7 = 0 THEN 'weekly_period_invalid' WHEN k % 11 = 0 THEN 'digest_schema_invalid' WHEN k % 13 = 0 THEN 'digest_privacy_violation' END AS problem FROM b),
d AS (SELECT *, 'sha256:' || sha256(replace(replace(replace(t1, '@K', kind), '@L', logical_id), '@E', e)) AS h FROM c)
SELECT CAST(k AS VARCHAR) AS id, CASE WHEN problem IS NULL THEN logical_id END AS logical_id, CASE WHEN problem IS NULL THEN CASE WHEN k % 5 = 0 THEN 'partial' ELSE 'complete' END END AS status, CASE WHEN problem IS NULL THEN e END AS evidence_hash, CASE WHEN problem IS NULL THEN h END AS content_hash,
  CASE WHEN problem IS NULL THEN length(replace(replace(replace(replace(t2, '@K', kind), '@L', logical_id), '@E', e), '@C', h)) END AS length, problem FROM d"""

ORACLE = {"digest_faults": FAULTS, "report_digests": DIGESTS}
