"""Queries of the general training-data problems and their SQL."""

from __future__ import annotations

from sluice.operators.diff import p5_found
from sluice.operators.flatten import p4_found, p4_tables
from sluice.operators.instants import p1_found, p1_zones
from sluice.operators.intervals import p2_found
from sluice.operators.rejects import p3_found, p3_loaded
from sluice.operators.replay import p6_committed, p6_found, p6_watermark

QUERIES = {"p1_found": p1_found, "p1_zones": p1_zones, "p2_found": p2_found, "p3_found": p3_found, "p3_loaded": p3_loaded, "p4_found": p4_found, "p4_tables": p4_tables, "p5_found": p5_found, "p6_found": p6_found, "p6_committed": p6_committed, "p6_watermark": p6_watermark}

SQL = {
    "p2_found": """
WITH RECURSIVE s AS (
  SELECT DISTINCT mpd_id, period_id, as_id, snap, ord, t::HUGEINT AS t, coalesce(d, 0)::HUGEINT AS d, coalesce(r, 0) AS r FROM segment_timeline_s
), w AS (
  SELECT *, lead(t) OVER c AS next_t,
    sum(CASE WHEN r >= 0 THEN d * (r + 1) ELSE 0 END) OVER c - CASE WHEN r >= 0 THEN d * (r + 1) ELSE 0 END AS run
  FROM s WINDOW c AS (PARTITION BY mpd_id, period_id, as_id, snap ORDER BY ord)
), a AS (
  SELECT *, coalesce(last_value(t IGNORE NULLS) OVER c, 0) AS anchor, coalesce(last_value(CASE WHEN t IS NOT NULL THEN run END IGNORE NULLS) OVER c, 0) AS anchor_run
  FROM w WINDOW c AS (PARTITION BY mpd_id, period_id, as_id, snap ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), b AS (SELECT mpd_id, period_id, as_id, d, r, next_t, anchor + run - anchor_run AS s FROM a),
i AS (
  SELECT mpd_id, period_id, as_id, s, CASE WHEN r = -1 AND d > 0 THEN coalesce(next_t, s) WHEN r >= 0 THEN s + d * (r + 1) ELSE s END AS e FROM b
), p AS (
  SELECT *, max(e) OVER (PARTITION BY mpd_id, period_id, as_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM i WHERE e > s
), n AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY mpd_id, period_id, as_id ORDER BY s, e) AS k FROM p
), u AS (SELECT mpd_id, period_id, as_id, k, min(s) AS s, max(e) AS e FROM n GROUP BY ALL),
g AS (SELECT *, lag(e) OVER (PARTITION BY mpd_id, period_id, as_id ORDER BY k) AS prev FROM u)
SELECT mpd_id, period_id, as_id, 'period' AS kind, CAST(CAST(s AS HUGEINT) AS VARCHAR) AS start_t, CAST(CAST(e AS HUGEINT) AS VARCHAR) AS end_t FROM g
UNION ALL
SELECT mpd_id, period_id, as_id, 'gap', CAST(CAST(prev AS HUGEINT) AS VARCHAR), CAST(CAST(s AS HUGEINT) AS VARCHAR) FROM g WHERE prev IS NOT NULL""",
    "p3_found": """
WITH k AS (SELECT line_id, raw, string_split(regexp_replace(raw, '"[^"]*"', chr(1), 'g'), ',') AS s FROM conversion_raw WHERE raw IS NOT NULL),
q AS (SELECT line_id, raw, len(s) AS n, len(list_filter(s, lambda x: regexp_matches(x, '["\\r\\n]') OR (contains(x, chr(1)) AND trim(x, chr(1)) <> ''))) > 0 AS bad FROM k),
v AS (SELECT line_id, list_transform(regexp_extract_all(',' || raw, ',("(?:[^"]|"")*"|[^",]*)', 1), lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM q WHERE NOT bad AND n = 8),
w AS (SELECT line_id, f, regexp_extract(trim(f[7], E' \\t\\r\\n'), '^([0-9]{4}-[0-9]{2}-[0-9]{2})T(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\\.[0-9]+)?|24:00:00(\\.0+)?)(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?$', 1) AS day FROM v),
j AS (SELECT line_id, f, day, list_transform(f[4:5], lambda x: x = '' OR (json_valid(x) AND NOT regexp_matches(x, ',\\s*\\]\\s*$') AND json_type(CASE WHEN json_valid(x) THEN x ELSE '[]' END) = 'ARRAY'
  AND len(list_filter(CAST(CASE WHEN json_valid(x) AND json_type(CASE WHEN json_valid(x) THEN x ELSE '[]' END) = 'ARRAY' THEN x ELSE '[]' END AS JSON[]), lambda y: coalesce(json_type(y), 'NULL') <> 'VARCHAR')) = 0)) AS lists FROM w)
SELECT line_id, 'quoting' AS reason, '' AS field FROM q WHERE bad
UNION ALL SELECT line_id, 'column_count', '' FROM q WHERE NOT bad AND n <> 8
UNION ALL SELECT line_id, 'invalid_value', field FROM (SELECT line_id, unnest([
  CASE WHEN f[1] = '' THEN 'doc_id' END, CASE WHEN f[2] NOT IN ('dash-js', 'dash-if', 'iso-annex-G', 'iso-annex-H', 'iso-annex-K', 'misc') THEN 'category' END,
  CASE WHEN trim(f[3], E' \\t\\r\\n') NOT IN ('true', 'false', '1', '0') THEN 'success' END, CASE WHEN NOT lists[1] THEN 'xsd_errors' END, CASE WHEN NOT lists[2] THEN 'json_schema_errors' END,
  CASE WHEN try_cast(nullif(day, '') AS DATE) IS NULL THEN 'finished_at' END, CASE WHEN f[8] <> '' AND NOT (regexp_full_match(f[8], '[0-9]+') AND try_cast(f[8] AS BIGINT) IS NOT NULL) THEN 'ms_to_json' END]) AS field FROM j) WHERE field IS NOT NULL""",
    "p4_found": """
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, mpd::JSON AS j FROM mpd_json WHERE mpd IS NOT NULL),
pi AS (
  SELECT doc_id, 'ProgramInformation' AS path, j->'ProgramInformation' AS o FROM d WHERE json_type(j, '$.ProgramInformation') = 'OBJECT'
  UNION ALL
  SELECT doc_id, 'ProgramInformation[' || (i - 1) || ']', (j->'ProgramInformation')[i - 1]
  FROM (SELECT doc_id, j, unnest(range(1, 1 + json_array_length(j, '$.ProgramInformation')::BIGINT)) AS i FROM d WHERE json_type(j, '$.ProgramInformation') = 'ARRAY')
), program AS (
  SELECT doc_id, 'program' AS kind, path, '' AS parent_path, coalesce(CASE WHEN json_type(o, '$.Title') = 'OBJECT' THEN o->'Title'->>'$."$value"' ELSE o->>'Title' END, '') AS value
  FROM pi WHERE json_type(o) = 'OBJECT'
), ns AS (
  SELECT doc_id, 'ns' AS kind, k AS path, '' AS parent_path, coalesce(CASE WHEN json_type(b) = 'OBJECT' THEN b->>'prefix' ELSE b->>'$' END, '') AS value
  FROM (SELECT doc_id, k, map_extract(m, k)[1] AS b FROM (SELECT doc_id, unnest(map_keys(m)) AS k, m FROM (SELECT doc_id, CAST(j->'$."$ns"' AS MAP(VARCHAR, JSON)) AS m FROM d WHERE json_type(j->'$."$ns"') = 'OBJECT')))
), walk AS (
  SELECT doc_id, '' AS path, '' AS parent, j AS node FROM d WHERE json_type(j) = 'OBJECT'
  UNION ALL
  SELECT doc_id, CASE WHEN k IS NULL THEN path || '[' || i || ']' WHEN path = '' THEN k ELSE path || '.' || k END, CASE WHEN k IS NULL THEN parent ELSE path END, v
  FROM (
    SELECT doc_id, path, parent, k, NULL::BIGINT AS i, map_extract(m, k)[1] AS v FROM (SELECT doc_id, path, parent, unnest(map_keys(m)) AS k, m FROM (SELECT doc_id, path, parent, CAST(node AS MAP(VARCHAR, JSON)) AS m FROM walk WHERE json_type(node) = 'OBJECT'))
    UNION ALL
    SELECT doc_id, path, parent, NULL, i, node[i] FROM (SELECT doc_id, path, parent, node, unnest(range(json_array_length(node)::BIGINT)) AS i FROM walk WHERE json_type(node) = 'ARRAY')
  ) WHERE json_type(v) IN ('OBJECT', 'ARRAY') AND NOT coalesce(k = '$ns' AND path <> '', false)
)
SELECT DISTINCT doc_id, kind, path, parent_path, value FROM program
UNION SELECT doc_id, kind, path, parent_path, value FROM ns
UNION SELECT doc_id, 'value', path, parent, coalesce(map_extract(CAST(node AS MAP(VARCHAR, JSON)), '$value')[1]->>'$', '') FROM walk WHERE json_type(node) = 'OBJECT' AND list_contains(json_keys(node), '$value')""",
    "p6_committed": """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS mpd_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
k AS (SELECT *, min(event_id) OVER (PARTITION BY mpd_id) AS first FROM e WHERE event_id % 23 <> 0),
g AS (SELECT mpd_id, min(event_id) AS gap FROM k WHERE before % 23 = 0 AND event_id > first GROUP BY mpd_id)
SELECT k.mpd_id, CAST(event_id AS VARCHAR) AS rep_id, event_id AS bandwidth FROM k LEFT JOIN g USING (mpd_id) WHERE gap IS NULL OR event_id < gap
UNION ALL SELECT DISTINCT mpd_id, 'r', 0 FROM e""",
    "p3_loaded": """
WITH k AS (SELECT raw, string_split(regexp_replace(raw, '"[^"]*"', chr(1), 'g'), ',') AS s FROM conversion_raw WHERE raw IS NOT NULL),
v AS (SELECT list_transform(regexp_extract_all(',' || raw, ',("(?:[^"]|"")*"|[^",]*)', 1), lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM k
  WHERE len(s) = 8 AND len(list_filter(s, lambda x: regexp_matches(x, '["\\r\\n]') OR (contains(x, chr(1)) AND trim(x, chr(1)) <> ''))) = 0),
w AS (SELECT f, regexp_extract(trim(f[7], E' \\t\\r\\n'), '^([0-9]{4}-[0-9]{2}-[0-9]{2})T(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\\.[0-9]+)?|24:00:00(\\.0+)?)(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?$', 1) AS day,
  list_transform(f[4:5], lambda x: CASE WHEN x = '' THEN 0 WHEN json_valid(x) AND NOT regexp_matches(x, ',\\s*\\]\\s*$') AND json_type(CASE WHEN json_valid(x) THEN x ELSE '{}' END) = 'ARRAY'
    AND len(list_filter(CAST(CASE WHEN json_valid(x) AND json_type(CASE WHEN json_valid(x) THEN x ELSE '{}' END) = 'ARRAY' THEN x ELSE '[]' END AS JSON[]), lambda y: coalesce(json_type(y), 'NULL') <> 'VARCHAR')) = 0 THEN CAST(json_array_length(x) AS BIGINT) END) AS sizes FROM v)
SELECT f[2] AS category, count(*) AS records, count(*) FILTER (trim(f[3], E' \\t\\r\\n') IN ('true', '1')) AS passed, CAST(sum(sizes[1] + sizes[2]) AS BIGINT) AS errors, CAST(coalesce(sum(try_cast(nullif(f[8], '') AS BIGINT)), 0) AS BIGINT) AS ms FROM w
WHERE f[1] <> '' AND f[2] IN ('dash-js', 'dash-if', 'iso-annex-G', 'iso-annex-H', 'iso-annex-K', 'misc') AND trim(f[3], E' \\t\\r\\n') IN ('true', 'false', '1', '0') AND sizes[1] IS NOT NULL AND sizes[2] IS NOT NULL
  AND try_cast(nullif(day, '') AS DATE) IS NOT NULL AND (f[8] = '' OR (regexp_full_match(f[8], '[0-9]+') AND try_cast(f[8] AS BIGINT) IS NOT NULL)) GROUP BY f[2]""",
}
