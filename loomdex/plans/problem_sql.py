"""Problems 3 to 5 as SQL."""

from loomdex.plans.index_diff_sql import FITS, P1

P3 = f"""
SELECT DISTINCT file_id, label FROM gff_fields
WHERE path = label AND lower(type) IN ('float','double','byte','char','word','short','dword','int','dword64','int64')
  AND value IS NOT NULL AND trim(value) <> '' AND NOT ({FITS.format(t="type", v="value")})
"""

P3_WIDE_CELLS = f"""
WITH e AS (SELECT DISTINCT file_id, lower(label) AS attribute, lower(type) AS kind, value, coalesce({FITS.format(t="type", v="value")}, false) AS fit FROM gff_fields
           WHERE path = label AND file_id IN (SELECT id FROM files WHERE ext IN ('uti','utc','utp','utm'))),
t AS (SELECT attribute, CASE WHEN bool_and(kind IN ('byte','char','word','short','dword','int','int64')) THEN 'bigint'
        WHEN bool_and(kind IN ('byte','char','word','short','dword','int','int64','float','double')) THEN 'double' ELSE 'string' END AS col FROM e GROUP BY 1),
c AS (SELECT * FROM e JOIN t USING (attribute) QUALIFY row_number() OVER (PARTITION BY file_id, attribute ORDER BY NOT fit, value IS NULL, value) = 1),
w AS (SELECT file_id, attribute, col AS kind, CASE WHEN col = 'bigint' AND fit THEN CAST(TRY_CAST(trim(value) AS DECIMAL(38,0)) AS BIGINT) END AS whole,
        CASE WHEN col = 'double' AND fit THEN TRY_CAST(trim(value) AS DOUBLE) END AS "real", CASE WHEN col = 'string' THEN value END AS text FROM c)
SELECT file_id, attribute, kind, coalesce(whole, 0) AS whole, coalesce("real", 0) AS "real", coalesce(text, '') AS text FROM w WHERE whole IS NOT NULL OR "real" IS NOT NULL OR text IS NOT NULL
"""

_ORPHANS = r"""
WITH k AS (SELECT DISTINCT * FROM ref_kinds),
held AS (SELECT DISTINCT g.file_id, g.path, f.ext, f.indexed_at, lower(trim(g.value)) AS resref, k.target_ext
         FROM gff_fields g JOIN files f ON f.id = g.file_id AND f.removed_at IS NULL
         JOIN k ON k.file_ext = f.ext AND k.label = g.label AND k.list_label = regexp_extract(g.path, '([^/\[\]]*)\[[0-9]+\][^\[\]]*$', 1)
         WHERE trim(g.value) <> ''),
base AS (SELECT DISTINCT lower(name) AS name FROM base_resources),
t AS (SELECT resref, ext, count(*) AS n, count(*) FILTER (WHERE removed_at IS NULL) AS live, min(indexed_at) FILTER (WHERE removed_at IS NULL) AS first
      FROM files GROUP BY 1, 2),
j AS (SELECT h.file_id, h.path, h.ext, h.indexed_at, h.resref, max(CASE WHEN b.name IS NULL THEN 0 ELSE 1 END) AS base,
      coalesce(sum(t.n), 0) AS n, coalesce(sum(t.live), 0) AS live, min(t.first) AS first
      FROM held h LEFT JOIN t ON t.resref = h.resref AND t.ext = h.target_ext LEFT JOIN base b ON b.name = h.resref || '.' || h.target_ext
      GROUP BY 1, 2, 3, 4, 5),
o AS (SELECT DISTINCT file_id, path, ext, CASE WHEN n = 0 THEN 'missing' WHEN live = 0 THEN 'deleted' WHEN first > indexed_at THEN 'late' END AS state,
      strftime(indexed_at, '%Y-%m') AS period FROM j WHERE base = 0)
"""
P5_FOUND = _ORPHANS + "SELECT file_id, path, state, period FROM o WHERE state IS NOT NULL"
P5_REPORT = _ORPHANS + "SELECT ext, period, state, count(*) AS n FROM o WHERE state IS NOT NULL GROUP BY 1, 2, 3"

_BODIES = r"""
WITH RECURSIVE raw AS (SELECT DISTINCT file_id, trim(regexp_replace(trim(body, ' \t\n\r'), '^' || chr(65279), ''), ' \t\n\r' || chr(10) || chr(13) || chr(9)) AS b FROM gff_raw WHERE body IS NOT NULL),
whole AS (SELECT file_id, CAST(b AS JSON) AS j FROM raw WHERE CASE WHEN json_valid(b) THEN json_type(b) = 'OBJECT' ELSE false END),
s(file_id, path, parent_path, node) AS (
 SELECT file_id, '', CAST(NULL AS VARCHAR), j FROM whole
 UNION ALL
 SELECT file_id, CASE WHEN path = '' THEN '' ELSE path || '/' END || k || CASE WHEN t = 'list' THEN '[' || (i - 1) || ']' ELSE '' END, path, x FROM (
  SELECT file_id, path, k, t, unnest(items) AS x, generate_subscripts(items, 1) AS i FROM (
   SELECT s.file_id, s.path, e.key AS k, json_extract_string(e.value, '$.type') AS t,
    CASE WHEN json_type(e.value, '$.value') = 'ARRAY' AND json_extract_string(e.value, '$.type') = 'list' THEN CAST(json_extract(e.value, '$.value') AS JSON[])
         WHEN json_type(e.value, '$.value') = 'OBJECT' THEN [json_extract(e.value, '$.value')] ELSE [] END AS items
   FROM s, json_each(node) e WHERE NOT starts_with(e.key, '__') AND json_extract_string(e.value, '$.type') IN ('struct', 'list')))
 WHERE json_type(x) = 'OBJECT')
"""
P4_FOUND = _BODIES + "SELECT DISTINCT file_id, path, parent_path FROM s WHERE parent_path IS NOT NULL"
P4_FIELDS = _BODIES + r"""
SELECT DISTINCT s.file_id, CASE WHEN s.path = '' THEN '' ELSE s.path || '/' END || e.key AS path, s.path AS parent_path, e.key AS label, json_extract_string(e.value, '$.type') AS type,
 CASE WHEN json_type(e.value, '$.value') = 'OBJECT' THEN '{' || list_aggregate(list_transform(list_sort(json_keys(e.value, '$.value')), lambda k: to_json(k) || ': ' || CAST(json_extract(e.value, '$.value."' || k || '"') AS VARCHAR)), 'string_agg', ', ') || '}'
      ELSE json_extract_string(e.value, '$.value') END AS value
FROM s, json_each(node) e WHERE NOT starts_with(e.key, '__') AND json_extract_string(e.value, '$.type') NOT IN ('struct', 'list')
"""
P4_REJECTED = _BODIES + "SELECT DISTINCT file_id, CASE WHEN b = '' THEN 'empty' WHEN json_valid(b) THEN 'not_object' ELSE 'not_json' END AS why FROM raw WHERE NOT CASE WHEN json_valid(b) THEN json_type(b) = 'OBJECT' ELSE false END"

PROBLEM_SQL = {"p4_found": P4_FOUND, "p4_fields": P4_FIELDS, "p4_rejected": P4_REJECTED, "p1_found": P1, "p3_found": P3, "p3_wide_cells": P3_WIDE_CELLS, "p5_found": P5_FOUND, "p5_report": P5_REPORT}
