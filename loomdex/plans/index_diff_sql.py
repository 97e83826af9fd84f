"""Problem 1 as SQL."""

FITS = r"""
CASE WHEN lower({t}) IN ('float','double') THEN regexp_full_match(trim({v}), '-?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')
     WHEN lower({t}) IN ('byte','char','word','short','dword','int','dword64','int64') AND regexp_full_match(trim({v}), '-?[0-9]+')
     THEN coalesce(TRY_CAST(trim({v}) AS DECIMAL(38,0)) BETWEEN
       CASE lower({t}) WHEN 'char' THEN -128 WHEN 'short' THEN -32768 WHEN 'int' THEN -2147483648 WHEN 'int64' THEN -9223372036854775808 ELSE 0 END
       AND CASE lower({t}) WHEN 'byte' THEN 255 WHEN 'char' THEN 127 WHEN 'word' THEN 65535 WHEN 'short' THEN 32767 WHEN 'dword' THEN 4294967295
           WHEN 'int' THEN 2147483647 WHEN 'int64' THEN 9223372036854775807 ELSE 18446744073709551615 END, false)
     ELSE false END
"""

_REL = r"regexp_replace(lower(replace(relpath, '\', '/')), '^(\./)+', '')"

P1 = f"""
WITH l AS (SELECT DISTINCT id, source_id, {_REL} AS rel, lower(sha256) AS sha256, size, status FROM files),
r AS (SELECT DISTINCT id, source_id, {_REL} AS rel, lower(sha256) AS sha256, size, status FROM files_mirror),
m AS (SELECT l.id AS lid, r.id AS rid, l.sha256 IS DISTINCT FROM r.sha256 AS d1, l.size IS DISTINCT FROM r.size AS d2, l.status IS DISTINCT FROM r.status AS d3
      FROM l JOIN r USING (source_id, rel)),
a AS (SELECT DISTINCT file_id, path, lower(type) AS kind, value, coalesce({FITS.format(t="type", v="value")}, false) AS fit FROM gff_fields WHERE file_id IN (SELECT lid FROM m)),
b AS (SELECT DISTINCT m.lid AS file_id, path, lower(type) AS kind, value, coalesce({FITS.format(t="type", v="value")}, false) AS fit FROM gff_fields_mirror JOIN m ON m.rid = file_id),
j AS (SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.path, b.path) AS path, a.file_id IS NULL AS no_l, b.file_id IS NULL AS no_r,
      a.kind IS DISTINCT FROM b.kind AS dk,
      CASE WHEN a.fit AND b.fit THEN CASE WHEN a.kind IN ('float','double') OR b.kind IN ('float','double') THEN CAST(trim(a.value) AS DOUBLE) <> CAST(trim(b.value) AS DOUBLE)
                ELSE CAST(trim(a.value) AS DECIMAL(38,0)) <> CAST(trim(b.value) AS DECIMAL(38,0)) END
           ELSE a.value IS DISTINCT FROM b.value END AS dv
      FROM a FULL JOIN b ON a.file_id = b.file_id AND a.path = b.path)
SELECT 'files' AS tbl, id AS file_id, '' AS path, '' AS col, 'left_only' AS side FROM l WHERE id NOT IN (SELECT lid FROM m)
UNION ALL SELECT 'files', id, '', '', 'right_only' FROM r WHERE id NOT IN (SELECT rid FROM m)
UNION ALL SELECT 'files', lid, '', 'sha256', 'differs' FROM m WHERE d1
UNION ALL SELECT 'files', lid, '', 'size', 'differs' FROM m WHERE d2
UNION ALL SELECT 'files', lid, '', 'status', 'differs' FROM m WHERE d3
UNION ALL SELECT 'gff_fields', file_id, path, '', CASE WHEN no_r THEN 'left_only' ELSE 'right_only' END FROM j WHERE no_l OR no_r
UNION ALL SELECT 'gff_fields', file_id, path, 'type', 'differs' FROM j WHERE NOT no_l AND NOT no_r AND dk
UNION ALL SELECT 'gff_fields', file_id, path, 'value', 'differs' FROM j WHERE NOT no_l AND NOT no_r AND dv
"""
