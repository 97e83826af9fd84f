"""All queries of the llm subpackage, with their SQL."""

from __future__ import annotations

from loomdex.llm import bpe, encodings, leaks, pages, survivors

QUERIES = {
    "p2_found": encodings.p2_found,
    "p2_restored": encodings.p2_restored,
    "p6_found": survivors.p6_found,
    "p6_records": survivors.p6_records,
    "p7_ids": bpe.p7_ids,
    "p8_found": leaks.p8_found,
    "p9_found": pages.p9_found,
    "p9_shares": pages.p9_shares,
}

_COPIES = """
WITH RECURSIVE f AS (SELECT DISTINCT id, source_id, ext, lower(content_hash) AS a, lower(sha256) AS b, mtime, size, kind, resref FROM files WHERE removed_at IS NULL),
hub AS (SELECT ext, 'a' AS k, a AS h, min(id) AS m FROM f WHERE a IS NOT NULL GROUP BY ALL UNION ALL SELECT ext, 'b', b, min(id) FROM f WHERE b IS NOT NULL GROUP BY ALL),
e AS (SELECT f.id AS x, m AS y FROM f JOIN hub ON hub.ext = f.ext AND ((k = 'a' AND h = a) OR (k = 'b' AND h = b)) WHERE f.id <> m),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, w.y FROM reach r JOIN both_ways w ON w.x = r.y),
root AS (SELECT x AS id, least(x, min(y)) AS group_id FROM reach GROUP BY x),
c AS (SELECT f.*, group_id, CASE s.kind WHEN 'hak' THEN priority WHEN 'module' THEN 10000 ELSE 20000 + priority END AS p
      FROM f JOIN root USING (id) LEFT JOIN sources s ON s.id = f.source_id),
best AS (SELECT group_id, first(id ORDER BY p NULLS LAST, mtime DESC NULLS LAST, id) AS keep_id,
         first(id ORDER BY p NULLS LAST, mtime DESC NULLS LAST, id) FILTER (WHERE size IS NOT NULL) AS size_id,
         first(id ORDER BY p NULLS LAST, mtime DESC NULLS LAST, id) FILTER (WHERE kind IS NOT NULL) AS kind_id
         FROM c GROUP BY group_id)
"""

SQL = {
    "p6_found": _COPIES + "SELECT * FROM best",
    "p6_records": _COPIES
    + """SELECT best.group_id, keep_id AS id, k.resref, k.ext, s.size, d.kind,
         CAST(coalesce(size_id <> keep_id, false) AS INT) + CAST(coalesce(kind_id <> keep_id, false) AS INT) AS n_columns_from_others
         FROM best JOIN f k ON k.id = keep_id LEFT JOIN f s ON s.id = size_id LEFT JOIN f d ON d.id = kind_id""",
}
