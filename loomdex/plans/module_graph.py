"""The dependency graph of the module tables, and the queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.numbers import is_blank
from loomdex.operators import graph
from loomdex.operators.components import components
from loomdex.operators.precedence import source_rank, winners
from loomdex.plans.session import cut, table

#: Kind of edge by the label of the field that makes it; any other label is an event script.
EDGE_KINDS = {
    "TemplateResRef": "contains", "Conversation": "uses_conversation", "Script": "dlg_script", "Active": "dlg_script", "InventoryRes": "inventory",
    "EquippedRes": "inventory", "RESREF": "name_ref",
}


def _kind(label):
    out = F.lit("event_script")
    for k, v in EDGE_KINDS.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind): every field of a present file that names a resource; dst is missing:<name> if no file carries it."""
    kinds = table(spark, sf_dir, "ref_kinds").groupBy("file_ext", F.col("list_label").alias("k_list"), F.col("label").alias("k_label")).agg(F.collect_set("target_ext").alias("exts"))
    kinds = F.broadcast(kinds)  # fixed, 37 rows
    files = table(spark, sf_dir, "files")
    inner = F.regexp_extract("path", r"([^/\[\]]*)\[[0-9]+\][^\[\]]*$", 1)
    places = F.broadcast(kinds.select("k_list", "k_label").distinct())
    named = table(spark, sf_dir, "gff_fields").where(~is_blank(F.col("value"))).select("file_id", "label", inner.alias("inner"), F.lower(F.trim("value")).alias("name"))
    named = named.join(places, (F.col("inner") == F.col("k_list")) & (F.col("label") == F.col("k_label")), "left_semi")
    held = named.join(files.where("removed_at IS NULL").select(F.col("id").alias("file_id"), F.col("node").alias("src"), F.col("ext").alias("holder")).distinct(), "file_id")
    refs = held.join(kinds, (F.col("holder") == F.col("file_ext")) & (F.col("inner") == F.col("k_list")) & (F.col("label") == F.col("k_label")))
    refs = refs.select("src", "name", _kind(F.col("label")).alias("kind"), F.explode("exts").alias("ext")).distinct()
    there = files.groupBy(F.col("resref").alias("name"), "ext").agg(F.min("node").alias("node"))
    hit = refs.join(there, ["name", "ext"], "left").groupBy("src", "name", "kind").agg(F.min("node").alias("node"))
    return hit.select("src", F.coalesce("node", F.concat(F.lit("missing:"), "name")).alias("dst"), "kind").distinct()


EDGES_SQL = r"""
k AS (SELECT DISTINCT * FROM ref_kinds),
there AS (SELECT resref, ext, min(node) AS node FROM files GROUP BY 1, 2),
refs AS (SELECT DISTINCT f.node AS src, lower(trim(g.value)) AS name, k.target_ext AS ext,
         CASE g.label WHEN 'TemplateResRef' THEN 'contains' WHEN 'Conversation' THEN 'uses_conversation' WHEN 'Script' THEN 'dlg_script' WHEN 'Active' THEN 'dlg_script'
              WHEN 'InventoryRes' THEN 'inventory' WHEN 'EquippedRes' THEN 'inventory' WHEN 'RESREF' THEN 'name_ref' ELSE 'event_script' END AS kind
         FROM gff_fields g JOIN files f ON f.id = g.file_id AND f.removed_at IS NULL
         JOIN k ON k.file_ext = f.ext AND k.label = g.label AND k.list_label = regexp_extract(g.path, '([^/\[\]]*)\[[0-9]+\][^\[\]]*$', 1) WHERE trim(g.value) <> ''),
hit AS (SELECT src, refs.name, kind, min(node) AS node FROM refs LEFT JOIN there t ON t.resref = refs.name AND t.ext = refs.ext GROUP BY 1, 2, 3),
edges AS (SELECT DISTINCT src, coalesce(node, 'missing:' || name) AS dst, kind FROM hit),
nodes AS (SELECT DISTINCT node FROM files WHERE removed_at IS NULL),
roots AS (SELECT DISTINCT f.node FROM files f JOIN sources s ON s.id = f.source_id WHERE s.kind = 'module' AND f.ext = 'git' AND f.removed_at IS NULL)
"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").where("removed_at IS NULL").select("node").distinct()


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas that the module itself carries."""
    modules = F.broadcast(table(spark, sf_dir, "sources").where("kind = 'module'").select(F.col("id").alias("source_id")))
    return table(spark, sf_dir, "files").where("ext = 'git' AND removed_at IS NULL").join(modules, "source_id", "left_semi").select("node").distinct()


def graph_edges(spark, sf_dir):
    return edges(spark, sf_dir)


def reachable_from_roots(spark, sf_dir):
    return graph.reachable(edges(spark, sf_dir), roots(spark, sf_dir))


def shortest_paths(spark, sf_dir):
    return graph.paths(edges(spark, sf_dir), roots(spark, sf_dir))


def who_uses(spark, sf_dir):
    """(dst, users, kinds): neighbours in."""
    e = edges(spark, sf_dir)
    return e.groupBy("dst").agg(F.countDistinct("src").alias("users"), F.concat_ws(", ", F.array_sort(F.collect_set("kind"))).alias("kinds"))


def uses(spark, sf_dir):
    """(src, used, missing): neighbours out."""
    e = edges(spark, sf_dir)
    return e.groupBy("src").agg(F.countDistinct("dst").alias("used"), F.countDistinct(F.when(F.col("dst").startswith("missing:"), F.col("dst"))).alias("missing"))


def deletion_status(spark, sf_dir):
    """(node, status, bytes): what the module's areas don't lead to. Safe if nothing names it, Safe as group if only unreached
    nodes do, Review if it, or an unreached user of it, is named by a palette or another reached file."""
    e = cut(edges(spark, sf_dir))
    live = cut(graph.reachable(e, roots(spark, sf_dir)).select("node"))
    files = table(spark, sf_dir, "files").where("removed_at IS NULL").dropDuplicates(["id"])
    kept = ["2da", "itp", "hak", "tlk", "ifo", "jrl", "fac"]
    sizes = files.groupBy("node").agg(F.sum(F.coalesce("size", F.lit(0))).alias("bytes"), F.max(F.col("ext").isin(*kept)).alias("kept"))
    candidates = sizes.where("NOT kept").join(live, "node", "left_anti").select("node", "bytes")
    users = e.where("src <> dst").select(F.col("dst").alias("node"), "src").distinct()
    dead = candidates.select(F.col("node").alias("src"), F.lit(True).alias("dead"))
    named = users.join(candidates.select("node"), "node", "left_semi").join(dead, "src", "left").groupBy("node").agg(F.max(F.col("dead").isNull()).alias("by_live"))
    first = candidates.join(named, "node", "left").select("node", "bytes", F.when(F.col("by_live"), "Review").when(F.col("by_live").isNotNull(), "Safe as group").otherwise("Safe").alias("status"))
    first = cut(first)
    final = graph.spread_status(first, e, "Review", "Safe as group", "Review")
    return final.join(first.select("node", "bytes"), "node").select("node", "status", "bytes")


def impact_level(spark, sf_dir):
    """(start, level, total, areas, scripts, quests, placed) of every node; live is what the module's areas lead to."""
    e, n = cut(edges(spark, sf_dir)), nodes(spark, sf_dir)
    return graph.judge(graph.impact(e, n), n, graph.reachable(e, roots(spark, sf_dir)))


def graph_components(spark, sf_dir):
    """(node, root): nodes connected by any edges."""
    return components(edges(spark, sf_dir), "src", "dst")


def chain_depth(spark, sf_dir):
    """(node, depth): longest chain of uses from each node."""
    return graph.longest_chain(edges(spark, sf_dir))


def cycles(spark, sf_dir):
    """(node, component): nodes that use themselves, directly or through others."""
    return graph.strong_components(edges(spark, sf_dir))


def missing_nodes(spark, sf_dir, of: DataFrame | None = None):
    """(dst, kind, users): names that lead to no file and no base resource."""
    e = (edges(spark, sf_dir) if of is None else of).where(F.col("dst").startswith("missing:"))
    base = table(spark, sf_dir, "base_resources").select(F.concat(F.lit("missing:"), F.regexp_extract(F.lower("name"), r"^(.*)\.[^.]*$", 1)).alias("dst")).distinct()
    return e.join(base, "dst", "left_anti").groupBy("dst", "kind").agg(F.countDistinct("src").alias("users"))


def area_contents(spark, sf_dir):
    """(area, kind, n): what every area leads to, by type of node: closure from all areas at once."""
    e = cut(edges(spark, sf_dir))
    areas = nodes(spark, sf_dir).where(F.col("node").startswith("area:"))
    pairs = graph.closure(e, areas)
    return pairs.groupBy(F.col("start").alias("area"), graph.node_type(F.col("node")).alias("kind")).agg(F.count("*").alias("n"))


def winning_nodes(spark, sf_dir):
    """(resref, ext, id, source_id): the copy of each resource that is used."""
    s = F.broadcast(table(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), source_rank(F.col("kind"), F.col("priority")).alias("rank")))
    copies = table(spark, sf_dir, "files").where("removed_at IS NULL").select("id", "source_id", "resref", "ext").distinct().join(s, "source_id")
    return winners(copies, ["resref", "ext"], [F.asc("rank"), F.asc("id")]).select("resref", "ext", "id", "source_id")


_R = "WITH RECURSIVE " + EDGES_SQL
_CARRIERS = "('event_script','dlg_script','uses_conversation','contains','inventory')"
_TYPE = "CASE split_part({0}, ':', 1) WHEN 'bp' THEN 'blueprint' WHEN 'dlg' THEN 'conversation' ELSE split_part({0}, ':', 1) END"
QUERIES = {f.__name__: f for f in (graph_edges, reachable_from_roots, shortest_paths, who_uses, uses, deletion_status, impact_level, graph_components, chain_depth, cycles, missing_nodes, area_contents, winning_nodes)}
_REACH = ", reach(node, depth) AS (SELECT node, 0 FROM roots UNION SELECT dst, depth + 1 FROM reach JOIN edges ON src = node AND src <> dst WHERE depth < 30)"
SQL = {
    "graph_edges": _R + "SELECT src, dst, kind FROM edges",
    "reachable_from_roots": _R + _REACH + " SELECT node, min(depth) AS depth FROM reach GROUP BY node",
    "shortest_paths": _R
    + """, d AS (SELECT src, dst FROM edges WHERE src <> dst GROUP BY 1, 2),
      walk(node, depth, path) AS (SELECT node, 0, node FROM roots UNION ALL
        SELECT dst, depth + 1, min(path || ' > ' || dst) FROM walk JOIN d ON src = node WHERE depth < 12 GROUP BY dst, depth)
      SELECT node, depth, path FROM walk QUALIFY row_number() OVER (PARTITION BY node ORDER BY depth, path) = 1""",
    "who_uses": _R + "SELECT dst, count(DISTINCT src) AS users, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds FROM edges GROUP BY dst",
    "uses": _R + "SELECT src, count(DISTINCT dst) AS used, count(DISTINCT dst) FILTER (WHERE dst LIKE 'missing:%') AS missing FROM edges GROUP BY src",
    "deletion_status": _R
    + _REACH
    + """, live AS (SELECT DISTINCT node FROM reach),
      f AS (SELECT DISTINCT id, node, ext, size FROM files WHERE removed_at IS NULL),
      c AS (SELECT node, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes FROM f GROUP BY node HAVING NOT max(ext IN ('2da','itp','hak','tlk','ifo','jrl','fac')) AND node NOT IN (SELECT node FROM live)),
      u AS (SELECT DISTINCT dst AS node, src, src NOT IN (SELECT node FROM c) AS by_live FROM edges WHERE src <> dst AND dst IN (SELECT node FROM c)),
      s AS (SELECT c.node, CASE WHEN max(by_live) THEN 'Review' WHEN max(by_live) IS NOT NULL THEN 'Safe as group' ELSE 'Safe' END AS status FROM c LEFT JOIN u USING (node) GROUP BY c.node),
      rv(node) AS (SELECT node FROM s WHERE status = 'Review' UNION SELECT s.node FROM rv JOIN u ON u.src = rv.node JOIN s ON s.node = u.node AND s.status = 'Safe as group')
      SELECT c.node, CASE WHEN c.node IN (SELECT node FROM rv) THEN 'Review' ELSE s.status END AS status, bytes FROM c JOIN s USING (node)""",
    "impact_level": _R
    + _REACH
    + f""", b AS (SELECT DISTINCT src, dst, kind FROM edges WHERE src <> dst),
      first AS (SELECT n.node AS start, b.src AS node FROM nodes n JOIN b ON b.dst = n.node WHERE b.kind IN {_CARRIERS}
                OR (b.kind = 'name_ref' AND NOT ({_TYPE.format('b.src')} IN ('area','blueprint','conversation','module','instance') AND {_TYPE.format('n.node')} IN ('script','blueprint','conversation')))),
      walk(start, node) AS (SELECT start, node FROM first UNION SELECT w.start, b.src FROM walk w JOIN b ON b.dst = w.node AND b.kind IN {_CARRIERS} WHERE b.src <> w.start),
      a AS (SELECT start, count(*) AS total, count(*) FILTER (WHERE node LIKE 'area:%') AS areas, count(*) FILTER (WHERE node LIKE 'script:%') AS scripts,
            bool_or(node IN (SELECT node FROM reach)) AS used FROM walk GROUP BY start)
      SELECT n.node AS start, CASE WHEN coalesce(total, 0) = 0 OR ({_TYPE.format('n.node')} IN ('area','script','blueprint','conversation') AND n.node NOT IN (SELECT node FROM reach) AND NOT coalesce(used, false)) THEN 'None' WHEN areas >= 10 OR scripts >= 25 THEN 'Critical' WHEN areas >= 3 OR scripts >= 8 THEN 'High'
        WHEN areas >= 1 OR total >= 3 THEN 'Medium' ELSE 'Low' END AS level, coalesce(total, 0) AS total, coalesce(areas, 0) AS areas, coalesce(scripts, 0) AS scripts, CAST(0 AS BIGINT) AS quests, CAST(0 AS BIGINT) AS placed
      FROM nodes n LEFT JOIN a ON a.start = n.node""",
    "graph_components": _R
    + """, b AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
      r(node, other) AS (SELECT src, dst FROM b UNION SELECT node, dst FROM r JOIN b ON src = other) SELECT node, least(node, min(other)) AS root FROM r GROUP BY node""",
    "cycles": _R
    + """, r(node, other) AS (SELECT src, dst FROM edges UNION SELECT node, dst FROM r JOIN edges ON src = other)
      SELECT x.node, least(x.node, min(x.other)) AS component FROM r x JOIN r y ON x.node = y.other AND x.other = y.node GROUP BY x.node""",
    "chain_depth": _R
    + """, d AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), n(node, depth) AS (SELECT dst, 0 FROM d UNION SELECT src, depth + 1 FROM n JOIN d ON dst = node WHERE depth < 64)
      SELECT node, max(depth) AS depth FROM (SELECT * FROM n UNION ALL SELECT src, 0 FROM d) GROUP BY node""",
    "missing_nodes": _R
    + r"""SELECT dst, kind, count(DISTINCT src) AS users FROM edges WHERE dst LIKE 'missing:%'
      AND dst NOT IN (SELECT 'missing:' || regexp_extract(lower(name), '^(.*)\.[^.]*$', 1) FROM base_resources) GROUP BY 1, 2""",
    "area_contents": _R
    + f""", p(area, node) AS (SELECT src, dst FROM edges WHERE src LIKE 'area:%' AND src IN (SELECT node FROM nodes) UNION SELECT area, dst FROM p JOIN edges ON src = node)
      SELECT area, {_TYPE.format('node')} AS kind, count(*) AS n FROM p GROUP BY 1, 2""",
    "winning_nodes": """SELECT resref, ext, id, source_id FROM (SELECT DISTINCT f.id, f.source_id, resref, ext,
      CASE s.kind WHEN 'hak' THEN priority WHEN 'module' THEN 10000 WHEN 'override' THEN 20000 + priority ELSE 30000 END AS rank
      FROM files f JOIN sources s ON s.id = f.source_id WHERE removed_at IS NULL) QUALIFY row_number() OVER (PARTITION BY resref, ext ORDER BY rank, id) = 1""",
}
