"""Positions in areas, containment, first edges, groups within groups, patterns, plans of changes, and troubles told in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions.scalars import natural
from loomdex.operators import graph, precedence, spatial
from loomdex.operators.changes import plan_values
from loomdex.operators.duplicates import subsets
from loomdex.operators.text import joined_labels, match_globs, suffix_link
from loomdex.plans import module_graph
from loomdex.plans.session import cut, table
from loomdex.streaming import logs

#: A room in the shape of an L, and the side of an area with the margin that is its border.
ROOM = ((0, 0), (80, 0), (80, 40), (40, 40), (40, 80), (0, 80))
SIDE, MARGIN = 160.0, 20.0
REAL = r"^-?[0-9]+(\.[0-9]+)?$"
HOLDING = ("contains", "inventory")


def placed(spark, sf_dir) -> DataFrame:
    """(file_id, kind, spot, x, y): creatures and placeables of the areas that have both coordinates, the least of repeated ones."""
    g = table(spark, sf_dir, "gff_fields").where(F.col("label").isin("XPosition", "YPosition", "X", "Y") & F.trim("value").rlike(REAL))
    at = r"^((Creature|Placeable) List\[[0-9]+\])/[^/]+$"
    g = g.select("file_id", F.regexp_extract("path", at, 2).alias("kind"), F.regexp_extract("path", at, 1).alias("spot"), F.substring("label", 1, 1).alias("axis"), F.trim("value").cast("double").alias("v")).where("spot <> ''")
    both = g.groupBy("file_id", "kind", "spot").agg(F.min(F.when(F.col("axis") == "X", F.col("v"))).alias("x"), F.min(F.when(F.col("axis") == "Y", F.col("v"))).alias("y"))
    return both.where("x IS NOT NULL AND y IS NOT NULL")


def placed_inside(spark, sf_dir):
    """(file_id, spot): what stands in ROOM."""
    room = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ROOM])
    return placed(spark, sf_dir).where(spatial.inside(F.col("x"), F.col("y"), room)).select("file_id", "spot")


def placed_borders(spark, sf_dir):
    """(side, n): how much stands near each border of an area."""
    side = spatial.border_side(F.col("x"), F.col("y"), F.lit(SIDE), F.lit(SIDE), MARGIN)
    return placed(spark, sf_dir).select(side.alias("side")).where("side IS NOT NULL").groupBy("side").agg(F.count("*").alias("n"))


def nearest_creature(spark, sf_dir):
    """(file_id, spot, other, distance): for every placeable of an area the nearest creature of it."""
    p = cut(placed(spark, sf_dir))
    creatures, things = p.where("kind = 'Creature'").withColumnRenamed("spot", "other"), p.where("kind = 'Placeable'")
    return spatial.nearest(things, creatures, ["file_id"], "spot", "other", 16.0).withColumn("distance", F.round("distance", 4))


def shadowed_copies(spark, sf_dir):
    """(id, winner, place): copies of a resource that another one hides."""
    s = F.broadcast(table(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), precedence.source_rank(F.col("kind"), F.col("priority")).alias("rank")))  # fixed, 20 rows
    copies = table(spark, sf_dir, "files").where("removed_at IS NULL").select("id", "source_id", "resref", "ext").distinct().join(s, "source_id")
    hidden = precedence.shadowed(copies, ["resref", "ext"], [F.asc("rank"), F.asc("id")], "id")
    return hidden.select("id", "winner", F.col("place").cast("bigint").alias("place"))


def content_conflicts(spark, sf_dir):
    """(resref, n_sources, n_contents, sources): names that several sources carry with different contents."""
    f = table(spark, sf_dir, "files").where("removed_at IS NULL").select("resref", F.col("source_id").cast("string").alias("source"), F.lower("sha256").alias("content"))
    return precedence.conflicts(f, ["resref"], "source", "content")


def breadcrumbs(spark, sf_dir):
    """(node, depth, trail): what holds each node, from the outermost in."""
    return graph.breadcrumbs(module_graph.edges(spark, sf_dir), HOLDING)


def first_edges(spark, sf_dir):
    """(node, src, kind): the edge by which each node is met first from the module's areas."""
    e = cut(module_graph.edges(spark, sf_dir))
    return graph.first_edges(e, graph.reachable(e, module_graph.roots(spark, sf_dir)))


def area_labels(spark, sf_dir):
    """(area, kind, labels, n): the contents of each area by type, up to four named."""
    e = module_graph.edges(spark, sf_dir).where("kind IN ('contains', 'inventory') AND src LIKE 'area:%'")
    return joined_labels(e.select(F.col("src").alias("area"), graph.node_type(F.col("dst")).alias("kind"), "dst"), ["area", "kind"], "dst")


def tag_groups_within(spark, sf_dir):
    """(tag, content): groups of two or more files of one tag that all are copies of one content."""
    f = table(spark, sf_dir, "files").where("removed_at IS NULL").select(F.col("id").alias("member"), F.lower("content_hash").alias("content")).distinct()
    tags = table(spark, sf_dir, "gff_fields").where("path = 'Tag' AND value <> ''").select(F.col("file_id").alias("member"), F.col("value").alias("group"))
    tags = tags.join(f.select("member"), "member", "left_semi").distinct()
    several = tags.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    within = subsets(tags.join(several, "group", "left_semi"), f.select(F.col("content").alias("group"), "member"))
    return within.select(F.col("group").alias("tag"), F.col("within").alias("content"))


def glob_matches(spark, sf_dir):
    """(pattern, n): names that match the patterns of the families of tags: the letters before the last digits, then any."""
    names = table(spark, sf_dir, "files").select("resref")
    tags = table(spark, sf_dir, "gff_fields").where("path = 'Tag'").select(F.regexp_extract("value", "^([A-Za-z0-9_]*[A-Za-z_])[0-9]+[A-Za-z]?$", 1).alias("start")).where("length(start) > 3")
    patterns = tags.select(F.concat("start", F.lit("*?")).alias("pattern")).distinct()
    return match_globs(names, "resref", patterns, "pattern").groupBy("pattern").agg(F.count("*").alias("n"))


def name_tags(spark, sf_dir):
    """(name, suffix): files whose name ends with the last part of an item's tag, of five letters or more."""
    names = table(spark, sf_dir, "files").select("resref")
    items = table(spark, sf_dir, "files").where("ext = 'uti'").select(F.col("id").alias("file_id"))
    tags = table(spark, sf_dir, "gff_fields").where("path = 'Tag'").join(items, "file_id", "left_semi").select(F.regexp_extract(F.lower("value"), "([a-z0-9]+)$", 1).alias("tag")).where("length(tag) >= 5")
    return suffix_link(names, "resref", tags, "tag", 5)


def value_plan(spark, sf_dir):
    """(file_id, path, old, new, verdict): what it takes to give Cost and Charges the values of the second system."""
    own = table(spark, sf_dir, "gff_fields").where("path IN ('Cost', 'Charges') AND value IS NOT NULL").groupBy("file_id", "path").agg(F.min(F.trim("value")).alias("value"))
    asked = table(spark, sf_dir, "gff_fields_mirror").where("path IN ('Cost', 'Charges')").select("file_id", "path", "value")
    plan = plan_values(own, asked, ["file_id", "path"], "value")
    return plan.select("file_id", "path", F.coalesce("old", F.lit("-")).alias("old"), F.coalesce("new", F.lit("-")).alias("new"), "verdict")


def natural_places(spark, sf_dir):
    """(label, value, place): the different values of some fields in natural order, numbers first."""
    g = table(spark, sf_dir, "gff_fields").where("path = label AND label IN ('PaletteID', 'FactionID', 'HitPoints', 'Race', 'BaseItem') AND value IS NOT NULL").select("label", F.trim("value").alias("value")).distinct()
    return g.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(*natural(F.col("value")))).cast("bigint"))


def next_ids(spark, sf_dir):
    """(tbl, next): the id after the greatest of each table, 1 for one without rows."""
    one = lambda name, where="true": table(spark, sf_dir, name).where(where).agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next")).select(F.lit(name).alias("tbl"), "next")
    return one("files").unionByName(one("sources")).unionByName(one("files_mirror", "id < 0"))


def running_cost(spark, sf_dir):
    """(ext, bytes, done): bytes by type, and the running sum from the largest type on."""
    g = table(spark, sf_dir, "files").where("size IS NOT NULL").select("id", "ext", "size").distinct().groupBy("ext").agg(F.sum("size").alias("bytes"))
    return g.withColumn("done", F.sum("bytes").over(Window.orderBy(F.desc("bytes"), "ext").rowsBetween(Window.unboundedPreceding, 0)))  # one row per type


def log_lines(spark, sf_dir) -> DataFrame:
    """(id, line): a log of the files: what was removed, damaged, is compiled, or has no size; others give lines of no trouble."""
    f = table(spark, sf_dir, "files").where(F.col("resref").rlike("^[a-z0-9_]+$")).dropDuplicates(["id"])
    at = lambda c, form: F.date_format(c, form)
    line = (
        F.when(F.col("removed_at").isNotNull(), F.concat(F.lit("E ["), at("removed_at", "HH:mm:ss"), F.lit("] Loader (res.cpp:10:Demand): Failed to load "), "resref", F.lit("."), "ext"))
        .when(F.col("status") == "error", F.concat(F.lit("Script error: "), "resref", F.lit(" OID: 1f, Tag: "), "ext", F.lit(", ERROR: "), F.coalesce("error", F.lit("NONE"))))
        .when(F.col("ext") == "ncs", F.concat(F.lit("script "), "resref", F.lit(" at level 0 on object 0x1 took 5 us, error: -"), (F.col("id") % 7).cast("string")))
        .when(F.col("size").isNull(), F.concat(F.lit("["), at("indexed_at", "yyyy-MM-dd HH:mm:ss"), F.lit("] Warning: no size of "), F.col("id").cast("string")))
        .otherwise(F.concat(F.lit("loaded "), "resref"))
    )
    return f.select("id", line.alias("line"))


def log_file_groups(spark, sf_dir):
    """(kind, subject, signature, severity, count, first_seen, last_seen, tags): the log's lines, parsed and grouped."""
    g = logs.group(logs.parse(log_lines(spark, sf_dir), "line"), "id")
    return g.select("kind", "subject", "signature", "severity", "count", F.coalesce("first_seen", F.lit("")).alias("first_seen"), F.coalesce("last_seen", F.lit("")).alias("last_seen"), F.concat_ws(",", "tags").alias("tags"))


QUERIES = {
    f.__name__: f
    for f in (placed_inside, placed_borders, nearest_creature, shadowed_copies, content_conflicts, breadcrumbs, first_edges, area_labels, tag_groups_within, glob_matches, name_tags, value_plan,
              natural_places, next_ids, running_cost, log_file_groups)
}
_PLACED = r"""WITH g AS (SELECT file_id, regexp_extract(path, '^((Creature|Placeable) List\[[0-9]+\])/[^/]+$', 2) AS kind, regexp_extract(path, '^((Creature|Placeable) List\[[0-9]+\])/[^/]+$', 1) AS spot,
      label[1:1] AS axis, CAST(trim(value) AS DOUBLE) AS v FROM gff_fields WHERE label IN ('XPosition','YPosition','X','Y') AND regexp_full_match(trim(value), '-?[0-9]+(\.[0-9]+)?')),
 p AS (SELECT file_id, kind, spot, min(v) FILTER (WHERE axis = 'X') AS x, min(v) FILTER (WHERE axis = 'Y') AS y FROM g WHERE spot <> '' GROUP BY ALL HAVING x IS NOT NULL AND y IS NOT NULL)
"""
_RANKED = """WITH c AS (SELECT DISTINCT f.id, resref, ext, CASE s.kind WHEN 'hak' THEN priority WHEN 'module' THEN 10000 WHEN 'override' THEN 20000 + priority ELSE 30000 END AS rank
      FROM files f JOIN sources s ON s.id = f.source_id WHERE removed_at IS NULL),
 r AS (SELECT id, first(id) OVER w AS winner, row_number() OVER w AS place FROM c WINDOW w AS (PARTITION BY resref, ext ORDER BY rank, id))
"""
SQL = {
    "placed_inside": _PLACED + "SELECT file_id, spot FROM p WHERE x >= 0 AND y >= 0 AND ((y < 40 AND x < 80) OR (y >= 40 AND y < 80 AND x < 40))",
    "placed_borders": _PLACED
    + f""", s AS (SELECT CASE WHEN least(x, {SIDE} - x, y, {SIDE} - y) > {MARGIN} THEN NULL WHEN x = least(x, {SIDE} - x, y, {SIDE} - y) THEN 'west' WHEN {SIDE} - x = least(x, {SIDE} - x, y, {SIDE} - y) THEN 'east'
        WHEN y = least(x, {SIDE} - x, y, {SIDE} - y) THEN 'south' ELSE 'north' END AS side FROM p) SELECT side, count(*) AS n FROM s WHERE side IS NOT NULL GROUP BY side""",
    "nearest_creature": _PLACED
    + """SELECT a.file_id, a.spot, b.spot AS other, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 4) AS distance FROM p a JOIN p b ON a.file_id = b.file_id AND b.kind = 'Creature'
      WHERE a.kind = 'Placeable' QUALIFY row_number() OVER (PARTITION BY a.file_id, a.spot ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.spot) = 1""",
    "shadowed_copies": _RANKED + "SELECT * FROM r WHERE place > 1",
    "content_conflicts": """SELECT resref, count(DISTINCT source_id) AS n_sources, count(DISTINCT lower(sha256)) AS n_contents, string_agg(DISTINCT CAST(source_id AS VARCHAR), ' | ' ORDER BY CAST(source_id AS VARCHAR)) AS sources
      FROM files WHERE removed_at IS NULL GROUP BY 1 HAVING n_sources > 1 AND n_contents > 1""",
    "breadcrumbs": module_graph._R
    + """, up AS (SELECT dst AS held, min(src) AS holder FROM edges WHERE kind IN ('contains','inventory') AND src <> dst GROUP BY dst),
      t(node, top, path) AS (SELECT held, holder, [holder, held] FROM up UNION ALL SELECT node, holder, list_prepend(holder, path) FROM t JOIN up ON up.held = top WHERE len(path) <= 10 AND NOT list_contains(path, holder))
      SELECT node, len(path) - 1 AS depth, array_to_string(path, ' > ') AS trail FROM t QUALIFY row_number() OVER (PARTITION BY node ORDER BY len(path) DESC) = 1""",
    "first_edges": module_graph._R
    + module_graph._REACH
    + """, d AS (SELECT node AS src, min(depth) AS depth FROM reach GROUP BY node)
      SELECT dst AS node, src, kind FROM edges JOIN d USING (src) WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY dst ORDER BY depth, kind, src) = 1""",
    "area_labels": module_graph._R
    + f""", d AS (SELECT DISTINCT src AS area, {module_graph._TYPE.format("dst")} AS kind, dst AS label FROM edges WHERE kind IN ('contains','inventory') AND src LIKE 'area:%')
      SELECT area, kind, array_to_string(list_sort(list(label))[1:4], '; ') || CASE WHEN count(*) > 4 THEN '; …' ELSE '' END AS labels, count(*) AS n FROM d GROUP BY 1, 2""",
    "tag_groups_within": """WITH f AS (SELECT DISTINCT id, lower(content_hash) AS content FROM files WHERE removed_at IS NULL),
      t AS (SELECT DISTINCT g.value AS tag, f.id, f.content FROM gff_fields g JOIN f ON f.id = g.file_id WHERE path = 'Tag' AND value <> '')
      SELECT tag, min(content) AS content FROM t GROUP BY tag HAVING count(DISTINCT id) > 1 AND count(DISTINCT content) = 1 AND count(*) FILTER (WHERE content IS NULL) = 0""",
    "glob_matches": """WITH p AS (SELECT DISTINCT regexp_extract(value, '^([A-Za-z0-9_]*[A-Za-z_])[0-9]+[A-Za-z]?$', 1) AS start FROM gff_fields WHERE path = 'Tag'), n AS (SELECT DISTINCT resref FROM files)
      SELECT start || '*?' AS pattern, count(*) AS n FROM p JOIN n ON starts_with(lower(resref), lower(start)) AND length(resref) > length(start) WHERE length(start) > 3 GROUP BY start""",
    "name_tags": """WITH n AS (SELECT DISTINCT lower(resref) AS name FROM files),
      t AS (SELECT DISTINCT regexp_extract(lower(value), '([a-z0-9]+)$', 1) AS suffix FROM gff_fields WHERE path = 'Tag' AND file_id IN (SELECT id FROM files WHERE ext = 'uti'))
      SELECT name, suffix FROM n JOIN t ON ends_with(name, suffix) WHERE length(suffix) >= 5""",
    "value_plan": """WITH own AS (SELECT file_id, path, min(trim(value)) AS old FROM gff_fields WHERE path IN ('Cost','Charges') AND value IS NOT NULL GROUP BY 1, 2),
      w AS (SELECT DISTINCT file_id, path, trim(value) AS new FROM gff_fields_mirror WHERE path IN ('Cost','Charges'))
      SELECT w.file_id, w.path, coalesce(old, '-') AS old, coalesce(new, '-') AS new, CASE WHEN count(*) OVER (PARTITION BY w.file_id, w.path) > 1 THEN 'twice' WHEN own.file_id IS NULL THEN 'unknown'
        WHEN coalesce(new, '') = '' THEN 'empty' WHEN old = new THEN 'same' ELSE 'set' END AS verdict FROM w LEFT JOIN own USING (file_id, path)""",
    "natural_places": """SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY n IS NULL, n, value) AS place FROM (SELECT DISTINCT label, trim(value) AS value,
      CASE WHEN regexp_full_match(trim(value), '[-+]?[0-9]+') THEN TRY_CAST(trim(value) AS BIGINT) END AS n FROM gff_fields WHERE path = label AND label IN ('PaletteID','FactionID','HitPoints','Race','BaseItem') AND value IS NOT NULL)""",
    "next_ids": "SELECT 'files' AS tbl, coalesce(max(id), 0) + 1 AS next FROM files UNION ALL SELECT 'sources', coalesce(max(id), 0) + 1 FROM sources UNION ALL SELECT 'files_mirror', coalesce(max(id), 0) + 1 FROM files_mirror WHERE id < 0",
    "running_cost": """WITH g AS (SELECT ext, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT DISTINCT id, ext, size FROM files WHERE size IS NOT NULL) GROUP BY ext)
      SELECT *, CAST(sum(bytes) OVER (ORDER BY bytes DESC, ext ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done FROM g""",
    "log_file_groups": r"""WITH f AS (SELECT DISTINCT id, resref, ext, removed_at, status, error, size, indexed_at FROM files WHERE regexp_full_match(resref, '[a-z0-9_]+')),
      l AS (SELECT id, CASE WHEN removed_at IS NOT NULL THEN 'missing_resource' WHEN status = 'error' THEN 'script_error' WHEN ext = 'ncs' THEN 'script_stopped' WHEN size IS NULL THEN 'warning' END AS kind,
        CASE WHEN removed_at IS NOT NULL THEN resref || '.' || ext WHEN status = 'error' OR ext = 'ncs' THEN resref ELSE '' END AS subject,
        CASE WHEN removed_at IS NOT NULL THEN 'Failed to load ' || resref || '.' || ext WHEN status = 'error' THEN 'ERROR: ' || coalesce(error, 'NONE') WHEN ext = 'ncs' THEN '-' || (id % 7) ELSE 'Warning: no size of ' || id END AS message,
        CASE WHEN removed_at IS NOT NULL THEN strftime(removed_at, '%H:%M:%S') WHEN status = 'error' OR ext = 'ncs' THEN '' ELSE strftime(indexed_at, '%Y-%m-%d %H:%M:%S') END AS ts,
        CASE WHEN removed_at IS NULL AND status = 'error' THEN ext ELSE '' END AS tag FROM f)
      SELECT kind, subject, CASE WHEN ends_with(subject, '.2da') THEN '' ELSE regexp_replace(regexp_replace(message, '0x[0-9a-fA-F]+', '#', 'g'), '[0-9]+', '#', 'g')[1:160] END AS signature,
        CASE kind WHEN 'warning' THEN 'warning' ELSE 'error' END AS severity, count(*) AS count, arg_min(ts, id) AS first_seen, arg_max(ts, id) AS last_seen, max(tag) AS tags
      FROM l WHERE kind IS NOT NULL GROUP BY 1, 2, 3, 4""",
}
