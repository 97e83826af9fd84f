"""Plans over archives, palettes and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdex.operators.precedence import source_rank
from loomdex.plans.session import table

#: Cost of ingesting a file, in tenths of a unit: tree, text, other; and units per megabyte.
TREE_COST, TEXT_COST, OTHER_COST, MEGABYTE_COST = 60, 20, 4, 12


def lean_sources(spark, sf_dir):
    """(source_id, droppable, bytes): copies that a source could drop: same name and same bytes as the copy that wins."""
    s = F.broadcast(table(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), source_rank(F.col("kind"), F.col("priority")).alias("rank")))
    f = table(spark, sf_dir, "files").where("removed_at IS NULL").select("id", "source_id", "resref", "ext", "size", F.lower("sha256").alias("sha")).distinct().join(s, "source_id")
    first = f.groupBy("resref", "ext").agg(F.min_by(F.struct("id", "sha"), F.struct("rank", "id")).alias("w"))
    same = f.join(first, ["resref", "ext"]).where((F.col("id") != F.col("w.id")) & (F.col("sha") == F.col("w.sha")))
    return same.groupBy("source_id").agg(F.count("*").alias("droppable"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


def palette_tree(spark, sf_dir):
    """(file_id, branch, depth, blueprints): branches of palettes with the blueprints right below them."""
    palettes = table(spark, sf_dir, "files").where("ext = 'itp'").select(F.col("id").alias("file_id")).distinct()
    p = table(spark, sf_dir, "gff_fields").where("label = 'RESREF'").join(palettes, "file_id", "left_semi").select("file_id", F.regexp_extract("path", r"^(.*)/[^/]+/RESREF$", 1).alias("branch"), "path").distinct()
    return p.groupBy("file_id", "branch").agg(F.count("*").alias("blueprints")).withColumn("depth", F.size(F.split("branch", "/")).cast("bigint"))


def ingest_cost(spark, sf_dir):
    """(kind, files, units): expected cost of ingestion in tenths of a unit."""
    f = table(spark, sf_dir, "files").where("removed_at IS NULL").select("id", "ext", "size").distinct()
    kind = F.when(F.col("ext").isin("uti", "utc", "utp", "utm", "dlg", "git", "itp"), "tree").when(F.col("ext").isin("nss", "2da"), "text").otherwise("other")
    base = F.when(F.col("kind") == "tree", TREE_COST).when(F.col("kind") == "text", TEXT_COST).otherwise(OTHER_COST)
    g = f.withColumn("kind", kind).groupBy("kind").agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))
    return g.select("kind", "files", (F.col("files") * base + F.floor(F.col("bytes") * (10 * MEGABYTE_COST) / 1048576)).cast("bigint").alias("units"))


def conversation_hubs(spark, sf_dir):
    """(script, conversation, lines): the conversation that runs each script most (ties: the least)."""
    d = table(spark, sf_dir, "files").where("ext = 'dlg' AND removed_at IS NULL").select(F.col("id").alias("file_id"), "resref").distinct()
    g = table(spark, sf_dir, "gff_fields").where("label = 'Script' AND value <> ''").select("file_id", "path", F.lower(F.trim("value")).alias("script")).distinct().join(d, "file_id")
    n = g.groupBy("script", "resref").agg(F.count("*").alias("lines"))
    return n.groupBy("script").agg(F.min_by(F.struct("resref", "lines"), F.struct((-F.col("lines")).alias("l"), "resref")).alias("m")).select("script", F.col("m.resref").alias("conversation"), "m.lines")


QUERIES = {f.__name__: f for f in (lean_sources, palette_tree, ingest_cost, conversation_hubs)}
SQL = {
    "lean_sources": """WITH f AS (SELECT DISTINCT f.id, source_id, resref, ext, size, lower(sha256) AS sha, CASE s.kind WHEN 'hak' THEN priority WHEN 'module' THEN 10000 WHEN 'override' THEN 20000 + priority ELSE 30000 END AS rank
      FROM files f JOIN sources s ON s.id = source_id WHERE removed_at IS NULL),
      w AS (SELECT *, first_value(id) OVER o AS wid, first_value(sha) OVER o AS wsha FROM f WINDOW o AS (PARTITION BY resref, ext ORDER BY rank, id))
      SELECT source_id, count(*) AS droppable, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes FROM w WHERE id <> wid AND sha = wsha GROUP BY 1""",
    "palette_tree": r"""WITH p AS (SELECT DISTINCT file_id, regexp_extract(path, '^(.*)/[^/]+/RESREF$', 1) AS branch, path FROM gff_fields WHERE label = 'RESREF' AND file_id IN (SELECT id FROM files WHERE ext = 'itp'))
      SELECT file_id, branch, count(*) AS blueprints, CAST(len(string_split(branch, '/')) AS BIGINT) AS depth FROM p GROUP BY 1, 2""",
    "ingest_cost": """WITH f AS (SELECT DISTINCT id, size, CASE WHEN ext IN ('uti','utc','utp','utm','dlg','git','itp') THEN 'tree' WHEN ext IN ('nss','2da') THEN 'text' ELSE 'other' END AS kind FROM files WHERE removed_at IS NULL)
      SELECT kind, count(*) AS files, CAST(count(*) * CASE kind WHEN 'tree' THEN 60 WHEN 'text' THEN 20 ELSE 4 END + floor(sum(coalesce(size, 0)) * 120 / 1048576) AS BIGINT) AS units FROM f GROUP BY kind""",
    "conversation_hubs": """WITH d AS (SELECT DISTINCT id, resref FROM files WHERE ext = 'dlg' AND removed_at IS NULL), g AS (SELECT DISTINCT file_id, path, lower(trim(value)) AS script FROM gff_fields WHERE label = 'Script' AND value <> ''),
      n AS (SELECT script, resref AS conversation, count(*) AS lines FROM g JOIN d ON d.id = file_id GROUP BY 1, 2) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY script ORDER BY lines DESC, conversation) = 1""",
}
