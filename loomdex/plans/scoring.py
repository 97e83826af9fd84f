"""Scores, shares, keep-or-archive windows and spatial queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomdex.operators.precedence import source_rank
from loomdex.plans.session import table

#: Weights and thresholds of the area load score.
BIG_CONTAINER, LOAD_THRESHOLD = 5, 60


def area_score(spark, sf_dir):
    """(area, creatures, items, placeables, big_containers, score, heavy): the load of every area."""
    areas = table(spark, sf_dir, "files").where("ext = 'git' AND removed_at IS NULL").select(F.col("id").alias("file_id"), F.col("resref").alias("area")).distinct()
    g = table(spark, sf_dir, "gff_fields").join(areas, "file_id").select("area", "file_id", "path").distinct()
    spot = F.regexp_extract("path", r"^((Creature List|Placeable List)\[[0-9]+\])", 1)
    item = F.regexp_extract("path", r"^(.*ItemList\[[0-9]+\])", 1)
    g = g.select("area", "file_id", spot.alias("spot"), item.alias("item"))
    per = g.where("spot <> ''").groupBy("area", "file_id", "spot").agg(F.countDistinct(F.when(F.col("item") != "", F.col("item"))).alias("items"))
    a = per.groupBy("area").agg(
        F.count_if(F.col("spot").startswith("Creature")).alias("creatures"), F.count_if(F.col("spot").startswith("Placeable")).alias("placeables"),
        F.sum("items").alias("items"), F.count_if(F.col("items") > BIG_CONTAINER).alias("big_containers"),
    )
    score = F.col("creatures") + F.floor(F.col("items") / 20) + 5 * F.col("big_containers")
    return a.withColumn("score", score).withColumn("heavy", F.col("score") > LOAD_THRESHOLD)


def share_of_total(spark, sf_dir):
    """(segment, revenue, share): revenue of each market segment, in hundredths of a percent of all."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    g = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("revenue"))
    total = F.sum("revenue").over(Window.partitionBy())  # over one row per segment
    return g.withColumn("share", F.floor(F.col("revenue") * 10000 / total).cast("bigint"))


def median_size(spark, sf_dir):
    """(ext, median, n): median size of the files of each type."""
    f = table(spark, sf_dir, "files").where("size IS NOT NULL").select("id", "ext", "size").distinct()
    return f.groupBy("ext").agg(F.round(F.median("size"), 1).alias("median"), F.count("*").alias("n"))


def keep_newest(spark, sf_dir):
    """(id, family, place, keep): of each resource's versions the two newest are kept, and the newest of every month."""
    f = table(spark, sf_dir, "files").where("mtime IS NOT NULL").select("id", "resref", "ext", "mtime").distinct().withColumn("family", F.concat_ws(".", "resref", "ext"))
    order = [F.desc("mtime"), F.asc("id")]
    w, m = Window.partitionBy("family").orderBy(*order), Window.partitionBy("family", F.date_trunc("month", "mtime")).orderBy(*order)
    ranked = f.withColumn("place", F.row_number().over(w).cast("bigint")).withColumn("in_month", F.row_number().over(m))
    return ranked.select("id", "family", "place", ((F.col("place") <= 2) | (F.col("in_month") == 1)).alias("keep"))


def bytes_by_type(spark, sf_dir):
    """(ext, files, bytes, removed_bytes): conditional sums."""
    f = table(spark, sf_dir, "files").select("id", "ext", "size", "removed_at").distinct()
    return f.groupBy("ext").agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"), F.sum(F.when(F.col("removed_at").isNotNull(), F.coalesce("size", F.lit(0))).otherwise(0)).alias("removed_bytes"))


def largest_files(spark, sf_dir):
    """(id, size): the 25 largest files; a top-k report."""
    return table(spark, sf_dir, "files").where("size IS NOT NULL").select("id", "size").distinct().orderBy(F.desc("size"), "id").limit(25)


def catalogue(spark, sf_dir):
    """(source_id, provided, winning, shadowed, used): what each source brings, what of it wins, and what of that is referred to."""
    s = table(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), source_rank(F.col("kind"), F.col("priority")).alias("rank"))
    f = table(spark, sf_dir, "files").where("removed_at IS NULL").select("id", "source_id", "resref", "ext").distinct().join(F.broadcast(s), "source_id")
    first = f.groupBy("resref", "ext").agg(F.min_by("id", F.struct("rank", "id")).alias("winner"))
    named = table(spark, sf_dir, "gff_fields").where("lower(type) = 'resref' AND value <> ''").select(F.lower(F.trim("value")).alias("resref"), F.lit(True).alias("named")).distinct()
    j = f.join(first, ["resref", "ext"]).join(named, "resref", "left")
    win = F.col("id") == F.col("winner")
    return j.groupBy("source_id").agg(F.count("*").alias("provided"), F.count_if(win).alias("winning"), F.count_if(~win).alias("shadowed"), F.count_if(win & F.col("named")).alias("used"))


def placed_flags(spark, sf_dir):
    """(file_id, flags): item files whose Plot, Stolen or Cursed flag is set; rows pivoted to a record, folded over letter case."""
    g = table(spark, sf_dir, "gff_fields").where("path = label AND lower(label) IN ('plot', 'stolen', 'cursed')")
    wide = g.groupBy("file_id").agg(*[F.max(F.when((F.lower("label") == x) & (F.trim("value") == "1"), F.lit(x))).alias(x) for x in ("plot", "stolen", "cursed")])
    return wide.select("file_id", F.concat_ws(",", "plot", "stolen", "cursed").alias("flags")).where("flags <> ''")


def spatial_inside(spark, sf_dir):
    """(vec_id, side): vectors whose first two coordinates lie in the diamond |x| + |y| <= 1/8, with the nearest side of its box."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    inside = e.where(F.abs("x") + F.abs("y") <= 0.125)
    gaps = [(F.col("x") + 0.125, "west"), (0.125 - F.col("x"), "east"), (F.col("y") + 0.125, "south"), (0.125 - F.col("y"), "north")]
    least = F.least(*[g for g, _ in gaps])
    side = F.when(gaps[0][0] == least, "west").when(gaps[1][0] == least, "east").when(gaps[2][0] == least, "south").otherwise("north")
    return inside.select("vec_id", side.alias("side"))


QUERIES = {f.__name__: f for f in (area_score, share_of_total, median_size, keep_newest, bytes_by_type, largest_files, catalogue, placed_flags, spatial_inside)}
_RANK = "CASE s.kind WHEN 'hak' THEN priority WHEN 'module' THEN 10000 WHEN 'override' THEN 20000 + priority ELSE 30000 END"
SQL = {
    "area_score": r"""WITH a AS (SELECT DISTINCT id, resref AS area FROM files WHERE ext = 'git' AND removed_at IS NULL),
      g AS (SELECT DISTINCT area, file_id, regexp_extract(path, '^((Creature List|Placeable List)\[[0-9]+\])', 1) AS spot, regexp_extract(path, '^(.*ItemList\[[0-9]+\])', 1) AS item FROM gff_fields JOIN a ON a.id = file_id),
      p AS (SELECT area, file_id, spot, count(DISTINCT item) FILTER (WHERE item <> '') AS items FROM g WHERE spot <> '' GROUP BY 1, 2, 3),
      s AS (SELECT area, count(*) FILTER (WHERE spot LIKE 'Creature%') AS creatures, count(*) FILTER (WHERE spot LIKE 'Placeable%') AS placeables, CAST(sum(items) AS BIGINT) AS items, count(*) FILTER (WHERE items > 5) AS big_containers FROM p GROUP BY 1)
      SELECT *, creatures + items // 20 + 5 * big_containers AS score, creatures + items // 20 + 5 * big_containers > 60 AS heavy FROM s""",
    "share_of_total": """WITH g AS (SELECT c_mktsegment AS segment, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
      SELECT segment, revenue, CAST(floor(revenue * 10000 / sum(revenue) OVER ()) AS BIGINT) AS share FROM g""",
    "median_size": "SELECT ext, round(median(size), 1) AS median, count(*) AS n FROM (SELECT DISTINCT id, ext, size FROM files WHERE size IS NOT NULL) GROUP BY ext",
    "keep_newest": """WITH f AS (SELECT DISTINCT id, resref || '.' || ext AS family, mtime FROM files WHERE mtime IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY mtime DESC, id) AS place, row_number() OVER (PARTITION BY family, date_trunc('month', mtime) ORDER BY mtime DESC, id) AS m FROM f)
      SELECT id, family, place, place <= 2 OR m = 1 AS keep FROM r""",
    "bytes_by_type": """SELECT ext, count(*) AS files, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes, CAST(sum(CASE WHEN removed_at IS NOT NULL THEN coalesce(size, 0) ELSE 0 END) AS BIGINT) AS removed_bytes
      FROM (SELECT DISTINCT id, ext, size, removed_at FROM files) GROUP BY ext""",
    "largest_files": "SELECT DISTINCT id, size FROM files WHERE size IS NOT NULL ORDER BY size DESC, id LIMIT 25",
    "catalogue": f"""WITH f AS (SELECT DISTINCT f.id, source_id, resref, ext, {_RANK} AS rank FROM files f JOIN sources s ON s.id = source_id WHERE removed_at IS NULL),
      w AS (SELECT *, id = first_value(id) OVER (PARTITION BY resref, ext ORDER BY rank, id) AS win FROM f), n AS (SELECT DISTINCT lower(trim(value)) AS resref FROM gff_fields WHERE lower(type) = 'resref' AND value <> '')
      SELECT source_id, count(*) AS provided, count(*) FILTER (WHERE win) AS winning, count(*) FILTER (WHERE NOT win) AS shadowed, count(*) FILTER (WHERE win AND resref IN (SELECT resref FROM n)) AS used FROM w GROUP BY 1""",
    "placed_flags": """WITH g AS (SELECT file_id, lower(label) AS l FROM gff_fields WHERE path = label AND lower(label) IN ('plot','stolen','cursed') AND trim(value) = '1')
      SELECT file_id, concat_ws(',', max(CASE WHEN l = 'plot' THEN l END), max(CASE WHEN l = 'stolen' THEN l END), max(CASE WHEN l = 'cursed' THEN l END)) AS flags FROM g GROUP BY 1""",
    "spatial_inside": """WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), i AS (SELECT * FROM e WHERE abs(x) + abs(y) <= 0.125)
      SELECT vec_id, CASE least(x + 0.125, 0.125 - x, y + 0.125, 0.125 - y) WHEN x + 0.125 THEN 'west' WHEN 0.125 - x THEN 'east' WHEN y + 0.125 THEN 'south' ELSE 'north' END AS side FROM i""",
}
