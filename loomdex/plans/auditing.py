"""Version diff, snapshots and audit checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.plans import module_graph
from loomdex.plans.session import table


def manifest(files: DataFrame) -> DataFrame:
    """(name, size, sha): the least copy of each resource."""
    f = files.where("removed_at IS NULL").select(F.concat_ws(".", "resref", "ext").alias("name"), "size", F.lower("sha256").alias("sha"), "source_id")
    return f.groupBy("name").agg(F.min(F.struct("source_id", "sha", "size")).alias("m")).select("name", "m.size", "m.sha")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change): added, removed or changed between two manifests."""
    a, b = before.select("name", F.col("sha").alias("old"), F.lit(1).alias("a")), after.select("name", F.col("sha").alias("new"), F.lit(1).alias("b"))
    j = a.join(b, "name", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return j.select("name", change.alias("change")).where("change IS NOT NULL")


def diff_versions(spark, sf_dir):
    """(name, change, users): files added, removed or changed in the mirror, and how many nodes use each."""
    c = compare(manifest(table(spark, sf_dir, "files")), manifest(table(spark, sf_dir, "files_mirror")))
    named = module_graph.edges(spark, sf_dir).groupBy(F.substring_index("dst", ":", -1).alias("key")).agg(F.countDistinct("src").alias("users"))
    stem = F.substring_index("name", ".", 1)
    bp = F.substring_index("name", ".", -1).isin("uti", "utc", "utp", "utm")
    j = c.withColumn("key", F.when(bp, F.col("name")).otherwise(stem)).join(named, "key", "left")
    return j.select("name", "change", F.coalesce("users", F.lit(0)).alias("users"))


def diff_counts(spark, sf_dir):
    """(ext, added, removed, changed)"""
    c = compare(manifest(table(spark, sf_dir, "files")), manifest(table(spark, sf_dir, "files_mirror")))
    n = lambda x: F.count_if(F.col("change") == x).alias(x)
    return c.groupBy(F.substring_index("name", ".", -1).alias("ext")).agg(n("added"), n("removed"), n("changed"))


def check(name: str, bad: DataFrame, total: DataFrame, warn_only: bool = False) -> DataFrame:
    """(check, verdict, bad, total) of one audit check: PASS without bad rows, else FAIL (or WARN)."""
    both = bad.select(F.lit(True).alias("bad")).unionByName(total.select(F.lit(False).alias("bad")))
    counts = both.agg(F.count_if(F.col("bad")).alias("bad"), F.count_if(~F.col("bad")).alias("total"))
    verdict = F.when(F.col("bad") == 0, "PASS").otherwise("WARN" if warn_only else "FAIL")
    return counts.select(F.lit(name).alias("check"), verdict.alias("verdict"), "bad", "total")


def audit_checks(spark, sf_dir):
    """(check, verdict, bad, total): whether the mirror is a faithful copy of the index."""
    a, b = table(spark, sf_dir, "files").where("removed_at IS NULL"), table(spark, sf_dir, "files_mirror").where("removed_at IS NULL")
    name = [F.concat_ws(".", "resref", "ext").alias("name")]
    na, nb = a.select(*name).distinct(), b.select(*name).distinct()
    areas = lambda f: f.where("ext = 'git'").select("resref").distinct()
    fields = lambda t: table(spark, sf_dir, t).where("path = label").select(F.lower("label").alias("label")).distinct()
    checks = [
        check("removals", na.join(nb, "name", "left_anti"), na),
        check("additions", nb.join(na, "name", "left_anti"), nb, warn_only=True),
        check("areas", areas(a).join(areas(b), "resref", "left_anti"), areas(a)),
        check("ids", b.groupBy("id").agg(F.countDistinct("relpath").alias("n")).where("n > 1"), b.select("id").distinct()),
        check("labels", fields("gff_fields").join(fields("gff_fields_mirror"), "label", "left_anti"), fields("gff_fields")),
        check("parse", b.where("status = 'error'").select("id").distinct(), b.select("id").distinct(), warn_only=True),
    ]
    return reduce(DataFrame.unionByName, checks)


def multiset_difference(spark, sf_dir):
    """(side, kind, n): rows of (ext, status, kind) that one side holds more often than the other."""
    c = ["ext", "status", "kind"]
    a, b = table(spark, sf_dir, "files").select(*c), table(spark, sf_dir, "files_mirror").select(*c)
    out = a.exceptAll(b).select(F.lit("left").alias("side"), "kind").unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "kind"))
    return out.groupBy("side", "kind").agg(F.count("*").alias("n"))


_A = """v AS (SELECT 'a' AS v, resref || '.' || ext AS name, source_id, lower(sha256) AS sha, size FROM files WHERE removed_at IS NULL
   UNION ALL SELECT 'b', resref || '.' || ext, source_id, lower(sha256), size FROM files_mirror WHERE removed_at IS NULL),
 w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY v, name ORDER BY source_id, sha NULLS FIRST, size NULLS FIRST) = 1),
 c AS (SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' WHEN a.sha IS DISTINCT FROM b.sha THEN 'changed' END AS change
       FROM (SELECT * FROM w WHERE v = 'a') a FULL JOIN (SELECT * FROM w WHERE v = 'b') b ON a.name = b.name)"""
QUERIES = {f.__name__: f for f in (diff_versions, diff_counts, audit_checks, multiset_difference)}
SQL = {
    "diff_versions": module_graph._R
    + f""", {_A}, n AS (SELECT regexp_extract(dst, '([^:]*)$', 1) AS key, count(DISTINCT src) AS users FROM edges GROUP BY 1)
      SELECT c.name, change, coalesce(users, 0) AS users FROM c LEFT JOIN n ON n.key = CASE WHEN split_part(c.name, '.', -1) IN ('uti','utc','utp','utm') THEN c.name ELSE split_part(c.name, '.', 1) END WHERE change IS NOT NULL""",
    "diff_counts": f"""WITH {_A} SELECT split_part(name, '.', -1) AS ext, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed,
      count(*) FILTER (WHERE change = 'changed') AS changed FROM c WHERE change IS NOT NULL GROUP BY 1""",
    "audit_checks": """WITH a AS (SELECT *, resref || '.' || ext AS name FROM files WHERE removed_at IS NULL), b AS (SELECT *, resref || '.' || ext AS name FROM files_mirror WHERE removed_at IS NULL),
      t AS (SELECT 'removals' AS c, 'FAIL' AS v, (SELECT count(DISTINCT name) FROM a WHERE name NOT IN (SELECT name FROM b)) AS bad, (SELECT count(DISTINCT name) FROM a) AS total
      UNION ALL SELECT 'additions', 'WARN', (SELECT count(DISTINCT name) FROM b WHERE name NOT IN (SELECT name FROM a)), (SELECT count(DISTINCT name) FROM b)
      UNION ALL SELECT 'areas', 'FAIL', (SELECT count(DISTINCT resref) FROM a WHERE ext = 'git' AND resref NOT IN (SELECT resref FROM b WHERE ext = 'git')), (SELECT count(DISTINCT resref) FROM a WHERE ext = 'git')
      UNION ALL SELECT 'ids', 'FAIL', (SELECT count(*) FROM (SELECT id FROM b GROUP BY id HAVING count(DISTINCT relpath) > 1)), (SELECT count(DISTINCT id) FROM b)
      UNION ALL SELECT 'labels', 'FAIL', (SELECT count(DISTINCT lower(label)) FROM gff_fields WHERE path = label AND lower(label) NOT IN (SELECT lower(label) FROM gff_fields_mirror WHERE path = label)), (SELECT count(DISTINCT lower(label)) FROM gff_fields WHERE path = label)
      UNION ALL SELECT 'parse', 'WARN', (SELECT count(DISTINCT id) FROM b WHERE status = 'error'), (SELECT count(DISTINCT id) FROM b))
      SELECT c AS "check", CASE WHEN bad = 0 THEN 'PASS' ELSE v END AS verdict, bad, total FROM t""",
    "multiset_difference": """WITH a AS (SELECT ext, status, kind FROM files), b AS (SELECT ext, status, kind FROM files_mirror), d AS (SELECT 'left' AS side, kind FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
      UNION ALL SELECT 'right', kind FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) SELECT side, kind, count(*) AS n FROM d GROUP BY 1, 2""",
}
