"""The rules over the module tables, and the queries that combine them."""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.operators import graph, rules
from loomdex.operators.rules import rule
from loomdex.plans import module_graph
from loomdex.plans.session import cut, table


#: The edges, computed once for all the rules of a call.
_EDGES: ContextVar[DataFrame | None] = ContextVar("edges", default=None)


def _edges(spark, sf_dir) -> DataFrame:
    e = _EDGES.get()
    return module_graph.edges(spark, sf_dir) if e is None else e


#: Fixed value: characters that the name of a resource may have.
NAME_LIMIT = 16


def _files(spark, sf_dir):
    return table(spark, sf_dir, "files").where("removed_at IS NULL")


def _field(spark, sf_dir):
    """Fields with the node of their file, present files only."""
    f = _files(spark, sf_dir).select(F.col("id").alias("file_id"), "node", "ext").distinct()
    return table(spark, sf_dir, "gff_fields").join(f, "file_id")


@rule("parse_error", "error")
def parse_error(spark, sf_dir):
    return _files(spark, sf_dir).where("status = 'error'").select("node", F.coalesce("error", F.lit("")).alias("detail"))


@rule("name_too_long", "warning")
def name_too_long(spark, sf_dir):
    return _files(spark, sf_dir).where(F.length("resref") > NAME_LIMIT).select("node", F.length("resref").cast("string").alias("detail"))


@rule("unsafe_name", "warning")
def unsafe_name(spark, sf_dir):
    return _files(spark, sf_dir).where(~F.col("resref").rlike("^[a-z0-9_]+$")).select("node", F.col("resref").alias("detail"))


@rule("resref_case", "info")
def resref_case(spark, sf_dir):
    g = _field(spark, sf_dir).where((F.lower("type") == "resref") & (F.col("value") != F.lower("value")))
    return g.select("node", F.concat_ws(" = ", "path", "value").alias("detail"))


@rule("compiled_without_source", "warning")
def compiled_without_source(spark, sf_dir):
    f = _files(spark, sf_dir)
    return f.where("ext = 'ncs'").join(f.where("ext = 'nss'").select("resref"), "resref", "left_anti").select("node", F.col("resref").alias("detail"))


@rule("not_compiled", "info")
def not_compiled(spark, sf_dir):
    f = _files(spark, sf_dir)
    return f.where("ext = 'nss'").join(f.where("ext = 'ncs'").select("resref"), "resref", "left_anti").select("node", F.col("resref").alias("detail"))


@rule("missing_reference", "error")
def missing_reference(spark, sf_dir):
    e = _edges(spark, sf_dir)
    m = module_graph.missing_nodes(spark, sf_dir, e).select("dst")
    return e.join(m.distinct(), "dst", "left_semi").select(F.col("src").alias("node"), F.concat_ws(" ", "kind", F.expr("substring(dst, 9)")).alias("detail"))


@rule("resource_conflict", "warning")
def resource_conflict(spark, sf_dir):
    g = _files(spark, sf_dir).groupBy("node").agg(F.countDistinct("source_id").alias("n"), F.countDistinct(F.lower("content_hash")).alias("c"))
    return g.where("n > 1 AND c > 1").select("node", F.concat_ws(" ", F.col("n").cast("string"), F.lit("sources")).alias("detail"))


@rule("broken_strref", "error")
def broken_strref(spark, sf_dir):
    f = _files(spark, sf_dir).select(F.col("id").alias("file_id"), "node").distinct()
    s = table(spark, sf_dir, "locstrings").where("strref <> 4294967295 AND tlk_text IS NULL").join(f, "file_id")
    return s.select("node", F.concat_ws(" ", "path", F.col("strref").cast("string")).alias("detail"))


@rule("locstring_both", "info")
def locstring_both(spark, sf_dir):
    f = _files(spark, sf_dir).select(F.col("id").alias("file_id"), "node").distinct()
    s = table(spark, sf_dir, "locstrings").where("text <> '' AND tlk_text IS NOT NULL AND text <> tlk_text").join(f, "file_id")
    return s.select("node", F.col("path").alias("detail"))


@rule("blueprint_unplaced", "info")
def blueprint_unplaced(spark, sf_dir):
    used = _edges(spark, sf_dir).where("kind IN ('contains', 'inventory')").select(F.col("dst").alias("node")).distinct()
    return _files(spark, sf_dir).where("ext IN ('utc', 'utp', 'uti')").join(used, "node", "left_anti").select("node", F.col("ext").alias("detail"))


@rule("include_cycle", "error")
def include_cycle(spark, sf_dir):
    return graph.strong_components(_edges(spark, sf_dir).where("kind = 'include'")).select("node", F.col("component").alias("detail"))


@rule("tag_case", "warning")
def tag_case(spark, sf_dir):
    t = _field(spark, sf_dir).where("path = 'Tag' AND value <> ''").select("node", "value", F.lower("value").alias("low"))
    twins = t.groupBy("low").agg(F.countDistinct("value").alias("n")).where("n > 1")
    return t.join(twins, "low").select("node", F.col("value").alias("detail"))


@rule("removed_but_referenced", "warning")
def removed_but_referenced(spark, sf_dir):
    gone = table(spark, sf_dir, "files").groupBy("node").agg(F.count_if(F.col("removed_at").isNull()).alias("left")).where("left = 0")
    e = _edges(spark, sf_dir)
    return e.join(gone, e["dst"] == gone["node"]).select(e["src"].alias("node"), F.col("dst").alias("detail"))


def issues(spark, sf_dir):
    """(severity, category, node, detail): the findings of all rules."""
    return _issues(spark, sf_dir, cut(module_graph.edges(spark, sf_dir)))


def _issues(spark, sf_dir, e: DataFrame) -> DataFrame:
    before = _EDGES.set(e)
    try:
        return rules.run_all(spark, sf_dir)
    finally:
        _EDGES.reset(before)


def issue_counts(spark, sf_dir):
    """(severity, category, n, nodes, place): a summary, worst first."""
    from pyspark.sql import Window

    g = issues(spark, sf_dir).groupBy("severity", "category").agg(F.count("*").alias("n"), F.countDistinct("node").alias("nodes"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(rules.severity_rank(F.col("severity")), F.desc("n"), "category")).cast("bigint"))  # one row per rule


def issues_downgraded(spark, sf_dir):
    """(severity, category, n): after findings about nodes that no area leads to became info."""
    e = cut(module_graph.edges(spark, sf_dir))
    live = graph.reachable(e, module_graph.roots(spark, sf_dir)).select("node")
    out = rules.downgrade_unused(_issues(spark, sf_dir, e), live, ("missing_reference", "broken_strref", "resref_case", "tag_case"))
    return out.groupBy("severity", "category").agg(F.count("*").alias("n"))


def issues_report(spark, sf_dir):
    """(category, node, detail, place, hidden): a report of at most 20 findings per rule."""
    return rules.cap_per_category(issues(spark, sf_dir), 20).select("category", "node", "detail", F.col("place").cast("bigint").alias("place"), "hidden")


def new_issues(spark, sf_dir):
    """(severity, category, n): findings but the accepted ones; accepted here are all unplaced blueprints of creatures."""
    all_ = issues(spark, sf_dir)
    rest = rules.without_accepted(all_, all_.where("category = 'blueprint_unplaced' AND detail = 'utc'"))
    return rest.groupBy("severity", "category").agg(F.count("*").alias("n"))


_ISSUES = (
    module_graph._R
    + r""", f AS (SELECT DISTINCT * FROM files WHERE removed_at IS NULL), g AS (SELECT DISTINCT gf.path, gf.label, gf.type, gf.value, f.node, f.ext FROM gff_fields gf JOIN f ON f.id = gf.file_id),
 base AS (SELECT 'missing:' || regexp_extract(lower(name), '^(.*)\.[^.]*$', 1) AS dst FROM base_resources),
 gone AS (SELECT node FROM files GROUP BY node HAVING count(*) FILTER (WHERE removed_at IS NULL) = 0),
 led(src, dst) AS (SELECT src, dst FROM edges WHERE kind = 'include' UNION SELECT led.src, e.dst FROM led JOIN edges e ON e.src = led.dst AND e.kind = 'include'),
 l AS (SELECT f.node, s.* FROM locstrings s JOIN f ON f.id = s.file_id),
 issues AS (
 SELECT 'error' AS severity, 'parse_error' AS category, node, coalesce(error, '') AS detail FROM f WHERE status = 'error'
 UNION SELECT 'warning', 'name_too_long', node, CAST(length(resref) AS VARCHAR) FROM f WHERE length(resref) > 16
 UNION SELECT 'warning', 'unsafe_name', node, resref FROM f WHERE NOT regexp_full_match(resref, '[a-z0-9_]+')
 UNION SELECT 'info', 'resref_case', node, path || ' = ' || value FROM g WHERE lower(type) = 'resref' AND value <> lower(value)
 UNION SELECT 'warning', 'compiled_without_source', node, resref FROM f WHERE ext = 'ncs' AND resref NOT IN (SELECT resref FROM f WHERE ext = 'nss')
 UNION SELECT 'info', 'not_compiled', node, resref FROM f WHERE ext = 'nss' AND resref NOT IN (SELECT resref FROM f WHERE ext = 'ncs')
 UNION SELECT 'error', 'missing_reference', src, kind || ' ' || substr(dst, 9) FROM edges WHERE dst LIKE 'missing:%' AND dst NOT IN (SELECT dst FROM base)
 UNION SELECT 'warning', 'resource_conflict', node, count(DISTINCT source_id) || ' sources' FROM f GROUP BY node HAVING count(DISTINCT source_id) > 1 AND count(DISTINCT lower(content_hash)) > 1
 UNION SELECT 'error', 'broken_strref', node, path || ' ' || strref FROM l WHERE strref <> 4294967295 AND tlk_text IS NULL
 UNION SELECT 'info', 'locstring_both', node, path FROM l WHERE text <> '' AND tlk_text IS NOT NULL AND text <> tlk_text
 UNION SELECT 'info', 'blueprint_unplaced', node, ext FROM f WHERE ext IN ('utc','utp','uti') AND node NOT IN (SELECT dst FROM edges WHERE kind IN ('contains','inventory'))
 UNION SELECT 'error', 'include_cycle', node, component FROM (SELECT x.src AS node, least(x.src, min(x.dst)) AS component FROM led x JOIN led y ON x.src = y.dst AND x.dst = y.src GROUP BY x.src)
 UNION SELECT 'warning', 'tag_case', node, value FROM g WHERE path = 'Tag' AND value <> '' AND lower(value) IN (SELECT lower(value) FROM g WHERE path = 'Tag' GROUP BY 1 HAVING count(DISTINCT value) > 1)
 UNION SELECT 'warning', 'removed_but_referenced', src, dst FROM edges WHERE dst IN (SELECT node FROM gone))
"""
)
QUERIES = {f.__name__: f for f in (issues, issue_counts, issues_downgraded, issues_report, new_issues)}
SQL = {
    "issues": _ISSUES + "SELECT severity, category, node, detail FROM issues",
    "issue_counts": _ISSUES
    + """, c AS (SELECT severity, category, count(*) AS n, count(DISTINCT node) AS nodes FROM issues GROUP BY 1, 2)
      SELECT *, row_number() OVER (ORDER BY list_position(['error','warning','info'], severity), n DESC, category) AS place FROM c""",
    "issues_downgraded": _ISSUES
    + module_graph._REACH
    + """ SELECT CASE WHEN category IN ('missing_reference','broken_strref','resref_case','tag_case') AND node NOT IN (SELECT node FROM reach) THEN 'info' ELSE severity END AS severity, category, count(*) AS n FROM issues GROUP BY 1, 2""",
    "issues_report": _ISSUES
    + """SELECT category, node, detail, row_number() OVER (PARTITION BY category ORDER BY node, detail, severity) AS place,
      greatest(count(*) OVER (PARTITION BY category) - 20, 0) AS hidden FROM issues QUALIFY place <= 20""",
    "new_issues": _ISSUES + "SELECT severity, category, count(*) AS n FROM issues WHERE NOT (category = 'blueprint_unplaced' AND detail = 'utc') GROUP BY 1, 2",
}
