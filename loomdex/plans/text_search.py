"""Queries that search, link and rewrite text."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdex.operators import text
from loomdex.plans.session import table


def grep_lines(spark, sf_dir):
    """(doc_id, line, body): script calls that set a variable."""
    return text.grep(table(spark, sf_dir, "documents"), "doc_id", "text", r"SetLocalInt\(")


def token_link(spark, sf_dir):
    """(doc_id, name): documents that name a resource of the base game or of the module."""
    names = table(spark, sf_dir, "files").select(F.col("resref").alias("name"))
    parts = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name"))
    return text.link_names(table(spark, sf_dir, "documents"), "doc_id", "text", names.unionByName(parts), "name")


def find_everywhere(spark, sf_dir):
    """(where_found, id, hit): everything whose name or value holds 'lantern'."""
    d, f = table(spark, sf_dir, "documents"), table(spark, sf_dir, "files")
    g, p = table(spark, sf_dir, "gff_fields"), table(spark, sf_dir, "part")
    like = lambda c: F.col(c).ilike("%lantern%")
    return (
        f.where(like("resref")).select(F.lit("file").alias("where_found"), F.col("id"), F.col("relpath").alias("hit")).distinct()
        .unionByName(g.where(like("value")).select(F.lit("field").alias("where_found"), F.col("file_id").alias("id"), F.col("path").alias("hit")).distinct())
        .unionByName(d.where(like("text")).select(F.lit("document").alias("where_found"), F.col("doc_id").alias("id"), F.lit("").alias("hit")))
        .unionByName(p.where(like("p_name")).select(F.lit("part").alias("where_found"), F.col("p_partkey").alias("id"), F.col("p_name").alias("hit")))
    )


def replace_plan(spark, sf_dir):
    """(file_id, path, value, after): texts in which 'lantern' would become 'lamp'."""
    g = table(spark, sf_dir, "gff_fields").select("file_id", "path", "value").distinct()
    return text.replace_plan(g, "value", "lantern", "lamp")


def reference_rewrite(spark, sf_dir):
    """(file_id, path, value, changed): resource references after merging every copy into the least resref of its content."""
    f = table(spark, sf_dir, "files").where("removed_at IS NULL AND content_hash IS NOT NULL").select("resref", "ext", F.lower("content_hash").alias("c")).distinct()
    keep = f.groupBy("ext", "c").agg(F.min("resref").alias("new"))
    renames = f.join(keep, ["ext", "c"]).where("resref <> new").groupBy(F.col("resref").alias("old")).agg(F.min("new").alias("new"))
    refs = table(spark, sf_dir, "gff_fields").where("lower(type) = 'resref' AND value <> ''").select("file_id", "path", F.lower(F.trim("value")).alias("value")).distinct()
    return text.rewrite(refs, "value", renames)


def masked_signature(spark, sf_dir):
    """(signature, n, first_id): lines of change logs grouped by their text without numbers."""
    d = table(spark, sf_dir, "documents").where("kind = 'changelog'")
    s = text.lines(d, "doc_id", "text").select("doc_id", text.mask(F.col("body")).alias("signature")).where("signature <> ''")
    return s.groupBy("signature").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def name_families(spark, sf_dir):
    return text.name_sets(table(spark, sf_dir, "files"), "resref")


def numbered_slice(spark, sf_dir):
    """(doc_id, line, body): lines 3 to 5 of every script source."""
    d = table(spark, sf_dir, "documents").where("kind = 'script'")
    return text.lines(d, "doc_id", "text").where("line BETWEEN 3 AND 5")


def header_comments(spark, sf_dir):
    """(doc_id, comment): the comment lines that open a script."""
    d = table(spark, sf_dir, "documents").where("kind = 'script' AND text IS NOT NULL")
    head = F.regexp_extract("text", r"^((?://[^\n]*\n?)*)", 1)
    return d.select("doc_id", F.trim(F.regexp_replace(F.regexp_replace(head, "(?m)^// ?", ""), "\n$", "")).alias("comment")).where("comment <> ''")


def run_time_names(spark, sf_dir):
    """(fragment, scripts): names that start with a prefix which a script may complete at run time; prefix files join by equality."""
    r = table(spark, sf_dir, "files").where("ext IN ('nss', 'ncs')").select("resref").distinct()
    cuts = r.select("resref", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("resref") - 1)), lambda i: F.substring(F.col("resref"), F.lit(1), i))).alias("fragment"))
    frags = table(spark, sf_dir, "gff_fields").where("lower(type) = 'resref' AND value <> ''").select(F.regexp_extract(F.lower(F.trim("value")), "^([a-z0-9]+_)", 1).alias("fragment")).where("fragment <> ''").distinct()
    return cuts.join(frags, "fragment").groupBy("fragment").agg(F.countDistinct("resref").alias("scripts"))


QUERIES = {f.__name__: f for f in (grep_lines, token_link, find_everywhere, replace_plan, reference_rewrite, masked_signature, name_families, numbered_slice, header_comments, run_time_names)}
_LINES = "SELECT doc_id, kind, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS body, generate_subscripts(string_split_regex(text, '\\r\\n|\\r|\\n'), 1) AS line FROM documents WHERE text IS NOT NULL"
SQL = {
    "grep_lines": f"SELECT doc_id, line, body FROM ({_LINES}) WHERE body LIKE '%SetLocalInt(%'",
    "token_link": """WITH n AS (SELECT lower(resref) AS name FROM files UNION SELECT lower(unnest(string_split(p_name, ' '))) FROM part),
      t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_-]{3,32}')) AS name FROM documents) SELECT doc_id, name FROM t WHERE name IN (SELECT name FROM n)""",
    "find_everywhere": """SELECT DISTINCT 'file' AS where_found, id, relpath AS hit FROM files WHERE resref ILIKE '%lantern%' UNION ALL SELECT DISTINCT 'field', file_id, path FROM gff_fields WHERE value ILIKE '%lantern%'
      UNION ALL SELECT 'document', doc_id, '' FROM documents WHERE text ILIKE '%lantern%' UNION ALL SELECT 'part', p_partkey, p_name FROM part WHERE p_name ILIKE '%lantern%'""",
    "replace_plan": r"""SELECT DISTINCT file_id, path, value, regexp_replace(value, '(^|[^A-Za-z0-9_])lantern($|[^A-Za-z0-9_])', '\1lamp\2', 'gi') AS after FROM gff_fields
      WHERE regexp_matches(value, '(?i)(^|[^A-Za-z0-9_])lantern($|[^A-Za-z0-9_])')""",
    "reference_rewrite": """WITH f AS (SELECT DISTINCT resref, ext, lower(content_hash) AS c FROM files WHERE removed_at IS NULL AND content_hash IS NOT NULL), k AS (SELECT ext, c, min(resref) AS n FROM f GROUP BY 1, 2),
      r AS (SELECT resref AS old, min(n) AS new FROM f JOIN k USING (ext, c) WHERE resref <> n GROUP BY 1), g AS (SELECT DISTINCT file_id, path, lower(trim(value)) AS value FROM gff_fields WHERE lower(type) = 'resref' AND value <> '')
      SELECT file_id, path, coalesce(new, value) AS value, new IS NOT NULL AS changed FROM g LEFT JOIN r ON r.old = g.value""",
    "masked_signature": f"""WITH s AS (SELECT doc_id, substr(regexp_replace(body, '0x[0-9a-fA-F]+|[0-9]+', '#', 'g'), 1, 160) AS signature FROM ({_LINES}) WHERE kind = 'changelog')
      SELECT signature, count(*) AS n, min(doc_id) AS first_id FROM s WHERE signature <> '' GROUP BY 1""",
    "name_families": """WITH n AS (SELECT DISTINCT resref AS name, string_split_regex(resref, '[_ ]+') AS parts FROM files WHERE resref IS NOT NULL),
      p AS (SELECT name, array_to_string(parts[1:i], '_') AS prefix FROM n, unnest(range(1, len(parts))) AS u(i) WHERE len(parts) > 1),
      g AS (SELECT prefix FROM p GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60), b AS (SELECT name, first(prefix ORDER BY length(prefix)) AS family FROM p JOIN g USING (prefix) GROUP BY 1)
      SELECT n.name, family FROM n LEFT JOIN b USING (name)""",
    "numbered_slice": f"SELECT doc_id, line, body FROM ({_LINES}) WHERE kind = 'script' AND line BETWEEN 3 AND 5",
    "header_comments": r"""WITH h AS (SELECT doc_id, regexp_extract(text, '^((?://[^\n]*\n?)*)', 1) AS head FROM documents WHERE kind = 'script' AND text IS NOT NULL)
      SELECT doc_id, trim(regexp_replace(regexp_replace(head, '(?m)^// ?', '', 'g'), '\n$', '')) AS comment FROM h WHERE comment <> ''""",
    "run_time_names": r"""WITH r AS (SELECT DISTINCT resref FROM files WHERE ext IN ('nss','ncs')),
      f AS (SELECT DISTINCT regexp_extract(lower(trim(value)), '^([a-z0-9]+_)', 1) AS fragment FROM gff_fields WHERE lower(type) = 'resref' AND value <> '')
      SELECT fragment, count(DISTINCT resref) AS scripts FROM f JOIN r ON starts_with(resref, fragment) AND length(resref) > length(fragment) WHERE fragment <> '' GROUP BY 1""",
}
