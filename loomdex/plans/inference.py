"""Facts inferred from source text and field values: variables, literals, tags, list slots, attitudes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdex.operators import scripts, text
from loomdex.plans.session import table


def script_literals(spark, sf_dir):
    """(doc_id, line, func, literal): string literals of calls in script sources; comment lines hold none."""
    d = table(spark, sf_dir, "documents").where("kind = 'script' AND text IS NOT NULL")
    code = text.lines(d, "doc_id", "text").where(~F.col("body").rlike(r"^\s*//"))
    call = F.regexp_extract_all("body", F.lit(r'([A-Za-z_]\w*\([^()"]*"[^"]*")'), F.lit(1))
    c = code.select("doc_id", F.col("line").cast("bigint").alias("line"), F.explode(call).alias("c"))
    return c.select("doc_id", "line", F.regexp_extract("c", r"^([A-Za-z_]\w*)\(", 1).alias("func"), F.regexp_extract("c", r'"([^"]*)"$', 1).alias("literal"))


def lexed_literals(spark, sf_dir):
    """(doc_id, line, func, literal): the same from the lexer, which also knows nesting, escapes and block comments."""
    d = table(spark, sf_dir, "documents").where("kind = 'script'")
    lit = scripts.script_literals(d, "doc_id", "text").where("func IS NOT NULL")
    return lit.select(F.col("script").alias("doc_id"), F.col("line").cast("bigint").alias("line"), "func", "literal")


def script_index(spark, sf_dir):
    """(doc_id, has_main, lines, functions): what each script source defines."""
    f = scripts.script_facts(table(spark, sf_dir, "documents").where("kind = 'script'"), "doc_id", "text")
    return f.select(F.col("script").alias("doc_id"), "has_main", F.col("lines").cast("bigint").alias("lines"), F.concat_ws(",", "functions").alias("functions"))


def same_code(spark, sf_dir):
    """(script, peers): script sources of the same code, comments and spaces aside."""
    f = scripts.script_facts(table(spark, sf_dir, "documents").where("kind = 'script'"), "doc_id", "text")
    n = f.groupBy("norm_hash").agg(F.count("*").alias("n")).where("n > 1")
    return f.join(n, "norm_hash").select("script", (F.col("n") - 1).alias("peers"))


def variable_audit(spark, sf_dir):
    """(name, n_sets, n_reads, scripts, status): read_never_set, set_never_read or ok. Names are case-sensitive."""
    lit = script_literals(spark, sf_dir)
    n = lit.where("func IN ('SetLocalInt', 'GetLocalInt')").groupBy(F.col("literal").alias("name")).agg(
        F.count_if(F.col("func") == "SetLocalInt").alias("n_sets"), F.count_if(F.col("func") == "GetLocalInt").alias("n_reads"), F.countDistinct("doc_id").alias("scripts")
    )
    return n.withColumn("status", F.when(F.col("n_sets") == 0, "read_never_set").when(F.col("n_reads") == 0, "set_never_read").otherwise("ok"))


def function_use(spark, sf_dir):
    """(func, calls, scripts): the functions that scripts call with text."""
    return script_literals(spark, sf_dir).groupBy("func").agg(F.count("*").alias("calls"), F.countDistinct("doc_id").alias("scripts"))


def tag_audit(spark, sf_dir):
    """(speaker, uses, found): speakers of conversations against tags of blueprints: exact, by case or unknown."""
    g = table(spark, sf_dir, "gff_fields")
    tags = g.where("path = 'Tag' AND value <> ''").select(F.col("value").alias("tag")).distinct()
    names = g.where("path IN ('FirstName', 'LocName', 'Tag') AND value <> ''").select(F.lower(F.trim("value")).alias("low")).distinct()
    s = g.where("label = 'Speaker' AND value <> ''").groupBy(F.col("value").alias("speaker")).agg(F.count("*").alias("uses"))
    j = s.join(tags.withColumn("exact", F.lit(True)), F.col("speaker") == F.col("tag"), "left").drop("tag")
    j = j.join(names.withColumn("near", F.lit(True)), F.lower(F.trim("speaker")) == F.col("low"), "left")
    return j.select("speaker", "uses", F.when(F.col("exact"), "exact").when(F.col("near"), "by_case").otherwise("unknown").alias("found"))


def list_slots(spark, sf_dir):
    """(file_id, list_path, size, holes): lists whose numbering leaves slots out."""
    p = table(spark, sf_dir, "gff_fields").select("file_id", F.regexp_extract("path", r"^(.*)\[([0-9]+)\][^\[\]]*$", 1).alias("list_path"), F.regexp_extract("path", r"^(.*)\[([0-9]+)\][^\[\]]*$", 2).alias("slot")).where("slot <> ''")
    g = p.groupBy("file_id", "list_path").agg(F.max(F.col("slot").cast("bigint")).alias("top"), F.countDistinct("slot").alias("n"))
    return g.select("file_id", "list_path", (F.col("top") + 1).alias("size"), (F.col("top") + 1 - F.col("n")).alias("holes")).where("holes > 0")


def faction_members(spark, sf_dir):
    """(faction, members, kinds): who is in which faction."""
    f = table(spark, sf_dir, "files").where("removed_at IS NULL").select(F.col("id").alias("file_id"), "ext").distinct()
    g = table(spark, sf_dir, "gff_fields").where("path = label AND lower(label) IN ('factionid', 'faction')").select("file_id", F.trim("value").alias("faction")).distinct().join(f, "file_id")
    return g.groupBy("faction").agg(F.count("*").alias("members"), F.concat_ws(",", F.array_sort(F.collect_set("ext"))).alias("kinds"))


def attitudes(spark, sf_dir):
    """(user_id, event_type, attitude): reputation of users by the mean value of their events: hostile, neutral or friendly."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("v"), F.count("*").alias("n"))
    mean = F.col("v") / F.col("n") / 100
    return e.select("user_id", "event_type", F.when(mean <= 10, "hostile").when(mean >= 90, "friendly").otherwise("neutral").alias("attitude"))


def never_true(spark, sf_dir):
    """(user_id, k, reads): values of k that a user's views wait for and no purchase of theirs ever set."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    sets = e.where("event_type = 'purchase'").select("user_id", "k").distinct()
    return e.where("event_type = 'view'").join(sets, ["user_id", "k"], "left_anti").groupBy("user_id", "k").agg(F.count("*").alias("reads"))


def set_read_audit(spark, sf_dir):
    """(user_id, sets, reads, status)"""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("sets"), F.count_if(F.col("event_type") == "view").alias("reads"))
    return e.withColumn("status", F.when(F.col("sets") == 0, "read_never_set").when(F.col("reads") == 0, "set_never_read").otherwise("ok"))


def localised_text(spark, sf_dir):
    """(file_id, path, shown, origin): what a localised string shows: its entry of lowest key that has text, else the string table's."""
    s = table(spark, sf_dir, "locstrings").select("file_id", "path", "tlk_text", F.array_sort(F.map_entries(F.coalesce("entries", F.create_map().cast("map<int,string>")))).alias("e")).distinct()
    own = F.get(F.filter("e", lambda x: F.coalesce(x["value"], F.lit("")) != ""), 0)["value"]
    return s.select("file_id", "path", F.coalesce(own, "tlk_text", F.lit("")).alias("shown"), F.when(own.isNotNull(), "entry").when(F.col("tlk_text").isNotNull(), "table").otherwise("none").alias("origin"))


def strref_status(spark, sf_dir):
    """(status, custom, n): string references: none, ok or broken, by table (bit 24 selects the custom one)."""
    s = table(spark, sf_dir, "locstrings").select("file_id", "path", "strref", "tlk_text").distinct()
    status = F.when(F.col("strref") == 4294967295, "none").when(F.col("tlk_text").isNull(), "broken").otherwise("ok")
    custom = (F.col("strref") != 4294967295) & (F.col("strref").bitwiseAND(1 << 24) != 0)
    return s.groupBy(status.alias("status"), custom.alias("custom")).agg(F.count("*").alias("n"))


def language_coverage(spark, sf_dir):
    """(lang, strings, empty): entries per language key."""
    e = table(spark, sf_dir, "locstrings").select(F.explode("entries").alias("lang", "text"))
    return e.groupBy("lang").agg(F.count("*").alias("strings"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty"))


QUERIES = {f.__name__: f for f in (script_literals, lexed_literals, script_index, same_code, variable_audit, function_use, tag_audit, list_slots, faction_members, attitudes, never_true, set_read_audit, localised_text, strref_status, language_coverage)}
_LIT = r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS body, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) AS line FROM documents WHERE kind = 'script' AND text IS NOT NULL),
 c AS (SELECT doc_id, line, unnest(regexp_extract_all(body, '[A-Za-z_]\w*\([^()"]*"[^"]*"')) AS c FROM l WHERE NOT regexp_matches(body, '^\s*//')),
 lit AS (SELECT doc_id, line, regexp_extract(c, '^([A-Za-z_]\w*)\(', 1) AS func, regexp_extract(c, '"([^"]*)"$', 1) AS literal FROM c)
"""
SQL = {
    "script_literals": _LIT + "SELECT * FROM lit",
    "lexed_literals": _LIT + "SELECT * FROM lit",
    "script_index": r"""SELECT doc_id, regexp_matches(text, 'void\s+main\s*\(\s*\)\s*\{') AS has_main, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines,
      CASE WHEN regexp_matches(text, 'void\s+main\s*\(\s*\)\s*\{') THEN 'main' ELSE '' END AS functions FROM documents WHERE kind = 'script' AND text IS NOT NULL""",
    "same_code": r"""WITH c AS (SELECT doc_id AS script, regexp_replace(regexp_replace(text, '//[^\n]*', '', 'g'), '\s+', '', 'g') AS code FROM documents WHERE kind = 'script' AND text IS NOT NULL)
      SELECT script, count(*) OVER (PARTITION BY code) - 1 AS peers FROM c QUALIFY peers > 0""",
    "variable_audit": _LIT
    + """, n AS (SELECT literal AS name, count(*) FILTER (WHERE func = 'SetLocalInt') AS n_sets, count(*) FILTER (WHERE func = 'GetLocalInt') AS n_reads, count(DISTINCT doc_id) AS scripts FROM lit
      WHERE func IN ('SetLocalInt','GetLocalInt') GROUP BY 1) SELECT *, CASE WHEN n_sets = 0 THEN 'read_never_set' WHEN n_reads = 0 THEN 'set_never_read' ELSE 'ok' END AS status FROM n""",
    "function_use": _LIT + "SELECT func, count(*) AS calls, count(DISTINCT doc_id) AS scripts FROM lit GROUP BY 1",
    "tag_audit": """SELECT value AS speaker, count(*) AS uses, CASE WHEN value IN (SELECT value FROM gff_fields WHERE path = 'Tag' AND value <> '') THEN 'exact'
      WHEN lower(trim(value)) IN (SELECT lower(trim(value)) FROM gff_fields WHERE path IN ('FirstName','LocName','Tag') AND value <> '') THEN 'by_case' ELSE 'unknown' END AS found FROM gff_fields WHERE label = 'Speaker' AND value <> '' GROUP BY 1""",
    "list_slots": r"""WITH p AS (SELECT file_id, regexp_extract(path, '^(.*)\[([0-9]+)\][^\[\]]*$', 1) AS list_path, regexp_extract(path, '^(.*)\[([0-9]+)\][^\[\]]*$', 2) AS slot FROM gff_fields)
      SELECT file_id, list_path, max(CAST(slot AS BIGINT)) + 1 AS size, max(CAST(slot AS BIGINT)) + 1 - count(DISTINCT slot) AS holes FROM p WHERE slot <> '' GROUP BY 1, 2 HAVING max(CAST(slot AS BIGINT)) + 1 > count(DISTINCT slot)""",
    "faction_members": """WITH f AS (SELECT DISTINCT id, ext FROM files WHERE removed_at IS NULL), g AS (SELECT DISTINCT file_id, trim(value) AS faction FROM gff_fields WHERE path = label AND lower(label) IN ('factionid','faction'))
      SELECT faction, count(*) AS members, string_agg(DISTINCT ext, ',' ORDER BY ext) AS kinds FROM g JOIN f ON f.id = file_id GROUP BY 1""",
    "attitudes": """WITH e AS (SELECT user_id, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS m FROM events GROUP BY 1, 2)
      SELECT user_id, event_type, CASE WHEN m <= 10 THEN 'hostile' WHEN m >= 90 THEN 'friendly' ELSE 'neutral' END AS attitude FROM e""",
    "never_true": """WITH e AS (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
      SELECT user_id, k, count(*) AS reads FROM e v WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM e p WHERE p.event_type = 'purchase' AND p.user_id = v.user_id AND p.k = v.k) GROUP BY 1, 2""",
    "set_read_audit": """WITH e AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS sets, count(*) FILTER (WHERE event_type = 'view') AS reads FROM events GROUP BY 1)
      SELECT *, CASE WHEN sets = 0 THEN 'read_never_set' WHEN reads = 0 THEN 'set_never_read' ELSE 'ok' END AS status FROM e""",
    "localised_text": """WITH s AS (SELECT DISTINCT file_id, path, tlk_text, list_filter(list_sort(map_entries(entries)), lambda x: coalesce(x.value, '') <> '')[1].value AS own FROM locstrings)
      SELECT file_id, path, coalesce(own, tlk_text, '') AS shown, CASE WHEN own IS NOT NULL THEN 'entry' WHEN tlk_text IS NOT NULL THEN 'table' ELSE 'none' END AS origin FROM s""",
    "strref_status": """SELECT CASE WHEN strref = 4294967295 THEN 'none' WHEN tlk_text IS NULL THEN 'broken' ELSE 'ok' END AS status, strref <> 4294967295 AND (strref & 16777216) <> 0 AS custom, count(*) AS n
      FROM (SELECT DISTINCT file_id, path, strref, tlk_text FROM locstrings) GROUP BY 1, 2""",
    "language_coverage": "SELECT e.key AS lang, count(*) AS strings, count(*) FILTER (WHERE coalesce(e.value, '') = '') AS empty FROM (SELECT unnest(map_entries(entries)) AS e FROM locstrings) GROUP BY 1",
}
