"""Queries for duplicates and look-alikes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomdex.operators.duplicates import case_twins, collapse, near_names, same_key, signature
from loomdex.operators.precedence import source_rank
from loomdex.plans.session import table

#: Fields that don't change what an item does.
COSMETIC = (
    "TemplateResRef", "Tag", "LocalizedName", "Description", "DescIdentified", "Comment", "PaletteID", "ModelPart1", "ModelPart2", "ModelPart3",
    "Cloth1Color", "Cloth2Color", "Leather1Color", "Leather2Color", "Metal1Color", "Metal2Color", "Identified", "Stolen",
)
#: Groups that the report of asset duplicates lists, those that waste most first.
MOST_GROUPS = 3000
_COSMETIC_SQL = "(" + ", ".join(f"'{x}'" for x in COSMETIC) + ")"


def _present(spark, sf_dir):
    return table(spark, sf_dir, "files").where("removed_at IS NULL")


def dup_exact(spark, sf_dir):
    """(ext, content, id, n): copies of the same content."""
    return same_key(_present(spark, sf_dir).select("ext", F.lower("content_hash").alias("content"), "id"), ["ext", "content"], "id")


def dup_same_function(spark, sf_dir):
    """(id, peers): item files that equal another in all but their cosmetic fields."""
    items = _present(spark, sf_dir).where("ext = 'uti'").select(F.col("id").alias("file_id")).distinct()
    rows = table(spark, sf_dir, "gff_fields").where(~F.col("label").isin(*COSMETIC)).join(items, "file_id", "left_semi")
    g = same_key(signature(rows, "file_id", ["path", "value"]), ["signature"], "file_id")
    return g.select(F.col("file_id").alias("id"), (F.col("n") - 1).alias("peers"))


def dup_shared_tag(spark, sf_dir):
    """(tag, node, n): blueprints of one type that share a tag; tags are case-sensitive."""
    tags = table(spark, sf_dir, "gff_fields").where("path = 'Tag' AND value <> ''").select("file_id", F.col("value").alias("tag"))
    files = _present(spark, sf_dir).select(F.col("id").alias("file_id"), "ext", "node")
    return same_key(tags.join(files, "file_id"), ["ext", "tag"], "node")


def dup_same_name(spark, sf_dir):
    """(name, node, n): items of the same display name."""
    names = table(spark, sf_dir, "gff_fields").where("path = 'LocalizedName'").select("file_id", F.lower(F.trim("value")).alias("name")).where("name <> ''")
    files = _present(spark, sf_dir).select(F.col("id").alias("file_id"), "node")
    return same_key(names.join(files, "file_id"), ["name"], "node")


def dup_normalised_text(spark, sf_dir):
    """(digest, doc_id, n): documents equal but for case and white space."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.md5(collapse(F.col("text")).cast("binary")).alias("digest"), "doc_id")
    return same_key(docs, ["digest"], "doc_id")


def asset_duplicates(spark, sf_dir):
    """(ext, sha, members, extra_bytes, place): the most wasteful groups of byte-identical models and textures; a name in two
    sources is one member."""
    f = _present(spark, sf_dir).where("ext IN ('tga', 'mdl') AND sha256 IS NOT NULL")
    names = f.groupBy("ext", F.lower("sha256").alias("sha"), "resref").agg(F.max("size").alias("size"))
    g = names.groupBy("ext", "sha").agg(F.count("*").alias("members"), F.max("size").alias("size")).where("members > 1")
    g = g.withColumn("extra_bytes", F.coalesce("size", F.lit(0)) * (F.col("members") - 1))
    top = g.orderBy(F.desc("extra_bytes"), "ext", "sha").limit(MOST_GROUPS)  # the report's length; only these are numbered in one task
    rows = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("extra_bytes"), "ext", "sha")))
    return rows.select("ext", "sha", "members", "extra_bytes", F.col("place").cast("bigint").alias("place"))


def dup_keeper(spark, sf_dir):
    """(ext, content, keeper, members, referenced): of each group of copies the one to keep: most referred to, best source, least id."""
    s = F.broadcast(table(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), source_rank(F.col("kind"), F.col("priority")).alias("rank")))
    f = _present(spark, sf_dir).select("id", "source_id", "ext", "resref", F.lower("content_hash").alias("content")).distinct().where("content IS NOT NULL")
    named = table(spark, sf_dir, "gff_fields").where("type = 'resref' AND value <> ''").groupBy(F.lower(F.trim("value")).alias("resref")).agg(F.count("*").alias("refs"))
    f = f.join(s, "source_id").join(named, "resref", "left").na.fill(0, ["refs"])
    order = F.struct((-F.col("refs")).alias("r"), F.col("rank"), F.col("id"))
    g = f.groupBy("ext", "content").agg(F.min_by("id", order).alias("keeper"), F.count("*").alias("members"), F.sum("refs").alias("referenced"))
    return g.where("members > 1")


def lookalike_field_diff(spark, sf_dir):
    """(keeper, member, path, kind): fields in which copies of a winning resource differ from it, as look or function."""
    s = F.broadcast(table(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), source_rank(F.col("kind"), F.col("priority")).alias("rank")))
    f = _present(spark, sf_dir).select("id", "source_id", "resref", "ext").distinct().join(s, "source_id")
    first = f.groupBy("resref", "ext").agg(F.min_by("id", F.struct("rank", "id")).alias("keeper"))
    pairs = f.join(first, ["resref", "ext"]).where("id <> keeper").select("keeper", F.col("id").alias("member"))
    cells = table(spark, sf_dir, "gff_fields").select("file_id", "path", "label", "value").distinct()
    a = pairs.join(cells, pairs["keeper"] == cells["file_id"]).select("keeper", "member", "path", "label", F.col("value").alias("v"), F.lit(1).alias("side"))
    b = pairs.join(cells, pairs["member"] == cells["file_id"]).select("keeper", "member", "path", "label", F.col("value").alias("v"), F.lit(2).alias("side"))
    rest = a.unionByName(b).groupBy("keeper", "member", "path", "v").agg(F.bit_or("side").alias("side"), F.min("label").alias("label")).where("side <> 3")
    kind = F.when(F.col("label").isin(*COSMETIC), "look").otherwise("function")
    return rest.select("keeper", "member", "path", kind.alias("kind")).distinct()


def near_tags(spark, sf_dir):
    """(a, b): field labels and part names one edit apart."""
    labels = table(spark, sf_dir, "gff_fields").select(F.col("label").alias("name"))
    resrefs = table(spark, sf_dir, "base_resources").select(F.regexp_extract("name", r"^([^.]*)", 1).alias("name"))
    return near_names(labels.unionByName(resrefs), "name")


def label_case_twins(spark, sf_dir):
    return case_twins(table(spark, sf_dir, "gff_fields"), "label")


def duplicate_entries(spark, sf_dir):
    """(source_id, rel, n): paths that one source lists more than once, letter case aside."""
    f = table(spark, sf_dir, "files").groupBy("source_id", F.lower("relpath").alias("rel")).agg(F.count("*").alias("n"))
    return f.where("n > 1")


def family_of_sources(spark, sf_dir):
    """(family, members): source files that are versions of one another: digits and dates struck from the name."""
    stem = F.regexp_extract(F.lower("path"), r"([^/]*)\.[^./]*$|([^/]*)$", 1)
    stem = F.when(stem == "", F.regexp_extract(F.lower("path"), r"([^/]*)$", 1)).otherwise(stem)
    fam = F.regexp_replace(F.regexp_replace(stem, "[0-9]+", ""), "[ _.-]+$", "")
    return table(spark, sf_dir, "sources").groupBy(fam.alias("family")).agg(F.count("*").alias("members"))


_P = "p AS (SELECT * FROM files WHERE removed_at IS NULL)"
_RANK = "CASE s.kind WHEN 'hak' THEN priority WHEN 'module' THEN 10000 WHEN 'override' THEN 20000 + priority ELSE 30000 END"
QUERIES = {f.__name__: f for f in (dup_exact, dup_same_function, dup_shared_tag, dup_same_name, dup_normalised_text, asset_duplicates, dup_keeper, lookalike_field_diff, near_tags, label_case_twins, duplicate_entries, family_of_sources)}
SQL = {
    "dup_exact": f"WITH {_P}, m AS (SELECT DISTINCT ext, lower(content_hash) AS content, id FROM p WHERE content_hash IS NOT NULL AND ext IS NOT NULL) SELECT *, count(*) OVER (PARTITION BY ext, content) AS n FROM m QUALIFY n > 1",
    "dup_same_function": f"""WITH {_P}, r AS (SELECT DISTINCT file_id, path, coalesce(value, chr(1)) AS value FROM gff_fields WHERE label NOT IN {_COSMETIC_SQL} AND file_id IN (SELECT id FROM p WHERE ext = 'uti')),
      s AS (SELECT file_id, list((path, value) ORDER BY path, value) AS sig FROM r GROUP BY 1) SELECT file_id AS id, count(*) OVER (PARTITION BY sig) - 1 AS peers FROM s QUALIFY peers > 0""",
    "dup_shared_tag": f"WITH {_P}, m AS (SELECT DISTINCT ext, value AS tag, node FROM gff_fields JOIN p ON p.id = file_id WHERE path = 'Tag' AND value <> '') SELECT *, count(*) OVER (PARTITION BY ext, tag) AS n FROM m QUALIFY n > 1",
    "dup_same_name": f"WITH {_P}, m AS (SELECT DISTINCT lower(trim(value)) AS name, node FROM gff_fields JOIN p ON p.id = file_id WHERE path = 'LocalizedName' AND trim(value) <> '') SELECT *, count(*) OVER (PARTITION BY name) AS n FROM m QUALIFY n > 1",
    "dup_normalised_text": "WITH m AS (SELECT DISTINCT md5(trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g'), ' ')) AS digest, doc_id FROM documents WHERE text IS NOT NULL) SELECT *, count(*) OVER (PARTITION BY digest) AS n FROM m QUALIFY n > 1",
    "asset_duplicates": f"""WITH {_P}, n AS (SELECT ext, lower(sha256) AS sha, resref, max(size) AS size FROM p WHERE ext IN ('tga','mdl') AND sha256 IS NOT NULL GROUP BY 1, 2, 3),
      g AS (SELECT ext, sha, count(*) AS members, CAST(coalesce(max(size), 0) * (count(*) - 1) AS BIGINT) AS extra_bytes FROM n GROUP BY 1, 2 HAVING count(*) > 1)
      SELECT *, row_number() OVER (ORDER BY extra_bytes DESC, ext, sha) AS place FROM g QUALIFY place <= 3000""",
    "dup_keeper": f"""WITH {_P}, r AS (SELECT lower(trim(value)) AS resref, count(*) AS refs FROM gff_fields WHERE type = 'resref' AND value <> '' GROUP BY 1),
      f AS (SELECT DISTINCT p.id, p.ext, p.resref, lower(content_hash) AS content, {_RANK} AS rank FROM p JOIN sources s ON s.id = source_id WHERE content_hash IS NOT NULL),
      j AS (SELECT f.*, coalesce(refs, 0) AS refs FROM f LEFT JOIN r USING (resref))
      SELECT ext, content, first(id ORDER BY refs DESC, rank, id) AS keeper, count(*) AS members, CAST(sum(refs) AS BIGINT) AS referenced FROM j GROUP BY ext, content HAVING count(*) > 1""",
    "lookalike_field_diff": f"""WITH {_P}, f AS (SELECT DISTINCT p.id, resref, ext, {_RANK} AS rank FROM p JOIN sources s ON s.id = source_id),
      k AS (SELECT *, first_value(id) OVER (PARTITION BY resref, ext ORDER BY rank, id) AS keeper FROM f), c AS (SELECT DISTINCT file_id, path, label, value FROM gff_fields),
      x AS (SELECT keeper, k.id AS member, path, label, value FROM k JOIN c ON c.file_id = keeper WHERE k.id <> keeper), y AS (SELECT keeper, k.id AS member, path, label, value FROM k JOIN c ON c.file_id = k.id WHERE k.id <> keeper),
      d AS (SELECT coalesce(x.keeper, y.keeper) AS keeper, coalesce(x.member, y.member) AS member, coalesce(x.path, y.path) AS path, coalesce(x.label, y.label) AS label
            FROM x FULL JOIN y ON x.keeper = y.keeper AND x.member = y.member AND x.path = y.path WHERE x.keeper IS NULL OR y.keeper IS NULL OR x.value IS DISTINCT FROM y.value)
      SELECT DISTINCT keeper, member, path, CASE WHEN label IN {_COSMETIC_SQL} THEN 'look' ELSE 'function' END AS kind FROM d""",
    "near_tags": r"""WITH n AS (SELECT DISTINCT lower(label) AS name FROM gff_fields UNION SELECT regexp_extract(lower(name), '^([^.]*)', 1) FROM base_resources)
      SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON x.name < y.name AND length(x.name) >= 6 AND length(y.name) >= 6 AND abs(length(x.name) - length(y.name)) <= 1 AND levenshtein(x.name, y.name) = 1""",
    "label_case_twins": "SELECT lower(label) AS folded, string_agg(DISTINCT label, ' | ' ORDER BY label) AS spellings, count(DISTINCT label) AS n FROM gff_fields GROUP BY 1 HAVING count(DISTINCT label) > 1",
    "duplicate_entries": "SELECT source_id, lower(relpath) AS rel, count(*) AS n FROM files GROUP BY 1, 2 HAVING count(*) > 1",
    "family_of_sources": r"""WITH s AS (SELECT regexp_replace(regexp_extract(lower(path), '([^/]*)$', 1), '\.[^./]*$', '') AS stem FROM sources)
      SELECT regexp_replace(regexp_replace(stem, '[0-9]+', '', 'g'), '[ _.-]+$', '') AS family, count(*) AS members FROM s GROUP BY 1""",
}
