"""Files written from the tables and read again by the readers: what is read must be what was written."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions.numbers import fits
from loomdex.plans.session import table
from loomdex.sources import formats, readers, writers

#: Letters that the files' code page holds for sure.
PLAIN = r"^[ -~]*$"


def ingest_leaves(spark, sf_dir):
    """(file_id, label, type, value, n): leaves of tree files made of the fields, read back; of texts and of whole numbers in plain
    decimals, without list numbers, which a part numbers anew."""
    g = table(spark, sf_dir, "gff_fields").select("file_id", "path", "label", F.lower("type").alias("type"), "value").distinct()
    whole = F.col("type").isin("byte", "char", "word", "short", "dword", "int") & F.col("value").rlike("^(0|-?[1-9][0-9]*)$") & fits(F.col("type"), F.col("value"))
    g = g.where(F.col("value").rlike(PLAIN) & F.col("path").rlike(PLAIN) & (whole | F.col("type").isin("cexostring", "cexolocstring") | ((F.col("type") == "resref") & (F.lower("value") == F.col("value")))))
    read = readers.parse_trees(writers.pack_trees(g))
    read = read.where("error IS NULL").select(F.substring_index("path", "/", 1).cast("bigint").alias("file_id"), "label", "type", "value")
    return read.groupBy("file_id", "label", "type", "value").agg(F.count("*").alias("n"))


def _files(rows: DataFrame, key: str, make) -> DataFrame:
    """(path, content): a file of the rows of each key, which must be few, made by ``make`` of their columns as lists."""
    columns = [c for c in rows.columns if c != key]

    def run(key_: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"path": [str(key_[0].as_py())], "content": pa.array([make(*(t[c].to_pylist() for c in columns))], pa.binary())})

    return rows.groupBy(key).applyInArrow(run, "path string, content binary")


def ingest_archives(spark, sf_dir):
    """(source, resref, ext, bytes): archives of the files' names, one per source and first letter, read back."""
    f = table(spark, sf_dir, "files").where(F.col("ext").isin(*sorted(writers.TYPE_IDS)) & F.col("resref").rlike("^[a-z0-9_]{1,16}$")).select("source_id", "resref", "ext").distinct()
    f = f.withColumn("key", F.concat_ws("/", F.col("source_id").cast("string"), F.substring("resref", 1, 1), F.substring(F.sha1("resref"), 1, 2))).select("key", "resref", "ext")
    made = _files(f, "key", lambda names, kinds: writers.archive_bytes([(n, k, n.encode() * 2) for n, k in sorted(zip(names, kinds, strict=True))]))
    read = readers.parse_archives(made)
    return read.where("error IS NULL").select(F.substring_index("path", "/", 1).alias("source"), "resref", "ext", "bytes")


def ingest_cells(spark, sf_dir):
    """(name, row, label, col, value): cells of 2DA tables, one per region with its nations, read back."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")

    def text(keys: list[int], names: list[str]) -> bytes:
        return writers.table_text(["Key", "Name", "None"], [(str(i), [str(k), name, None]) for i, (k, name) in enumerate(sorted(zip(keys, names, strict=True)))]).encode(formats.CODEPAGE)

    read = readers.parse_tables(_files(n, "n_regionkey", text))
    return read.select(F.col("path").alias("name"), "row", "label", "col", F.coalesce("value", F.lit("****")).alias("value"))


def ingest_strings(spark, sf_dir):
    """(part, index, text): the tables of a part's names and stock texts as string tables, read back."""
    p = table(spark, sf_dir, "part").select((F.floor(F.col("p_partkey") / 500)).alias("part"), (F.col("p_partkey") % 500).alias("index"), "p_name")
    read = readers.parse_string_tables(_files(p, "part", lambda index, names: writers.string_table_bytes(dict(zip(index, names, strict=True)))))
    return read.select(F.col("path").alias("part"), "index", "text")


QUERIES = {f.__name__: f for f in (ingest_leaves, ingest_archives, ingest_cells, ingest_strings)}
SQL = {
    "ingest_leaves": r"""SELECT file_id, label, type, value, count(*) AS n FROM (SELECT DISTINCT file_id, path, label, lower(type) AS type, value FROM gff_fields)
      WHERE regexp_full_match(value, '[ -~]*') AND regexp_full_match(path, '[ -~]*') AND (type IN ('cexostring', 'cexolocstring') OR (type = 'resref' AND lower(value) = value)
        OR (type IN ('byte','char','word','short','dword','int') AND regexp_full_match(value, '0|-?[1-9][0-9]*') AND length(value) < 18 AND TRY_CAST(value AS HUGEINT) BETWEEN
          CASE type WHEN 'char' THEN -128 WHEN 'short' THEN -32768 WHEN 'int' THEN -2147483648 ELSE 0 END AND
          CASE type WHEN 'byte' THEN 255 WHEN 'char' THEN 127 WHEN 'word' THEN 65535 WHEN 'short' THEN 32767 WHEN 'int' THEN 2147483647 ELSE 4294967295 END)) GROUP BY ALL""",
    "ingest_archives": f"""SELECT DISTINCT CAST(source_id AS VARCHAR) AS source, resref, ext, CAST(2 * length(resref) AS BIGINT) AS bytes FROM files
      WHERE ext IN ({", ".join(f"'{x}'" for x in sorted(writers.TYPE_IDS))}) AND regexp_full_match(resref, '[a-z0-9_]{{1,16}}')""",
    "ingest_cells": """WITH n AS (SELECT CAST(n_regionkey AS VARCHAR) AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, n_name) - 1 AS row, n_nationkey AS k, n_name FROM nation)
      SELECT name, row, CAST(row AS VARCHAR) AS label, 'Key' AS col, CAST(k AS VARCHAR) AS value FROM n UNION ALL SELECT name, row, CAST(row AS VARCHAR), 'Name', n_name FROM n
      UNION ALL SELECT name, row, CAST(row AS VARCHAR), 'None', '****' FROM n""",
    "ingest_strings": "SELECT CAST(p_partkey // 500 AS VARCHAR) AS part, p_partkey % 500 AS index, p_name AS text FROM part",
}
