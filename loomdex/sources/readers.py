"""Readers: files in, tables out. One damaged file gives a row with its error, never a failed job.

Files are read by Spark's binaryFile source, so executors share them out, only matching ones are opened, and contents are not
read at all where a query asks for names and sizes only.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomdex.sources import formats

MAX_ENTRY = 256 << 20


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, ext, bytes, mtime): names and sizes; contents aren't read."""
    f = files(spark, path, glob)
    name = F.lower(F.substring_index("path", "/", -1))
    return f.select("path", F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1).alias("name"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("ext"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))


def content_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha1)"""
    return files(spark, path, glob).select("path", F.col("length").alias("bytes"), F.sha1("content").alias("sha1"))


def _parsed(frame: DataFrame, parse: Callable[[str, bytes], Iterable[tuple]], fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """(path, the fields, error): rows that ``parse`` makes of each file, or one row with the error."""
    schema = pa.schema([("path", pa.string()), *((n, t) for n, t, _ in fields), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(path, *r, None) for r in parse(path, content)]
                except Exception as e:  # noqa: BLE001 - any damage is a row
                    rows = [(path, *[None] * len(fields), f"{type(e).__name__}: {e}")]
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], f.type) for i, f in enumerate(schema)], schema=schema)

    ddl = ", ".join(["path string", *(f"`{n}` {d}" for n, _, d in fields), "error string"])
    return frame.select("path", "content").mapInArrow(run, ddl)


_S, _L = (pa.string(), "string"), (pa.int64(), "bigint")


def read_trees(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, field, label, type, value, error): leaves of tree files (GFF)."""
    return parse_trees(files(spark, path, glob))


def parse_trees(frame: DataFrame) -> DataFrame:
    """The same of files at hand (path, content), as the other parse_ functions."""
    return _parsed(frame, lambda p, b: formats.tree_leaves(b), [("field", *_S), ("label", *_S), ("type", *_S), ("value", *_S)])


def read_tree_strings(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, field, strref, entries, error): localised strings of tree files."""
    kinds = [("field", *_S), ("strref", *_L), ("entries", pa.map_(pa.int32(), pa.string()), "map<int,string>")]
    return _parsed(files(spark, path, glob), lambda p, b: [(f, s, list(e.items())) for f, s, e in formats.tree_strings(b)], kinds)


def read_archives(spark: SparkSession, path: str, glob: str = "*", contents: bool = False) -> DataFrame:
    """(path, resref, ext, bytes, compressed[, body], error): entries of archives; bodies are unpacked if asked for."""
    return parse_archives(files(spark, path, glob), contents)


def parse_archives(frame: DataFrame, contents: bool = False) -> DataFrame:
    def rows(p: str, b: bytes):
        for resref, ext, at, size, packed in formats.archive_entries(b):
            if not contents:
                yield resref, ext, size, packed
                continue
            body = b[at : at + size]
            if packed:
                import zstandard

                head = body.find(b"\x28\xb5\x2f\xfd")
                body = zstandard.ZstdDecompressor().decompress(body[head:], max_output_size=MAX_ENTRY) if head >= 0 else body
            yield resref, ext, size, packed, body

    kinds = [("resref", *_S), ("ext", *_S), ("bytes", *_L), ("compressed", pa.bool_(), "boolean")]
    return _parsed(frame, rows, kinds + [("body", pa.binary(), "binary")] * contents)


def read_tables(spark: SparkSession, path: str, glob: str = "*.2da") -> DataFrame:
    """(path, row, label, col, value, error): cells of 2DA tables."""
    return parse_tables(files(spark, path, glob))


def parse_tables(frame: DataFrame) -> DataFrame:
    return _parsed(frame, lambda p, b: formats.table_cells(b.decode(formats.CODEPAGE, "replace")), [("row", *_L), ("label", *_S), ("col", *_S), ("value", *_S)])


def read_string_tables(spark: SparkSession, path: str, glob: str = "*.tlk") -> DataFrame:
    """(path, index, text, error): texts of string tables."""
    return parse_string_tables(files(spark, path, glob))


def parse_string_tables(frame: DataFrame) -> DataFrame:
    return _parsed(frame, lambda p, b: formats.string_table(b), [("index", *_L), ("text", *_S)])


def overlay_strings(refs: DataFrame, base: DataFrame, custom: DataFrame) -> DataFrame:
    """``refs`` (strref, ...) with ``text``: from the custom table if bit 24 is set, else from the base one; NULL if missing."""
    own = (F.col("strref") != formats.NO_STRREF) & (F.col("strref").bitwiseAND(1 << 24) != 0)
    number = F.when(own, F.col("strref") - (1 << 24)).when(F.col("strref") != formats.NO_STRREF, F.col("strref"))
    both = base.select(F.lit(False).alias("c"), F.col("index").alias("i"), "text").unionByName(custom.select(F.lit(True).alias("c"), F.col("index").alias("i"), "text"))
    r = refs.withColumn("__c", own).withColumn("__i", number)
    return r.join(both, (r["__c"] == both["c"]) & (r["__i"] == both["i"]), "left").drop("__c", "__i", "c", "i")


def read_install(spark: SparkSession, path: str, glob: str = "*.key") -> DataFrame:
    return _parsed(files(spark, path, glob), lambda p, b: [(x,) for x in formats.install_names(b)], [("name", *_S)])


def read_dbase(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, value, error): cells of DBF tables; a memo file of the same name is joined to its table."""
    f = files(spark, path, "*.{dbf,DBF,fpt,FPT}").withColumn("stem", F.regexp_replace("path", r"\.[^.]*$", ""))
    dbf = f.where("lower(path) LIKE '%.dbf'").select("path", "content", "stem")
    memo = f.where("lower(path) LIKE '%.fpt'").select("stem", F.col("content").alias("memo"))
    pairs = dbf.join(memo, "stem", "left").select("path", F.struct("content", "memo").alias("content"))

    def cells(p, pair):
        columns, rows = formats.dbase_rows(pair["content"], pair["memo"])
        return [(i, c, v) for i, r in enumerate(rows) for (c, _), v in zip(columns, r, strict=True)]

    return _parsed(pairs, cells, [("row", *_L), ("col", *_S), ("value", *_S)])


def read_dumps(spark: SparkSession, path: str, glob: str = "*.sql") -> DataFrame:
    """(path, tbl, row, fields, error): rows inserted by SQL dumps."""
    return _parsed(files(spark, path, glob), lambda p, b: formats.dump_rows(b.decode("utf-8", "replace")), [("tbl", *_S), ("row", *_L), ("fields", pa.list_(pa.string()), "array<string>")])


def read_sections(spark: SparkSession, path: str, glob: str = "*.{ini,set}") -> DataFrame:
    return _parsed(files(spark, path, glob), lambda p, b: formats.sections(b.decode(formats.CODEPAGE, "replace")), [("section", *_S), ("key", *_S), ("value", *_S)])


def read_settings(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return _parsed(files(spark, path, glob), lambda p, b: formats.settings(b.decode("utf-8", "replace"), p), [("key", *_S), ("value", *_S)])


def read_models(spark: SparkSession, path: str, glob: str = "*.mdl") -> DataFrame:
    """(path, supermodel, textures): what ASCII models name, in built-in expressions."""
    text = F.decode("content", "ISO-8859-1")
    textures = F.regexp_extract_all(text, F.lit(r"(?im)^\s*(?:bitmap|texture[0-9])\s+(\S+)"), F.lit(1))
    f = files(spark, path, glob).select("path", F.lower(F.regexp_extract(text, r"(?im)^\s*setsupermodel\s+\S+\s+(\S+)", 1)).alias("supermodel"), F.array_sort(F.array_distinct(F.transform(textures, F.lower))).alias("textures"))
    return f.select("path", F.when(~F.col("supermodel").isin("", "null"), F.col("supermodel")).alias("supermodel"), F.filter("textures", lambda x: x != "null").alias("textures"))


def read_upload(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A spreadsheet's CSV, all columns as text, formula guards undone; ValueError if a required column is missing."""
    df = spark.read.option("header", "true").option("mode", "PERMISSIVE").option("multiLine", "true").option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df.select(*[F.regexp_replace(F.col(f"`{c}`"), r"^'(?=[=+\-@\t\r])", "").alias(c) for c in df.columns])


class SqliteSource(DataSource):
    """spark.read.format("sqlite").option("path", file).option("table", name): all values as text; the file is opened read-only."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _columns(self) -> list[str]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro&immutable=1", uri=True) as db:
            return [r[1] for r in db.execute(f'PRAGMA table_info("{self.options["table"]}")')]

    def schema(self) -> str:
        names = self._columns()
        if not names:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{c}` string" for c in names)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options["path"], self.options["table"], schema.names, int(self.options.get("parts", 4)))


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, names: list[str], parts: int):
        self.path, self.table, self.names, self.parts = path, table, names, parts

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [InputPartition((0, -1))]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [InputPartition((a, min(a + step - 1, high))) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition):
        low, high = partition.value
        columns = ", ".join(f'CAST("{c}" AS TEXT)' for c in self.names)
        with sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True) as db:
            yield from db.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (low, high))


def register(spark: SparkSession) -> None:
    """Makes the Python data sources known to a session."""
    from loomdex.streaming.tail import TailSource

    spark.dataSource.register(SqliteSource)
    spark.dataSource.register(TailSource)


def read_bytecode(spark: SparkSession, path: str, glob: str = "*.ncs") -> DataFrame:
    """(path, intact, numbers, texts, error): constants of compiled scripts."""
    kinds = [("intact", pa.bool_(), "boolean"), ("numbers", pa.list_(pa.int64()), "array<bigint>"), ("texts", pa.list_(pa.string()), "array<string>")]
    return _parsed(files(spark, path, glob), lambda p, b: [formats.bytecode(b)], kinds)


def stale_bytecode(compiled: DataFrame, literals: DataFrame) -> DataFrame:
    """(script, missing): texts of a source that its compiled form lacks. ``compiled``: script, texts; ``literals``: script, literal."""
    want = literals.where(F.length("literal") > 2).select("script", "literal").distinct()
    have = compiled.select("script", F.explode("texts").alias("literal")).distinct()
    known = compiled.select("script").distinct()
    lack = want.join(known, "script", "left_semi").join(have, ["script", "literal"], "left_anti")
    return lack.groupBy("script").agg(F.count("*").alias("missing"))
