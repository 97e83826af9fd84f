"""Sinks: spreadsheets, snapshots, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_cell(value: Column) -> Column:
    """A value that no spreadsheet runs as a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header: lists joined by '; ', maps as JSON, other values guarded against formulas; as many files as partitions."""
    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.concat_ws("; ", c.cast("array<string>"))
        elif isinstance(f.dataType, T.MapType | T.StructType):
            c = F.to_json(c)
        elif not isinstance(f.dataType, T.StringType):
            return c.cast("string").alias(f.name)
        return safe_cell(c).alias(f.name)

    df.select(*[cell(f) for f in df.schema.fields]).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_snapshot(manifest: DataFrame, root: str, snapshot: str) -> None:
    """One partition of a snapshot table; writing the same snapshot again replaces it and no other."""
    manifest.withColumn("snapshot", F.lit(snapshot)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(root)


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """(snapshot, files, bytes)"""
    return spark.read.parquet(root).groupBy(F.col("snapshot").cast("string").alias("snapshot")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with rows of ``changes`` in place of those of the same key, new keys added; to be written as a new version."""
    return table.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes)


def insert_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``table`` and those ``rows`` whose key it lacks, one per key."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key).distinct(), key, "left_anti"))


def report(sections: dict[str, DataFrame], cap: int = 3000) -> dict[str, dict]:
    """A JSON-ready report: of each section up to ``cap`` rows and the number of all. The cap is the feature; rows leave as JSON."""
    out = {}
    for name, df in sections.items():
        rows = [r[0] for r in df.select(F.to_json(F.struct("*"))).limit(cap).collect()]
        total = df.count()
        out[name] = {"rows": rows, "total": total, "truncated": total > len(rows)}
    return out
