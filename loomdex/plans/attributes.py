"""Problem 3: top-level attributes of files as a wide table, with the cells that don't fit their type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.operators.wide import attributes, widen
from loomdex.plans.session import table

#: The files that hold attributes: items, creatures, placeables, stores.
HOLDERS = ("uti", "utc", "utp", "utm")
RESERVED = ("file_id", "misfits", "rest")


def top_level(fields: DataFrame) -> DataFrame:
    return fields.where(F.col("path") == F.col("label")).select("file_id", "label", "type", "value")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, label) of every top-level cell, of any file, that doesn't fit its numeric type: the misfits of the wide table."""
    eav = top_level(table(spark, sf_dir, "gff_fields"))
    wide = widen(eav, attributes(eav, reserved=RESERVED))
    return wide.select("file_id", F.explode("misfits").alias("label"))


def p3_wide_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, attribute, kind, whole, real, text): the cells of the wide table that hold something, in long form; the value is in
    the column of its kind, the others are 0 or empty."""
    wide = p3_wide(spark, sf_dir)
    kinds = dict(wide.dtypes)
    attributes_ = [c for c in wide.columns if c not in RESERVED]

    def cell(c: str):
        held = lambda kind: F.col(f"`{c}`") if kinds[c] == kind else F.lit(None).cast(kind)
        return F.struct(F.lit(c.lower()).alias("attribute"), F.lit(kinds[c]).alias("kind"), held("bigint").alias("whole"), held("double").alias("real"), held("string").alias("text"))

    cells = wide.select("file_id", F.explode(F.array(*map(cell, attributes_))).alias("c")) if attributes_ else wide.select("file_id", F.lit(None).cast("struct<attribute:string,kind:string,whole:bigint,real:double,text:string>").alias("c"))
    cells = cells.select("file_id", "c.*").where("whole IS NOT NULL OR real IS NOT NULL OR text IS NOT NULL")
    return cells.na.fill(0, ["whole", "real"]).na.fill("", ["text"])


def p3_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item, creature, placeable and store file."""
    holders = table(spark, sf_dir, "files").where(F.col("ext").isin(*HOLDERS)).select(F.col("id").alias("file_id"))
    eav = top_level(table(spark, sf_dir, "gff_fields")).join(holders, "file_id", "left_semi")
    return widen(eav, attributes(eav, reserved=RESERVED))
