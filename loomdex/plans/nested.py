"""Problem 4: areas and conversations as flat tables of structs and fields with parent-child links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomdex.operators.shred import field_table, rejected, shred, struct_table
from loomdex.plans.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, parent_path) of every struct below the root of every whole body; repeated bodies count once."""
    levels = shred(table(spark, sf_dir, "gff_raw"), "file_id", "body")
    return struct_table(levels).withColumnRenamed("record", "file_id").distinct()


def p4_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, parent_path, label, type, value) of every leaf of every whole body."""
    levels = shred(table(spark, sf_dir, "gff_raw"), "file_id", "body")
    return field_table(levels).withColumnRenamed("record", "file_id").distinct()


def p4_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, why): bodies that aren't whole JSON."""
    return rejected(table(spark, sf_dir, "gff_raw"), "file_id", "body").withColumnRenamed("record", "file_id").distinct()
