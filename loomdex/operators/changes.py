"""Bulk changes from an uploaded sheet: every row is classified, none is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a sheet may say yes and no with.
YES, NO = ("yes", "y", "true", "1", "x"), ("no", "n", "false", "0")


def plan_values(state: DataFrame, wanted: DataFrame, key: list[str], value: str) -> DataFrame:
    """``wanted`` (key, value) with ``old`` and ``verdict``: set, same, unknown (no such key), empty or twice (asked for with
    several values)."""
    w = wanted.select(*key, F.trim(value).alias("new")).distinct()
    many = w.groupBy(*key).agg(F.count("*").alias("asked"))
    s = state.select(*key, F.col(value).alias("old")).dropDuplicates(key).withColumn("there", F.lit(True))
    j = w.join(many, key).join(s, key, "left")
    verdict = F.when(F.col("asked") > 1, "twice").when(F.col("there").isNull(), "unknown").when(F.coalesce("new", F.lit("")) == "", "empty").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("set")
    return j.select(*key, "old", "new", verdict.alias("verdict"))


def plan_deletions(candidates: DataFrame, sheet: DataFrame) -> DataFrame:
    """``sheet`` (node, delete) with ``verdict``: delete, keep, refused (not safe), unknown or unclear. ``candidates``: (node, status)."""
    word = F.lower(F.trim(F.coalesce("delete", F.lit(""))))
    s = sheet.select("node", word.alias("word")).distinct().join(candidates.select("node", "status"), "node", "left")
    verdict = F.when(F.col("word").isin(*NO, ""), "keep").when(~F.col("word").isin(*YES), "unclear").when(F.col("status").isNull(), "unknown").when(F.col("status").startswith("Safe"), "delete").otherwise("refused")
    return s.select("node", "status", verdict.alias("verdict"))


def apply_values(state: DataFrame, plan: DataFrame, key: list[str], value: str) -> DataFrame:
    """``state`` with the planned values that are to be set; to be written as a new version."""
    p = plan.where("verdict = 'set'").select(*key, F.col("new").alias("__new"), F.lit(True).alias("__set"))
    return state.join(p, key, "left").withColumn(value, F.when(F.col("__set"), F.col("__new")).otherwise(F.col(value))).drop("__new", "__set")
