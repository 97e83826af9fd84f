"""Problem 5: script, conversation and blueprint names that lead to no file, per holding file type and month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.numbers import is_blank
from loomdex.operators.orphans import orphan_references
from loomdex.plans.session import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the kinds of reference are a fixed list of 37 rows, so they are broadcast
    kinds = table(spark, sf_dir, "ref_kinds").groupBy("file_ext", "list_label", "label").agg(F.concat_ws("|", F.array_sort(F.collect_set("target_ext"))).alias("exts"))
    files = table(spark, sf_dir, "files")
    places = F.broadcast(kinds.select(F.col("list_label").alias("k_list"), F.col("label").alias("k_label")).distinct())
    inner = F.regexp_extract("path", r"([^/\[\]]*)\[[0-9]+\][^\[\]]*$", 1)
    named = table(spark, sf_dir, "gff_fields").where(~is_blank(F.col("value"))).select("file_id", "path", "label", inner.alias("inner"), F.lower(F.trim("value")).alias("resref"))
    named = named.join(places, (F.col("inner") == F.col("k_list")) & (F.col("label") == F.col("k_label")), "left_semi")
    holders = files.where("removed_at IS NULL").select(F.col("id").alias("file_id"), "ext", "indexed_at").distinct()
    held = named.join(holders, "file_id")
    k = F.broadcast(kinds)
    refs = held.join(k, (held["ext"] == k["file_ext"]) & (held["inner"] == k["list_label"]) & (held["label"] == k["label"])).select("file_id", "path", "ext", "indexed_at", "resref", "exts")
    targets = F.broadcast(kinds.select("exts", F.explode(F.split("exts", r"\|")).alias("target_ext")).distinct())
    there = files.select("resref", "ext", F.col("removed_at").isNotNull().alias("removed"), F.col("indexed_at").alias("since"))
    # base resources (fixed, 560) are parents that were always there
    base = table(spark, sf_dir, "base_resources").select(
        F.regexp_extract(F.lower("name"), r"^(.*)\.([^.]*)$", 1).alias("resref"), F.regexp_extract(F.lower("name"), r"^(.*)\.([^.]*)$", 2).alias("ext"),
        F.lit(False).alias("removed"), F.lit(None).cast(there.schema["since"].dataType).alias("since"),
    )
    parents = there.unionByName(base).join(targets, F.col("ext") == F.col("target_ext")).select("exts", "resref", "removed", "since")
    return orphan_references(refs, parents, ["exts", "resref"], "indexed_at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, state, period) of every reference that leads nowhere."""
    return _orphans(spark, sf_dir).select("file_id", "path", "state", "period").distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ext, period, state, n): orphan references per holding file type and month."""
    rows = _orphans(spark, sf_dir).select("file_id", "path", "ext", "state", "period").distinct()
    return rows.groupBy("ext", "period", "state").agg(F.count("*").alias("n"))
