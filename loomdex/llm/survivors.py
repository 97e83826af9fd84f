"""One surviving record per group of copies, chosen column by column from ranked copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.operators.components import components
from loomdex.plans.session import table


def linked_groups(records: DataFrame, id_col: str, within: str, first: str, second: str) -> DataFrame:
    """(id, group_id) of records of the same ``within`` linked, also through others, by equal ``first`` or equal ``second``.

    NULL hashes and a NULL ``within`` link nothing. Records that share ``first`` are contracted to their least id before
    anything else, so that the iterated graph only holds the links that ``second`` adds between such classes; copies are
    never paired. ``id_col`` must be unique.
    """
    r = records.select(F.col(id_col).alias("id"), F.col(within).alias("w"), F.col(first).alias("a"), F.col(second).alias("b")).where("w IS NOT NULL")
    classes = r.where("a IS NOT NULL").groupBy("w", "a").agg(F.min("id").alias("class"))
    r = r.join(classes, ["w", "a"], "left").select("id", "w", "b", F.coalesce("class", "id").alias("class"))
    hubs = r.where("b IS NOT NULL").groupBy("w", "b").agg(F.min("class").alias("hub"), F.max("class").alias("far")).where("hub <> far").drop("far")
    links = r.where("b IS NOT NULL").select("w", "b", "class").distinct().join(hubs, ["w", "b"]).where("class <> hub")
    roots = components(links, "class", "hub").withColumnRenamed("node", "class")
    return r.join(roots, "class", "left").select("id", F.coalesce("root", "class").alias("group_id"))


def rank_survivors(copies: DataFrame, group: str, id_col: str, order: Sequence[Column], columns: dict[str, Column | None]) -> DataFrame:
    """One row per group of two or more: ``group`` and for each name in ``columns`` the id of the best copy that has it.

    A column's value is the copies' ``order`` by window, restricted to the copies where the given column isn't NULL (None:
    all copies); NULL where no copy has it. ``order`` must end in a unique column. Keeping only the first row lets Spark limit
    each map task to one row per group and column before the shuffle, so a hot group costs no more than others.
    """
    wanted = F.array(*[F.when(F.lit(True) if c is None else c.isNotNull(), F.lit(n)) for n, c in columns.items()])
    cells = copies.withColumn("__column", F.explode(F.array_compact(wanted)))
    best = cells.withColumn("__rank", F.row_number().over(Window.partitionBy(group, "__column").orderBy(*order))).where("__rank = 1")
    many = copies.groupBy(group).agg(F.count("*").alias("n")).where("n > 1").select(group)
    row = best.join(many, group, "left_semi").groupBy(group).agg(*[F.max(F.when(F.col("__column") == n, F.col(id_col))).alias(n) for n in columns])
    return row


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files").where("removed_at IS NULL")
    files = files.select("id", "source_id", "ext", F.lower("content_hash").alias("content"), F.lower("sha256").alias("sha"), "mtime", "size", "kind").distinct()
    groups = linked_groups(files, "id", "ext", "content", "sha")
    sources = table(spark, sf_dir, "sources")  # fixed, 20 rows
    rank = F.when(F.col("kind") == "hak", F.col("priority")).when(F.col("kind") == "module", 10000).otherwise(20000 + F.col("priority"))
    ranked = F.broadcast(sources.select(F.col("id").alias("source_id"), rank.alias("precedence")))
    return files.join(ranked, "source_id", "left").join(groups, "id")


def _order() -> list[Column]:
    return [F.asc_nulls_last("precedence"), F.desc_nulls_last("mtime"), F.asc("id")]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, keep_id, size_id, kind_id) of every group of copies."""
    return rank_survivors(_copies(spark, sf_dir), "group_id", "id", _order(), {"keep_id": None, "size_id": F.col("size"), "kind_id": F.col("kind")})


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving records: (group_id, id, resref, ext, size, kind, n_columns_from_others)."""
    best = p6_found(spark, sf_dir)
    files = table(spark, sf_dir, "files").select("id", "resref", "ext", "size", "kind").distinct()
    sizes = files.select(F.col("id").alias("size_id"), F.col("size").alias("best_size"))
    kinds = files.select(F.col("id").alias("kind_id"), F.col("kind").alias("best_kind"))
    out = best.join(files.withColumnRenamed("id", "keep_id").drop("size", "kind"), "keep_id").join(sizes, "size_id", "left").join(kinds, "kind_id", "left")
    others = (F.col("size_id") != F.col("keep_id")).cast("int"), (F.col("kind_id") != F.col("keep_id")).cast("int")
    return out.select(
        "group_id", F.col("keep_id").alias("id"), "resref", "ext", F.col("best_size").alias("size"), F.col("best_kind").alias("kind"),
        (F.coalesce(others[0], F.lit(0)) + F.coalesce(others[1], F.lit(0))).alias("n_columns_from_others"),
    )
