"""Tables kept as cells (name, row, label, col, value): checks, comparison of copies, wide views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_drift(cells: DataFrame) -> DataFrame:
    """(name, row, label): rows whose label isn't their number."""
    return cells.select("name", "row", "label").distinct().where(F.col("label").try_cast("bigint").isNull() | (F.col("label").try_cast("bigint") != F.col("row")))


def conflicts(cells: DataFrame, rank: str = "rank") -> DataFrame:
    """(name, source, winner, missing_rows, changed, added_rows, kind) of every copy of a table that another source's copy hides.

    ``cells`` also has source and ``rank`` (lower wins). kind: duplicate (nothing differs), stale (the winner lacks rows of the
    loser) or customised.
    """
    copies = cells.select("name", "source", rank).distinct()
    first = copies.groupBy("name").agg(F.min_by("source", F.struct(rank, "source")).alias("winner"))
    losers = copies.join(first, "name").where("source <> winner").select("name", "source", "winner")
    c = cells.select("name", "source", "row", F.lower("col").alias("col"), "value").distinct()
    a = losers.join(c.withColumnRenamed("source", "s").withColumnRenamed("value", "v"), ["name"]).where("s = winner").select("name", "source", "row", "col", F.col("v").alias("w"), F.lit(1).alias("in_w"))
    b = losers.select("name", "source").join(c, ["name", "source"]).select("name", "source", "row", "col", F.col("value").alias("l"), F.lit(1).alias("in_l"))
    j = a.join(b, ["name", "source", "row", "col"], "full_outer")
    g = j.groupBy("name", "source").agg(
        F.countDistinct(F.when(F.col("in_w").isNull(), F.col("row"))).alias("missing_rows"),
        F.count_if(F.col("in_w").isNotNull() & F.col("in_l").isNotNull() & ~F.col("w").eqNullSafe(F.col("l"))).alias("changed"),
        F.countDistinct(F.when(F.col("in_l").isNull(), F.col("row"))).alias("added_rows"),
    )
    kind = F.when((F.col("missing_rows") == 0) & (F.col("changed") == 0) & (F.col("added_rows") == 0), "duplicate").when(F.col("missing_rows") > 0, "stale").otherwise("customised")
    return losers.join(g, ["name", "source"]).withColumn("kind", kind)


def wide(cells: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One row per row of a table, with the given columns; matched without regard to letter case."""
    c = cells.where(F.col("name") == name)
    return c.groupBy("row", "label").agg(*[F.max(F.when(F.lower("col") == x.lower(), F.col("value"))).alias(x) for x in columns])


def dangling(cells: DataFrame, col: str, targets: DataFrame, target: str) -> DataFrame:
    """(name, row, value): values of a column that name nothing in ``targets``; NULLs name nothing and are fine."""
    v = cells.where((F.lower("col") == col.lower()) & F.col("value").isNotNull()).select("name", "row", "value")
    return v.join(targets.select(F.lower(F.col(target).cast("string")).alias("t")).distinct(), F.lower("value") == F.col("t"), "left_anti")


def renumbered(cells: DataFrame) -> DataFrame:
    """The cells with every label set to its row's number."""
    return cells.withColumn("label", F.col("row").cast("string"))
