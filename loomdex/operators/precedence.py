"""Which copy of a resource wins: the one from the source that comes first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Precedence of the kinds of source; lower wins.
MODULE_RANK, OVERRIDE_RANK, BASE_RANK = 10_000, 20_000, 30_000


def source_rank(kind: Column, priority: Column) -> Column:
    return F.when(kind == "hak", priority).when(kind == "module", MODULE_RANK).when(kind == "override", OVERRIDE_RANK + priority).otherwise(BASE_RANK)


def winners(copies: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; ``order`` must be total. Each map task keeps one row per key before the shuffle."""
    return copies.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rank = 1").drop("__rank")


def shadowed(copies: DataFrame, key: Sequence[str], order: Sequence[Column], id_col: str) -> DataFrame:
    """The other rows of each key, with ``winner`` (the first row's id) and ``place`` (2, 3, ...).

    Winners come from a partial-limit window and are joined back; only keys of several rows are ranked in full.
    """
    first = winners(copies, key, order).select(*[F.col(k).alias(f"__{k}") for k in key], F.col(id_col).alias("winner"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    on = same[0]
    for c in same[1:]:
        on = on & c
    rest = copies.join(first, on).drop(*[f"__{k}" for k in key]).where(F.col(id_col) != F.col("winner"))
    return rest.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) + 1)


def conflicts(copies: DataFrame, key: Sequence[str], source: str, content: str) -> DataFrame:
    """key, n_sources, n_contents, sources (joined in order): keys that several sources carry with different contents."""
    g = copies.groupBy(*key).agg(F.collect_set(source).alias("s"), F.countDistinct(content).alias("n_contents"))
    g = g.withColumn("n_sources", F.size("s").cast("bigint")).where("n_sources > 1 AND n_contents > 1")
    return g.withColumn("sources", F.concat_ws(" | ", F.array_sort("s"))).drop("s")
