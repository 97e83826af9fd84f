"""Connected components by alternating large-star and small-star rounds.

Each round points every node at the least node of its neighbourhood; stars form in a number of rounds that is logarithmic in
the length of the longest chain. No neighbourhood is ever collected: least neighbours are aggregated (combined before the
shuffle) and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.plans.session import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for each node on an edge the least node of its component, itself included.

    NULL ends and self edges join nothing. An empty input gives an empty table.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or tuple(seen) == before:
            break
        before = tuple(seen)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = cut(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
