"""Duplicate and look-alike groups. Members are never paired: groups are keyed by a signature and listed once per member."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_key(members: DataFrame, key: Sequence[str], member: str) -> DataFrame:
    """key, member, n: members of every key that two or more distinct ones share. NULL keys group nothing.

    Sizes are aggregated (combined before the shuffle) and joined back; AQE splits a hot key's side of that join.
    """
    m = members.select(*key, member).where(" AND ".join(f"`{k}` IS NOT NULL" for k in key)).distinct()
    sizes = m.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return m.join(sizes, list(key)).select(*key, member, "n")


def signature(rows: DataFrame, entity: str, parts: Sequence[str]) -> DataFrame:
    """(entity, signature): order-free digest of an entity's distinct rows, by sums of row hashes of fixed width, so that no
    entity's rows are ever gathered; entities without rows have none."""
    h = rows.select(entity, *parts).distinct()
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(p), F.lit("\x00")) for p in parts])
    h = h.select(entity, F.xxhash64(text, F.lit(1)).cast("decimal(38,0)").alias("a"), F.xxhash64(text, F.lit(2)).cast("decimal(38,0)").alias("b"))
    return h.groupBy(entity).agg(F.concat_ws(":", F.sum("a").cast("string"), F.sum("b").cast("string"), F.count("*").cast("string")).alias("signature"))


def collapse(text: Column) -> Column:
    """Text compared without regard to case and white space."""
    return F.trim(F.regexp_replace(F.lower(text), "[ \t\n\r]+", " "))


def near_names(names: DataFrame, name: str, least: int = 6) -> DataFrame:
    """(a, b): pairs of distinct names, a < b, at edit distance 1 in lower case, of at least ``least`` characters.

    Every name is filed under itself with each one character left out, and under itself whole; two names at distance 1 share
    a file. So the pairs come from an equi-join on near-unique keys, not from comparing all names.
    """
    n = names.select(F.lower(name).alias("name")).where(F.length("name") >= least).distinct()
    cut_out = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.concat(F.substring(F.col("name"), F.lit(1), i - 1), F.substr(F.col("name"), i + 1)))
    filed = n.select("name", F.explode(F.array_distinct(F.concat(F.array("name"), cut_out))).alias("key"))
    other = filed.withColumnRenamed("name", "b")
    pairs = filed.withColumnRenamed("name", "a").join(other, "key").where("a < b").select("a", "b").distinct()
    return pairs.where(F.levenshtein("a", "b", 1) == 1)


def case_twins(names: DataFrame, name: str) -> DataFrame:
    """(folded, spellings, n): names that differ in letter case only."""
    g = names.where(F.col(name).isNotNull()).groupBy(F.lower(name).alias("folded")).agg(F.array_sort(F.collect_set(name)).alias("s"))
    return g.where(F.size("s") > 1).select("folded", F.concat_ws(" | ", "s").alias("spellings"), F.size("s").cast("bigint").alias("n"))


def subsets(groups: DataFrame, of: DataFrame) -> DataFrame:
    """(group, within): groups of (group, member) all of whose members are in one group of ``of`` (group, member).

    Members met are counted per pair of groups that share one, and compared with the group's size; pairs that share nothing never
    meet. A NULL group or member is none; an empty group is no subset.
    """
    g = groups.select("group", "member").dropna().distinct()
    size = g.groupBy("group").agg(F.count("*").alias("size"))
    shared = g.join(of.select(F.col("group").alias("within"), "member").dropna().distinct(), "member").groupBy("group", "within").agg(F.count("*").alias("met"))
    return shared.join(size, "group").where("met = size").select("group", "within")
