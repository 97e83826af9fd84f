"""Findings: every rule gives rows of one schema, which are unioned, ranked, capped, downgraded and matched to accepted ones."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.operators.text import mask

#: Severities, worst first.
SEVERITIES = ("error", "warning", "info")
COLUMNS = ("severity", "category", "node", "detail")

Rule = Callable[..., DataFrame]
REGISTRY: dict[str, Rule] = {}


def rule(category: str, severity: str) -> Callable[[Rule], Rule]:
    """Registers a function that gives (node, detail) rows as the rule of a category."""
    def register(f: Rule) -> Rule:
        def run(*args, **kwargs) -> DataFrame:
            found = f(*args, **kwargs)
            return found.select(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.col("node").cast("string").alias("node"), F.col("detail").cast("string").alias("detail")).distinct()

        REGISTRY[category] = run
        return run

    return register


def run_all(*args, only: tuple[str, ...] | None = None) -> DataFrame:
    """The findings of all rules (or of ``only``), as one table."""
    return reduce(DataFrame.unionByName, [r(*args) for c, r in sorted(REGISTRY.items()) if only is None or c in only])


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def downgrade_unused(issues: DataFrame, live: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Findings of the given categories about nodes that aren't ``live`` (node) become info, with a note."""
    alive = live.select("node", F.lit(True).alias("alive")).distinct()
    low = F.col("alive").isNull() & F.col("category").isin(*categories)
    out = issues.join(alive, "node", "left")
    return out.select(F.when(low, "info").otherwise(F.col("severity")).alias("severity"), "category", "node", F.when(low, F.concat("detail", F.lit(" (not in use)"))).otherwise(F.col("detail")).alias("detail"))


def cap_per_category(issues: DataFrame, most: int) -> DataFrame:
    """A report's view: at most ``most`` findings of each category, least node first, with ``hidden``, how many more there are.

    Ranking by window keeps only that many rows per category on each map task.
    """
    w = Window.partitionBy("category").orderBy("node", "detail", "severity")
    total = issues.groupBy("category").agg(F.count("*").alias("total"))
    top = issues.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return top.join(F.broadcast(total), "category").withColumn("hidden", F.greatest(F.col("total") - most, F.lit(0))).drop("total")  # one row per rule


def without_accepted(issues: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings that no accepted one (category, node, detail) matches, numbers aside."""
    key = lambda d: d.select("category", "node", mask(F.col("detail")).alias("sig")).distinct()
    return issues.withColumn("sig", mask(F.col("detail"))).join(key(accepted), ["category", "node", "sig"], "left_anti").drop("sig")
