"""Differences between two copies of a dataset, cell by cell.

Both sides become key-field-value rows. The union of the two carries, per row, the bit of its side; one grouping by the
whole cell (key, field, value) leaves out every cell that both sides hold, so that only what does not cancel is moved
again and judged. The first grouping keeps fixed-width buffers only (hash aggregation, combined before the shuffle) and its
key holds the whole cell, so no key is hot, however many rows one record has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEFT, RIGHT, BOTH = 1, 2, 3


def unpivot(df: DataFrame, key: Sequence[str], fields: dict[str, Column], carry: Sequence[str] = ()) -> DataFrame:
    """key + carry columns, ``field`` and ``value`` (text): one row for each field of each row."""
    cells = F.array(*[F.struct(F.lit(name).alias("field"), c.cast("string").alias("value")) for name, c in fields.items()])
    return df.select(*key, *carry, F.inline(cells))


def uncancelled(left: DataFrame, right: DataFrame, cell: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """The cells (columns ``cell``) that only one side holds, with ``side`` (1 left, 2 right).

    ``ids`` are long columns kept as the least of each side, as ``<id>_l`` and ``<id>_r``. Repeats of a row count once;
    NULL equals NULL; empty sides are allowed. Extra columns are dropped by the selection, so names cannot clash.
    """
    both = left.select(*cell, *ids, F.lit(LEFT).alias("__side")).unionByName(right.select(*cell, *ids, F.lit(RIGHT).alias("__side")))
    kept = [F.bit_or("__side").alias("side")]
    for x in ids:
        kept += [F.min(F.when(F.col("__side") == LEFT, F.col(x))).alias(f"{x}_l"), F.min(F.when(F.col("__side") == RIGHT, F.col(x))).alias(f"{x}_r")]
    return both.groupBy(*cell).agg(*kept).where(F.col("side") != BOTH)


def matched_keys(left: DataFrame, right: DataFrame, key: Sequence[str], id_col: str) -> DataFrame:
    """(left_id, right_id) for every key that both sides hold; of several ids under one key the lowest stands for it."""
    both = left.select(*key, F.col(id_col).alias("l"), F.lit(None).cast("bigint").alias("r")).unionByName(
        right.select(*key, F.lit(None).cast("bigint").alias("l"), F.col(id_col).alias("r"))
    )
    pairs = both.groupBy(*key).agg(F.min("l").alias("left_id"), F.min("r").alias("right_id"))
    return pairs.where(F.col("left_id").isNotNull() & F.col("right_id").isNotNull()).select("left_id", "right_id")
