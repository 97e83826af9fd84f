"""References to records that do not exist, by bitmaps per key range and period.

Referred keys are dictionary-encoded as integers. Per range of 65,536 keys and per period, the keys referred to and the
keys whose parent was there before make two compressed bitmaps; reference AND-NOT parent leaves the few keys to decode. Only
references to surviving keys are then looked at one by one. Everything before that works on one row per key, combined
before the shuffle, so a key that a third of all references name weighs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.operators import bitmaps
from loomdex.plans.session import cut

#: Period codes: months since year 0; a reference without time, and a parent that was always there.
NO_TIME, ALWAYS = -1, -2
#: Copies of the surviving keys, and parts of each key's references, where the two meet.
SALTS = 16


def month_code(at):
    return F.coalesce(F.year(at) * 12 + F.month(at) - 1, F.lit(NO_TIME))


def encode_keys(keys: DataFrame) -> DataFrame:
    """``keys`` with ``id``, an integer, dense within each partition; written once, so that it never changes. No order is needed,
    and none is made: sorting by range would read the references twice, once to sample them."""
    return cut(keys.withColumn("id", F.monotonically_increasing_id()))


def surviving_keys(keys: DataFrame) -> DataFrame:
    """(id, period) of every key and period whose references aren't all certain to find a parent.

    ``keys``: id, periods (array of the period codes it is referred to in), since (period code from whose next period on
    its parent is certain, ALWAYS, or NULL: never).
    """
    out = pa.schema([("id", pa.int64()), ("period", pa.int32())])

    def and_not(key: tuple, table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        base = int(ids[0]) & ~(bitmaps.SPAN - 1)
        at = (ids - base).astype(np.int64)
        since = table["since"].to_numpy(zero_copy_only=False).astype(np.float64)  # NaN: never
        lists = table["periods"].combine_chunks()
        owner = np.repeat(at, lists.value_lengths().to_numpy(zero_copy_only=False))
        periods = lists.flatten().to_numpy(zero_copy_only=False)
        # parents by the period they come in; running over the periods they add up
        known, waiting = bitmaps.container(at[since == ALWAYS]), sorted({x for x in since if not np.isnan(x) and x != ALWAYS})
        anytime = bitmaps.container(at[~np.isnan(since)])
        found = []
        for period in np.unique(periods):
            while waiting and waiting[0] < period:
                known = bitmaps.union(known, bitmaps.container(at[since == waiting.pop(0)]))
            parents = anytime if period == NO_TIME else known
            rest = bitmaps.decode(bitmaps.and_not(bitmaps.container(owner[periods == period]), parents))
            found.append((rest.astype(np.int64) + base, np.full(len(rest), period, np.int32)))
        return pa.table([pa.array(np.concatenate([f[k] for f in found]) if found else [], t.type) for k, t in enumerate(out)], schema=out)

    ranged = keys.select("id", "periods", F.col("since").cast("int"), F.shiftright("id", bitmaps.RANGE_BITS).alias("range"))
    return ranged.groupBy("range").applyInArrow(and_not, "id bigint, period int")


def orphan_references(refs: DataFrame, parents: DataFrame, key: list[str], time: str) -> DataFrame:
    """All columns of ``refs`` that have no sound parent, with ``state`` and ``period`` (YYYY-MM of ``time``, NULL without).

    ``parents``: key columns, ``removed`` (boolean), ``since`` (timestamp; NULL: always there). State is missing without any
    parent, deleted if all are removed, late if the earliest of the others came after the reference. A reference without
    time is never late. NULL keys refer to nothing. Repeated references stay repeated.
    """
    live = ~F.coalesce(F.col("removed"), F.lit(False))
    known = parents.groupBy(*key).agg(
        F.max(live).alias("alive"),
        F.max(live & F.col("since").isNull()).alias("always"),
        F.min(F.when(live, F.col("since"))).alias("first"),
    )
    refs = refs.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key)).withColumn("__month", month_code(F.col(time)))
    used = refs.groupBy(*key, "__month").agg(F.lit(1).alias("one")).groupBy(*key).agg(F.collect_list("__month").alias("periods"))
    since = F.when(F.col("always"), F.lit(ALWAYS)).when(F.col("alive"), month_code(F.col("first")))
    keys = encode_keys(used.join(known, key, "left").withColumn("since", since))
    rest = surviving_keys(keys).join(keys.select("id", *key, "alive", "always", "first"), "id").drop("id")
    # a few keys may hold most of the references: those are spread, the keys copied
    rest = rest.withColumnRenamed("period", "__month").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = refs.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in refs.columns if c != "__month"]), F.lit(SALTS)).cast("int"))
    state = F.when(F.col("alive").isNull(), "missing").when(~F.col("alive"), "deleted").when(~F.col("always") & (F.col("first") > F.col(time)), "late")
    joined = salted.join(rest, [*key, "__month", "__salt"]).withColumn("state", state).where("state IS NOT NULL")
    return joined.withColumn("period", F.date_format(time, "yyyy-MM")).drop("alive", "always", "first", "__month", "__salt")
