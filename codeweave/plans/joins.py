"""Joins that no frequent key can pile up in one task.

A key is frequent if over ``limit`` rows of the larger side have it, and the limit grows with that side so that there are never more
than FREQUENT_KEYS of them: what is broadcast has a bound whatever the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.session import materialize

#: Rows of one key that a task takes at least before the key is dealt over several, and frequent keys that are broadcast at most.
ROWS_A_TASK, FREQUENT_KEYS = 500, 500_000


def frequent(large: DataFrame, keys: list[str], rows: int = ROWS_A_TASK) -> DataFrame | None:
    """(*keys, _deals): the frequent keys of a stored table, and over how many tasks each is to be dealt; None if there are none."""
    if large.limit(rows + 1).count() <= rows:
        return None
    counts = large.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > rows)
    counts = materialize(counts, "frequent")
    if not counts.limit(1).count():
        return None
    limit = max(rows, -(-large.count() // FREQUENT_KEYS))
    return counts.where(F.col("_rows") > limit).select(*keys, F.ceil(F.col("_rows") / limit).cast("int").alias("_deals"))


def dealt_join(large: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", rows: int = ROWS_A_TASK) -> DataFrame:
    """``large.join(small, keys, how)`` for how of inner, left, left_semi and left_anti; rows come out the same, in another order.

    Frequent keys are dealt by a hash of the whole row; their rows of small go to each of the tasks that a key is dealt to. Null keys
    match nothing. ``large`` is read several times, so it should be a stored table; it must have no column of a map type.
    """
    hot = frequent(large, keys, rows)
    if hot is None:
        return large.join(small, keys, how)
    few = F.broadcast(hot)
    others = large.join(F.broadcast(hot.drop("_deals")), keys, "left_anti").join(small, keys, how)
    left = large.join(few, keys).withColumn("_deal", F.pmod(F.xxhash64(*large.columns), F.col("_deals")).cast("int")).drop("_deals")
    right = small.join(few, keys).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1))).drop("_deals")
    dealt = left.join(right, [*keys, "_deal"], how).drop("_deal")
    return others.unionByName(dealt)


def looked_up(large: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """``large.join(small, keys, "left")`` for a small with one row a key at most.

    hot: ``frequent(large, keys)``, or keys frequent in a table with the same keys. Their rows of small are broadcast; rows of large
    with such a key, or a null one, are spread by a hash of the row instead of meeting at the key.
    """
    if hot is None:
        return large.join(small, keys, "left")
    values = [c for c in small.columns if c not in keys]
    told = hot.select(*keys).join(small, keys).select(*keys, F.struct(*values).alias("_hot"))
    near = large.join(F.broadcast(told), keys, "left")
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    near = near.withColumn("_deal", F.when(F.col("_hot").isNotNull() | null, F.xxhash64(*large.columns)).otherwise(F.lit(0).cast("long")))
    rest = small.select(*keys, F.struct(*values).alias("_cold"), F.lit(0).cast("long").alias("_deal"))
    both = near.join(rest, [*keys, "_deal"], "left")
    found = F.coalesce("_hot", "_cold")
    return both.select(*large.columns, *(found[c].alias(c) for c in values))


def counted(df: DataFrame, keys: list[str], name: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """df with the number of its rows that share the keys as ``name``; df is evaluated twice."""
    counts = materialize(df.groupBy(*keys).agg(F.count("*").alias(name)), "counts")
    limit = max(rows, -(-(counts.agg(F.sum(name)).first()[0] or 0) // FREQUENT_KEYS))
    hot = counts.where(F.col(name) > limit)
    return looked_up(df, counts, keys, hot if hot.limit(1).count() else None)
