"""Join a large, possibly skewed table to a table with one row per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from flowsieve.runtime import stage

MAX_BROADCAST_ROWS = 200_000
HOT_SHARE = 0.001


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left",
                max_broadcast_rows: int = MAX_BROADCAST_ROWS,
                hot_share: float = HOT_SHARE) -> DataFrame:
    """``rows`` joined (left, inner, left_semi, left_anti) to ``lookup``, unique on ``keys``.

    The lookup is written first, so its row count is known. Up to ``max_broadcast_rows`` it
    is broadcast. Beyond that only the hot keys are: a key is hot with more than
    ``hot_share`` of all rows, so there are at most ``1 / hot_share`` of them. The other rows
    take a shuffled join in which no key holds more than that share, and rows with a null
    key, which match nothing, skip the shuffle.
    """
    lookup = stage(lookup, "lookup")
    if lookup.count() <= max_broadcast_rows:
        return rows.join(F.broadcast(lookup), keys, how)

    null_key = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    matchable = rows.filter(~null_key)
    counts = matchable.groupBy(*keys).agg(F.count("*").alias("_n"))
    limit = matchable.count() * hot_share
    hot = F.broadcast(stage(counts.filter(F.col("_n") > limit).select(*keys), "hot_keys"))

    by_broadcast = matchable.join(hot, keys, "left_semi").join(
        F.broadcast(lookup.join(hot, keys, "left_semi")), keys, how)
    by_shuffle = matchable.join(hot, keys, "left_anti").join(lookup, keys, how)
    out = by_broadcast.unionByName(by_shuffle)
    if how in ("left", "left_anti"):
        out = out.unionByName(rows.filter(null_key), allowMissingColumns=True)
    return out
