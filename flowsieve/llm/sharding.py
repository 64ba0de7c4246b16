"""Sharding by a k-d tree over metadata.

A node holds a set of documents and the number of shards it will become. It is split along
its widest metadata dimension, at the weighted median of the bytes, until every node is one
shard of about the target bytes; a node of an odd number of shards is split in proportion.
So a shard is a box in metadata space: documents alike in source, language and length stay
together, and shards have nearly equal bytes whatever the skew.

Only (dimensions, bytes) per row is written and read again. The nodes of a level are a table too, joined
on the node, so a tree of thousands of shards is no larger a plan than one of eight. Spreads and medians are grouped
sums: all nodes of a level are split in the same passes, and rows that tie on the dimension,
such as one hot source, are split by a hash. The row at a cut goes to the side that it brings nearer to its share. Slots count rows per bucket of a hash, so no
shard is sorted as a whole.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsieve.llm.cuts import PLACE_BITS, below_cut, weighted_cuts
from flowsieve.operators.skew import lookup_join
from flowsieve.runtime import stage

#: Rows of a slot bucket, about; a bucket is ordered in one task.
BUCKET_ROWS = 20_000
#: Steps into which a dimension's range is cut.
STEPS = 2 ** 16 - 1


def _measure(column: str, kind: str) -> Column:
    """A dimension as a finite number: a text by its hash, null as 0."""
    if kind in ("string", "boolean", "date", "timestamp"):
        value = F.xxhash64(F.col(column).cast("string")).cast("double")
    else:
        value = F.col(column).cast("double")
        value = F.when(~F.isnan(value), F.greatest(F.least(value, F.lit(1e300)), F.lit(-1e300)))
    return F.when(F.col(column).isNotNull(), value).otherwise(0.0)


def kd_shards(rows: DataFrame, dimensions: list[str], shards: int) -> DataFrame:
    """Add ``shard`` to written rows of (size, _place, dimensions as numbers).

    ``_place`` is unique. Rows of size 0 follow their neighbours in the order. Rows that tie on the dimension at a cut are told
    apart by a hash of ``_place``. No rows, no shards.
    """
    root = rows.agg(*[F.min(d).alias(f"lo_{d}") for d in dimensions], *[F.max(d).alias(f"hi_{d}") for d in dimensions]).first()
    low = {d: root[f"lo_{d}"] or 0.0 for d in dimensions}
    width = {d: (root[f"hi_{d}"] or 0.0) - low[d] or 1.0 for d in dimensions}
    steps = F.array(*[F.floor((F.col(d) - low[d]) / width[d] * STEPS).cast("bigint") for d in dimensions])
    # A node is named by its first shard and holds ``n`` of them. Written, so that the node is no constant to a join.
    placed = stage(rows.withColumns({"shard": F.lit(0), "n": F.lit(shards)}), "kd_level")
    most = shards
    while most > 1:
        spread = placed.filter("n > 1").groupBy("shard", "n").agg(
            F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in dimensions])
        widest = F.array_max(F.array(*[F.struct((F.col(d) / width[d]).alias("share"), F.lit(d).alias("name"), F.lit(i).alias("i"))
                                       for i, d in enumerate(dimensions)]))["i"]
        half = F.floor(F.col("n") / 2).cast("int")
        splits = stage(spread.select("shard", widest.alias("_dim"), (F.col("bytes") * half / F.col("n")).alias("quota")), "kd_nodes")
        # 16 bits of the dimension, then 32 bits of a hash that splits ties.
        along = F.shiftleft(F.get(steps, F.col("_dim")), 32) + F.pmod(F.xxhash64("_place"), F.lit(2 ** 32))
        keyed = lookup_join(placed, splits.select("shard", "_dim"), ["shard"]).withColumn("_key", along).drop("_dim")
        cuts = weighted_cuts(keyed.filter("n > 1"), splits, "shard", {"_key": 48, "_place": PLACE_BITS}, "size", nearer=True)
        high = F.col("left").isNotNull() & ~below_cut(["_key", "_place"])
        placed = stage(lookup_join(keyed, cuts, ["shard"]).select(
            *rows.columns, F.when(high, F.col("shard") + half).otherwise(F.col("shard")).alias("shard"),
            F.when(high, F.col("n") - half).when(F.col("n") > 1, half).otherwise(F.col("n")).alias("n")), "kd_level")
        most -= most // 2
    return placed.drop("n")


def with_slots(rows: DataFrame) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... in every shard, in the order of a hash of ``_place``."""
    buckets = max(1, ceil(rows.count() / BUCKET_ROWS))
    dealt = rows.withColumn("_hash", F.xxhash64("_place")).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    sizes = dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select("shard", "_bucket", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_hash", "_place"))
    return (
        dealt.withColumn("_in_bucket", place).join(stage(before, "slots"), ["shard", "_bucket"])
        .withColumn("slot", (F.col("_before") + F.col("_in_bucket") - 1).cast("bigint"))
        .drop("_hash", "_bucket", "_before", "_in_bucket")
    )


def sharded(docs: DataFrame, columns: list[str], dimensions: list[str], shards: int | None = None,
            target_bytes: int | None = None) -> DataFrame:
    """Each row of ``docs`` as (row, size, shard, slot); ``row`` holds ``columns``.

    Size is the UTF-8 bytes of ``text`` plus 1, null as empty. Give the number of shards, or the bytes a shard
    should hold. Null in a dimension is its lowest value; repeated rows are dealt out like others.
    An empty table gives an empty one.
    """
    kinds = dict(docs.dtypes)
    size = (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("bigint")
    names = [f"_d{i}" for i in range(len(dimensions))]
    rows = stage(docs.select(
        F.struct(*columns).alias("row"), size.alias("size"), F.monotonically_increasing_id().alias("_place"),
        *[_measure(d, kinds[d]).alias(n) for d, n in zip(dimensions, names)]), "shard_rows")
    if shards is None:
        shards = max(1, ceil((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    slim = rows.select("size", "_place", *names)
    found = with_slots(kd_shards(slim, names, shards)).select("_place", "shard", "slot")
    return rows.join(found, "_place").select("row", "size", "shard", "slot")
