"""Row numbers, order statistics and 'first n' without a single sorting task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsieve.runtime import stage


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the 0-based position of each row in the given (unique) order.

    Range-partitioned sort, then one offset per partition. The offsets table has one row
    per shuffle partition.
    """
    placed = stage(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id()),
        "numbered",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
        .select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_row") + F.col("_shift"))
        .drop("_part", "_row", "_shift")
    )


#: Bits of a bucket number that are settled at a time, so that no window sees more than 65,536 rows of a group.
DIGIT = 16


def _run_out(counts: DataFrame, quota: DataFrame) -> DataFrame:
    """Written (_of, _edge, _quota, _full): the bucket in which each group's quota runs out, and the rows before it.

    ``counts`` is written (_group, _bucket, _n), buckets not negative. Digits of the bucket number are settled from the top:
    sums per digit below the ones known, until the quota falls into one. ``_edge`` is null where the quota does not run out.
    """
    highest = int(counts.agg(F.max("_bucket")).first()[0] or 0)
    state = stage(counts.select("_group").distinct().join(
        F.broadcast(quota), F.col("_group").eqNullSafe(F.col("_of"))).select(
            "_of", F.col("quota").alias("_quota"), F.lit(0).cast("bigint").alias("_full"), F.lit(0).cast("bigint").alias("_edge")), "edges")
    for shift in range(DIGIT * ((max(1, highest.bit_length()) - 1) // DIGIT), -1, -DIGIT):
        digit = F.shiftright("_bucket", shift)
        inside = counts.join(F.broadcast(state.filter("_edge is not null")), F.col("_group").eqNullSafe(F.col("_of"))).filter(
            F.shiftright(digit, DIGIT) == F.col("_edge"))
        sums = inside.groupBy("_of", digit.alias("_digit")).agg(
            F.sum("_n").alias("_n"), F.first("_quota").alias("_quota"), F.first("_full").alias("_full"))
        upto = F.col("_full") + F.sum("_n").over(Window.partitionBy("_of").orderBy("_digit"))
        found = sums.withColumn("_upto", upto).groupBy("_of").agg(
            F.min(F.when(F.col("_upto") > F.col("_quota"), F.col("_digit"))).alias("_at"),
            F.max(F.when(F.col("_upto") <= F.col("_quota"), F.col("_upto"))).alias("_now"))
        found = found.withColumnRenamed("_of", "_found")
        # One row per group.
        state = stage(state.join(F.broadcast(found), F.col("_of").eqNullSafe(F.col("_found")), "left").select(
            "_of", "_quota", F.coalesce("_now", "_full").alias("_full"), F.col("_at").alias("_edge")), "edges")
    return state


def take_by_quota(df: DataFrame, quota: DataFrame, group: str, bucket: Column,
                  order: list[str], flag: str) -> DataFrame:
    """Mark, per group, the first ``quota`` rows in order: ``flag`` is true for them.

    ``bucket`` must never decrease along the (unique) order, nor be negative. Counting rows per (group,
    bucket) finds the one bucket per group in which the quota runs out (see ``_run_out``); only the keys of that
    bucket are sorted, to find the last row inside. The rows themselves are then compared
    with one cut per group: they are neither shuffled nor sorted, and no task holds a group.
    ``quota`` has the columns (group, quota), one row for each of few groups.
    """
    place = F.struct(*[F.col(c) for c in order])
    keys = df.select(F.col(group).alias("_group"), bucket.cast("bigint").alias("_bucket"), place.alias("_place"))
    quota = quota.select(F.col(group).alias("_of"), "quota")
    edges = _run_out(stage(keys.groupBy("_group", "_bucket").agg(F.count("*").alias("_n")), "counts"), quota)
    rank = F.row_number().over(Window.partitionBy("_of", "_bucket").orderBy("_place"))
    cuts = (
        keys.join(F.broadcast(edges), F.col("_group").eqNullSafe(F.col("_of")))
        .filter(F.col("_bucket") == F.col("_edge"))
        .withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_quota") - F.col("_full"))
        .groupBy("_of").agg(F.max("_place").alias("_last"))
        .withColumnRenamed("_of", "_cut_of")
    )
    cuts = edges.select("_of", "_edge").join(
        cuts, F.col("_of").eqNullSafe(F.col("_cut_of")), "left").drop("_cut_of")
    cuts = stage(cuts, "cuts")
    inside = (
        F.col("_edge").isNull() | (F.col("_bucket") < F.col("_edge"))
        | ((F.col("_bucket") == F.col("_edge")) & F.coalesce(place <= F.col("_last"), F.lit(False)))
    )
    return (
        df.withColumn("_bucket", bucket.cast("bigint"))
        .join(F.broadcast(cuts), F.col(group).eqNullSafe(F.col("_of")))
        .withColumn(flag, inside).select(*df.columns, flag)
    )


def _magnitude_bucket(v: Column) -> Column:
    """Integer bucket that grows with the value, fine near zero and relative in the tails."""
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * 4096)).cast("bigint")


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: (column, probability, value).

    Two passes. The first counts rows per value bucket, which fits any size because the
    buckets are few. The second looks only at the buckets that hold a wanted rank, again as
    counts per distinct value. Nulls are left out.
    """
    long = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("v"))
            for i, c in enumerate(columns)
        ])).alias("s")
    ).select("s.*").filter(F.col("v").isNotNull()).withColumn("bucket", _magnitude_bucket(F.col("v")))

    by_bucket = Window.partitionBy("column").orderBy("bucket")
    buckets = (
        long.groupBy("column", "bucket").agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(by_bucket))
        .withColumn("total", F.sum("n").over(Window.partitionBy("column")))
    )
    # Wanted 0-based ranks: the two neighbours of (n - 1) * p.
    wanted = buckets.select(
        "*",
        F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability"),
    ).withColumn("h", (F.col("total") - 1) * F.col("probability")).select(
        "*", F.explode(F.array_distinct(F.array(F.floor("h"), F.ceil("h")))).alias("rank")
    ).filter(F.col("rank").between(F.col("upto") - F.col("n"), F.col("upto") - 1)).select(
        "column", "bucket", "probability", "h", "rank", (F.col("upto") - F.col("n")).alias("before"))
    wanted = stage(wanted, "ranks")  # at most 2 rows per column and probability

    near = F.broadcast(wanted.select("column", "bucket").distinct())
    by_value = Window.partitionBy("column", "bucket").orderBy("v")
    values = (
        long.join(near, ["column", "bucket"], "left_semi")
        .groupBy("column", "bucket", "v").agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(by_value))
    )
    hit = (F.col("rank") >= F.col("before") + F.col("upto") - F.col("n")) & (
        F.col("rank") < F.col("before") + F.col("upto"))
    found = values.join(F.broadcast(wanted), ["column", "bucket"]).filter(hit)
    low = F.max(F.when(F.col("rank") == F.floor("h"), F.col("v")))
    high = F.max(F.when(F.col("rank") == F.ceil("h"), F.col("v")))
    return found.groupBy("column", "probability", "h").agg(low.alias("lo"), high.alias("hi")).select(
        F.get(F.array(*[F.lit(c) for c in columns]), F.col("column")).alias("column"), "probability",
        (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("h") - F.floor("h"))).alias("value"),
    )
