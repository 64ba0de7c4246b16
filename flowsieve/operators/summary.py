"""Quantiles from summaries that add up, so that a scaler follows new data without reading old logs.

A summary counts values per bucket of fixed borders, fine near zero and relative in the tails, with
the least and greatest value of each. Buckets do not depend on the data, so summaries of batches merge by sums and
extremes, in any order and grouping, to the summary of all rows. A quantile is off by no more than the width of
the values in its bucket, and that bound comes with it. A summary has at most a few hundred thousand rows per
column, however many rows it stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from flowsieve.operators.ranking import _magnitude_bucket
from flowsieve.runtime import stage

SUMMARY = "column string, bucket bigint, n bigint, low double, high double"


def summarize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, bucket, n, low, high) of the numbers in ``columns``; missing values are left out."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*")
    kept = long.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return kept.groupBy("column", _magnitude_bucket(F.col("v")).alias("bucket")).agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def merged(summaries: DataFrame) -> DataFrame:
    """The summary of all rows from summaries of parts."""
    return summaries.groupBy("column", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def summary_quantiles(summary: DataFrame, probabilities: list[float]) -> DataFrame:
    """(column, probability, value, error): quantiles with linear interpolation, each off by at most ``error``.

    The first and last value of a bucket are known, those between are taken as evenly spaced.
    """
    upto = F.sum("n").over(Window.partitionBy("column").orderBy("bucket"))
    total = F.sum("n").over(Window.partitionBy("column"))
    placed = summary.withColumns({"upto": upto, "total": total})
    wanted = placed.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability")).withColumn(
        "h", (F.col("total") - 1) * F.col("probability"))
    ranks = wanted.select("*", F.explode(F.array_distinct(F.array(F.floor("h"), F.ceil("h")))).alias("rank")).withColumn(
        "at", F.col("rank") - F.col("upto") + F.col("n")).filter((F.col("at") >= 0) & (F.col("at") < F.col("n")))
    width = F.col("high") - F.col("low")
    value = F.col("low") + F.when(F.col("n") > 1, width * F.col("at") / (F.col("n") - 1)).otherwise(0.0)
    error = F.when((F.col("at") == 0) | (F.col("at") == F.col("n") - 1), 0.0).otherwise(width)
    valued = ranks.select("column", "probability", "h", "rank", value.alias("v"), error.alias("e"))
    low = F.max(F.when(F.col("rank") == F.floor("h"), F.col("v")))
    high = F.max(F.when(F.col("rank") == F.ceil("h"), F.col("v")))
    return valued.groupBy("column", "probability", "h").agg(low.alias("lo"), high.alias("hi"), F.max("e").alias("error")).select(
        "column", "probability", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("h") - F.floor("h"))).alias("value"), "error")


def summary_scaler(summary: DataFrame) -> DataFrame:
    """(column, center, scale, error) as ``fit_scaler`` has them, each off by at most twice ``error``."""
    q = summary_quantiles(summary, [0.25, 0.5, 0.75])
    at = {p: F.max(F.when(F.col("probability") == p, F.col("value"))) for p in (0.25, 0.5, 0.75)}
    iqr = F.col("q75") - F.col("q25")
    return q.groupBy("column").agg(
        at[0.25].alias("q25"), at[0.5].alias("center"), at[0.75].alias("q75"), F.max("error").alias("error"),
    ).select("column", "center", F.when(iqr == 0, 1.0).otherwise(iqr).alias("scale"), "error")


def refresh_scaler(df: DataFrame, columns: list[str], folder: str, batch: str) -> DataFrame:
    """The scaler of all batches so far, after the summary of ``df`` was kept in ``folder`` under the name ``batch``.

    A batch that is repeated under its name replaces its summary, so nothing counts twice. Earlier batches' rows are not
    read again.
    """
    spark = df.sparkSession
    summarize(df, columns).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch}")
    return summary_scaler(stage(merged(spark.read.schema(SUMMARY + ", batch string").parquet(folder)), "summary"))
