"""Alert volume: frequency, enrichment, rate limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from flowsieve.operators.skew import lookup_join


def alert_frequency(alerts: DataFrame, ts: str = "ts", width: str = "5 minutes",
                    keys: tuple[str, ...] = ("alert_signature", "src_ip")) -> DataFrame:
    """Alerts per time window, signature and source."""
    return alerts.groupBy(F.window(ts, width).alias("_w"), *keys).agg(
        F.count("*").alias("n_alerts")
    ).select(F.col("_w.start").alias("window_start"), *keys, "n_alerts")


def rate_limit(alerts: DataFrame, keep: int, ts: str = "ts", tie: str = "ord",
               width: str = "5 minutes",
               keys: tuple[str, ...] = ("alert_signature", "src_ip")) -> DataFrame:
    """The first ``keep`` alerts per window, signature and source, with the number held back.

    The rank filter lets Spark cut each task's groups to ``keep`` rows before the shuffle,
    and the totals are a partial aggregate, so one noisy source costs no single task.
    """
    alerts = alerts.withColumn("window_start", F.window(ts, width)["start"])
    group = ["window_start", *keys]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(ts, tie))
    kept = alerts.withColumn("rank", rank).filter(F.col("rank") <= keep)
    totals = alerts.groupBy(*group).agg(
        F.greatest(F.count("*") - keep, F.lit(0)).alias("suppressed"))
    match = [kept[k].eqNullSafe(totals[k]) for k in group]
    return kept.join(totals, match).select(*[kept[c] for c in kept.columns], "suppressed")


def enrich(flows: DataFrame, assets: DataFrame, key: str = "src_ip") -> DataFrame:
    """Asset columns (network, device, ...) by address; unknown addresses stay."""
    return lookup_join(flows, assets, [key])
