"""Attack events plus the first N normal events of a log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from flowsieve.functions.text import contains_ci, norm_port, trimmed
from flowsieve.operators.ranking import take_by_quota


def is_attack(alert_contains: str | None = "Heartbleed", src_ip: str | None = None,
              dest_ip: str | None = None, dest_port: str | None = None) -> Column:
    """Signature or category holds the needle, or all given address checks hold."""
    found = F.lit(False)
    if alert_contains:
        found = contains_ci(F.col("alert_signature"), alert_contains) | contains_ci(
            F.col("alert_category"), alert_contains)
    checks = []
    if src_ip:
        checks.append(trimmed(F.col("src_ip")) == src_ip.strip())
    if dest_ip:
        checks.append(trimmed(F.col("dest_ip")) == dest_ip.strip())
    if dest_port:
        wanted = norm_port(F.lit(str(dest_port)), empty_as_null=True)
        checks.append(norm_port(F.col("dest_port"), empty_as_null=True).eqNullSafe(wanted))
    if checks:
        found = found | F.coalesce(reduce(Column.__and__, checks), F.lit(False))
    return found


def extract(events: DataFrame, attack: Column, max_normal: int = 15000, normal_type: str = "flow",
            order: str = "ord") -> DataFrame:
    """All attack events and the first ``max_normal`` normal ones, with ``is_attack``.

    Normal events have type ``normal_type`` (``any`` takes every type). ``order`` is the
    unique position of the event. Which normal events come first is settled by counts per
    stretch of 65536 positions; only the stretch in which the limit falls is sorted.
    """
    normal = F.lit(True) if normal_type == "any" else F.coalesce(
        F.col("event_type") == normal_type, F.lit(False))
    rows = events.withColumn("is_attack", attack)
    rows = rows.withColumn(
        "_class", F.when(F.col("is_attack"), 0).when(normal, 1)).filter("_class is not null")
    quota = events.sparkSession.createDataFrame(
        [(0, 2 ** 62), (1, max_normal)], "_class int, quota bigint")
    stretch = F.floor(F.col(order) / 65536)
    return take_by_quota(rows, quota, "_class", stretch, [order], "_kept").filter("_kept").drop(
        "_kept", "_class")


def extract_counts(extracted: DataFrame) -> DataFrame:
    """Saved, attack and normal events."""
    return extracted.agg(
        F.count("*").alias("saved"),
        F.count_if("is_attack").alias("attack"),
        F.count_if(~F.col("is_attack")).alias("normal"),
    )
