"""Ground truth on flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowsieve.functions.text import norm_port, trimmed
from flowsieve.operators.skew import lookup_join

_KEYS = ["_src", "_dst", "_port"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "_src": trimmed(F.col("src_ip")),
        "_dst": trimmed(F.col("dest_ip")),
        "_port": norm_port(F.col("dest_port")),
    })


def tag_attacks(rows: DataFrame, tuples: DataFrame, flag: str = "Actual_Is_Attack") -> DataFrame:
    """1 when the row's (src_ip, dest_ip, dest_port) is an attack tuple, else 0."""
    hits = tuples.toDF(*_KEYS).withColumn("_hit", F.lit(1))
    return lookup_join(_keyed(rows), hits, _KEYS).withColumn(
        flag, F.coalesce("_hit", F.lit(0))).drop(*_KEYS, "_hit")


def attack_rows(rows: DataFrame, tuples: DataFrame) -> DataFrame:
    """Only the rows on an attack tuple."""
    return lookup_join(_keyed(rows), tuples.toDF(*_KEYS), _KEYS, "left_semi").drop(*_KEYS)


def other_rows(rows: DataFrame, tuples: DataFrame) -> DataFrame:
    """Only the rows on no attack tuple."""
    return lookup_join(_keyed(rows), tuples.toDF(*_KEYS), _KEYS, "left_anti").drop(*_KEYS)
