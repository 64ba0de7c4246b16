"""A smaller log: attack events and the first normal ones, lines unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsieve.operators.extract import extract, extract_counts, is_attack
from flowsieve.runtime import stage
from flowsieve.schema import Settings
from flowsieve.sources.events import parse_events, read_lines, with_positions
from flowsieve.sources.tables import write_lines


def extract_log(spark: SparkSession, source: str, target: str, settings: Settings = Settings(),
                src_ip: str | None = None, dest_ip: str | None = None, dest_port: str | None = None,
                in_order: bool = True) -> DataFrame:
    """Write the kept lines to ``target``; returns the counts (saved, attack, normal).

    With ``in_order`` the files and the lines in them follow the input order, by a range
    partition of the kept lines only.
    """
    lines = with_positions(read_lines(spark, source)).withColumn("line", F.col("value"))
    attack = is_attack(settings.alert_contains, src_ip, dest_ip, dest_port)
    kept = extract(parse_events(lines), attack, settings.max_normal_events, settings.normal_event_type)
    kept = stage(kept.select("line", "ord", "is_attack"), "kept")
    lines_out = kept.repartitionByRange("ord").sortWithinPartitions("ord") if in_order else kept
    write_lines(lines_out, target, "line")
    return extract_counts(kept)
