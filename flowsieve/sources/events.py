"""Scan of event logs: JSON lines in, one flat row per valid event out."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowsieve.functions.labels import is_json_object, is_json_value
from flowsieve.functions.text import fallback_flow_id
from flowsieve.operators.skew import lookup_join
from flowsieve.schema import EVENT_COLUMNS, EVENT_SCHEMA, _DNS_RECORDS, col_name


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines with their place: file, start of the block in the file, row id.

    ``monotonically_increasing_id`` follows the lines within one block, so (file, block, row)
    is file order however the blocks were packed into tasks.
    """
    return spark.read.text(path).select(
        F.make_valid_utf8("value").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def count_blocks(lines: DataFrame) -> DataFrame:
    """Lines, usable events and first row id of every input block: one row per block, a millionth of the bytes read."""
    return lines.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.min("row").alias("first_row"),
        F.count_if(is_json_object(F.col("value"))).alias("n_events"))


def block_index(spark: SparkSession, path: str | list[str], folder: str) -> DataFrame:
    """``count_blocks`` of a log from a table kept in ``folder``, counted only if the log is not there as it is now.

    A log is known by its files with length and time of change, and by the settings that decide how files
    are cut and packed, since row ids follow from them. A changed, added or removed file means another count; tables
    of earlier states stay until they are dropped.
    """
    paths = [path] if isinstance(path, str) else list(path)
    files = spark.read.format("binaryFile").load(paths).select("path", "length", F.col("modificationTime").cast("double").alias("time"))
    marks = [F.xxhash64(F.lit(i), "path", "length", "time").cast("decimal(38,0)") for i in range(2)]
    state = files.agg(F.count("*"), *[F.sum(m) for m in marks]).first()
    settings = [str(spark.conf.get(f"spark.sql.files.{k}", None)) for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum", "maxPartitionNum")]
    known = hashlib.sha256("|".join([*map(str, state), str(spark.sparkContext.defaultParallelism), *settings]).encode()).hexdigest()
    place = f"{folder.rstrip('/')}/{known}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        count_blocks(read_lines(spark, paths)).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def with_positions(lines: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Replace the place by ``ord``, the position over all files, and ``line_number``.

    Both count from 1 and count blank lines. ``blocks`` is the count of the lines' blocks, made in a pass of its own
    if not given. Up to a million blocks it is broadcast.
    """
    earlier = (Window.unboundedPreceding, -1)
    blocks = count_blocks(lines) if blocks is None else blocks
    blocks = blocks.select("file", "block", "n", "first_row")
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(*earlier))
    files = blocks.groupBy("file").agg(F.sum("n").alias("n"))
    skipped = F.sum("n").over(Window.orderBy("file").rowsBetween(*earlier))  # one row per file
    blocks = blocks.withColumn("before", F.coalesce(before, F.lit(0))).join(
        files.select("file", F.coalesce(skipped, F.lit(0)).alias("skipped")), "file")
    # The lines are scanned again later; other files or split settings by then are an error.
    inside = (F.col("row") >= F.col("first_row")) & (F.col("row") < F.col("first_row") + F.col("n"))
    known = F.when(inside, F.col("first_row")).otherwise(F.raise_error(F.lit("the input or its splits changed")).cast("bigint"))
    line = F.col("before") + F.col("row") - known + 1
    return (
        lookup_join(lines, blocks, ["file", "block"], max_broadcast_rows=1_000_000)
        .withColumn("line_number", line).withColumn("ord", F.col("skipped") + F.col("line_number"))
        .drop("block", "row", "first_row", "before", "skipped", "n")
    )


def _first_record(list_name: str, key: str) -> Column:
    if list_name == "grouped":  # a list in some logs, an object in others
        records = F.from_json("e.dns.grouped", _DNS_RECORDS)
    else:
        records = F.col(f"e.dns.{list_name}")
    return F.get(records, F.lit(0))[key]


def _dns_value(key: str) -> Column:
    return F.coalesce(
        F.col(f"e.dns.{key}"),
        *[_first_record(name, key) for name in ("queries", "answers", "grouped")],
    )


def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Keep the lines that hold one JSON object and flatten them.

    Other columns (``ord``, ``line_number``) pass through. The id may still be null here.
    """
    keep = [c for c in lines.columns if c != value]
    flat = [
        (_dns_value(c.split(".")[1]) if c.startswith("dns.") else F.col(f"e.{c}")).alias(col_name(c))
        for c in EVENT_COLUMNS
    ]
    return (
        lines.filter(is_json_object(F.col(value)))
        .select(*keep, F.from_json(value, EVENT_SCHEMA).alias("e"))
        .select(*keep, *flat)
    )


def rejected_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Counts of blank, unusable and usable lines."""
    blank = ~F.col(value).rlike(r"\S")
    ok = is_json_object(F.col(value))
    return lines.agg(
        F.count("*").alias("n_lines"),
        F.count_if(blank).alias("n_blank"),
        F.count_if(~blank & ~ok).alias("n_rejected"),
        F.count_if(ok).alias("n_events"),
        F.count_if(~ok & is_json_value(F.col(value))).alias("n_not_object"),
    )


def read_events(spark: SparkSession, path: str | list[str], strict: bool = False, index: str | None = None) -> DataFrame:
    """Events of JSON-lines files, each with an id and its position ``ord``.

    Bad lines are skipped; with ``strict`` one bad line is an error. No events is an error. With a folder
    ``index``, the lines of an unchanged log are counted once and for all (see ``block_index``), and a later run scans
    the log only for its events; without it, a counting pass and a look for a first event come before.
    """
    lines = read_lines(spark, path)
    if strict:
        counts = rejected_lines(lines).first()
        if counts["n_rejected"]:
            raise ValueError(f"{counts['n_rejected']} lines are no JSON objects: {path}")
    blocks = None if index is None else block_index(spark, path, index)
    empty = parse_events(lines).isEmpty() if blocks is None else blocks.filter("n_events > 0").isEmpty()
    if empty:
        raise ValueError(f"no valid JSON events in {path}")
    events = parse_events(with_positions(lines, blocks))
    return events.withColumn(
        "flow_id", F.coalesce("flow_id", fallback_flow_id(F.col("line_number")))
    ).drop("line_number", "file")
