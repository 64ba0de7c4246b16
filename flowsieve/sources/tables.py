"""Result tables on disk: ``{out}/{table}/dataset={dataset}``."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsieve.operators.boosting import BoostedTrees, Tree
from flowsieve.schema import dotted

MODEL_SCHEMA = "tree int, shared string, features array<int>, bins array<int>, leaf_values array<double>, gains array<double>"


def table_path(out: str, dataset: str, table: str) -> str:
    return f"{out.rstrip('/')}/{table}/dataset={dataset}"


def write_table(df: DataFrame, out: str, dataset: str, table: str, fmt: str = "parquet",
                partition_by: list[str] | None = None) -> str:
    """Write one result table. CSV gets the public dotted names and a header."""
    path = table_path(out, dataset, table)
    writer = (dotted(df) if fmt == "csv" else df).write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def read_table(spark: SparkSession, out: str, dataset: str, table: str, fmt: str = "parquet",
               schema=None) -> DataFrame:
    """Read a result table back. A missing table is the reader's own error."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(table_path(out, dataset, table))


def write_split(split: DataFrame, out: str, dataset: str) -> str:
    """Train and test rows as partitions of one table."""
    return write_table(split, out, dataset, "split", partition_by=["split"])


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    """Original lines, unchanged."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_metrics(spark: SparkSession, metrics: dict, out: str, dataset: str) -> str:
    """The metrics object as one JSON line."""
    path = table_path(out, dataset, "metrics")
    spark.createDataFrame([(json.dumps(metrics),)], "value string").coalesce(1).write.mode(
        "overwrite").text(path)
    return path


def read_metrics(spark: SparkSession, out: str, dataset: str) -> dict:
    return json.loads(spark.read.text(table_path(out, dataset, "metrics")).first()["value"])


def save_model(model: BoostedTrees | PipelineModel, out: str, dataset: str, spark: SparkSession | None = None) -> str:
    """A boosted model as a table with one row per tree and one for what they share; a pipeline in its own format."""
    path = table_path(out, dataset, "model")
    if isinstance(model, BoostedTrees):
        spark = spark or SparkSession.active()
        shared = json.dumps({"features": model.features, "labels": model.labels, "borders": model.borders,
                             "losses": model.losses, "rounds_trained": model.rounds_trained})
        rows = [(-1, shared, [], [], [], [])] + [
            (i, None, t.features, t.bins, t.values.ravel().tolist(), t.gains) for i, t in enumerate(model.trees)]
        spark.createDataFrame(rows, MODEL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
    else:
        model.write().overwrite().save(path)
    return path


def load_model(out: str, dataset: str, spark: SparkSession | None = None) -> BoostedTrees | PipelineModel:
    """The saved model. One row per tree reaches the driver, as many as training was allowed."""
    path = table_path(out, dataset, "model")
    spark = spark or SparkSession.active()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return PipelineModel.load(path)
    shared, *trees = spark.read.schema(MODEL_SCHEMA).parquet(path).orderBy("tree").collect()
    known = json.loads(shared["shared"])
    classes = len(known["labels"])
    return BoostedTrees(known["features"], known["labels"], known["borders"], [
        Tree(t["features"], t["bins"], np.reshape(t["leaf_values"], (-1, classes)), t["gains"]) for t in trees],
        known["losses"], known["rounds_trained"])
