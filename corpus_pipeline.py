"""The corpus pipeline: language, near copies, benchmark passages, mixture, shards.

Every stage takes what the one before it kept, as a written table, and returns documents;
the last one returns the shard and slot of every document of the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsieve.llm import langid, near
from flowsieve.llm.decontaminate import decontaminate
from flowsieve.llm.mixing import mix
from flowsieve.llm.sharding import sharded
from flowsieve.runtime import stage

#: A document is rejected if it has no letters, or its main language holds less than this share of them.
LEAST_SHARE = 0.5
SHARDS = 8


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language, by a model learned from two thirds of them."""
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))).withColumn("key", F.col("doc_id").cast("string")))
    found = docs.withColumn("__found", langid.language(model, F.col("text")))
    clear = (F.col("__found.lang") != langid.UNKNOWN) & (F.col("__found.score") >= LEAST_SHARE)
    return found.filter(clear).drop("__found")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near.dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mix(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    columns = ["doc_id", "source", "lang", "n_chars"]
    found = sharded(docs, columns, ["source", "lang", "n_chars", "doc_id"], shards=SHARDS)
    return found.select("row.*", "size", "shard", "slot")


STAGES = [
    ("language", keep_languages),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("mixture", mix_sources),
    ("shards", deal_shards),
]

#: Learned models, signatures and hashes have no SQL twin; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, keep in STAGES[:-1]:
        docs = stage(keep(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
