"""Mixing, sharding, the pipeline, and all registered queries."""

import random
import re
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from flowsieve.llm import registry
from flowsieve.llm.cuts import below_cut, weighted_cuts
from flowsieve.llm.mixing import mix, mixed, source_targets
from flowsieve.llm.sharding import sharded
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


def reshared(sizes, weights=(5, 2, 1), share=1.5):
    """Targets by dealing the excess out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left = share * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / total for s in names}
        more = {s for s in names if target[s] > 2 * sizes[s]} - full
        if not more:
            return target
        full |= more


def test_targets_equal_resharing(spark):
    rng = random.Random(6)
    for n in (1, 2, 3, 7, 20):
        sizes = {f"s{i}": rng.choice([0, 3, 50, 1000, 7]) for i in range(n)} | {None: 5}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r["source"]: r["target"] for r in source_targets(df).collect()}
        assert got == pytest.approx(reshared(sizes))


def test_cuts_equal_sorting(spark):
    rng = random.Random(7)
    rows = [(g, rng.randrange(2 ** 20) if g else 5, i, rng.randrange(9)) for g in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, k bigint, place bigint, w bigint")
    quotas = spark.createDataFrame([(0, 300.0), (1, 77.5), (2, 1e9)], "g int, quota double")
    cuts = weighted_cuts(df, quotas, "g", {"k": 20, "place": 64}, "w")
    inside = df.join(cuts, "g").filter(below_cut(["k", "place"])).groupBy("g").agg(F.sum("w").alias("w"), F.first("left").alias("left"))
    got = {r["g"]: (r["w"], r["left"]) for r in inside.collect()}
    for g, quota in ((0, 300.0), (1, 77.5)):
        total = 0
        for x in sorted(r[1:] for r in rows if r[0] == g):
            if total + x[2] > quota:
                break
            total += x[2]
        assert got[g] == (total, quota - total)
    assert 2 not in got


def test_mixed_edges(edge_docs, no_docs):
    rows = mixed(edge_docs, ["doc_id", "size"]).collect()
    assert len(rows) == 10 and all(0 <= r["copies"] <= 2 for r in rows)
    assert mix(edge_docs).columns == edge_docs.columns and mix(no_docs).count() == 0


def test_mix_meets_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 40), f"s{i % 5 % 3}") for i in range(900)], "doc_id int, text string, source string")
    rows = mixed(docs, ["doc_id"])
    per = rows.join(docs.select("doc_id", "source"), rows["row.doc_id"] == docs["doc_id"]).groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 40 for r in per) and len(per) == 3
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, mixed(docs.repartition(7), ["doc_id"]).collect()))


def test_mix_goes_on_behind_a_long_document(spark):
    ids = sorted(range(300), key=lambda i: md5(str(i).encode()).hexdigest())
    size = {i: 1 + i % 20 for i in ids} | {ids[0]: 9000, ids[100]: 700}
    docs = spark.createDataFrame([(i, "w " * n, "s2") for i, n in size.items()] + [(1000 + i, "w " * 50, f"s{i % 2}") for i in range(1800)],
                                 "doc_id int, text string, source string")
    first = mixed(docs, ["doc_id"], share=0.25).select("row.doc_id", "size", "target", "copies").collect()
    target = next(r["target"] for r in first if r["doc_id"] in size)
    assert target < sum(size.values()) and not any(r["copies"] for r in first if r["doc_id"] in size)
    taken = Counter(r["doc_id"] for r in mix(docs, share=0.25).collect())
    left, want = target, set()
    for i in ids:
        if size[i] <= left:
            want.add(i)
            left -= size[i]
    assert {i for i in taken if i in size} == want and all(taken[i] == 1 for i in want)
    assert 0 < len(want) < len(ids) and left < 20


def test_shards_are_even(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, "x" * rng.choice([0, 10, 300]), "hot" if i % 3 else f"s{i % 11}") for i in range(600)],
                                 "doc_id int, text string, source string")
    for n in (1, 5, 8):
        rows = sharded(docs, ["doc_id"], ["source", "doc_id"], shards=n).collect()
        size = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(n)]
        assert len(rows) == 600 and max(size) - min(size) <= 8 * 301
        for s in range(n):
            slots = sorted(r["slot"] for r in rows if r["shard"] == s)
            assert slots == list(range(len(slots)))
    few = sharded(docs, ["doc_id"], ["source"], target_bytes=20_000).agg(F.countDistinct("shard")).first()[0]
    assert few == -(-sum(r["size"] for r in rows) // 20_000)


def test_shards_keep_neighbours(spark):
    """Without ties a cut along one dimension leaves intervals."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    bounds = sharded(docs, ["doc_id"], ["doc_id"], shards=4).groupBy("shard").agg(
        F.min("row.doc_id").alias("lo"), F.max("row.doc_id").alias("hi"), F.count("*").alias("n")).orderBy("shard").collect()
    assert all(a["hi"] < b["lo"] + 2 for a, b in zip(bounds, bounds[1:])) and all(990 < r["n"] < 1010 for r in bounds)


def test_shard_edges(edge_docs, no_docs):
    rows = sharded(edge_docs, edge_docs.columns, ["source", "lang", "doc_id"], shards=4).collect()
    assert len(rows) == 10 and {r["shard"] for r in rows} <= {0, 1, 2, 3}
    assert sharded(no_docs, ["doc_id"], ["source"], shards=3).count() == 0


def test_pipeline(spark):
    """Each stage on its own input, held against what defines it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {tuple(words(t)[i:i + 10]) for t in bench for i in range(len(words(t)) - 9)}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    table = docs
    for name, keep in corpus_pipeline.STAGES:
        table = corpus_pipeline.stage(keep(spark, table, SF), name)
        if name != "shards":
            assert table.columns == docs.columns
        after = [r["doc_id"] for r in table.select("doc_id").collect()]
        if name == "language":
            assert {i for i, t in before.items() if not re.search(r"[^\W\d_]", t)} == before.keys() - {*after}
        if name == "near_copies":
            assert len({before[i] for i in after}) == len(after) and {*before.values()} - {before[i] for i in after} != before.keys()
        if name == "benchmark":
            gone = {i for i, t in before.items() if any(tuple(words(t)[k:k + 10]) in windows for k in range(len(words(t)) - 9))}
            assert {*after} == before.keys() - gone and gone
        if name == "mixture":
            assert {*after} <= before.keys() and max(map(after.count, after)) == 2
        if name == "shards":
            size = [r["n"] for r in table.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
            assert len(size) == 8 and len(after) == mixed_rows
        mixed_rows = len(after)
        before = {i: before[i] for i in after}


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, name):
    verdict = compare(spark, connect(SF), name, registry.QUERIES[name], registry.ORACLE[name], SF)
    assert verdict.startswith("ok"), verdict


def test_all_registered():
    names = [*entry_points.queries()]
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
