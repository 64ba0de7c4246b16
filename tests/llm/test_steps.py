"""Increments of exact dedup and secret scans, and the k-d tree by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import secrets
from flowsieve.llm.exact import exact_groups, incremental_groups
from flowsieve.llm.sharding import STEPS, kd_shards, sharded
from flowsieve.runtime import stage


@pytest.mark.parametrize("steps", [1, 2, 3])
def test_increments_equal_the_whole(spark, edge_docs, no_docs, steps):
    docs = spark.createDataFrame([(i, f"t{i * i % 23}" if i % 9 else None) for i in range(150)] + [(7, "t3"), (None, "t3"), (None, "new")],
                                 "doc_id bigint, text string")
    for rows in (docs, edge_docs):
        got = incremental_groups(rows, F.pmod("doc_id", F.lit(steps)), steps)
        want = exact_groups(rows).select(got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert incremental_groups(no_docs, F.lit(0), steps).count() == 0


def test_second_increment_scans_only_new_blobs(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"token = abcdefgh{i % 6}" if i < 12 else f"password: secret{i:04d}") for i in range(18)] + [(20, None)],
                                 "doc_id bigint, text string")
    rows = stage(secrets.addressed(docs, ["doc_id"]))
    scanned, scan = [], secrets.scan

    def recorded(blobs, rules=secrets.RULES, ledger=None):
        found = scan(blobs, rules, ledger)
        scanned.append({r["blob"] for r in found[0].collect()})
        return found

    monkeypatch.setattr(secrets, "scan", recorded)
    ledger, findings = secrets.scan_increments(rows, F.when(F.col("doc_id") >= 6, 1).otherwise(0), 2)
    every = {r["blob"] for r in rows.collect()}
    assert len(scanned[0]) == 6 and len(scanned[1]) == len(every) - 6 and not scanned[0] & scanned[1]
    assert {r["blob"] for r in ledger.collect()} == every and ledger.count() == 3 * len(every)
    whole = secrets.findings_by_row(rows, scan(rows)[1], ["doc_id"])
    assert sorted(map(str, secrets.findings_by_row(rows, findings, ["doc_id"]).collect())) == sorted(map(str, whole.collect()))


def by_hand(points, sizes, shards):
    """Shard of each point: halves by bytes along the widest dimension, the point at the cut on the nearer side."""
    low, width = points.min(axis=0), np.ptp(points, axis=0)
    out = np.zeros(len(points), int)

    def split(rows, first, n):
        out[rows] = first
        if n < 2 or not len(rows):
            return
        share = np.ptp(points[rows], axis=0) / width
        d = max(range(points.shape[1]), key=lambda i: (share[i], f"d{i}"))
        order = rows[np.argsort(np.floor((points[rows, d] - low[d]) / width[d] * STEPS), kind="stable")]
        quota, upto = sizes[rows].sum() * (n // 2) / n, np.cumsum(sizes[order])
        cut = int(np.searchsorted(upto, quota, side="right"))
        if cut < len(order) and upto[cut] - quota < quota - (upto[cut - 1] if cut else 0):
            cut += 1
        split(order[:cut], first, n // 2)
        split(order[cut:], first + n // 2, n - n // 2)

    split(np.arange(len(points)), 0, shards)
    return out


@pytest.mark.parametrize("shards", [1, 2, 7, 16])
def test_tree_equals_one_by_hand(spark, shards):
    rng = np.random.default_rng(shards)
    points = np.stack([rng.permutation(300) * w for w in (1.0, 40.0)], axis=1)
    sizes = rng.integers(1, 500, 300)
    rows = stage(spark.createDataFrame([(i, int(s), *map(float, p)) for i, (s, p) in enumerate(zip(sizes, points))],
                                       "_place bigint, size bigint, d0 double, d1 double"))
    got = {r["_place"]: r["shard"] for r in kd_shards(rows, ["d0", "d1"], shards).collect()}
    assert [got[i] for i in range(300)] == by_hand(points, sizes, shards).tolist()


def test_thousands_of_shards(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.pmod(F.hash("id"), F.lit(40))).alias("text"))
    found = sharded(docs, ["doc_id"], ["doc_id"], shards=3000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    per = found.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert len(per) == 3000 and all(r["last"] == r["n"] - 1 for r in per)
    assert max(r["bytes"] for r in per) - min(r["bytes"] for r in per) <= 2 * 41 * 3
