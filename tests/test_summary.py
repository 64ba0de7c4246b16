"""Summaries that add up against exact quantiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators.features import apply_scaler, fit_scaler, scaler_values
from flowsieve.operators.summary import merged, refresh_scaler, summarize, summary_quantiles


def values(seed, n):
    rng = random.Random(seed)
    return [rng.choice([0.0, 5.0, rng.gauss(0, 1), rng.gauss(1e6, 1e5), -rng.expovariate(1e-3)]) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 9, 3000])
def test_quantiles_are_within_their_bound(spark, n):
    data = values(n, n)
    df = spark.createDataFrame([(v, None if i % 2 else float("nan")) for i, v in enumerate(data)], "a double, b double")
    found = summary_quantiles(summarize(df, ["a", "b"]), [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]).collect()
    assert len(found) == 6 and {r["column"] for r in found} == {"a"}
    for r in found:
        exact = np.quantile(data, r["probability"])
        assert abs(r["value"] - exact) <= r["error"] + 1e-9 and r["error"] <= 1e-3 * max(1, abs(exact))
        if r["probability"] in (0.0, 1.0):
            assert r["value"] == exact


def test_merged_equals_whole(spark):
    df = spark.createDataFrame([(v,) for v in values(7, 800)], "a double").withColumn("b", F.col("a") * 2)
    parts = [summarize(p, ["a", "b"]) for p in df.randomSplit([1.0, 2.0, 3.0], 3)]
    whole = merged(parts[0].unionByName(merged(parts[1].unionByName(parts[2]))))
    key = lambda d: sorted(map(tuple, d.select("column", "bucket", "n", "low", "high").collect()))
    assert key(whole) == key(summarize(df, ["a", "b"]))




def test_refreshed_scaler(spark, tmp_path):
    batches = [values(s, 400) for s in range(4)]
    folder = str(tmp_path / "summaries")
    frames = [spark.createDataFrame([(v, v % 3) for v in b], "a double, b double") for b in batches]
    for i, df in enumerate([*frames, frames[1]]):  # the second batch comes twice
        scaler = refresh_scaler(df, ["a", "b"], folder, str(i if i < 4 else 1))
    whole = frames[0]
    for df in frames[1:]:
        whole = whole.unionByName(df)
    exact = scaler_values(fit_scaler(whole, ["a", "b"]))
    for r in scaler.collect():
        center, scale = exact[r["column"]]
        assert abs(r["center"] - center) <= r["error"] + 1e-9 and abs(r["scale"] - scale) <= 2 * r["error"] + 1e-9
    params = {r["column"]: (r["center"], r["scale"]) for r in scaler.collect()}
    assert apply_scaler(whole, params).count() == 1600
