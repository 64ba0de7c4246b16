import math
import random

import numpy as np
import pytest
from hypothesis import Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from flowsieve.operators.components import connected_components
from flowsieve.operators.features import (
    apply_scaler, feature_matrix, fit_scaler, robust_scale, scaler_table, scaler_values,
)
from flowsieve.operators.metrics import classification_report, confusion_long, confusion_wide, report_dict
from flowsieve.operators.propagate import apply_replies, label_contexts, propagate
from flowsieve.operators import ranking
from flowsieve.operators.ranking import exact_quantiles, number_rows, take_by_quota
from flowsieve.operators.select import exemplars, outliers
from flowsieve.operators.skew import lookup_join
from flowsieve.operators.split import can_stratify, class_weights, split_quota, train_test
from flowsieve.operators.truth import attack_rows, other_rows, tag_attacks
from flowsieve.operators.tuning import rate_limit
from flowsieve.schema import LABEL_DNS, LABEL_MALFORMED, LABEL_UNCLASSIFIED
from flowsieve.schema import require_columns
from flowsieve.sources.groundtruth import attack_tuples, find_column, read_ground_truth


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_without_broadcast(spark, how):
    """Both ways give the plain join, with a hot key and null keys."""
    rng = random.Random(1)
    data = [(i, None if i % 7 == 0 else "hot" if i % 3 == 0 else str(rng.randrange(80))) for i in range(2000)]
    rows = spark.createDataFrame(data, "i int, k string")
    lookup = spark.createDataFrame([(str(k), k) for k in range(40)] + [("hot", -1)], "k string, v int")
    want = sorted(map(str, rows.join(lookup, ["k"], how).select("i", "k").collect()))
    for limit, share in ((1000, 0.001), (0, 0.2), (0, 0.001)):
        got = lookup_join(rows, lookup, ["k"], how, limit, share)
        assert sorted(map(str, got.select("i", "k").collect())) == want
        if how in ("left", "inner"):
            assert got.filter("v = -1").count() == sum(k == "hot" for _, k in data)


def test_number_rows(spark):
    rows = spark.createDataFrame([(v,) for v in random.Random(2).sample(range(10_000), 3000)], "v int")
    got = number_rows(rows.repartition(13), ["v"], "pos").orderBy("v").collect()
    assert [r["pos"] for r in got] == list(range(3000))


def test_take_by_quota(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5003).alias("v"))
    quota = spark.createDataFrame([(0, 0), (1, 777), (2, 10**6)], "g long, quota long")
    got = take_by_quota(rows, quota, "g", F.floor(F.col("v") / 100), ["v"], "take").collect()
    for g, n in ((0, 0), (1, 777), (2, 10**6)):
        values = sorted(r["v"] for r in got if r["g"] == g)
        assert sorted(r["v"] for r in got if r["g"] == g and r["take"]) == values[:n]


@pytest.mark.parametrize("digit", [3, 16])
def test_quota_runs_out_by_digits(spark, monkeypatch, digit):
    """Few bits at a time, buckets far apart, and a window that never sees more than a digit's values."""
    monkeypatch.setattr(ranking, "DIGIT", digit)
    rng = random.Random(digit)
    buckets = [0, 1, 7, 8, 9, 511, 512, 70_000, 2 ** 40, 2 ** 50 + 5]
    data = [(g, rng.choice(buckets)) for g in "abc" for _ in range(60)]
    rows = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(data)], "g string, v long, i int")
    quota = spark.createDataFrame([("a", 0), ("b", 31), ("c", 1000)], "g string, quota long")
    got = take_by_quota(rows, quota, "g", F.col("v"), ["v", "i"], "take").collect()
    for g, n in (("a", 0), ("b", 31), ("c", 1000)):
        mine = sorted((r["v"], r["i"]) for r in got if r["g"] == g)
        assert len(mine) == 60 and sorted((r["v"], r["i"]) for r in got if r["g"] == g and r["take"]) == mine[:n]


def test_take_by_quota_with_null_group_and_ties_in_a_bucket(spark):
    rows = spark.createDataFrame([(None, i) for i in range(50)] + [("a", i) for i in range(7)], "g string, v int")
    quota = spark.createDataFrame([(None, 11), ("a", 7)], "g string, quota long")
    got = take_by_quota(rows, quota, "g", F.lit(0), ["v"], "take").collect()
    assert len(got) == 57
    assert sorted(r["v"] for r in got if r["g"] is None and r["take"]) == list(range(11))
    assert sum(r["take"] for r in got if r["g"] == "a") == 7


@settings(max_examples=8, deadline=None)
@given(values=st.lists(st.one_of(
    st.floats(-1e9, 1e9), st.integers(-3, 3).map(float), st.just(0.0)), min_size=1, max_size=60))
def test_exact_quantiles(spark, values):
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(v, 1.0) for v in values], "a double, b double")
    got = {(r["column"], r["probability"]): r["value"] for r in exact_quantiles(df, ["a", "b"], probabilities).collect()}
    for p in probabilities:
        assert got["a", p] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9)
        assert got["b", p] == 1.0


def test_scaler(spark):
    df = spark.createDataFrame([(float(v), 0.0 if v < 9 else 9.0) for v in (1, 2, 3, 10)], "a double, flat double")
    params = scaler_values(fit_scaler(df, ["a", "flat"]))
    assert params == {"a": (2.5, 3.0), "flat": (0.0, 2.25)}
    flat = spark.createDataFrame([(0.0,)] * 9 + [(9.0,)], "flat double")
    scaled, params = robust_scale(flat, ["flat"])
    assert params == {"flat": (0.0, 1.0)} and scaled.agg(F.max("flat")).first()[0] == 9.0
    again = scaler_values(scaler_table(spark, params))
    assert apply_scaler(flat, again).collect() == scaled.collect()


def test_features(spark):
    flows = spark.createDataFrame(
        [("a", "TCP", "2", "aab", "nxdomain", "x"), ("b", "SCTP", "2.0", "", None, "3"), ("c", None, None, None, "OK", None)],
        "flow_id string, proto string, alert_severity string, tls_sni string, dns_rcode string, flow_age string")
    r = {x["flow_id"]: x for x in feature_matrix(flows).collect()}
    assert len(r["a"]) == 43
    assert (r["a"]["proto_TCP"], r["a"]["proto_nan"], r["a"]["alert_severity_2_0"]) == (1, 0, 1)
    assert (r["b"]["proto_TCP"], r["b"]["proto_nan"], r["b"]["alert_severity_2_0"]) == (0, 0, 1)
    assert (r["c"]["proto_nan"], r["c"]["alert_severity_nan"], r["c"]["flow_state_nan"]) == (1, 1, 1)
    assert r["a"]["tls_sni_entropy"] == pytest.approx(0.918296, abs=1e-6) and r["a"]["tls_sni_length"] == 3
    assert [r[k]["is_dns_failed"] for k in "abc"] == [1, 0, 0]
    assert [r[k]["flow_age"] for k in "abc"] == [0, 3, 0]
    parity = {x["flow_id"]: x for x in feature_matrix(flows, absent_as_zero=True).collect()}
    assert parity["c"]["flow_state_nan"] == 0 and parity["c"]["proto_nan"] == 1


def check_components(spark, edges):
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == {x: find(x) for x in parent}


@settings(max_examples=6, deadline=None, phases=[Phase.generate])
@given(edges=st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=4, max_size=40))
def test_components(spark, edges):
    check_components(spark, edges)


def test_components_with_a_node_under_two_roots(spark):
    """After one round 8 hangs under both 0 and 7, although neither hangs under anything."""
    check_components(spark, [(0, 10), (7, 9), (9, 8), (8, 10)])
    rng = random.Random(5)
    for n in (60, 300):  # sparse random graphs, many components at once
        check_components(spark, [(rng.randrange(n), rng.randrange(n)) for _ in range(n * 2 // 3)])


def test_components_of_a_long_path_and_a_hub(spark):
    path = spark.range(0, 400).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    hub = spark.range(1001, 3000).select(F.col("id").alias("u"), F.lit(5000).cast("long").alias("v"))
    got = connected_components(path.unionByName(hub)).groupBy("root").count().orderBy("root").collect()
    assert [tuple(r) for r in got] == [(0, 401), (1001, 2000)]


def test_exemplars_and_outliers(spark):
    rows = spark.createDataFrame(
        [("a", 0, .5, 3), ("b", 0, .9, 2), ("c", 0, .9, 1), ("d", 1, .1, 4), ("e", -1, .0, 5), ("f", -1, .0, 6)],
        "flow_id string, cluster_label int, cluster_probability double, ord int")
    for n in (1, 5):
        assert sorted(r["flow_id"] for r in exemplars(rows.repartition(n)).collect()) == ["c", "d"]
        assert [r["flow_id"] for r in outliers(rows.repartition(n), 1).collect()] == ["e"]
    assert outliers(rows, None).count() == 2


def test_propagate(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", -1), ("e", -1)], "flow_id string, cluster_label int")
    ex = spark.createDataFrame([(0, LABEL_DNS)], "cluster_label int, label string")
    ou = spark.createDataFrame([("d", "own")], "flow_id string, label string")
    got = {r["flow_id"]: r["target_label"] for r in propagate(rows, ex, ou).collect()}
    assert got == {"a": LABEL_DNS, "b": LABEL_DNS, "c": LABEL_UNCLASSIFIED, "d": "own", "e": LABEL_MALFORMED}


def test_labelers(spark):
    texts = spark.createDataFrame([("dns query x",), ("nothing",), ("boom dns query",), ("list",)], "context string")

    def labeler(text):
        if "boom" in text:
            raise RuntimeError("service down")
        return "[1]" if text == "list" else '{"label": "%s"}' % LABEL_DNS

    rules = {r["context"]: (r["label"], r["confidence"]) for r in label_contexts(texts).collect()}
    assert rules["dns query x"] == (LABEL_DNS, 0.0) and rules["nothing"] == (LABEL_MALFORMED, 0.0)
    own = {r["context"]: (r["label"], r["confidence"]) for r in label_contexts(texts, labeler).collect()}
    assert own == {"dns query x": (LABEL_DNS, 1.0), "nothing": (LABEL_DNS, 1.0), "boom dns query": (LABEL_DNS, 0.0),
                   "list": (LABEL_MALFORMED, 0.0)}
    replies = texts.withColumn("reply", F.when(F.col("context") == "nothing", "no json"))
    table = {r["context"]: (r["label"], r["confidence"]) for r in apply_replies(replies).collect()}
    assert table["nothing"] == (LABEL_MALFORMED, 1.0) and table["list"] == (LABEL_MALFORMED, 0.0)


def test_split(spark):
    rows = spark.range(1003).select(
        F.col("id").cast("string").alias("k"),
        F.when(F.col("id") < 900, "big").when(F.col("id") < 1000, "mid").otherwise("rare").alias("y"))
    assert can_stratify(rows, "y") and not can_stratify(rows.filter("y = 'big'"), "y")
    quota = {r["y"]: r["quota"] for r in split_quota(rows, "y", 0.2).collect()}
    assert sum(quota.values()) == math.ceil(0.2 * 1003)
    for y, n in (("big", 900), ("mid", 100), ("rare", 3)):
        assert abs(quota[y] - 0.2 * n) < 1
    one, other = (sorted(map(tuple, train_test(rows.repartition(n), "k", "y").collect())) for n in (2, 11))
    assert one == other and len(one) == 1003
    tests = [y for _, y, s in one if s == "test"]
    assert {y: tests.count(y) for y in quota} == quota
    assert train_test(rows, "k", None).filter("split = 'test'").count() == math.ceil(0.2 * 1003)
    weights = {r["y"]: r["weight"] for r in class_weights(rows, "y").collect()}
    assert weights == {"big": 1.0, "mid": 9.0, "rare": 300.0}


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), ("a", "z")], "y string, p string")
    assert {tuple(r) for r in confusion_long(rows, "y", "p").collect()} == {
        ("a", "a", 1), ("a", "b", 1), ("b", "b", 2), ("c", "a", 1), ("a", "z", 1)}
    wide = {r["actual"]: (r["a"], r["b"], r["c"]) for r in confusion_wide(rows, "y", "p", ["a", "b", "c"]).collect()}
    assert wide == {"a": (1, 1, 0), "b": (0, 2, 0), "c": (1, 0, 0)}
    report = report_dict(classification_report(rows, "y", "p"))
    assert report["a"] == {"precision": 0.5, "recall": pytest.approx(1 / 3), "f1-score": pytest.approx(0.4), "support": 3}
    assert report["b"]["precision"] == pytest.approx(2 / 3) and report["b"]["recall"] == 1.0
    assert report["z"] == {"precision": 0.0, "recall": 0.0, "f1-score": 0.0, "support": 0}
    assert report["accuracy"] == 0.5
    assert report["macro avg"]["recall"] == pytest.approx((1 / 3 + 1 + 0 + 0) / 4)
    assert report["weighted avg"]["recall"] == pytest.approx(0.5)


def test_ground_truth(spark, truth_path):
    truth = read_ground_truth(spark, truth_path)
    tuples = attack_tuples(truth, "heartbleed")
    assert {tuple(r) for r in tuples.collect()} == {
        ("172.16.0.1", "192.168.10.51", "444"), ("10.0.0.7", "10.0.0.2", "http")}
    rows = spark.createDataFrame(
        [(1, " 172.16.0.1", "192.168.10.51", "444.0"), (2, "10.0.0.1", "10.0.0.2", "80"), (3, None, None, None)],
        "i int, src_ip string, dest_ip string, dest_port string")
    assert {r["i"]: r["Actual_Is_Attack"] for r in tag_attacks(rows, tuples).collect()} == {1: 1, 2: 0, 3: 0}
    assert [r["i"] for r in attack_rows(rows, tuples).collect()] == [1]
    assert sorted(r["i"] for r in other_rows(rows, tuples).collect()) == [2, 3]
    assert find_column([" Source IP ", "x"], "source", "ip") == " Source IP "
    with pytest.raises(ValueError):
        attack_tuples(truth.drop("Label"), "x")
    with pytest.raises(ValueError):
        require_columns(rows, ["i", "nope"])


def test_rate_limit_prunes_before_the_shuffle(spark):
    rows = spark.range(1000).select(
        F.col("id").alias("ord"), F.timestamp_seconds(1000 + F.col("id") / 100).alias("ts"),
        F.when(F.col("id") > 9, "hot").alias("alert_signature"),
        F.when(F.col("id") > 9, "one").alias("src_ip"))
    got = rate_limit(rows, 3)
    assert [(r["ord"], r["suppressed"]) for r in got.orderBy("ord").collect()] == [
        (0, 7), (1, 7), (2, 7), (10, 987), (11, 987), (12, 987)]
    plan = got._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_ground_truth_in_windows_encoding(spark, tmp_path):
    """Quotes, dashes and the euro sign without a session setting; bytes that cp1252 leaves open stay."""
    path = tmp_path / "truth.csv"
    path.write_bytes(" Source IP ,\x93Label\x94 \n10.0.0.1,Web Attack \x96 \x91XSS\x92 \x97 \x80 \xe9 \x81\n".encode("latin-1"))
    rows = read_ground_truth(spark, str(path))
    assert rows.columns == ["Source IP", "“Label”"]
    assert rows.first()[1] == "Web Attack – ‘XSS’ — € é \x81"
