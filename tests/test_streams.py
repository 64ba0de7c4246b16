"""Rate limit and side tables of a live log."""

import datetime

import pytest
from pyspark.sql import functions as F

from flowsieve.operators.propagate import label_contexts, replies
from flowsieve.operators.select import exemplars, outliers
from flowsieve.operators.tuning import rate_limit
from flowsieve.schema import LABEL_DNS, LABEL_MALFORMED
from flowsieve.streaming import live
from flowsieve.streaming.live import late_rows, rate_limit_stream, undated, windowed_flows, write_alerts, write_undated

START = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "ts timestamp, ord bigint, alert_signature string, src_ip string"


def alert_rows(n):
    return [(START + datetime.timedelta(seconds=7 * i), i, f"s{i % 3 % 2}", None if i % 11 == 0 else f"10.0.0.{i % 2}") for i in range(n)]


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def limited(spark, folder, out):
    found = rate_limit_stream(spark.readStream.schema(SCHEMA).parquet(folder), 4)
    write_alerts(found, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{out}/rows")


def test_rate_limit_equals_batch_after_restarts(spark, tmp_path):
    logs, out, rows = str(tmp_path / "logs"), str(tmp_path / "out"), alert_rows(400)
    for a in range(0, 400, 90):  # every call starts the query anew
        add(spark, logs, rows[a:a + 90])
        limited(spark, logs, out)
    add(spark, logs, [(START + datetime.timedelta(days=1), 1000, "end", None)])
    limited(spark, logs, out)
    add(spark, logs, [(START + datetime.timedelta(days=1, seconds=1), 1001, "end", None)])
    found = limited(spark, logs, out).filter("alert_signature <> 'end'")
    want = rate_limit(spark.createDataFrame(rows, SCHEMA), 4)
    columns = ["window_start", "alert_signature", "src_ip", "ord", "rank"]
    assert sorted(map(str, found.filter("rank is not null").select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    closing = found.filter("rank is null").select("window_start", "alert_signature", "src_ip", "suppressed")
    totals = want.select("window_start", "alert_signature", "src_ip", "suppressed").distinct()
    assert sorted(map(str, closing.collect())) == sorted(map(str, totals.collect()))


def test_late_and_undated_rows_are_counted(spark, tmp_path):
    logs, out = str(tmp_path / "logs"), str(tmp_path / "out")
    late = 0
    for part, rows in enumerate([alert_rows(100), [(START + datetime.timedelta(hours=5), 500, "x", "y")], alert_rows(7) + [(None, 600 + i, "x", "y") for i in range(3)]]):
        add(spark, logs, rows)
        events = spark.readStream.schema(SCHEMA).parquet(logs).withColumn("flow_id", F.col("src_ip"))
        query = write_alerts(windowed_flows(events.drop("src_ip"), ["alert_signature"]), f"{out}/rows", f"{out}/state")
        query.awaitTermination()
        late += late_rows(query)
        write_undated(events, f"{out}/undated", f"{out}/undated_state").awaitTermination()
    assert spark.read.parquet(f"{out}/undated").count() == undated(spark.read.parquet(logs)).count() == 3
    # Seven late rows; those of one window and flow are one row by the time they meet the state.
    assert 1 <= late <= 7


def test_ledger_asks_once(spark, tmp_path):
    ledger, calls = str(tmp_path / "ledger"), str(tmp_path / "calls")

    def labeler(text):
        with open(calls, "a") as file:
            file.write(text + "\n")
        if text == "boom":
            raise RuntimeError("service down")
        return '{"label": "%s"}' % LABEL_DNS

    def run(texts, labels=None):
        df = spark.createDataFrame([(t,) for t in texts], "context string")
        found = label_contexts(df, labeler, ledger=ledger, **({"labels": labels} if labels else {})).collect()
        with open(calls) as file:
            asked = sorted(file.read().split())
        open(calls, "w").close()
        return sorted((r["context"], r["label"], r["confidence"]) for r in found), asked

    first, asked = run(["a", "b", "a", "boom"])
    assert asked == ["a", "b", "boom"]
    assert first == [("a", LABEL_DNS, 1.0), ("a", LABEL_DNS, 1.0), ("b", LABEL_DNS, 1.0), ("boom", LABEL_MALFORMED, 0.0)]
    second, asked = run(["b", "c", "boom"])
    assert asked == ["boom", "c"] and [r[0] for r in second] == ["b", "boom", "c"]
    assert run(["a", "b", "c"])[1] == []
    assert run(["a"], [LABEL_DNS, "another"])[1] == ["a"]  # another vocabulary is another question
    known = replies(spark.createDataFrame([("a",)], "context string"), labeler, ledger)
    assert known.count() == 4 and known.select("digest").distinct().count() == 4


def test_exemplars_without_wide_sorts(spark):
    rows = [(i, i % 3 - 1, [0.5, 0.9, 0.9, None][i % 4], "x" * i) for i in range(60)] + [(100, 9, None, "only"), (101, 9, None, "two")]
    df = spark.createDataFrame(rows, "ord bigint, cluster_label int, cluster_probability double, wide string")
    found = exemplars(df)
    assert found.columns == df.columns
    got = {r["cluster_label"]: r["ord"] for r in found.collect()}
    best = {}
    for o, c, p, _ in rows:
        if c >= 0 and (c not in best or (-(p or -1), o) < best[c]):
            best[c] = (-(p or -1), o)
    assert got == {c: o for c, (_, o) in best.items()}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="exemplars.*ord"):
        exemplars(df.drop("ord"))
    with pytest.raises(ValueError, match="outliers.*flow_id"):
        outliers(df)


def test_state_is_kept_on_disk(spark, tmp_path):
    """Open windows lie in RocksDB, not in the heap; the session's settings stay, and a provider that it names is used."""
    folder, key = tmp_path / "log", "spark.sql.streaming.stateStore.providerClass"
    folder.mkdir()
    stamp = '{"flow_id": %d, "event_type": "flow", "timestamp": "2024-01-01T00:%02d:00.000000+0000"}\n'
    (folder / "a.json").write_text("".join(stamp % (i % 20, i % 60) for i in range(200)))

    def run(name):
        flows = live.windowed_flows(live.read_event_stream(spark, str(folder)), ["event_type"])
        live.write_alerts(flows, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state").awaitTermination()
        kinds = {p.suffix for p in (tmp_path / f"{name}-state" / "state").rglob("*") if p.is_file() and not p.name.startswith((".", "_"))}
        return kinds, spark.read.parquet(f"{tmp_path}/{name}").count()

    kinds, n = run("disk")
    assert n == 50 and ".zip" in kinds and ".delta" not in kinds and spark.conf.get(key, None) is None
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        kinds, again = run("heap")
        assert again == n and ".delta" in kinds and ".zip" not in kinds
    finally:
        spark.conf.unset(key)
