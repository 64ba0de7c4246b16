"""Whole runs: labeling, training, evaluation, scoring, sanity, tables on disk, streaming."""

import importlib
import inspect

import pytest
from pyspark.sql import functions as F

from flowsieve.catalog.views import event_lines, event_rows
from flowsieve.operators.collapse import collapse
from flowsieve.plans import labeling, legacy
from flowsieve.plans.extraction import extract_log
from flowsieve.plans.evaluation import attack_report, evaluate_attacks, relink, truth_is_one_sided
from flowsieve.plans.sanity import cluster_summary, preview, profile, sample_labels, shape
from flowsieve.plans.scoring import score_batch
from flowsieve.plans.training import PREDICTION, feature_importance, fit, predict, train_and_measure
from flowsieve.schema import FEATURES, FLAT_COLUMNS, LABELS, LABEL_DNS, LEGACY_DEFAULT_LABEL, LEGACY_LABELS, Settings
from flowsieve.sources import tables
from flowsieve.sources.events import read_events
from flowsieve.streaming.live import read_event_stream, score_stream, write_alerts

SF = "/root/testdata/sf0.001"
QUICK = Settings(iterations=4, depth=3, min_cluster_size=20, min_samples=5)


@pytest.fixture(scope="module")
def events(spark):
    return event_rows(spark, SF).select("flow_id", "ord", *[c for c in FLAT_COLUMNS if c != "flow_id"])


@pytest.fixture(scope="module")
def run(events):
    return labeling.label_flows(events, QUICK, eps=0.5)


def by_proto(rows):
    """A stand-in label with several classes that the features can predict."""
    label = F.when(F.col("proto_TCP") == 1, "Active attack").when(F.col("proto_UDP") == 1, LABEL_DNS).otherwise("C2")
    return rows.withColumn("target_label", label)


def test_labeling(run, events):
    n = events.select("flow_id").distinct().count()
    rows = run.labeled.collect()
    assert len(rows) == len({r["flow_id"] for r in rows}) == n
    assert {r["target_label"] for r in rows} <= set(LABELS)
    assert run.labeled.columns == [*FEATURES, "target_label", "flow_id", "cluster_label", "cluster_probability"]
    summary = cluster_summary(run.clustered).first()
    kinds = {r["kind"]: r["count"] for r in run.reviewed.groupBy("kind").count().collect()}
    assert kinds.get("exemplar", 0) == summary["n_clusters"]
    assert kinds.get("outlier", 0) == min(summary["n_noise"], 100)
    assert run.split.filter("split = 'test'").count() == -(-n // 5)
    assert sample_labels(labeling.readable(run.clustered, labeling.CLUSTER_COLUMNS), 2).count() == min(
        2, summary["n_clusters"])


def test_labeling_ignores_partitioning(run, events):
    other = labeling.label_flows(events.repartition(3), QUICK, eps=0.5)
    columns = ["flow_id", "target_label", "cluster_label"]
    assert sorted(map(tuple, other.labeled.select(*columns).collect())) == sorted(
        map(tuple, run.labeled.select(*columns).collect()))


def test_own_labeler_runs_once_per_context(events):
    result = labeling.label_flows(events, QUICK, lambda text: '{"label": "%s"}' % LABEL_DNS, eps=0.5)
    assert {r["confidence"] for r in result.reviewed.collect()} == {1.0}


def test_tables_on_disk(spark, run, tmp_path):
    out = str(tmp_path)
    labeling.save(run, out, "demo")
    assert tables.read_table(spark, out, "demo", "labeled").count() == run.labeled.count()
    split = tables.read_table(spark, out, "demo", "split")
    assert {r[0] for r in split.select("split").distinct().collect()} == {"train", "test"}
    assert tables.read_table(spark, out, "demo", "scaler").count() == 17
    tables.write_table(run.labeled, out, "demo", "labeled_csv", "csv")
    assert "alert.severity_2.0" in tables.read_table(spark, out, "demo", "labeled_csv", "csv").columns
    with pytest.raises(Exception):
        tables.read_table(spark, out, "demo", "nothing")


def test_training(spark, run, tmp_path):
    rows = by_proto(run.labeled)
    train, test = rows.filter("pmod(xxhash64(flow_id), 5) > 0"), rows.filter("pmod(xxhash64(flow_id), 5) = 0")
    model, metrics = train_and_measure(train, test, QUICK, model_file="m", importance_file="i")
    assert set(metrics) == {
        "dataset", "train_rows", "test_rows", "train_seconds", "prediction_seconds", "latency_per_alert_seconds",
        "events_per_second", "classification_report", "confusion_matrix_labels", "confusion_matrix", "model_file",
        "feature_importance_file"}
    assert metrics["classification_report"]["accuracy"] == 1.0
    assert metrics["confusion_matrix_labels"] == ["Active attack", "C2", LABEL_DNS]
    assert sum(map(sum, metrics["confusion_matrix"])) == metrics["test_rows"] == test.count()
    top = feature_importance(spark, model).limit(2).collect()
    assert {r["Feature"] for r in top} <= {"proto_TCP", "proto_UDP", "proto_nan", "proto_ICMP", "proto_IPv6-ICMP"}
    out = str(tmp_path)
    tables.save_model(model, out, "demo")
    again = predict(tables.load_model(out, "demo"), test).select("flow_id", PREDICTION)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, predict(model, test).select("flow_id", PREDICTION).collect()))
    tables.write_metrics(spark, metrics, out, "demo")
    assert tables.read_metrics(spark, out, "demo") == metrics
    with pytest.raises(ValueError):
        fit(train.filter("target_label = 'C2'"), QUICK)


def test_early_stopping(run):
    """Labels that no feature explains keep fewer rounds than the last."""
    noise = run.labeled.withColumn(
        "target_label", F.when(F.xxhash64("flow_id") % 2 == 0, "a").otherwise("b"))
    model = fit(noise, Settings(iterations=12, depth=2))
    assert len(model.trees) <= model.rounds_trained <= 12 and len(model.losses) == model.rounds_trained + 1


def test_evaluation(spark, run, events):
    flows = collapse(events)
    validation = relink(run.labeled, flows)
    assert validation.count() == run.labeled.count()
    assert {"src_ip", "alert_signature", "flow_id_human"} <= set(validation.columns)
    tuples = flows.filter("alert_signature = 'Heartbleed probe'").select(
        "src_ip", "dest_ip", F.regexp_replace(F.trim("dest_port"), r"\.0$", "").alias("dest_port")).distinct()
    model = fit(by_proto(run.labeled), QUICK)
    done = evaluate_attacks(validation, tuples.fillna(""), model)
    r = done.agg(F.sum("Actual_Is_Attack").alias("a"), F.sum("Predicted_Is_Attack").alias("p"),
                 F.count_if(F.col(PREDICTION) == LABEL_DNS).alias("dns"), F.count("*").alias("n")).first()
    assert 0 < r["a"] < r["n"] and r["p"] == r["n"] - r["dns"]
    report, matrix = attack_report(done)
    assert {x["actual"] for x in matrix.collect()} == {0, 1} and report.count() == 5
    assert not truth_is_one_sided(done)
    with pytest.raises(ValueError):
        evaluate_attacks(validation, tuples)


def test_sanity(spark, events):
    flows = collapse(events)
    seen = {r["column"]: r["n_values"] for r in profile(flows, ["proto", "dns_rrname"]).collect()}
    assert 0 < seen["dns_rrname"] < flows.count()
    assert all(r["dns_rrname"] for r in preview(flows, ["flow_id", "dns_rrname"]).collect())
    assert shape(flows) == (flows.count(), 34)


def test_extract_log(spark, golden_path, tmp_path):
    target = str(tmp_path / "small")
    counts = extract_log(spark, golden_path, target, Settings(max_normal_events=3))
    assert counts.first().asDict() == {"saved": 4, "attack": 1, "normal": 3}
    source = open(golden_path, encoding="utf-8", errors="replace").read().splitlines()
    written = [r["value"] for r in spark.read.text(target).select("value").collect()]
    assert sorted(written) == sorted([source[0], source[2], source[10], source[11]])


def test_legacy_run(events):
    def scorer(texts):
        return [None if "UDP" in t else (LEGACY_LABELS[2], 0.9) for t in texts]

    rows = legacy.label_flows(events, scorer, eps=0.5)
    labels = {r[0] for r in rows.select("target_label").distinct().collect()}
    assert LEGACY_DEFAULT_LABEL in labels and rows.count() == events.select("flow_id").distinct().count()


def test_stream_equals_batch(spark, run, tmp_path):
    logs, out = str(tmp_path / "logs"), str(tmp_path / "out")
    event_lines(spark, SF).select("value").coalesce(3).write.text(logs)
    labeled = run.labeled.withColumn(
        "target_label", F.when(F.col("proto_TCP") == 1, "Active attack").otherwise("Routine"))
    model = fit(labeled, QUICK, method="forest")
    found = score_stream(read_event_stream(spark, logs), model, run.scaler, width="3650 days", delay="0 seconds")
    # one more, later event closes the only window
    (tmp_path / "logs" / "later.txt").write_text('{"flow_id":-1,"timestamp":"2050-01-01T00:00:00.000000+0000"}\n')
    query = write_alerts(found, f"{out}/rows", f"{out}/state")
    query.awaitTermination()
    streamed = spark.read.schema(found.schema).parquet(f"{out}/rows")
    batch = score_batch(read_events(spark, logs), model, run.scaler)
    with_id = F.col("flow_id").rlike("^[0-9]+$")  # generated ids differ by design
    columns = ["flow_id", "src_ip", "diagnosis"]
    got = sorted(map(str, streamed.filter(with_id).select("flow_id", "diagnosis").collect()))
    want = sorted(map(str, batch.filter(with_id).select("flow_id", "diagnosis").collect()))
    assert got == want and len(got) > 50
    assert streamed.filter(~F.col("message").startswith("[Active attack] detected from 10.0.")).count() == 0
    assert set(columns) <= set(streamed.columns)


@pytest.mark.parametrize("module,name", [("models", "train_predict"), ("models", "importances"), ("streams", "stream_score"), ("streams", "batch_score")])
def test_registered_training_is_whole(spark, monkeypatch, module, name):
    class Called(Exception):
        pass

    def recorded(*args, **options):
        raise Called(inspect.signature(fit).bind(*args, **options))

    catalog = importlib.import_module(f"flowsieve.catalog.{module}")
    monkeypatch.setattr(catalog, "fit", recorded)
    with pytest.raises(Called) as call:
        getattr(catalog, name)(spark, SF)
    bound = call.value.args[0]
    bound.apply_defaults()
    assert bound.arguments["settings"] == Settings() and bound.arguments["method"] == "boosted"
    assert (Settings().iterations, Settings().depth, Settings().patience) == (500, 6, 50)
