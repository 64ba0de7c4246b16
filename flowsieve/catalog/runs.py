"""Whole runs on planted flows, and what runs leave behind: lines, splits, scalers, models, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.catalog import query, table
from flowsieve.catalog.labels import quota_sql
from flowsieve.operators.density import density_cluster
from flowsieve.operators.features import fit_scaler, scaler_values
from flowsieve.operators.propagate import label_contexts
from flowsieve.operators.split import can_stratify, train_test
from flowsieve.operators.summary import refresh_scaler
from flowsieve.plans import labeling
from flowsieve.plans.scoring import is_threat
from flowsieve.plans.training import PREDICTION, feature_importance, predict, train_and_measure
from flowsieve.runtime import new_path
from flowsieve.schema import LABEL_ATTACK, LABEL_DNS, LABEL_HTTP, LABEL_TLS, Settings
from flowsieve.sources import tables
from flowsieve.sources.events import read_events

#: Per planted group: the values of its flows, and the label that the rules give them.
_GROUPS = [
    ({"proto": "UDP", "app_proto": "dns", "dns_rrname": "host.example", "dest_port": "53"}, LABEL_DNS),
    ({"proto": "TCP", "app_proto": "tls", "tls_sni": "shop.example.org", "dest_port": "443", "flow_state": "established"}, LABEL_TLS),
    ({"proto": "TCP", "app_proto": "http", "http_hostname": "news.example.net", "http_url": "/", "dest_port": "80", "flow_state": "closed"}, LABEL_HTTP),
    ({"proto": "TCP", "app_proto": "failed", "alert_signature": "exploit attempt", "alert_severity": "1", "dest_port": "445"}, LABEL_ATTACK),
]
_LABEL_SQL = "case o_orderkey % 4 " + " ".join(f"when {i} then '{label}'" for i, (_, label) in enumerate(_GROUPS)) + " end"


def _planted(spark, sf_dir):
    """Two events per order: four kinds of flows, each with even jitter in bytes and packets of its own width."""
    names = sorted({c for values, _ in _GROUPS for c in values})
    kind = F.col("o_orderkey") % 4

    def pick(values):
        out = F.lit(None).cast("string")
        for i, v in enumerate(values):
            if v is not None:
                out = F.when(kind == i, F.lit(v)).otherwise(out)
        return out

    def jitter(step: float, width: float):
        at = F.col("o_orderkey") * F.lit(step)
        return ((kind + 1) * F.lit(width) * (1 + (at - F.floor(at)))).cast("string")

    flows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("flow_id"), F.col("o_orderkey").alias("place"),
        F.lit("10.0.0.1").alias("src_ip"), F.lit("10.0.0.2").alias("dest_ip"),
        jitter(0.7548776662466927, 200.0).alias("flow_bytes_toserver"), jitter(0.5698402909980532, 4.0).alias("flow_pkts_toserver"),
        *[pick([values.get(c) for values, _ in _GROUPS]).alias(c) for c in names])
    # The values come with the second event; the first one has the addresses only.
    part = F.explode(F.array(F.lit(0), F.lit(1))).alias("part")
    return flows.select("*", part).select(
        "flow_id", (F.col("place") * 2 + F.col("part")).alias("ord"), "src_ip", "dest_ip",
        *[F.when(F.col("part") == 1, F.col(c)).alias(c) for c in (*names, "flow_bytes_toserver", "flow_pkts_toserver")])


@query(f"select cast(o_orderkey as varchar) as flow_id, {_LABEL_SQL} as target_label from orders")
def planted_labels(spark, sf_dir):
    """The labeling run on four planted kinds of flows: every flow gets the label of its kind."""
    return labeling.label_flows(_planted(spark, sf_dir)).labeled.select("flow_id", "target_label")


@query(f"""with f as (select o_orderkey, {_LABEL_SQL} as target_label from orders), {quota_sql("f", "target_label")},
h as (select target_label as label, cast(quota as bigint) as support from k),
r as (select unnest(['rows in train', 'rows in test', 'rows in the matrix', 'rows predicted again']) as fact,
 unnest([(select count(*) from f) - (select sum(support) from h), (select sum(support) from h), (select sum(support) from h), (select sum(support) from h)]) as n)
select fact, cast(n as double) as value from r union all select 'support of ' || label, cast(support as double) from h
union all select unnest(['accuracy', 'labels in order', 'metrics', 'importance adds up', 'scaler columns']), unnest([1.0, 4.0, 12.0, 1.0, 17.0])""")
def whole_run(spark, sf_dir):
    """Label, split, train, measure, save everything, read it back and predict again with the saved model."""
    out, name = new_path(spark, "run"), "planted"
    run = labeling.label_flows(_planted(spark, sf_dir))
    labeling.save(run, out, name)
    split = tables.read_table(spark, out, name, "split")
    test = split.filter("split = 'test'")
    model, metrics = train_and_measure(split.filter("split = 'train'"), test, Settings(dataset=name))
    tables.save_model(model, out, name)
    tables.write_metrics(spark, metrics, out, name)
    tables.write_table(feature_importance(spark, model), out, name, "importance")

    again = predict(tables.load_model(out, name), test)
    metrics = tables.read_metrics(spark, out, name)
    importance = tables.read_table(spark, out, name, "importance").agg(F.round(F.sum("Importance"), 9)).first()[0]
    report = metrics["classification_report"]
    labels = metrics["confusion_matrix_labels"]
    facts = {
        "rows in train": metrics["train_rows"], "rows in test": metrics["test_rows"], "accuracy": report["accuracy"],
        "rows in the matrix": sum(map(sum, metrics["confusion_matrix"])), "metrics": len(metrics),
        "labels in order": len(labels) if labels == sorted(labels) else 0, "importance adds up": importance,
        "rows predicted again": again.filter(F.col(PREDICTION) == F.col("target_label")).count(),
        "scaler columns": tables.read_table(spark, out, name, "scaler").count(),
    } | {f"support of {v}": report[v]["support"] for v in labels}
    return spark.createDataFrame([(k, float(v)) for k, v in facts.items()], "fact string, value double")


@query("select o_orderpriority as value, count(*) as n from orders group by 1")
def lines_roundtrip(spark, sf_dir):
    """Lines written as they are and read back."""
    path = new_path(spark, "lines")
    tables.write_lines(table(spark, sf_dir, "orders"), path, "o_orderpriority")
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


@query(f"""with {quota_sql('documents', 'lang')}
select lang, 'test' as split, cast(quota as bigint) as n from k union all select k.lang, 'train', n.n - quota from k join n on n.lang is not distinct from k.lang""")
def split_roundtrip(spark, sf_dir):
    """Train and test rows as partitions of a written table."""
    out = new_path(spark, "split")
    tables.write_split(train_test(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang"), out, "d")
    return tables.read_table(spark, out, "d", "split").groupBy("lang", "split").agg(F.count("*").alias("n"))


@query("""with q as (select quantile_cont(l_quantity, [0.25, 0.5, 0.75]) as q from lineitem)
select 'l_quantity' as "column", round(q[2], 6) as center, round(q[3] - q[1], 6) as scale from q""")
def scaler_roundtrip(spark, sf_dir):
    """A scaler written as a table, read back as values and written out again."""
    out = new_path(spark, "scaler")
    tables.write_table(fit_scaler(table(spark, sf_dir, "lineitem"), ["l_quantity"]), out, "d", "scaler")
    values = scaler_values(tables.read_table(spark, out, "d", "scaler"))
    return spark.createDataFrame([(c, round(a, 6), round(b, 6)) for c, (a, b) in values.items()], "column string, center double, scale double")


@query(f"""select o_orderkey, case when o_orderkey % 3 = 0 then '{LABEL_TLS}' when o_orderkey % 3 = 1 then '{LABEL_DNS}' else '{LABEL_HTTP}' end as label,
case when o_orderkey % 3 = 0 then 1.0::double else 0.0::double end as confidence from orders""")
def labeler_hook(spark, sf_dir):
    """A labeler that answers, raises or says nothing; the rules step in for the last two."""
    kind = F.col("o_orderkey") % 3
    texts = table(spark, sf_dir, "orders").select("o_orderkey", F.when(kind == 0, "plain").when(kind == 1, "boom: dns query").otherwise(
        "silent: application layer: http").alias("context"))

    def labeler(text: str) -> str | None:
        if text.startswith("boom"):
            raise RuntimeError("service down")
        return None if text.startswith("silent") else '{"label": "%s"}' % LABEL_TLS

    return label_contexts(texts, labeler).select("o_orderkey", "label", "confidence")


@query("select cast(event_id as varchar) as flow_id, event_type from events")
def strict_scan(spark, sf_dir):
    """A log without a bad line passes the strict scan."""
    path = new_path(spark, "lines")
    record = F.struct(F.col("event_id").alias("flow_id"), F.col("event_type"))
    table(spark, sf_dir, "events").select(F.to_json(record).alias("value")).write.text(path)
    return read_events(spark, path, strict=True).select("flow_id", "event_type")


@query("select l_returnflag, count(*) as n from lineitem where l_returnflag <> 'N' group by 1")
def threats_kept(spark, sf_dir):
    """Rows whose label is not on the list of harmless ones."""
    rows = table(spark, sf_dir, "lineitem").filter(is_threat(F.col("l_returnflag"), ["N"]))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("""select unnest(['all', 'one class', 'a class of one', 'two rows']) as rows, unnest([true, false, false, true]) as answer""")
def guards(spark, sf_dir):
    """Whether classes allow a stratified split; two rows are one cluster of their own."""
    orders = table(spark, sf_dir, "orders")
    first = orders.orderBy("o_orderkey").limit(1).withColumn("o_orderstatus", F.lit("rare"))
    two = density_cluster(orders.orderBy("o_orderkey").limit(2), "o_orderkey", ["o_totalprice"])
    answers = {
        "all": can_stratify(orders, "o_orderstatus"), "one class": can_stratify(orders.withColumn("o_orderstatus", F.lit("x")), "o_orderstatus"),
        "a class of one": can_stratify(orders.unionByName(first), "o_orderstatus"),
        "two rows": two.filter("cluster_label = 0 and cluster_probability = 1").count() == 2,
    }
    return spark.createDataFrame(list(answers.items()), "rows string, answer boolean")


@query("select unnest(['l_quantity', 'l_extendedprice']) as \"column\", true as close, (select count(*) from lineitem) as n")
def scaler_refresh(spark, sf_dir):
    """A scaler kept up to date over three batches, one of them twice, lies within its bound of the exact one."""
    columns, folder = ["l_quantity", "l_extendedprice"], new_path(spark, "summaries")
    rows = table(spark, sf_dir, "lineitem")
    for batch in (0, 1, 2, 1):
        found = refresh_scaler(rows.filter(F.col("l_orderkey") % 3 == batch), columns, folder, str(batch))
    exact = fit_scaler(rows, columns).select("column", F.col("center").alias("c"), F.col("scale").alias("s"))
    counted = spark.read.parquet(folder).groupBy("column").agg(F.sum("n").alias("n"))
    close = (F.abs(F.col("center") - F.col("c")) <= F.col("error") + 1e-9) & (F.abs(F.col("scale") - F.col("s")) <= 2 * F.col("error") + 1e-9)
    return found.join(exact, "column").join(counted, "column").select("column", close.alias("close"), "n")
