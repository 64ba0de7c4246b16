"""Queries on ground truth, relinking and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.catalog import query, table
from flowsieve.catalog.events import FLOWS_SQL, flow_rows
from flowsieve.functions.labels import suspicious
from flowsieve.operators.metrics import (
    classification_report as report, confusion_long as long, confusion_wide as wide,
)
from flowsieve.operators.truth import attack_rows, other_rows, tag_attacks
from flowsieve.plans.evaluation import attack_report, evaluate_attacks, relink
from flowsieve.runtime import new_path
from flowsieve.sources.groundtruth import attack_tuples, read_ground_truth
from flowsieve.sources.tables import read_table, write_table

# Line items as address rows; those returned with a high quantity are the ground truth.
_ADDR_SQL = """addr as (select l_orderkey, l_linenumber, cast(l_orderkey as varchar) as src_ip,
cast(l_partkey as varchar) as dest_ip, cast(l_suppkey as varchar) as dest_port, l_returnflag, l_quantity from lineitem),
tuples as (select distinct src_ip, dest_ip, dest_port from addr where l_returnflag = 'R' and l_quantity > 40)"""


def _addresses(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("src_ip"),
        F.concat(F.lit(" "), F.col("l_partkey").cast("string")).alias("dest_ip"),
        F.col("l_suppkey").cast("double").cast("string").alias("dest_port"), "l_returnflag", "l_quantity")


def _tuples(spark, sf_dir):
    truth = _addresses(spark, sf_dir).select(
        F.col("src_ip").alias("Source IP"), F.col("dest_ip").alias("Destination IP"),
        F.col("dest_port").alias("Destination Port"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40), "DoS HeartBleed").alias("Label"))
    return attack_tuples(truth, "heartbleed")


@query(f"with {_ADDR_SQL} select src_ip, dest_ip, dest_port from tuples")
def truth_tuples(spark, sf_dir):
    """Distinct attack tuples of a ground-truth table."""
    return _tuples(spark, sf_dir)


@query(f"with {_ADDR_SQL} select src_ip, dest_ip, dest_port from tuples")
def truth_csv(spark, sf_dir):
    """The same tuples out of a ground-truth CSV with padded header names."""
    path = new_path(spark, "truth")
    _addresses(spark, sf_dir).select(
        F.col("src_ip").alias(" Source IP"), F.col("dest_ip").alias(" Destination IP "),
        F.col("dest_port").alias("Destination Port"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40), "DoS HeartBleed")
        .otherwise("BENIGN").alias(" Label")).write.option("header", True).csv(path)
    return attack_tuples(read_ground_truth(spark, path), "heartbleed")


@query(f"""with {_ADDR_SQL} select l_orderkey, l_linenumber, case when t.src_ip is null then 0 else 1 end as Actual_Is_Attack
from addr a left join tuples t using (src_ip, dest_ip, dest_port)""")
def truth_tag(spark, sf_dir):
    """Flag the rows on an attack tuple."""
    return tag_attacks(_addresses(spark, sf_dir), _tuples(spark, sf_dir)).select(
        "l_orderkey", "l_linenumber", "Actual_Is_Attack")


@query(f"""with {_ADDR_SQL} select l_orderkey, l_linenumber from addr a where exists (select 1 from tuples t
where t.src_ip = a.src_ip and t.dest_ip = a.dest_ip and t.dest_port = a.dest_port)""")
def truth_semi(spark, sf_dir):
    """Rows on an attack tuple."""
    return attack_rows(_addresses(spark, sf_dir), _tuples(spark, sf_dir)).select("l_orderkey", "l_linenumber")


@query(f"""with {_ADDR_SQL} select l_orderkey, l_linenumber from addr a where not exists (select 1 from tuples t
where t.src_ip = a.src_ip and t.dest_ip = a.dest_ip and t.dest_port = a.dest_port)""")
def truth_anti(spark, sf_dir):
    """Rows on no attack tuple."""
    return other_rows(_addresses(spark, sf_dir), _tuples(spark, sf_dir)).select("l_orderkey", "l_linenumber")


@query("""select l.doc_id as flow_id, l.quality, l.toxic, d.doc_id as flow_id_human, d.lang, d.source,
d.n_chars as toxic_human from labels l left join documents d using (doc_id)""")
def relink_left(spark, sf_dir):
    """Readable columns back on labeled rows; a clashing name is suffixed."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "flow_id")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("flow_id"), "lang", "source", F.col("n_chars").alias("toxic"))
    return relink(labels, docs, ["lang", "source", "toxic"])


# Quality labels against a rule on the text length.
_PAIRS_SQL = """pairs as (select quality as actual, case when n_chars > 800 then 1 when n_chars > 200 then 0 else 2 end as predicted
from labels join documents using (doc_id))"""


def _pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select(
        F.col("quality").alias("actual"),
        F.when(F.col("n_chars") > 800, 1).when(F.col("n_chars") > 200, 0).otherwise(2).alias("predicted"))


@query(f"with {_PAIRS_SQL} select actual, predicted, count(*) as n from pairs group by 1, 2")
def confusion_long(spark, sf_dir):
    """Confusion counts, one row per combination."""
    return long(_pairs(spark, sf_dir), "actual", "predicted")


@query(f"""with {_PAIRS_SQL} select l.actual, count(*) filter (predicted = 0) as "0", count(*) filter (predicted = 1) as "1"
from (values (0), (1)) l(actual) left join pairs p on p.actual = l.actual group by 1""")
def confusion_wide(spark, sf_dir):
    """Confusion matrix over the actual labels; other predictions vanish from it."""
    return wide(_pairs(spark, sf_dir), "actual", "predicted", [0, 1])


_REPORT_SQL = """l as (select distinct actual as label from pairs union select distinct predicted from pairs),
m as (select l.label, count(*) filter (p.actual = l.label and p.predicted = l.label) as hit,
  count(*) filter (p.actual = l.label) as support, count(*) filter (p.predicted = l.label) as called
  from l, pairs p group by 1),
r as (select cast(label as varchar) as label, coalesce(hit / nullif(called, 0), 0.0) as precision,
  coalesce(hit / nullif(support, 0), 0.0) as recall, hit, support from m),
f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from r),
out as (select label, precision, recall, f1, support from f
 union all select 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) from f
 union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from f
 union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support) from f)
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from out"""


def _rounded_report(rows):
    return rows.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"with {_PAIRS_SQL}, {_REPORT_SQL}")
def classification_report(spark, sf_dir):
    """Precision, recall and F1 per label, accuracy and averages."""
    return _rounded_report(report(_pairs(spark, sf_dir), "actual", "predicted"))


# Flows against tuples of their own heartbleed alerts; the rule label plays the prediction.
_EVAL_SQL = f"""{FLOWS_SQL}, v as (select flow_id, src_ip, dest_ip,
 coalesce(cast(cast(trunc(try_cast(trim(dest_port) as double)) as bigint) as varchar), trim(dest_port), '') as port,
 case when alert_signature is null then 'Standard traffic' else 'Active attack: ' || alert_signature end as predicted_label from flows),
tup as (select distinct src_ip, dest_ip, port from v where predicted_label like '%Heartbleed%'),
ev as (select flow_id, predicted_label, case when t.src_ip is null then 0 else 1 end as Actual_Is_Attack,
 cast(regexp_matches(predicted_label, 'suspicious|vulnerability|active attack|malformed|unknown suspicious|c2', 'i') as int) as Predicted_Is_Attack
 from v left join tup t using (src_ip, dest_ip, port))"""


def _evaluated(spark, sf_dir):
    flows = flow_rows(spark, sf_dir).select(
        "flow_id", "src_ip", "dest_ip", "dest_port",
        F.when(F.col("alert_signature").isNull(), "Standard traffic")
        .otherwise(F.concat(F.lit("Active attack: "), "alert_signature")).alias("predicted_label"))
    truth = flows.select(F.col("src_ip").alias("source ip"), F.col("dest_ip").alias("destination ip"),
                         F.col("dest_port").alias("destination port"), F.col("predicted_label").alias("label"))
    return evaluate_attacks(flows, attack_tuples(truth, "Heartbleed"))


@query(f"with {_EVAL_SQL} select flow_id, predicted_label, Actual_Is_Attack, Predicted_Is_Attack from ev")
def attack_evaluation(spark, sf_dir):
    """Flows with actual and predicted attack flags."""
    return _evaluated(spark, sf_dir).select(
        "flow_id", "predicted_label", "Actual_Is_Attack", "Predicted_Is_Attack")


@query(f"""with {_EVAL_SQL}, pairs as (select Actual_Is_Attack as actual, Predicted_Is_Attack as predicted from ev), {_REPORT_SQL}""")
def attack_evaluation_report(spark, sf_dir):
    """Binary report of the evaluation."""
    return _rounded_report(attack_report(_evaluated(spark, sf_dir))[0])


@query("""select label, cast(regexp_matches(label, 'suspicious|vulnerability|active attack|malformed|unknown suspicious|c2', 'i') as int) as threat,
count(*) as n from (select case when toxic = 1 then 'Suspicious text' else 'Routine text' end as label from labels) group by 1, 2""")
def threat_filter(spark, sf_dir):
    """Label predicate behind the live filter."""
    label = F.when(F.col("toxic") == 1, "Suspicious text").otherwise("Routine text")
    return table(spark, sf_dir, "labels").select(label.alias("label")).groupBy(
        "label", suspicious(F.col("label")).cast("int").alias("threat")).agg(F.count("*").alias("n"))


@query("select cast(doc_id as varchar) as flow_id, cast(quality as double) as \"alert.severity_1.0\", toxic from labels")
def table_roundtrip(spark, sf_dir):
    """A result table written as CSV with its public column names, and read back."""
    out = new_path(spark, "tables")
    rows = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("flow_id"),
        F.col("quality").cast("double").alias("alert_severity_1_0"), "toxic")
    write_table(rows, out, "demo", "labeled", "csv")
    return read_table(spark, out, "demo", "labeled", "csv",
                      "flow_id string, `alert.severity_1.0` double, toxic int")
