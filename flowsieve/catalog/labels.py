"""Queries on exemplars, outliers, label propagation, splits and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.catalog import query, table
from flowsieve.catalog.text import CONTEXT_SQL, rule_sql
from flowsieve.catalog.views import EVE_SQL, event_rows
from flowsieve.functions.context import context_text
from flowsieve.operators.propagate import label_contexts, propagate, propagate_legacy
from flowsieve.operators.ranking import number_rows
from flowsieve.operators.select import exemplars, outliers
from flowsieve.operators.split import class_weights as weights, split_quota, train_test
from flowsieve.plans.sanity import sample_labels
from flowsieve.schema import LABEL_MALFORMED, LABEL_UNCLASSIFIED, LEGACY_DEFAULT_LABEL

_CLUSTER = ("case event_type when 'signup' then 0 when 'click' then 1 when 'view' then 2 "
            "when 'purchase' then 3 else -1 end")


def _clustered_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.expr(_CLUSTER).alias("cluster_label"), F.col("value").alias("cluster_probability"), "props")


@query(f"""with c as (select event_id, {_CLUSTER} as cluster_label, value as cluster_probability, props from events)
select * from c where cluster_label <> -1
qualify row_number() over (partition by cluster_label order by cluster_probability desc, event_id) = 1""")
def exemplar_per_group(spark, sf_dir):
    """The highest-scored row per group, the earliest on ties."""
    return exemplars(_clustered_events(spark, sf_dir), tie="event_id")


@query(f"""with c as (select event_id, {_CLUSTER} as cluster_label, value as cluster_probability, props from events)
select * from c where cluster_label = -1 order by cluster_probability, event_id limit 100""")
def outlier_topk(spark, sf_dir):
    """The 100 noise rows with the lowest score."""
    return outliers(_clustered_events(spark, sf_dir), 100, tie="event_id")


# Clusters of events by application protocol; alerts are noise, scored by their id.
_EVE_CLUSTER = "case event_type when 'http' then 0 when 'tls' then 1 when 'dns' then 2 when 'flow' then 3 else -1 end"
_REVIEW_SQL = f"""{EVE_SQL}, c as (select *, {_EVE_CLUSTER} as cluster_label, ((ord * 7919) % 1000) / 1000.0 as cluster_probability from eve),
ex as (select *, {CONTEXT_SQL} as context from c where cluster_label <> -1
  qualify row_number() over (partition by cluster_label order by cluster_probability desc, ord) = 1),
ou as (select *, {CONTEXT_SQL} as context from c where cluster_label = -1 order by cluster_probability, ord limit 100),
exl as (select cluster_label, {rule_sql('context')} as label from ex),
oul as (select ord, {rule_sql('context')} as label from ou)"""


def _review(spark, sf_dir):
    rows = event_rows(spark, sf_dir).withColumns({
        "cluster_label": F.expr(_EVE_CLUSTER),
        "cluster_probability": (F.col("ord") * 7919) % 1000 / 1000.0,
    })

    def labeled(picked):
        texts = picked.withColumn("context", context_text(picked.drop("cluster_label", "cluster_probability")))
        return label_contexts(texts.select("ord", "cluster_label", "context"))

    return rows, labeled(exemplars(rows)), labeled(outliers(rows, 100, tie="ord"))


@query(f"""with {_REVIEW_SQL} select c.ord, c.cluster_label, case when c.cluster_label = -1
then coalesce(oul.label, '{LABEL_MALFORMED}') else coalesce(exl.label, '{LABEL_UNCLASSIFIED}') end as target_label
from c left join exl using (cluster_label) left join oul on oul.ord = c.ord""")
def label_propagation(spark, sf_dir):
    """Labels of exemplars to their clusters, of reviewed outliers to themselves, defaults to the rest."""
    rows, exemplar_labels, outlier_labels = _review(spark, sf_dir)
    return propagate(rows, exemplar_labels, outlier_labels, key="ord").select(
        "ord", "cluster_label", "target_label")


@query(f"""with {_REVIEW_SQL} select cluster_label, flow_id, array_to_string(string_split(context
 || chr(10) || '- Cluster: ' || cluster_label || ' (membership probability ' || cluster_probability::double || ')', chr(10))[1:8], chr(10)) as context,
 {rule_sql('context')} as label, 0.0::double as confidence from ex""")
def sample_contexts(spark, sf_dir):
    """Short descriptions of the first exemplars, with labels."""
    rows = event_rows(spark, sf_dir).withColumns({
        "cluster_label": F.expr(_EVE_CLUSTER),
        "cluster_probability": ((F.col("ord") * 7919) % 1000 / 1000.0).cast("double"),
    })
    return sample_labels(rows, 5)


_SCORED = "case when l.ord % 2 = 0 then 0.9 else 0.2 end"


@query(f"""with {_REVIEW_SQL}, exo as (select ord, {rule_sql('context')} as label from ex),
l as (select ord, label from oul union all select ord, label from exo as l where {_SCORED} > 0.3)
select c.ord, coalesce(l.label, '{LEGACY_DEFAULT_LABEL}') as target_label from c left join l using (ord)""")
def label_propagation_legacy(spark, sf_dir):
    """Older rule: only the reviewed rows themselves get a label, exemplars above a score."""
    rows, exemplar_labels, outlier_labels = _review(spark, sf_dir)
    score = F.when(F.col("ord") % 2 == 0, 0.9).otherwise(0.2)
    return propagate_legacy(
        rows, exemplar_labels.withColumn("score", score), outlier_labels.withColumn("score", score),
        key="ord").select("ord", "target_label")


def quota_sql(source: str, label: str) -> str:
    return f"""n as (select {label}, count(*) as n from {source} group by 1),
t as (select cast(sum(n) as bigint) as total, cast(sum(n) as bigint) - cast(ceil(sum(n) * 0.2::double) as bigint) as train from n),
s as (select {label}, n, n * train // total as whole, n * train % total as rest, train from n, t),
k as (select {label}, n - whole - case when row_number() over (order by rest desc, {label})
  <= train - sum(whole) over () then 1 else 0 end as quota from s)"""


@query(f"with {quota_sql('documents', 'lang')} select lang, quota from k")
def test_quota(spark, sf_dir):
    """Held-out rows per class by largest remainder."""
    return split_quota(table(spark, sf_dir, "documents"), "lang", 0.2)


@query(f"""with {quota_sql('events', 'event_type')} select event_id, event_type,
case when row_number() over (partition by event_type order by md5('42:' || event_id), event_id) <= quota then 'test' else 'train' end as split
from events join k using (event_type)""")
def stratified_split(spark, sf_dir):
    """Exact 80/20 split within each class."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return train_test(events, "event_id", "event_type")


@query("""select event_id, case when row_number() over (order by md5('42:' || event_id), event_id)
<= (select ceil(count(*) * 0.2::double) from events) then 'test' else 'train' end as split from events""")
def plain_split(spark, sf_dir):
    """Exact 80/20 split of the whole table."""
    return train_test(table(spark, sf_dir, "events").select("event_id"), "event_id", None)


@query("""select lang, count(*) as n, round(max(count(*)) over () / count(*), 6) as weight from documents group by lang""")
def class_weights(spark, sf_dir):
    """Balanced class weights."""
    return weights(table(spark, sf_dir, "documents"), "lang").withColumn("weight", F.round("weight", 6))


@query("select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) - 1 as position from orders")
def row_positions(spark, sf_dir):
    """Position of every row in a global order, without one sorting task."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return number_rows(orders, ["o_totalprice", "o_orderkey"], "position").select("o_orderkey", "position")
