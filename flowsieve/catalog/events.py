"""Queries on flows, features, extraction and tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.catalog import query, table
from flowsieve.catalog.text import ENTROPY_SQL
from flowsieve.catalog.views import EVE_SQL, event_rows
from flowsieve.operators.collapse import collapse
from flowsieve.operators.extract import extract, extract_counts, is_attack
from flowsieve.operators.features import feature_matrix, fit_scaler, indicators, robust_scale
from flowsieve.operators.ranking import exact_quantiles
from flowsieve.operators.split import value_counts as count_values
from flowsieve.operators.tuning import alert_frequency as frequency, enrich, rate_limit
from flowsieve.plans.sanity import profile as column_profile, preview
from flowsieve.runtime import stage
from flowsieve.schema import CONTINUOUS, FEATURES, FLAT_COLUMNS, HIGH_CARD_COLUMNS, INDICATOR_VALUES, col_name

_TYPES = ["view", "signup", "error", "click", "purchase"]


@query("select user_id, " + ", ".join(
    f"arg_min(value, event_id) filter (event_type = '{t}') as first_{t}" for t in _TYPES)
    + ", min(event_id) as event_id from events group by user_id")
def flow_collapse(spark, sf_dir):
    """Per user, the first value of each event type."""
    events = table(spark, sf_dir, "events").select(
        "user_id", "event_id",
        *[F.when(F.col("event_type") == t, F.col("value")).alias(f"first_{t}") for t in _TYPES])
    return collapse(events, "user_id", "event_id")


_COLLAPSED = ", ".join(
    f"arg_min({c}, ord) filter ({c} is not null) as {c}" for c in FLAT_COLUMNS if c != "flow_id")
FLOWS_SQL = f"{EVE_SQL}, flows as (select flow_id, min(ord) as ord, {_COLLAPSED} from eve group by flow_id)"


def flow_rows(spark, sf_dir):
    return collapse(event_rows(spark, sf_dir), columns=[c for c in FLAT_COLUMNS if c != "flow_id"])


@query(f"with {FLOWS_SQL} select * from flows")
def eve_collapse(spark, sf_dir):
    """One row per flow with the first value of every event column."""
    return flow_rows(spark, sf_dir)


def _feature_sql() -> str:
    number = "coalesce(case when not isnan(try_cast({0} as double)) then try_cast({0} as double) end, 0.0) as {0}"
    out = [number.format(c) for c in FEATURES[:5]]
    for c in map(col_name, HIGH_CARD_COLUMNS):
        out.append(f"cast(length(coalesce({c}, '')) as double) as {c}_length")
        out.append(f"{ENTROPY_SQL.format(c)} as {c}_entropy")
    out.append("case when upper(dns_rcode) in ('REFUSED', 'NXDOMAIN', 'SERVFAIL') then 1.0 else 0.0 end as is_dns_failed")
    for name, values in INDICATOR_VALUES.items():
        c = col_name(name)
        for v in values:
            test = f"try_cast({c} as double) = {v}" if v.endswith(".0") else f"{c} = '{v}'"
            out.append(f"case when {test} then 1.0 else 0.0 end as {col_name(c + '_' + v)}")
        out.append(f"case when {c} is null then 1.0 else 0.0 end as {c}_nan")
    return ", ".join(out)


FEATURES_SQL = f"{FLOWS_SQL}, features as (select flow_id, {_feature_sql()} from flows)"


def _rounded(columns):
    return [F.round(F.col(c), 6).alias(c) for c in columns]


def _rounded_sql(columns):
    return ", ".join(f"round(cast({c} as double), 6) as {c}" for c in columns)


@query(f"with {FEATURES_SQL} select flow_id, {_rounded_sql(FEATURES)} from features")
def feature_table(spark, sf_dir):
    """The feature matrix of every flow."""
    return feature_matrix(flow_rows(spark, sf_dir)).select("flow_id", *_rounded(FEATURES))


def _scaled_sql(source: str, keys: str, columns: list[str]) -> str:
    quants = ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) as q_{c}" for c in columns)
    scaled = ", ".join(
        f"round(({c} - q_{c}[2]) / case when q_{c}[3] = q_{c}[1] then 1 else q_{c}[3] - q_{c}[1] end, 6) as {c}"
        for c in columns)
    return f"q as (select {quants} from {source}) select {keys}, {scaled} from {source}, q"


@query(f"with {FEATURES_SQL}, {_scaled_sql('features', 'flow_id', CONTINUOUS)}")
def feature_scaled(spark, sf_dir):
    """The continuous features after robust scaling."""
    scaled, _ = robust_scale(stage(feature_matrix(flow_rows(spark, sf_dir)), "features"))
    return scaled.select("flow_id", *_rounded(CONTINUOUS))


_LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" union all ".join(
    f"select '{c}' as \"column\", unnest([0.25, 0.5, 0.75]::double[]) as probability, "
    f"round(unnest(quantile_cont({c}, [0.25, 0.5, 0.75])), 6) as value from lineitem" for c in _LINE_COLUMNS))
def quantile_fit(spark, sf_dir):
    """Exact quartiles of four columns in two counting passes."""
    return exact_quantiles(table(spark, sf_dir, "lineitem"), _LINE_COLUMNS, [0.25, 0.5, 0.75]).select(
        "column", "probability", F.round("value", 6).alias("value"))


@query(" union all ".join(
    f"select '{c}' as \"column\", round(q[2], 6) as center, round(case when q[3] = q[1] then 1 else q[3] - q[1] end, 6) as scale "
    f"from (select quantile_cont({c}, [0.25, 0.5, 0.75]) as q from orders_)" for c in ("o_totalprice", "price_band")
).replace("orders_", "(select o_totalprice, case when o_totalprice > 400000 then 1.0 else 0.0 end as price_band from orders)"))
def scaler_fit(spark, sf_dir):
    """Scaler parameters; a mostly constant column scales by 1."""
    orders = table(spark, sf_dir, "orders").withColumn(
        "price_band", F.when(F.col("o_totalprice") > 400000, 1.0).otherwise(0.0))
    return fit_scaler(orders, ["o_totalprice", "price_band"]).select(
        "column", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"))


_SCALE = [*_LINE_COLUMNS, "mostly_zero"]
_SCALE_SOURCE = ("src as (select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
                 "case when l_quantity = 50 then l_extendedprice else 0.0 end as mostly_zero from lineitem)")


@query(f"with {_SCALE_SOURCE}, {_scaled_sql('src', 'l_orderkey, l_linenumber', _SCALE)}")
def robust_scaled(spark, sf_dir):
    """Robust scaling, with one column whose interquartile range is 0."""
    rows = table(spark, sf_dir, "lineitem").withColumn(
        "mostly_zero", F.when(F.col("l_quantity") == 50, F.col("l_extendedprice")).otherwise(0.0))
    scaled, _ = robust_scale(rows, _SCALE)
    return scaled.select("l_orderkey", "l_linenumber", *_rounded(_SCALE))


@query("select event_id, " + ", ".join(
    f"case when event_type = '{t}' then 1.0::double else 0.0::double end as event_type_{t}" for t in ("view", "click"))
    + ", case when event_type is null then 1.0::double else 0.0::double end as event_type_nan from events")
def one_hot_event(spark, sf_dir):
    """Indicators for a fixed vocabulary; other values set none."""
    cols = indicators("event_type", ["view", "click"])
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in cols.items()])


_ATTACK_SQL = ("(contains(lower(coalesce(alert_signature, '')), 'heartbleed') or "
               "contains(lower(coalesce(alert_category, '')), 'heartbleed') or "
               "coalesce(dest_ip = '172.16.0.3' and cast(cast(trunc(try_cast(trim(dest_port) as double)) as bigint) as varchar) = '444', false))")
_EXTRACT_SQL = f"""{EVE_SQL}, a as (select ord, event_type, {_ATTACK_SQL} as is_attack from eve),
x as (select * from a where is_attack union all
(select * from a where not is_attack and event_type = 'http' order by ord limit 500))"""


def _extracted(spark, sf_dir):
    attack = is_attack("Heartbleed", dest_ip="172.16.0.3", dest_port="444.0")
    return extract(event_rows(spark, sf_dir), attack, max_normal=500, normal_type="http")


@query(f"with {_EXTRACT_SQL} select ord, event_type, is_attack from x")
def attack_extract(spark, sf_dir):
    """Attack events and the first 500 normal ones."""
    return _extracted(spark, sf_dir).select("ord", "event_type", "is_attack")


@query(f"""with {_EXTRACT_SQL} select count(*) as saved, count(*) filter (is_attack) as attack,
count(*) filter (not is_attack) as normal from x""")
def attack_extract_counts(spark, sf_dir):
    """How many events the extraction saved."""
    return extract_counts(_extracted(spark, sf_dir))


@query("select lang, count(*) as count from documents group by lang")
def value_counts(spark, sf_dir):
    """Rows per language."""
    return count_values(table(spark, sf_dir, "documents"), "lang")


_PROFILED = ["proto", "dns_rrname", "flow_state", "alert_severity", "flow_bytes_toclient"]


@query(f"with {FLOWS_SQL} " + " union all ".join(
    f"select '{c}' as \"column\", count(*) as n_rows, count({c}) as n_values, count({c}) > 0 as present from flows"
    for c in _PROFILED))
def profile(spark, sf_dir):
    """Which columns the flows fill, and how often."""
    return column_profile(flow_rows(spark, sf_dir), _PROFILED)


@query(f"""with {FLOWS_SQL} select least(count(*), 5) as n_rows, true as complete from flows
where flow_state is not null and dns_rrname is not null""")
def preview_complete(spark, sf_dir):
    """A five-row preview holds only complete rows (any five will do, so they are counted)."""
    rows = preview(flow_rows(spark, sf_dir), ["flow_state", "dns_rrname"])
    return rows.agg(F.count("*").alias("n_rows"),
                    F.bool_and(F.col("flow_state").isNotNull() & F.col("dns_rrname").isNotNull()).alias("complete"))


_ALERTS_SQL = f"{EVE_SQL}, al as (select * from eve where alert_signature is not null)"


@query(f"""with {_ALERTS_SQL} select time_bucket(interval '5 minutes', ts) as window_start, alert_signature, src_ip,
count(*) as n_alerts from al group by all""")
def alert_frequency(spark, sf_dir):
    """Alerts per five minutes, signature and source."""
    return frequency(event_rows(spark, sf_dir).filter("alert_signature is not null"))


@query(f"""with {_ALERTS_SQL}, w as (select ord, alert_signature, time_bucket(interval '1 day', ts) as window_start, ts from al),
r as (select *, row_number() over (partition by window_start, alert_signature order by ts, ord) as rank,
count(*) over (partition by window_start, alert_signature) as n from w)
select ord, alert_signature, window_start, cast(rank as int) as rank, greatest(n - 3, 0) as suppressed from r where rank <= 3""")
def alert_rate_limit(spark, sf_dir):
    """The first three alerts per day and signature, and how many more there were."""
    alerts = event_rows(spark, sf_dir).filter("alert_signature is not null")
    kept = rate_limit(alerts, 3, width="1 day", keys=("alert_signature",))
    return kept.select("ord", "alert_signature", "window_start", "rank", "suppressed")


@query(f"""with {EVE_SQL}, assets as (select '10.0.' || (n_nationkey * 7) || '.' || r_regionkey as src_ip, n_name as device,
r_name as segment from nation join region on n_regionkey = r_regionkey)
select ord, src_ip, device, segment from eve left join assets using (src_ip)""")
def asset_enrich(spark, sf_dir):
    """Device and segment of the source address, where known."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    assets = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.concat(F.lit("10.0."), (F.col("n_nationkey") * 7).cast("string"), F.lit("."),
                 F.col("r_regionkey").cast("string")).alias("src_ip"),
        F.col("n_name").alias("device"), F.col("r_name").alias("segment"))
    return enrich(event_rows(spark, sf_dir).select("ord", "src_ip"), assets).select(
        "ord", "src_ip", "device", "segment")
