"""Event rows shaped like a network log, derived from ``events`` and ``pages``.

The expressions below are plain SQL that Spark and DuckDB read alike, so both sides of a
check start from the same rows. Three consecutive events form a flow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsieve.catalog import table
from flowsieve.runtime import new_path, stage
from flowsieve.schema import FLAT_COLUMNS

_HOST = "split_part(split_part(url, '//', 2), '/', 1)"

_EXPRESSIONS = {
    "flow_id": "cast(cast(floor(event_id / 3.0) as bigint) as varchar(20))",
    "timestamp": "{stamp}",
    "event_type": "case event_type when 'view' then 'http' when 'click' then 'tls' when 'signup' then 'dns' "
                  "when 'error' then 'alert' else 'flow' end",
    "src_ip": "concat('10.0.', cast(user_id % 256 as varchar(20)), '.', cast(user_id % 5 as varchar(20)))",
    "src_port": "cast(1024 + event_id % 50000 as varchar(20))",
    "dest_ip": "concat('172.16.0.', cast(user_id % 7 as varchar(20)))",
    "dest_port": "case event_id % 4 when 0 then '444' when 1 then '443.0' when 2 then ' 53' end",
    "proto": "case when event_id % 15 < 5 then 'TCP' when event_id % 15 < 9 then 'UDP' "
             "when event_id % 15 = 9 then 'ICMP' when event_id % 15 = 10 then 'IPv6-ICMP' "
             "when event_id % 15 = 11 then 'SCTP' end",
    "app_proto": "case event_type when 'view' then 'http' when 'click' then 'tls' when 'signup' then 'dns' "
                 "when 'error' then 'failed' end",
    "in_iface": "'eth0'",
    "icmp_type": "case when event_id % 15 = 9 then '8' end",
    "icmp_code": "case when event_id % 15 = 9 then '0' end",
    "flow_pkts_toserver": "case when event_type <> 'error' then cast(event_id % 97 as varchar(20)) end",
    "flow_pkts_toclient": "case when event_type <> 'error' then concat(cast(user_id % 31 as varchar(20)), '.0') end",
    "flow_bytes_toserver": "case when event_type in ('view', 'click', 'purchase') "
                           "then cast(cast(round(value * 100) as bigint) as varchar(20)) end",
    "flow_bytes_toclient": "case when event_type = 'purchase' then cast(event_id * 7 % 5000 as varchar(20)) end",
    "flow_age": "case when event_id % 11 = 0 then 'n/a' else cast(event_id % 60 as varchar(20)) end",
    "flow_state": "case event_id % 9 when 0 then 'new' when 1 then 'established' when 2 then 'established' "
                  "when 3 then 'closed' when 4 then 'bypassed' end",
    "flow_reason": "case user_id % 4 when 0 then 'timeout' when 1 then 'shutdown' end",
    "flow_start": "{stamp}",
    "flow_end": "case when event_type = 'purchase' then {stamp} end",
    "flow_alerted": "case when event_type = 'error' then 'true' else 'false' end",
    "tls_sni": f"case when event_type = 'click' then {_HOST} end",
    "tls_subject": f"case when event_type = 'click' and user_id % 2 = 0 then concat('CN=', {_HOST}) end",
    "http_hostname": f"case when event_type = 'view' then {_HOST} end",
    "http_http_user_agent": "case when event_type = 'view' and user_id % 3 > 0 "
                            "then concat('agent/', cast(user_id % 13 as varchar(20))) end",
    "http_url": "case when event_type = 'view' then url end",
    "http_http_method": "case when event_type = 'view' then case when event_id % 2 = 0 then 'GET' else 'POST' end end",
    "dns_rrname": f"case when event_type = 'signup' then {_HOST} end",
    "dns_rcode": "case when event_type = 'signup' then case user_id % 4 when 0 then 'NXDOMAIN' "
                 "when 1 then 'servfail' when 2 then 'NOERROR' end end",
    "alert_signature": "case when event_type = 'error' then case user_id % 6 when 0 then 'Heartbleed probe' "
                       "when 1 then 'Trojan callback' when 2 then 'Beacon check-in' when 3 then 'SMB session' "
                       "when 4 then 'ICMP ping' else 'Stream event' end end",
    "alert_category": "case when event_type = 'error' then case user_id % 4 when 0 then 'Misc activity' "
                      "when 1 then 'Heartbleed family' else 'Not suspicious' end end",
    "alert_severity": "case when event_type = 'error' then case when user_id % 2 = 0 "
                      "then cast(1 + event_id % 3 as varchar(20)) else concat(cast(1 + event_id % 3 as varchar(20)), '.0') end end",
}

_SPARK_STAMP = "date_format(ts, 'yyyy-MM-dd\\'T\\'HH:mm:ss.SSSSSS')"
_DUCK_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"


def _select(stamp: str) -> str:
    cols = ",\n  ".join(f"{_EXPRESSIONS[c].replace('{stamp}', stamp)} as {c}" for c in FLAT_COLUMNS)
    return f"select event_id as ord, ts, user_id,\n  {cols}\n"


_PAGE_KEY = "(select *, event_id % (select count(*) from {pages}) as page_key from {events})"

# ``eve`` as a common table expression for DuckDB.
EVE_SQL = (
    "eve as (" + _select(_DUCK_STAMP)
    + "from " + _PAGE_KEY.format(pages="pages", events="events")
    + " e join pages p on p.page_id = e.page_key)"
)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat event rows with ``ord`` (the event id), ``ts`` and ``user_id``."""
    events, pages = table(spark, sf_dir, "events"), table(spark, sf_dir, "pages")
    n_pages = pages.agg(F.count("*")).scalar()
    keyed = events.withColumn("page_key", F.col("event_id") % n_pages)
    joined = keyed.join(pages, keyed["page_key"] == pages["page_id"])
    exprs = {c: _EXPRESSIONS[c].replace("{stamp}", _SPARK_STAMP) for c in FLAT_COLUMNS}
    return joined.select("ts", "user_id", F.col("event_id").alias("ord"), "url", "event_id", "event_type", "value"
                         ).selectExpr("ord", "ts", "user_id", *[f"{e} as {c}" for c, e in exprs.items()])


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows as JSON lines (``ord``, ``value``), with blank and broken lines among them.

    DNS values sit at the top level or in one of three lists; some events lack an id. One
    line in ten is blank, one has text after the object, one is no object.
    """
    rows = event_rows(spark, sf_dir)
    record = F.array(F.struct(F.col("dns_rrname").alias("rrname"), F.col("dns_rcode").alias("rcode")))
    has_dns = F.col("dns_rrname").isNotNull()
    place = F.col("ord") % 4

    def nested(prefix: str):
        names = [c for c in FLAT_COLUMNS if c.startswith(prefix + "_") and c != "flow_id"]
        return F.struct(*[F.col(c).alias(c[len(prefix) + 1:]) for c in names]).alias(prefix)

    groups = ("flow", "tls", "http", "dns", "alert")
    plain = [c for c in FLAT_COLUMNS if c != "flow_id" and not c.startswith(tuple(g + "_" for g in groups))]
    event = F.to_json(F.struct(
        F.when(F.col("ord") % 10 != 6, F.col("flow_id").cast("bigint")).alias("flow_id"),
        *plain, nested("flow"), nested("tls"), nested("http"), nested("alert"),
        F.when(has_dns, F.struct(
            F.when(place == 0, F.col("dns_rrname")).alias("rrname"),
            F.when(place == 0, F.col("dns_rcode")).alias("rcode"),
            F.when(place == 1, record).alias("queries"),
            F.when(place == 2, record).alias("answers"),
            F.when(place == 3, record).alias("grouped"),
        )).alias("dns"),
    ))
    broken = F.col("ord") % 10
    return rows.select("ord", F.when(broken == 7, "  ").when(broken == 8, F.concat(event, F.lit(" tail")))
                       .when(broken == 9, F.concat(F.lit("["), event, F.lit("]"))).otherwise(event).alias("value"))


def written_lines(spark: SparkSession, sf_dir: str) -> str:
    """The JSON lines as a folder of text files, in event order over the files."""
    path = new_path(spark, "lines")
    # staged, because a range partition reads its input twice
    stage(event_lines(spark, sf_dir), "json").repartitionByRange("ord").sortWithinPartitions("ord").select(
        "value").write.text(path)
    return path
