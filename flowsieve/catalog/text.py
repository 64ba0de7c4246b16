"""Queries on text measures, parsing and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.catalog import query, table
from flowsieve.catalog.views import EVE_SQL, event_lines, event_rows, written_lines
from flowsieve.functions.context import alert_message, context_text, first_lines, legacy_context_text
from flowsieve.functions.labels import reply_label, rule_label, suspicious, priority
from flowsieve.functions.text import (
    clean_flow_id, entropy, fallback_flow_id, norm_port, number, text_length, trimmed,
)
from flowsieve.runtime import new_path
from flowsieve.schema import FLAT_COLUMNS, LABELS, LABEL_MALFORMED, LABEL_RULES, SUSPICIOUS_KEYWORDS
from flowsieve.sources.events import parse_events, read_lines, rejected_lines, with_positions

ENTROPY_SQL = "coalesce(list_aggregate(string_split({0}, ''), 'entropy'), 0.0)"


@query(f"select page_id, length(url) as url_length, round({ENTROPY_SQL.format('url')}, 6) as url_entropy from pages")
def url_entropy(spark, sf_dir):
    """Length and entropy of every URL."""
    return table(spark, sf_dir, "pages").select(
        "page_id", text_length(F.col("url")).cast("bigint").alias("url_length"),
        F.round(entropy(F.col("url")), 6).alias("url_entropy"))


@query(f"""select lang, count(*) as n_docs, round(avg(e), 6) as avg_entropy, round(max(e), 6) as max_entropy
from (select lang, {ENTROPY_SQL.format('text')} as e from documents) group by lang""")
def doc_entropy_by_lang(spark, sf_dir):
    """Character entropy of whole documents, per language."""
    docs = table(spark, sf_dir, "documents").select("lang", entropy(F.col("text")).alias("e"))
    return docs.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.round(F.avg("e"), 6).alias("avg_entropy"),
        F.round(F.max("e"), 6).alias("max_entropy"))


@query("""select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), 0.0) as k,
coalesce(try_cast(event_type as double), 0.0) as bad from events""")
def json_props(spark, sf_dir):
    """Number out of a JSON text; what is no number becomes 0."""
    return table(spark, sf_dir, "events").select(
        "event_id", number(F.from_json("props", "k string")["k"]).alias("k"),
        number(F.col("event_type")).alias("bad"))


_PARSED = ", ".join(c for c in FLAT_COLUMNS if c != "flow_id")


@query(f"""with {EVE_SQL} select ord, case when ord % 10 <> 6 then flow_id end as flow_id, {_PARSED}
from eve where ord % 10 not in (7, 8, 9)""")
def eve_parse(spark, sf_dir):
    """Log files to flat events; broken lines skipped, DNS values found wherever they are."""
    lines = with_positions(read_lines(spark, written_lines(spark, sf_dir))).drop("file", "line_number")
    return parse_events(lines).withColumn("ord", F.col("ord") - 1)


@query("""select count(*) as n_lines, count(*) filter (event_id % 10 = 7) as n_blank,
count(*) filter (event_id % 10 in (8, 9)) as n_rejected, count(*) filter (event_id % 10 < 7) as n_events,
count(*) filter (event_id % 10 = 9) as n_not_object from events""")
def reject_counts(spark, sf_dir):
    """Usable, blank and rejected lines."""
    return rejected_lines(read_lines(spark, written_lines(spark, sf_dir)))


@query("select event_id, event_id + 1 as ord from events")
def line_positions(spark, sf_dir):
    """Positions of the lines of written text files; ids were written in order."""
    path = new_path(spark, "lines")
    lines = event_lines(spark, sf_dir).withColumn("id", F.lpad(F.col("ord").cast("string"), 20, "0"))
    lines.repartitionByRange("ord").sortWithinPartitions("ord").select(
        F.concat("id", F.lit(" "), "value").alias("value")).write.text(path)
    return with_positions(read_lines(spark, path)).select(
        F.substring("value", 1, 20).cast("bigint").alias("event_id"), "ord")


@query(f"""with {EVE_SQL} select ord, 'generated_' || substr(sha1(concat_ws('|', timestamp, src_ip, src_port, dest_ip,
coalesce(dest_port, ''), coalesce(proto, ''), cast(ord + 1 as varchar))), 1, 16) as flow_id from eve""")
def fallback_id(spark, sf_dir):
    """Generated id of events that have none."""
    return event_rows(spark, sf_dir).select(
        "ord", fallback_flow_id(F.col("ord") + 1).alias("flow_id"))


@query(f"""with {EVE_SQL} select ord, coalesce(cast(cast(trunc(try_cast(trim(dest_port) as double)) as bigint) as varchar),
trim(dest_port), '') as port, coalesce(cast(cast(trunc(try_cast(trim(dest_port) as double)) as bigint) as varchar), trim(dest_port)) as port_or_null,
trim(coalesce(alert_category, '')) as category, regexp_replace(flow_pkts_toclient, '\\.0$', '') as clean_id from eve""")
def port_norm(spark, sf_dir):
    """Ports and other texts in their compared form."""
    return event_rows(spark, sf_dir).select(
        "ord", norm_port(F.col("dest_port")).alias("port"),
        norm_port(F.col("dest_port"), empty_as_null=True).alias("port_or_null"),
        trimmed(F.col("alert_category")).alias("category"),
        clean_flow_id(F.col("flow_pkts_toclient")).alias("clean_id"))


@query("""select l_orderkey, l_linenumber,
cast(cast(trunc(try_cast(cast(l_quantity as varchar) as double)) as bigint) as varchar) as port from lineitem""")
def port_norm_lineitem(spark, sf_dir):
    """Port rule on the text form of a double."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", norm_port(F.col("l_quantity")).alias("port"))


_SUSPICIOUS = "|".join(SUSPICIOUS_KEYWORDS)


@query(f"""select doc_id, cast(regexp_matches(text, '{_SUSPICIOUS}|erthe', 'i') as int) as hit,
cast(regexp_matches(text, '{_SUSPICIOUS}', 'i') as int) as suspicious from documents""")
def suspicious_flag(spark, sf_dir):
    """Keyword flag on whole documents (and with one pattern that occurs in them)."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", (suspicious(text) | text.rlike("(?i)erthe")).cast("int").alias("hit"),
        suspicious(text).cast("int").alias("suspicious"))


def rule_sql(expr: str) -> str:
    """The label rules as a CASE expression."""
    whens = " ".join(
        "when " + " or ".join(f"contains(lower({expr}), '{n}')" for n in needles) + f" then '{label}'"
        for needles, label in LABEL_RULES)
    return f"case {whens} else '{LABEL_MALFORMED}' end"


@query(f"""select doc_id, {rule_sql('text')} as label from documents""")
def rule_label_docs(spark, sf_dir):
    """Keyword rules on whole documents."""
    return table(spark, sf_dir, "documents").select("doc_id", rule_label(F.col("text")).alias("label"))


def _plain(c: str) -> str:
    return f"regexp_replace({c}, '^(-?[0-9]+)\\.0+$', '\\1')"


def _or(c: str, default: str) -> str:
    return f"coalesce({_plain(c)}, '{default}')"


# The context text, written again in SQL.
CONTEXT_SQL = f"""concat_ws(chr(10), 'Network Flow Analysis:',
'- Connection: ' || {_or('src_ip', 'Unknown')} || ':' || {_or('src_port', 'Unknown')} || ' -> ' || {_or('dest_ip', 'Unknown')} || ':' || {_or('dest_port', 'Unknown')},
'- Protocol: ' || coalesce(proto, 'Unknown') || ' | Application Layer: ' || coalesce(app_proto, 'None'),
'- Flow Dynamics: Sent ' || {_or('flow_pkts_toserver', '0')} || ' packets (' || {_or('flow_bytes_toserver', '0')} || ' bytes). Received ' || {_or('flow_pkts_toclient', '0')} || ' packets (' || {_or('flow_bytes_toclient', '0')} || ' bytes).',
'- Connection State: ' || coalesce(flow_state, 'Unknown') || ' (Reason: ' || coalesce(flow_reason, 'Unknown') || ')',
'- HTTP Metadata: Hostname ''' || http_hostname || ''', Method ''' || coalesce(http_http_method, 'Unknown') || ''', URL ''' || coalesce(http_url, 'Unknown') || '''',
'- HTTP User-Agent: ' || http_http_user_agent,
'- DNS Query: Requested ''' || dns_rrname || ''' (Response Code: ' || coalesce(dns_rcode, 'Unknown') || ')',
'- TLS SNI: ' || tls_sni,
'- TLS Certificate Subject: ' || tls_subject,
'- Suricata Baseline Detection: ''' || alert_signature || ''' (Severity: ' || {_or('alert_severity', 'Unknown')} || ', Category: ' || coalesce(alert_category, 'Unknown') || ')')"""

LEGACY_CONTEXT_SQL = f"""'This is a ' || coalesce(proto, 'unknown protocol') || ' connection over '
|| coalesce(app_proto, 'no application layer') || ' on port ' || {_or('dest_port', 'unknown port')}
|| ' sending ' || {_or('flow_pkts_toserver', '0')} || ' packets and ' || {_or('flow_bytes_toserver', '0')} || ' bytes.'"""


@query(f"""with {EVE_SQL} select ord, {CONTEXT_SQL} as context, {LEGACY_CONTEXT_SQL} as legacy,
'[' || proto || '] detected from ' || coalesce(src_ip, 'Unknown') || ' to ' || coalesce(tls_sni, 'Unknown') as message from eve""")
def context(spark, sf_dir):
    """Long and short description and alert line of every event."""
    rows = event_rows(spark, sf_dir)
    return rows.select(
        "ord", context_text(rows).alias("context"), legacy_context_text(rows).alias("legacy"),
        alert_message(F.col("proto"), F.col("src_ip"), F.col("tls_sni")).alias("message"))


@query(f"""with {EVE_SQL}, c as (select ord, {CONTEXT_SQL} as context from eve)
select ord, array_to_string(string_split(context, chr(10))[1:4], chr(10)) as head, {rule_sql('context')} as label,
case when regexp_matches({rule_sql('context')}, '{_SUSPICIOUS}', 'i') then 'High-priority threat' else 'Likely noise' end as priority
from c""")
def rule_label_context(spark, sf_dir):
    """Keyword rules and priority on the descriptions, with their first lines."""
    rows = event_rows(spark, sf_dir)
    texts = rows.select("ord", context_text(rows).alias("context"))
    label = rule_label(F.col("context"))
    return texts.select("ord", first_lines(F.col("context"), 4).alias("head"), label.alias("label"),
                        priority(label).alias("priority"))


_REPLY = ("case event_id % 5 when 0 then '{\"label\": \"' || label || '\"}' when 1 then '{\"label\": \"none of these\"}' "
          "when 2 then props when 3 then '[' || event_id || ']' else 'no json' end")


@query(f"""select event_id, case event_id % 5 when 0 then label when 3 then null else '{LABEL_MALFORMED}' end as label
from (select event_id, ({LABELS!r})[event_id % 9 + 1] as label from events)""")
def reply_parse(spark, sf_dir):
    """Labels out of JSON replies: known, unknown, missing, no object, no JSON."""
    labels = F.array(*[F.lit(v) for v in LABELS])
    replies = table(spark, sf_dir, "events").select(
        "event_id", "props", F.get(labels, (F.col("event_id") % 9).cast("int")).alias("label"))
    return replies.select("event_id", reply_label(F.expr(_REPLY)).alias("label"))
