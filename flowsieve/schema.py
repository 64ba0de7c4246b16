"""Data model: event schema, feature list, label vocabulary, default parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

# --------------------------------------------------------------------------
# Fixed values. They define the result tables, so they are spelled out as is.
# --------------------------------------------------------------------------

# Strings with many values: turned into a length and an entropy.
HIGH_CARD_COLUMNS = [
    "tls.sni",
    "tls.subject",
    "dns.rrname",
    "http.hostname",
    "http.http_user_agent",
    "http.url",
]

# The feature matrix, in column order.
FEATURE_COLUMNS = [
    "flow.pkts_toserver",
    "flow.pkts_toclient",
    "flow.bytes_toserver",
    "flow.bytes_toclient",
    "flow.age",
    "tls.sni_length",
    "tls.sni_entropy",
    "tls.subject_length",
    "tls.subject_entropy",
    "dns.rrname_length",
    "dns.rrname_entropy",
    "http.hostname_length",
    "http.hostname_entropy",
    "http.http_user_agent_length",
    "http.http_user_agent_entropy",
    "http.url_length",
    "http.url_entropy",
    "is_dns_failed",
    "proto_TCP",
    "proto_UDP",
    "proto_ICMP",
    "proto_IPv6-ICMP",
    "proto_nan",
    "app_proto_http",
    "app_proto_tls",
    "app_proto_dns",
    "app_proto_smb",
    "app_proto_ftp",
    "app_proto_smtp",
    "app_proto_failed",
    "app_proto_nan",
    "flow.state_new",
    "flow.state_established",
    "flow.state_closed",
    "flow.state_nan",
    "flow.reason_timeout",
    "flow.reason_shutdown",
    "flow.reason_nan",
    "alert.severity_1.0",
    "alert.severity_2.0",
    "alert.severity_3.0",
    "alert.severity_nan",
]

# The first 17 features are continuous and get scaled.
CONTINUOUS_COLUMNS = FEATURE_COLUMNS[:17]

# Indicator vocabulary per low-cardinality column (null has its own indicator).
INDICATOR_VALUES = {
    "proto": ["TCP", "UDP", "ICMP", "IPv6-ICMP"],
    "app_proto": ["http", "tls", "dns", "smb", "ftp", "smtp", "failed"],
    "flow.state": ["new", "established", "closed"],
    "flow.reason": ["timeout", "shutdown"],
    "alert.severity": ["1.0", "2.0", "3.0"],
}

DNS_FAILURE_CODES = ["REFUSED", "NXDOMAIN", "SERVFAIL"]

LABEL_DNS = "Standard DNS Resolution and Naming Services"
LABEL_HTTP = "Routine Unencrypted Web Traffic (HTTP)"
LABEL_TLS = "Routine Encrypted Web Traffic (HTTPS/TLS)"
LABEL_NOISE = "Benign Background Network Noise (ICMP, ARP, DHCP)"
LABEL_INTERNAL = "Standard Internal IT and Directory Services (LDAP, SMB, Active Directory)"
LABEL_C2 = "Suspicious Command and Control (C2) Beaconing"
LABEL_ATTACK = "Known Vulnerability Exploitation or Active Attack"
LABEL_MALFORMED = "Malformed protocol anomaly or unknown suspicious behavior"
LABEL_UNCLASSIFIED = "Unclassified / Background Noise"

LABELS = [
    LABEL_DNS,
    LABEL_HTTP,
    LABEL_TLS,
    LABEL_NOISE,
    LABEL_INTERNAL,
    LABEL_C2,
    LABEL_ATTACK,
    LABEL_MALFORMED,
    LABEL_UNCLASSIFIED,
]

# First matching rule wins; a rule matches when any needle occurs in the lower-cased context.
LABEL_RULES = [
    (["heartbleed", "exploit", "attack", "trojan", "malware", "cve", "shellcode"], LABEL_ATTACK),
    (["beacon", "command and control", "c2"], LABEL_C2),
    (["dns query", "application layer: dns"], LABEL_DNS),
    (["application layer: http", "http metadata"], LABEL_HTTP),
    (["application layer: tls", "tls sni", "https"], LABEL_TLS),
    (["icmp", "arp", "dhcp"], LABEL_NOISE),
    (["smb", "ldap", "active directory"], LABEL_INTERNAL),
]

SUSPICIOUS_KEYWORDS = [
    "suspicious",
    "vulnerability",
    "active attack",
    "malformed",
    "unknown suspicious",
    "c2",
]

# The older label set and its defaults (``legacy`` options).
LEGACY_LABELS = [
    "Routine encrypted web browsing and standard HTTPS traffic",
    "Benign background network noise and routine ICMP pings",
    "Suspicious command and control beaconing or malware activity",
    "Aggressive brute force attack or password guessing",
    "Database SQL injection attack",
    "Malformed protocol anomaly or unknown suspicious behavior",
]
LEGACY_DEFAULT_LABEL = "Normal Network Traffic"
LEGACY_EMPTY_LABEL = "Protocol Anomaly or Suspicious Behavior"
LEGACY_ROUTINE_PREFIX = "Routine encrypted web browsing"

# Human-readable columns carried to the validation table.
VALIDATION_COLUMNS = [
    "timestamp",
    "src_ip",
    "src_port",
    "dest_ip",
    "dest_port",
    "proto",
    "app_proto",
    "alert.signature",
    "alert.category",
    "alert.severity",
]

# --------------------------------------------------------------------------
# Event schema. Scalars stay strings at the scan: 64-bit ids survive and a bad
# number is handled later by try_cast instead of losing the row.
# --------------------------------------------------------------------------


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


_DNS_RECORDS = T.ArrayType(_strings("rrname", "rcode"))

EVENT_SCHEMA = T.StructType(
    _strings(
        "flow_id", "timestamp", "event_type", "src_ip", "src_port", "dest_ip", "dest_port",
        "proto", "app_proto", "in_iface", "icmp_type", "icmp_code",
    ).fields
    + [
        T.StructField("flow", _strings(
            "pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient", "age",
            "state", "reason", "start", "end", "alerted")),
        T.StructField("tls", _strings("sni", "subject")),
        T.StructField("http", _strings("hostname", "http_user_agent", "url", "http_method")),
        T.StructField("dns", T.StructType(
            _strings("rrname", "rcode").fields
            + [T.StructField("queries", _DNS_RECORDS),
               T.StructField("answers", _DNS_RECORDS),
               T.StructField("grouped", T.StringType())])),
        T.StructField("alert", _strings("signature", "category", "severity")),
    ]
)


def col_name(dotted: str) -> str:
    """Column name used inside Spark for a dotted name (dots would need quoting)."""
    return re.sub(r"\W", "_", dotted)


def _leaves(schema: T.StructType) -> list[str]:
    out = []
    for f in schema.fields:
        if f.name == "dns":
            out += ["dns.rrname", "dns.rcode"]
        elif isinstance(f.dataType, T.StructType):
            out += [f"{f.name}.{g.name}" for g in f.dataType.fields]
        else:
            out.append(f.name)
    return out


EVENT_COLUMNS = _leaves(EVENT_SCHEMA)
FLAT_COLUMNS = [col_name(c) for c in EVENT_COLUMNS]
FEATURES = [col_name(c) for c in FEATURE_COLUMNS]
CONTINUOUS = [col_name(c) for c in CONTINUOUS_COLUMNS]
DOTTED_NAME = {col_name(c): c for c in EVENT_COLUMNS + FEATURE_COLUMNS}


def dotted(df: DataFrame) -> DataFrame:
    """Give result columns their public dotted names back (for sinks)."""
    return df.toDF(*[DOTTED_NAME.get(c, c) for c in df.columns])


@dataclass(frozen=True)
class Settings:
    """Parameters of the jobs, with the usual defaults."""

    dataset: str = "heartbleed"
    components: int = 5
    min_cluster_size: int = 50
    min_samples: int = 10
    max_outliers: int = 100
    test_size: float = 0.2
    seed: int = 42
    iterations: int = 500
    patience: int = 50
    learning_rate: float = 0.1
    depth: int = 6
    max_normal_events: int = 15000
    normal_event_type: str = "flow"
    alert_contains: str = "Heartbleed"
    attack_label: str = "Heartbleed"


def require_columns(df, columns: list[str], purpose: str = "") -> None:
    """Refuse a table that lacks a column, naming all that are missing and what they are for."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns{purpose and ' for ' + purpose}: {missing}")
