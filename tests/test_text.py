import math
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from flowsieve.functions.context import alert_message, context_text, first_lines, legacy_context_text
from flowsieve.functions.labels import is_json_object, label_prompt, priority, reply_label, rule_label, suspicious
from flowsieve.functions.text import (
    clean_flow_id, dns_failed, entropy, norm_port, number, plain_number, text_length, trimmed,
)
from flowsieve.schema import (
    CONTINUOUS, FEATURES, LABEL_ATTACK, LABEL_C2, LABEL_DNS, LABEL_HTTP, LABEL_INTERNAL, LABEL_MALFORMED,
    LABEL_NOISE, LABEL_TLS, LABELS, dotted,
)


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def by_hand(text):
    if not text:
        return 0.0
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def test_schema_sizes():
    assert len(FEATURES) == 42 and len(set(FEATURES)) == 42 and len(CONTINUOUS) == 17 and len(LABELS) == 9


def test_entropy_and_length(spark):
    values = ["aab", "", None, "a😀😀b", "aaaa", "é.*é", "x" * 5000 + "y" * 5000]
    assert column(spark, values, entropy(F.col("c"))) == pytest.approx([by_hand(v) for v in values], abs=1e-12)
    assert column(spark, values, text_length(F.col("c"))) == [3, 0, 0, 4, 4, 4, 10000]


@settings(max_examples=5, deadline=None)
@given(values=st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00")), max_size=40))
def test_entropy_of_any_text(spark, values):
    assert column(spark, values, entropy(F.col("c"))) == pytest.approx([by_hand(v) for v in values], abs=1e-9)


def test_entropy_of_a_long_text_is_whole(spark):
    long = "ab" * 3_000_000 + "c" * 2_000_000
    assert column(spark, ["x", long, "xy"], entropy(F.col("c"))) == pytest.approx([0, by_hand(long), 1])


def test_numbers(spark):
    values = ["1", " 2.5 ", "x", None, "NaN", "1e3", "", "80f", "0x10", "inf", "1e999", "-.5", "+7."]
    assert column(spark, values, number(F.col("c"))) == [1.0, 2.5, 0, 0, 0, 1000.0, 0, 0, 0, 0, 0, -0.5, 7.0]
    assert column(spark, ["5.0", "5", "5.5", "a.0"], plain_number(F.col("c"))) == ["5", "5", "5.5", "a.0"]
    assert column(spark, ["12.0", "1.05"], clean_flow_id(F.col("c"))) == ["12", "1.05"]


def test_ports(spark):
    values = ["444", "444.0", " 444\t", "abc ", None, "", "nan", "80.9", "80d"]
    assert column(spark, values, norm_port(F.col("c"))) == ["444", "444", "444", "abc", "", "", "nan", "80", "80d"]
    assert column(spark, ["", None, "1.0"], norm_port(F.col("c"), empty_as_null=True)) == [None, None, "1"]
    assert column(spark, [" a ", None], trimmed(F.col("c"))) == ["a", ""]


def test_dns_failed(spark):
    values = ["nxdomain", "NOERROR", None, "REFUSED"]
    assert column(spark, values, dns_failed(F.col("c"))) == [1, 0, 0, 1]
    assert column(spark, values, dns_failed(F.col("c"), case_sensitive=True)) == [0, 0, 0, 1]


def test_rules_in_order(spark):
    values = ["Heartbleed beacon", "C2 dns query", "- DNS Query: x", "Application Layer: http", "TLS SNI: x",
              "warp speed", "ldap bind", "nothing", "https://x"]
    assert column(spark, values, rule_label(F.col("c"))) == [
        LABEL_ATTACK, LABEL_C2, LABEL_DNS, LABEL_HTTP, LABEL_TLS, LABEL_NOISE, LABEL_INTERNAL, LABEL_MALFORMED,
        LABEL_TLS]


def test_replies(spark):
    values = ['{"label": "%s"}' % LABEL_DNS, '{"label": "other"}', "{}", "oops", "[1]", "5", '{"label": 3}']
    assert column(spark, values, reply_label(F.col("c"))) == [
        LABEL_DNS, LABEL_MALFORMED, LABEL_MALFORMED, LABEL_MALFORMED, None, None, LABEL_MALFORMED]


def test_json_objects(spark):
    values = ['{"a":1}', ' { "a" : [1] } ', "{}", '{"a":1} x', '{"a":1}{"b":2}', "[1]", "null", "'a'", "{'a':1}", "", None]
    assert column(spark, values, is_json_object(F.col("c"))) == [True] * 3 + [False] * 8


def test_suspicious(spark):
    want = [label in (LABEL_C2, LABEL_ATTACK, LABEL_MALFORMED) for label in LABELS]
    assert column(spark, LABELS, suspicious(F.col("c"))) == want
    assert column(spark, [LABEL_C2, LABEL_DNS, None], priority(F.col("c"))) == [
        "High-priority threat", "Likely noise", "Likely noise"]
    assert all(label in label_prompt() for label in LABELS)


def test_context(spark):
    row = spark.createDataFrame(
        [("1.1.1.1", "5.0", None, None, "TCP", "ET x", "2.0", 3, 0.5)],
        "src_ip string, src_port string, dest_ip string, dest_port string, proto string, alert_signature string, "
        "alert_severity string, cluster_label int, cluster_probability double")
    text, head, short, message = row.select(
        context_text(row), first_lines(context_text(row), 2), legacy_context_text(row),
        alert_message(F.lit("L"), F.col("src_ip"), F.col("dest_ip"))).first()
    assert text.split("\n") == [
        "Network Flow Analysis:",
        "- Connection: 1.1.1.1:5 -> Unknown:Unknown",
        "- Protocol: TCP | Application Layer: None",
        "- Flow Dynamics: Sent 0 packets (0 bytes). Received 0 packets (0 bytes).",
        "- Connection State: Unknown (Reason: Unknown)",
        "- Suricata Baseline Detection: 'ET x' (Severity: 2, Category: Unknown)",
        "- Cluster: 3 (membership probability 0.5)",
    ]
    assert head == "\n".join(text.split("\n")[:2])
    assert short == "This is a TCP connection over no application layer on port unknown port sending 0 packets and 0 bytes."
    assert message == "[L] detected from 1.1.1.1 to Unknown"


def test_dotted_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "flow_age int, alert_severity_2_0 int, target_label int")
    assert dotted(df).columns == ["flow.age", "alert.severity_2.0", "target_label"]
