"""The hand-written log: one line per oddity, expected rows worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from flowsieve.operators.collapse import collapse
from flowsieve.operators.extract import extract, extract_counts, is_attack
from flowsieve.sources import events as events_module
from flowsieve.sources.events import count_blocks, read_events, read_lines, rejected_lines, with_positions


@pytest.fixture(scope="module")
def flows(spark, golden_path):
    return {r["flow_id"]: r for r in collapse(read_events(spark, golden_path)).collect()}


def test_line_counts(spark, golden_path):
    r = rejected_lines(read_lines(spark, golden_path)).first()
    assert (r["n_lines"], r["n_blank"], r["n_rejected"], r["n_events"]) == (24, 2, 5, 17)
    assert r["n_not_object"] == 3


def test_flow_rows(flows):
    first = flows["1812345678901234567"]
    assert first["src_ip"] == "10.0.0.1" and first["dest_port"] == "444"
    assert first["alert_signature"] == "ET Heartbleed Probe" and first["flow_state"] == "closed"
    assert first["event_type"] == "flow" and first["flow_alerted"] == "true"
    assert flows["3"]["app_proto"] == "http" and flows["3"]["flow_age"] == "7"
    assert flows["3"]["proto"] is None and flows["3"]["flow_pkts_toserver"] == "many"


def test_generated_ids(flows):
    generated = sorted(k for k in flows if k.startswith("generated_"))
    want = []
    for line in (9, 10):
        raw = f"t1|10.0.0.3|53|10.0.0.4|444|SCTP|{line}"
        want.append("generated_" + hashlib.sha1(raw.encode()).hexdigest()[:16])
    assert generated == sorted(want)


def test_dns_values(flows):
    generated = next(r for k, r in flows.items() if k.startswith("generated_"))
    assert (generated["dns_rrname"], generated["dns_rcode"]) == ("q.example", "nxdomain")
    assert (flows["4"]["dns_rrname"], flows["4"]["dns_rcode"]) == ("only.answers", "NOERROR")
    assert flows["5"]["dns_rrname"] == "top.level"
    assert flows["6"]["src_ip"] == "1.1.1.1" and flows["6"]["dns_rcode"] == "SERVFAIL"
    assert flows["7"]["src_ip"] == "1.1.1.2" and flows["7"]["dns_rrname"] is None
    assert flows["8"]["dns_rrname"] == "g.example"
    assert flows["9"]["dns_rrname"] is None


def test_invalid_utf8_is_replaced(flows):
    assert flows["12"]["http_hostname"] == "bad�host"


def test_strict_and_empty(spark, golden_path, tmp_path):
    with pytest.raises(ValueError):
        read_events(spark, golden_path, strict=True)
    empty = tmp_path / "empty.jsonl"
    empty.write_text("\n[1]\n")
    with pytest.raises(ValueError):
        read_events(spark, str(empty))


def test_line_numbers_over_many_blocks(spark, tmp_path):
    """Small splits: several blocks per file and several files per task."""
    for name, n in (("a", 3000), ("b", 10), ("c", 1)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        lines = read_lines(spark, str(tmp_path))
        blocks = lines.select("file", "block").distinct().count()
        rows = with_positions(lines).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 3011
    assert blocks > 5
    assert all(r["value"][1:] == str(r["line_number"]) for r in rows)
    assert sorted(r["ord"] for r in rows) == list(range(1, 3012))
    in_order = [r["value"] for r in sorted(rows, key=lambda r: r["ord"])]
    assert in_order == [f"{f}{i}" for f, n in (("a", 3000), ("b", 10), ("c", 1)) for i in range(1, n + 1)]


def test_collapse_ignores_partitioning(spark, golden_path):
    events = read_events(spark, golden_path)
    want = sorted(map(str, collapse(events).collect()))
    for n in (1, 3, 17):
        assert sorted(map(str, collapse(events.repartition(n)).collect())) == want


def test_extract(spark, golden_path):
    events = read_events(spark, golden_path)

    def ids(df):
        return sorted((r["flow_id"], r["event_type"], r["is_attack"]) for r in df.collect())

    kept = extract(events, is_attack("HEARTBLEED"), max_normal=2, normal_type="flow")
    assert ids(kept) == [("1812345678901234567", "alert", True), ("1812345678901234567", "flow", False),
                         ("3", "flow", False)]
    assert extract_counts(kept).first().asDict() == {"saved": 3, "attack": 1, "normal": 2}
    by_address = is_attack(None, src_ip="172.16.0.1", dest_ip="192.168.10.51", dest_port="444")
    kept = extract(events, by_address, max_normal=0)
    assert ids(kept) == [("13", "flow", True)]
    everything = extract(events, is_attack(None), max_normal=10_000, normal_type="any")
    assert everything.count() == 17
    assert extract(events, is_attack(None), max_normal=5, normal_type="any").count() == 5


def log_files(folder):
    folder.mkdir()
    for name in "ba":
        (folder / f"{name}.jsonl").write_text("\n".join(
            ["", "no json"] + [f'{{"src_ip": "{name}{i}", "flow_id": {i if i % 3 else "null"}}}' for i in range(40)]) + "\n")
    return str(folder)


def test_block_index_is_counted_once(spark, tmp_path, monkeypatch):
    logs, index = log_files(tmp_path / "logs"), str(tmp_path / "index")
    want = sorted(map(tuple, read_events(spark, logs).select("ord", "flow_id", "src_ip").collect()))
    assert sorted(map(tuple, read_events(spark, logs, index=index).select("ord", "flow_id", "src_ip").collect())) == want

    def counted(*_):
        raise AssertionError("counted again")

    with monkeypatch.context() as patched:
        patched.setattr(events_module, "count_blocks", counted)
        again = read_events(spark, logs, index=index)
        assert sorted(map(tuple, again.select("ord", "flow_id", "src_ip").collect())) == want
        plan = again._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("value#") and sum("text" in line for line in plan.splitlines() if "Relation" in line) == 1
    (tmp_path / "logs" / "c.jsonl").write_text('{"src_ip": "c", "flow_id": 7}\n')
    more = read_events(spark, logs, index=index)
    assert more.count() == len(want) + 1 and more.filter("src_ip = 'c'").first()["ord"] == 85


def test_block_index_of_an_empty_log(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.jsonl").write_text("\n[1]\n")
    with pytest.raises(ValueError, match="no valid JSON"):
        read_events(spark, str(tmp_path / "logs"), index=str(tmp_path / "index"))


def test_another_packing_is_an_error(spark, tmp_path):
    """Counts of other splits are refused, not used."""
    logs = log_files(tmp_path / "logs")
    blocks = count_blocks(read_lines(spark, logs)).withColumn("first_row", F.col("first_row") + 7)
    with pytest.raises(Exception, match="splits changed"):
        with_positions(read_lines(spark, logs), blocks).collect()
