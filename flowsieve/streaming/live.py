"""Five-minute scoring of a live event log.

Flows are collapsed per event-time window; a window closes when the watermark passes its
end, and events later than that are dropped. A flow that spans two windows is scored once
in each, as it would be in two consecutive batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from flowsieve.functions.text import fallback_flow_id
from flowsieve.plans.scoring import alerts, score_flows
from flowsieve.plans.training import Model
from flowsieve.sources.events import parse_events

#: Open windows are kept on the executors' disks, with so much memory (MB) for all that an executor holds.
_STORE = "spark.sql.streaming.stateStore."
STATE = {
    f"{_STORE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}rocksdb.boundedMemoryUsage": "true", f"{_STORE}rocksdb.maxMemoryUsageMB": "256",
}


def read_event_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """New JSON-lines files of a folder as events with an event time ``ts``.

    ``files_per_batch`` bounds a micro-batch, so that a backlog is worked off in steps.

    Order within a flow comes from the data (time, then a hash of the line). The fallback id
    uses that hash in place of a line number.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(folder).select(F.make_valid_utf8("value").alias("value"))
    events = parse_events(lines.withColumn("line_hash", F.sha1("value")))
    return (
        events.withColumn("ts", F.col("timestamp").try_cast("timestamp"))
        .withColumn("flow_id", F.coalesce("flow_id", fallback_flow_id(F.col("line_hash"))))
        .withColumn("ord", F.struct("ts", "line_hash"))
        .drop("line_hash")
    )


def windowed_flows(events: DataFrame, columns: list[str], width: str = "5 minutes",
                   delay: str = "5 minutes") -> DataFrame:
    """One row per window and flow, with the first non-null value of each column.

    The same code serves a stream and a table; on a table the watermark has no effect. Events
    without a time belong to no window: ``undated`` gives them, to be written beside the alerts.
    """
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in columns]
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "flow_id").agg(*first)
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "flow_id", *columns)
    )


def undated(events: DataFrame) -> DataFrame:
    """Events whose time is missing or cannot be parsed, which no window holds."""
    return events.filter(F.col("ts").isNull())


def score_stream(events: DataFrame, model: Model, params: dict,
                 benign_labels: list[str] | None = None, width: str = "5 minutes",
                 delay: str = "5 minutes") -> DataFrame:
    """Alert rows of a stream of events."""
    columns = [c for c in events.columns if c not in ("flow_id", "ord", "ts")]
    flows = windowed_flows(events, columns, width, delay)
    scored = score_flows(
        flows, model, params, ["window_start", "flow_id", "src_ip", "dest_ip"])
    return alerts(scored, benign_labels)


def rate_limit_stream(alerts: DataFrame, keep: int, ts: str = "ts", tie: str = "ord", width_seconds: int = 300,
                      delay: str = "5 minutes", keys: tuple[str, ...] = ("alert_signature", "src_ip")) -> DataFrame:
    """The first ``keep`` alerts per window, signature and source of a stream, as they come, and closing counts.

    Rows are ``window_start``, the keys, ``ts``, ``tie``, ``rank`` for an alert that passes; and, once the watermark has passed a window's
    end, one row with null ``ts``, ``tie`` and ``rank`` and ``suppressed``, how many more there were. Ranks follow (``ts``, ``tie``) within
    a micro-batch and arrival across them, so with alerts in order of time they are those of ``rate_limit``.
    State is one pair of numbers per key and open window; a timer drops it. It is in the checkpoint, so a
    restarted query goes on where it was. Alerts later than the watermark and without a time are left out here.
    """
    fields = alerts.schema
    kinds = {k: fields[k].dataType.simpleString() for k in (*keys, ts, tie)}
    window = F.window(ts, f"{width_seconds} seconds")["start"]
    rows = alerts.filter(F.col(ts).isNotNull()).withWatermark(ts, delay).select(window.alias("window_start"), *keys, ts, tie)

    def step(key: tuple, batches, state):
        base = {"window_start": [key[0]], **{k: [v] for k, v in zip(keys, key[1:])}}
        if state.hasTimedOut:
            seen, = state.get
            state.remove()
            yield pd.DataFrame({**base, ts: [pd.NaT], tie: [None], "rank": [None], "suppressed": [max(0, seen - keep)]})
            return
        seen = state.get[0] if state.exists else 0
        found = pd.concat(list(batches)).sort_values([ts, tie])
        passed = found.head(max(0, keep - seen))
        if len(passed):
            yield pd.DataFrame({**{c: v * len(passed) for c, v in base.items()}, ts: passed[ts].to_numpy(), tie: passed[tie].to_numpy(),
                                "rank": range(seen + 1, seen + 1 + len(passed)), "suppressed": [None] * len(passed)})
        state.update((seen + len(found),))
        state.setTimeoutTimestamp(int(key[0].timestamp() * 1000) + 1000 * width_seconds)

    out = ", ".join(["window_start timestamp", *[f"{c} {kinds[c]}" for c in (*keys, ts, tie)], "rank int", "suppressed bigint"])
    return rows.groupBy("window_start", *keys).applyInPandasWithState(step, out, "seen bigint", "append", GroupStateTimeout.EventTimeTimeout)


def write_undated(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the events without a usable time to a side table, which ``score_stream`` cannot place in a window."""
    return write_alerts(undated(events), path, checkpoint, trigger)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their window was closed, by the progress reports of a query since it was started."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def write_alerts(alert_rows: DataFrame, path: str, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """Append alert rows to a table; the checkpoint makes each window's output exactly once.

    The trigger defaults to everything available now; a service passes
    ``{"processingTime": "5 minutes"}``. State is kept as ``STATE`` says unless the session names a provider; a query that
    goes on from a checkpoint keeps the one it was started with.
    """
    conf = alert_rows.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE}
    chosen = STATE if before[f"{_STORE}providerClass"] is None else {}
    for k, v in chosen.items():
        conf.set(k, v)
    try:  # a query has the settings of its start
        return (
            alert_rows.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )
    finally:
        for k in chosen:
            conf.unset(k) if before[k] is None else conf.set(k, before[k])
