"""Queries that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.catalog import query, table
from flowsieve.catalog.events import flow_rows
from flowsieve.catalog.views import written_lines
from flowsieve.operators.features import feature_matrix, robust_scale
from flowsieve.plans.scoring import score_batch
from flowsieve.plans.training import fit
from flowsieve.runtime import new_path, stage
from flowsieve.schema import Settings
from flowsieve.sources.events import read_events
from flowsieve.streaming.live import (
    rate_limit_stream, read_event_stream, score_stream, windowed_flows, write_alerts, write_undated,
)

_TYPES = ["view", "signup", "error", "click", "purchase"]
_FIRST_SQL = ", ".join(f"arg_min(value, event_id) filter (event_type = '{t}') as first_{t}" for t in _TYPES)


def _shaped(events):
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ord"),
        (F.col("user_id") % 5).cast("string").alias("flow_id"),
        *[F.when(F.col("event_type") == t, F.col("value")).alias(f"first_{t}") for t in _TYPES])


def _flat(windows):
    return windows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"),
                          "flow_id", *[f"first_{t}" for t in _TYPES])


@query(f"""select strftime(time_bucket(interval '5 minutes', ts), '%Y-%m-%d %H:%M') as window_start,
cast(user_id % 5 as varchar) as flow_id, {_FIRST_SQL} from events group by 1, 2""")
def flow_window_5m(spark, sf_dir):
    """Flows per five-minute window, as a batch."""
    return _flat(windowed_flows(_shaped(table(spark, sf_dir, "events")), [f"first_{t}" for t in _TYPES]))


def _event_files(spark, sf_dir, schema):
    """A stream over the events table, which is one file or a folder of part files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if files.getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/events.parquet")
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query(f"""with w as (select time_bucket(interval '5 minutes', ts) as w, cast(user_id % 5 as varchar) as flow_id, {_FIRST_SQL}
from events group by 1, 2)
select strftime(w, '%Y-%m-%d %H:%M') as window_start, flow_id, {', '.join(f'first_{t}' for t in _TYPES)} from w
where w + interval '5 minutes' <= (select max(ts) - interval '5 minutes' from events)""")
def stream_windows(spark, sf_dir):
    """The same windows from a stream: every window the watermark has closed."""
    source = table(spark, sf_dir, "events")
    events = _event_files(spark, sf_dir, source.schema)
    out = new_path(spark, "stream")
    flows = windowed_flows(_shaped(events), [f"first_{t}" for t in _TYPES])
    write_alerts(flows, f"{out}/rows", f"{out}/state").awaitTermination()
    return _flat(spark.read.schema(flows.schema).parquet(f"{out}/rows"))


@query("""with r as (select time_bucket(interval '5 minutes', ts) as w, event_type, event_id,
row_number() over (partition by time_bucket(interval '5 minutes', ts), event_type order by ts, event_id) as rank from events where ts is not null)
select strftime(w, '%Y-%m-%d %H:%M') as window_start, event_type, event_id, cast(rank as int) as rank from r where rank <= 3""")
def stream_rate_limit(spark, sf_dir):
    """The first three events of each type per five minutes, held in state by a stream."""
    events = _event_files(spark, sf_dir, table(spark, sf_dir, "events").schema)
    found = rate_limit_stream(events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id"), 3, tie="event_id", keys=("event_type",))
    out = new_path(spark, "stream")
    write_alerts(found, f"{out}/rows", f"{out}/state").awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{out}/rows").filter("rank is not null")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "event_id", "rank")


def _stamped_lines(spark, sf_dir):
    """Events as JSON lines; one in ten has no time, one in ten a time that cannot be read."""
    stamp = F.when(F.col("event_id") % 10 == 3, F.lit(None)).when(F.col("event_id") % 10 == 7, F.lit("soon")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+0000'"))
    record = F.struct(F.col("event_id").alias("flow_id"), F.col("event_type"), stamp.alias("timestamp"))
    path = new_path(spark, "lines")
    table(spark, sf_dir, "events").select(F.to_json(record).alias("value")).write.text(path)
    return path


@query("select event_type, count(*) as n from events where event_id % 10 in (3, 7) group by event_type")
def stream_undated(spark, sf_dir):
    """Events without a usable time, which no window holds, in their side table."""
    out = new_path(spark, "stream")
    events = read_event_stream(spark, _stamped_lines(spark, sf_dir))
    write_undated(events.select("flow_id", "event_type", "ts"), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("event_type").agg(F.count("*").alias("n"))


def _scorer(spark, sf_dir):
    """Boosted trees that know which flows had an alert, and the scaler they were trained with."""
    flows = flow_rows(spark, sf_dir).withColumn("h_alert", F.col("alert_signature"))
    label = F.when(F.col("h_alert").isNotNull(), "Suspicious activity").otherwise("Routine traffic")
    features, params = robust_scale(stage(feature_matrix(flows, keep=["flow_id", "h_alert"]), "features"))
    model = fit(features.withColumn("target_label", label), Settings())
    return model, params


@query()
def stream_score(spark, sf_dir):
    """Alerts of a JSON-lines stream, scored with a model trained on the batch flows."""
    model, params = _scorer(spark, sf_dir)
    logs, out = written_lines(spark, sf_dir), new_path(spark, "alerts")
    found = score_stream(read_event_stream(spark, logs), model, params)
    write_alerts(found, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{out}/rows")


@query()
def batch_score(spark, sf_dir):
    """Alert lines of one batch of log files."""
    model, params = _scorer(spark, sf_dir)
    return score_batch(read_events(spark, written_lines(spark, sf_dir)), model, params)
