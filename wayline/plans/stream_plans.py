"""Streams over the event log, run over all data there is; each has a batch twin in SQL or in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline import schemas
from wayline.plans.inputs import HOUR_US, POSES, q, qs
from wayline.plans.registry import query
from wayline.streaming import live


def event_stream(spark, sf):
    return live.stream_table(spark, sf, "events.parquet", schemas.EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


# windows are written once the watermark (newest event less the delay, in whole milliseconds) has passed their end
CLOSED = "window_end_us <= (SELECT (max(epoch_us(ts)) // 1000 - 10000) * 1000 FROM events)"


@query(
    "capture_health",
    f"""WITH w AS (SELECT epoch_us(ts) // {HOUR_US} * {HOUR_US} AS window_start_us, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT window_start_us, event_type, CAST(n AS BIGINT) AS n_messages FROM (SELECT *, window_start_us + {HOUR_US} AS window_end_us FROM w) WHERE {CLOSED}""",
)
def capture_health(spark, sf):
    d = live.run_available(live.capture_health(event_stream(spark, sf), "event_type", "1 hour"), "append", spark)
    return d.select(F.unix_micros("window_start").alias("window_start_us"), "event_type", "n_messages")


@query(
    "latest_state",
    """SELECT user_id, CAST(count(*) AS BIGINT) AS n_seen, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id""",
)
def latest_state(spark, sf):
    d = live.latest_state(event_stream(spark, sf), "user_id", ["event_id", "value"], ["ts", "event_id"])
    return live.run_available(d, "complete", spark, latest_only=True)


@query(
    "processing_delay",
    f"""WITH w AS (SELECT epoch_us(ts) // {HOUR_US} * {HOUR_US} AS window_start_us, event_id * 3 AS p, event_id * 3 + event_id % 100 AS d FROM events),
g AS (SELECT window_start_us, window_start_us + {HOUR_US} AS window_end_us, count(*) AS n, avg(p) AS mean_processing, max(p) AS max_processing, avg(d) AS mean_delay FROM w GROUP BY ALL)
SELECT window_start_us, CAST(n AS BIGINT) AS n, {qs('mean_processing', 3)} AS mean_processing, max_processing, {qs('mean_delay', 3)} AS mean_delay FROM g WHERE {CLOSED}""",
)
def processing_delay(spark, sf):
    """Stamps made from the event id: camera, start a little later, end three times the id after that."""
    e = event_stream(spark, sf).withColumns(
        {"camera": F.unix_micros("ts"), "start": F.unix_micros("ts") + F.col("event_id") % 100, "end": F.unix_micros("ts") + F.col("event_id") % 100 + F.col("event_id") * 3}
    )
    d = live.run_available(live.processing_delay(e, "camera", "start", "end", "1 hour"), "append", spark)
    return d.select(
        F.unix_micros("window_start").alias("window_start_us"), "n", q(F.col("mean_processing"), 3).alias("mean_processing"), "max_processing",
        q(F.col("mean_delay"), 3).alias("mean_delay"),
    )


@query(
    "live_sensor_join",
    f"""WITH {POSES} SELECT f.run_id AS user_id, f.idx AS frame, s.idx AS sensor FROM poses f JOIN poses s ON f.run_id = s.run_id AND f.kind = 'click' AND s.kind = 'view' AND s.t_us BETWEEN f.t_us - {12 * HOUR_US} AND f.t_us""",
)
def live_sensor_join(spark, sf):
    frames = event_stream(spark, sf).where("event_type = 'click'").select("user_id", F.col("event_id").alias("frame"), "ts")
    sensors = event_stream(spark, sf).where("event_type = 'view'").select("user_id", F.col("event_id").alias("sensor"), F.col("ts").alias("sensor_ts"))
    d = live.run_available(live.sensor_join(frames, sensors, "user_id", "12 HOURS"), "append", spark)
    return d.select("user_id", "frame", "sensor")


IDLE_HOURS = 60


@query(
    "live_sweeps",
    f"""WITH {POSES}, w AS (SELECT (max(t_us) // 1000 - 10000) * 1000 AS mark FROM poses),
p AS (SELECT poses.*, mark, t_us - lag(t_us) OVER (PARTITION BY run_id ORDER BY t_us, idx) > {IDLE_HOURS * HOUR_US} AS gap FROM poses, w WHERE t_us <= mark),
g AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY run_id ORDER BY t_us, idx) AS part FROM p),
d AS (
  SELECT *, last(CASE WHEN kind = 'signup' THEN t_us END IGNORE NULLS) OVER (PARTITION BY run_id, part ORDER BY t_us, idx) AS open_us,
    max(CASE WHEN kind = 'signup' THEN t_us END) OVER (PARTITION BY run_id, part) AS last_start, max(t_us) OVER (PARTITION BY run_id, part) AS last_us FROM g)
SELECT run_id AS user_id, open_us - 66000 AS sweep_us, CAST(count(*) FILTER (kind NOT IN ('signup', 'error') AND height > 10) AS BIGINT) AS n_objects,
  CAST(coalesce(sum(idx) FILTER (kind NOT IN ('signup', 'error') AND height > 10), 0) AS BIGINT) AS sum_ids
FROM d WHERE open_us IS NOT NULL AND (open_us < last_start OR mark - last_us > {IDLE_HOURS * HOUR_US}) GROUP BY run_id, open_us""",
)
def live_sweeps(spark, sf):
    """Sweeps closed by the next start or by silence; runs still within the watermark stay open."""
    e = event_stream(spark, sf)
    start = F.col("event_type") == "signup"
    keep = ~F.col("event_type").isin("signup", "error") & (F.col("value") > 10)
    d = live.run_available(live.sweep_stream(e, "user_id", start, keep, "event_id", idle_ms=IDLE_HOURS * 3_600_000), "append", spark)
    return d.select("user_id", "sweep_us", "n_objects", "sum_ids")


@query("live_tracks")
def live_tracks(spark, sf):
    """Track ids on the stream; equals the batch operator, which the tests check."""
    e = event_stream(spark, sf).select(
        (F.col("user_id") % 5).alias("seq"), "ts", F.unix_micros("ts").alias("frame_us"), "event_id",
        (F.col("event_id") % 97 * 10.0).alias("x1"), (F.col("event_id") % 89 * 10.0).alias("y1"),
    )
    # one frame is an hour; its boxes are the hour's events
    e = e.withColumns({"frame": F.floor(F.col("frame_us") / HOUR_US), "x2": F.col("x1") + 30, "y2": F.col("y1") + 20})
    return live.run_available(live.track_stream(e, "seq", "frame", "event_id"), "append", spark)
