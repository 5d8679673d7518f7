"""Time alignment and ordered work on the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import blocks, segments, timejoin
from wayline.plans.inputs import DAY_US, HOUR_US, POINTS, POSES, points, poses, q, qs, table
from wayline.plans.registry import query

BLOCK_US = 5 * DAY_US


def kind(df, *names):
    return df.where(F.col("kind").isin(*names))


@query(
    "frame_map",
    f"""WITH {POSES}
SELECT f.run_id, f.idx AS frame, f.t_us AS cam_us, s.idx AS sweep, s.t_us AS sweep_us
FROM (SELECT * FROM poses WHERE kind = 'click') f
ASOF JOIN (SELECT * FROM poses WHERE kind = 'view') s ON f.run_id = s.run_id AND f.t_us >= s.t_us""",
)
def frame_map(spark, sf):
    p = poses(spark, sf)
    frames = kind(p, "click").select("run_id", F.col("idx").alias("frame"), F.col("t_us").alias("cam_us"))
    sweeps = kind(p, "view").select("run_id", F.col("idx").alias("sweep"), F.col("t_us").alias("sweep_us"))
    return timejoin.asof_backward(frames, sweeps, ["run_id"], "cam_us", "sweep_us", ["sweep", "sweep_us"], BLOCK_US, tie="sweep")


@query(
    "next_record",
    f"""WITH {POSES}
SELECT f.run_id, f.idx AS frame, r.t_us AS record_us, CAST(count(*) AS BIGINT) AS n_records, CAST(sum(r.idx) AS BIGINT) AS sum_idx
FROM (SELECT * FROM poses WHERE kind = 'click') f
JOIN (SELECT * FROM poses WHERE kind IN ('purchase', 'signup')) r ON r.run_id = f.run_id
 AND r.t_us = (SELECT min(x.t_us) FROM poses x WHERE x.run_id = f.run_id AND x.kind IN ('purchase', 'signup') AND x.t_us > f.t_us)
GROUP BY ALL""",
)
def next_record(spark, sf):
    p = poses(spark, sf)
    frames = kind(p, "click").select("run_id", F.col("idx").alias("frame"), "t_us")
    recs = kind(p, "purchase", "signup").select("run_id", "idx", F.col("t_us").alias("record_us"))
    times = recs.groupBy("run_id", "record_us").agg(F.count("*").alias("n_records"), F.sum("idx").alias("sum_idx"))
    return timejoin.asof_forward(
        frames, times, ["run_id"], "t_us", "record_us", ["record_us", "n_records", "sum_idx"], BLOCK_US
    ).drop("t_us")


@query(
    "window_points",
    f"""WITH {POSES}
SELECT f.run_id, f.idx AS frame, CAST(count(*) AS BIGINT) AS n_points, CAST(sum(r.idx) AS BIGINT) AS sum_idx,
 min(r.t_us - f.t_us) AS first_offset
FROM poses f JOIN poses r ON r.run_id = f.run_id AND f.kind = 'click' AND r.kind <> 'click'
 AND r.t_us BETWEEN f.t_us - {12 * HOUR_US} AND f.t_us + {12 * HOUR_US}
GROUP BY f.run_id, f.idx""",
)
def window_points(spark, sf):
    p = poses(spark, sf).select("run_id", "idx", "t_us", "kind")
    frames = kind(p, "click").select("run_id", F.col("idx").alias("frame"), F.col("t_us").alias("cam_us"))
    pts = p.where("kind <> 'click'").select("run_id", "idx", "t_us")
    near = timejoin.window_join(frames, pts, ["run_id"], "cam_us", "t_us", 12 * HOUR_US, 12 * HOUR_US)
    return near.groupBy("run_id", "frame").agg(
        F.count("*").alias("n_points"),
        F.sum("idx").alias("sum_idx"),
        F.min(F.col("t_us") - F.col("cam_us")).alias("first_offset"),
    )


@query(
    "middle_sweep",
    f"""WITH {POSES}, inside AS (
 SELECT f.run_id, f.idx AS frame, r.idx AS sweep, row_number() OVER (PARTITION BY f.idx ORDER BY r.t_us, r.idx) - 1 AS no,
  count(*) OVER (PARTITION BY f.idx) AS n
 FROM poses f JOIN poses r ON r.run_id = f.run_id AND f.kind = 'click' AND r.kind = 'purchase'
  AND r.t_us BETWEEN f.t_us AND f.t_us + {5 * DAY_US})
SELECT run_id, frame, sweep FROM inside WHERE no = n // 2""",
)
def middle_sweep(spark, sf):
    p = poses(spark, sf).select("run_id", "idx", "t_us", "kind")
    frames = kind(p, "click").select("run_id", F.col("idx").alias("frame"), "t_us")
    sweeps = kind(p, "purchase").select("run_id", F.col("idx").alias("sweep"), F.col("t_us").alias("end_us"))
    hit = timejoin.middle_of_window(frames, sweeps, ["run_id"], "t_us", "end_us", ["sweep"], 5 * DAY_US, BLOCK_US, "sweep")
    return hit.select("run_id", "frame", "sweep")


@query(
    "shifted_key_lookup",
    """WITH r AS (SELECT DISTINCT user_id AS run_id, event_id // 10 AS k FROM events WHERE event_type = 'view'),
f AS (SELECT user_id AS run_id, event_id, event_id // 10 AS k FROM events WHERE event_type = 'click'),
hit AS (SELECT f.run_id, f.event_id, f.k, r.k AS found_key, r.k - f.k AS shift,
 row_number() OVER (PARTITION BY f.event_id ORDER BY abs(r.k - f.k), r.k - f.k) AS rn
 FROM f JOIN r ON f.run_id = r.run_id AND r.k BETWEEN f.k - 4 AND f.k + 4)
SELECT run_id, event_id, k, found_key, CAST(shift AS INTEGER) AS shift FROM hit WHERE rn = 1""",
)
def shifted_key_lookup(spark, sf):
    ev = table(spark, sf, "events").selectExpr("user_id AS run_id", "event_id", "event_id div 10 AS k", "event_type")
    frames = ev.where("event_type = 'click'").select("run_id", "event_id", "k")
    chunks = ev.where("event_type = 'view'").select("run_id", "k")
    return timejoin.nearest_key(frames, chunks, ["run_id"], "k", "k")


@query(
    "moving_average",
    f"""WITH {POSES}, d AS (SELECT run_id, idx, round(height * 1000000) AS u, row_number() OVER w AS rn, count(*) OVER (PARTITION BY run_id) AS n,
 first(round(height * 1000000)) OVER w AS f, last(round(height * 1000000)) OVER (PARTITION BY run_id ORDER BY t_us, idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
 sum(round(height * 1000000)) OVER (PARTITION BY run_id ORDER BY t_us, idx ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS s
 FROM poses WINDOW w AS (PARTITION BY run_id ORDER BY t_us, idx))
SELECT run_id, idx, {qs("(s + greatest(26 - rn, 0) * f + greatest(rn + 25 - n, 0) * l) / 51e6")} AS height_avg FROM d""",
)
def moving_average(spark, sf):
    p = poses(spark, sf).select("run_id", "idx", "t_us", "height")
    d = segments.moving_average(p, ["run_id"], ["t_us", "idx"], ["height"], BLOCK_US)
    return d.select("run_id", "idx", q(F.col("height_avg")).alias("height_avg"))


@query(
    "held_derivative",
    f"""WITH {POSES}, d AS (SELECT run_id, idx, t_us, height, height - lag(height) OVER (PARTITION BY run_id ORDER BY t_us, idx) AS dh FROM poses)
SELECT run_id, idx, {qs("sum(coalesce(greatest(-25e0, least(25e0, dh)), height)) OVER (PARTITION BY run_id ORDER BY t_us, idx)", 3)} AS held FROM d""",
)
def held_derivative(spark, sf):
    p = poses(spark, sf).select("run_id", "idx", "t_us", "height")
    d = segments.clip_derivative(p, ["run_id"], ["t_us", "idx"], "height", BLOCK_US, 25.0)
    return d.select("run_id", "idx", q(F.col("height_held"), 3).alias("held"))


@query(
    "smooth_derivative",
    f"""WITH {POSES}, d AS (SELECT run_id, idx, t_us, height, height - lag(height) OVER (PARTITION BY run_id ORDER BY t_us, idx) AS dh FROM poses),
e AS (SELECT run_id, idx, t_us, round(dh * 1e6) AS u, row_number() OVER w AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM d WHERE dh IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY t_us, idx)),
g AS (SELECT run_id, idx, t_us, (sum(u) OVER (PARTITION BY run_id ORDER BY t_us, idx ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING)
 + greatest(26 - rn, 0) * first(u) OVER (PARTITION BY run_id ORDER BY t_us, idx)
 + greatest(rn + 25 - n, 0) * last(u) OVER (PARTITION BY run_id ORDER BY t_us, idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 51e6 AS step FROM e),
h AS (SELECT run_id, idx, t_us, step FROM g UNION ALL SELECT run_id, idx, t_us, height FROM d WHERE dh IS NULL)
SELECT run_id, idx, {qs("sum(step) OVER (PARTITION BY run_id ORDER BY t_us, idx)", 3)} AS smooth FROM h""",
)
def smooth_derivative(spark, sf):
    p = poses(spark, sf).select("run_id", "idx", "t_us", "height")
    d = segments.smooth_derivative(p, ["run_id"], ["t_us", "idx"], "height", BLOCK_US)
    return d.select("run_id", "idx", q(F.col("height_smooth"), 3).alias("smooth"))


@query(
    "range_discontinuity",
    f"""WITH {POINTS}, d AS (SELECT laser, point_id, sweep, sqrt(x * x + y * y + z * z) AS dist, atan2(y, x) AS angle FROM points),
e AS (SELECT laser, point_id, sweep, greatest(coalesce(lag(dist) OVER w - dist, 0e0), coalesce(lead(dist) OVER w - dist, 0e0), 0e0) AS jump
 FROM d WINDOW w AS (PARTITION BY sweep, laser ORDER BY angle, point_id))
SELECT laser, point_id, sweep, {qs("jump")} AS jump FROM e WHERE jump > 2""",
)
def range_discontinuity(spark, sf):
    p = points(spark, sf).selectExpr(
        "laser", "point_id", "sweep", "sqrt(x * x + y * y + z * z) AS dist", "atan2(y, x) AS angle"
    )
    d = segments.range_jumps(p, ["sweep", "laser"], "angle", "point_id", "dist", 0.1)
    return d.where("jump > 2").select("laser", "point_id", "sweep", q(F.col("jump")).alias("jump"))


@query(
    "radar_sweeps",
    f"""WITH {POSES}, d AS (SELECT run_id, idx, kind, height, last(CASE WHEN kind = 'signup' THEN t_us - 66000 END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY t_us, idx) AS sweep_us FROM poses)
SELECT run_id, sweep_us, CAST(count(*) AS BIGINT) AS n_objects, CAST(sum(idx) AS BIGINT) AS sum_idx FROM d
WHERE sweep_us IS NOT NULL AND kind NOT IN ('signup', 'error') AND height > 10 GROUP BY run_id, sweep_us""",
)
def radar_sweeps(spark, sf):
    p = poses(spark, sf).select("run_id", "idx", "t_us", "kind", "height")
    d = segments.sweep_messages(
        p,
        ["run_id"],
        "t_us",
        "idx",
        is_start=F.col("kind") == "signup",
        dropped=F.col("kind").isin("signup", "error"),
        kept=F.col("height") > 10,
        width=BLOCK_US,
    )
    return d.groupBy("run_id", "sweep_us").agg(F.count("*").alias("n_objects"), F.sum("idx").alias("sum_idx"))


@query(
    "azimuth_sweeps",
    f"""WITH {POSES}, d AS (SELECT run_id, idx, t_us, azimuth, lag(azimuth) OVER (PARTITION BY run_id ORDER BY t_us, idx) AS before FROM poses)
SELECT run_id, idx, azimuth, CAST(sum(CASE WHEN azimuth < before THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY t_us, idx) AS BIGINT) AS sweep FROM d""",
)
def azimuth_sweeps(spark, sf):
    p = poses(spark, sf).select("run_id", "idx", "t_us", "azimuth")
    return segments.wrap_segments(p, ["run_id"], ["t_us", "idx"], "azimuth", BLOCK_US).drop("t_us")


@query(
    "message_groups",
    f"""WITH {POSES}, d AS (SELECT run_id, idx, t_us, kind, last(CASE WHEN kind = 'signup' THEN idx END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY t_us, idx) AS header_idx FROM poses)
SELECT run_id, header_idx, min(idx) AS first_member, max(idx) AS last_member, CAST(count(*) AS BIGINT) AS n
FROM d WHERE header_idx IS NOT NULL AND kind <> 'signup' AND idx % 8 <= header_idx % 8 GROUP BY run_id, header_idx""",
)
def message_groups(spark, sf):
    p = poses(spark, sf).select("run_id", "idx", "t_us", "kind")
    d = segments.group_under_header(p, ["run_id"], ["t_us", "idx"], F.col("kind") == "signup", ["idx"], BLOCK_US)
    inside = (F.col("kind") != "signup") & (F.col("idx") % 8 <= F.col("header.idx") % 8)
    return (
        d.where(inside)
        .groupBy("run_id", F.col("header.idx").alias("header_idx"))
        .agg(
            F.min("idx").alias("first_member"), F.max("idx").alias("last_member"), F.count("*").alias("n")
        )
    )


@query(
    "complete_groups",
    """SELECT event_id, user_id, CAST(ts AS DATE)::VARCHAR AS day FROM events
QUALIFY count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) % 3 = 0""",
)
def complete_groups(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").cast("string").alias("day"))
    return segments.drop_incomplete(ev, ["user_id", "day"], 3)


@query(
    "sequence_subset",
    f"""WITH {POSES}, d AS (SELECT run_id, idx, row_number() OVER (PARTITION BY run_id ORDER BY t_us, idx) - 1 AS pos, count(*) OVER (PARTITION BY run_id) AS n FROM poses)
SELECT run_id, idx, pos FROM d WHERE (pos >= 2 AND pos <= 40 AND (pos - 2) % 5 = 0) OR pos = n - 1""",
)
def sequence_subset(spark, sf):
    p = poses(spark, sf).select("run_id", "idx", "t_us")
    return segments.sequence_subset(p, ["run_id"], ["t_us", "idx"], BLOCK_US, 2, 40, 5, add_last=True).drop("t_us")


@query(
    "stride_sample",
    f"""WITH {POSES}, d AS (SELECT run_id, idx, lat, lon, row_number() OVER (PARTITION BY run_id ORDER BY t_us, idx) - 1 AS pos, count(*) OVER (PARTITION BY run_id) AS n FROM poses),
b AS (SELECT min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM poses)
SELECT run_id, idx, lat, lon, lat_min, lat_max, lon_min, lon_max FROM d, b WHERE pos % greatest(n // 10, 1) = 0""",
)
def stride_sample(spark, sf):
    p = poses(spark, sf).select("run_id", "idx", "t_us", "lat", "lon")
    bounds = p.agg(
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max")
    )
    d = segments.stride_sample(p, ["run_id"], ["t_us", "idx"], BLOCK_US, 10).drop("t_us")
    return d.join(F.broadcast(bounds))  # bounds is one row


@query(
    "warm_up_drop",
    """WITH f AS (SELECT DISTINCT event_type AS sequence, event_id // 20 AS frame FROM events),
d AS (SELECT sequence, frame, lag(frame, 1) OVER w AS a, lag(frame, 2) OVER w AS b, lag(frame, 3) OVER w AS c, lag(frame, 4) OVER w AS d FROM f WINDOW w AS (PARTITION BY sequence ORDER BY frame))
SELECT sequence, frame FROM d WHERE a = frame - 1 AND b = frame - 2 AND c = frame - 3 AND d = frame - 4""",
)
def warm_up_drop(spark, sf):
    frames = table(spark, sf, "events").selectExpr("event_type AS sequence", "event_id div 20 AS frame").distinct()
    return segments.drop_warm_up(frames, ["sequence"], "frame", 1000)


@query(
    "order_check",
    """WITH d AS (SELECT user_id, event_id, (event_id * 7) % 1000 AS number FROM events),
e AS (SELECT user_id, event_id, number, lag(number) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM d)
SELECT user_id, event_id, number, before FROM e WHERE before >= number""",
)
def order_check(spark, sf):
    ev = table(spark, sf, "events").selectExpr("user_id", "event_id", "(event_id * 7) % 1000 AS number")
    return segments.order_violations(ev, ["user_id"], "event_id", "number", 20000)


@query(
    "pose_steps",
    f"""WITH {POSES}, a AS (SELECT run_id, idx, t_us, height, lead(height) OVER (PARTITION BY run_id ORDER BY t_us, idx) - height AS step,
 row_number() OVER (PARTITION BY run_id ORDER BY t_us, idx) AS rn FROM poses WHERE kind = 'view'),
b AS (SELECT run_id, height / 100 AS fix, row_number() OVER (PARTITION BY run_id ORDER BY t_us, idx) AS rn FROM poses WHERE kind = 'click')
SELECT a.run_id, a.idx, {qs("a.step")} AS step, {qs("b.fix")} AS fix, {qs("a.step + b.fix")} AS total
FROM a JOIN b ON a.run_id = b.run_id AND a.rn = b.rn WHERE a.step IS NOT NULL""",
)
def pose_steps(spark, sf):
    """Height step of each pose beside the scan-match correction of the same step."""
    p = poses(spark, sf).select("run_id", "idx", "t_us", "kind", "height")
    order, width = ["t_us", "idx"], BLOCK_US
    a = blocks.next_row(kind(p, "view"), ["run_id"], order, ["height"], width, "after")
    a = blocks.row_index(a, ["run_id"], order, width).withColumn("step", F.col("after.height") - F.col("height"))
    b = blocks.row_index(kind(p, "click"), ["run_id"], order, width).select(
        "run_id", "rn", (F.col("height") / 100).alias("fix")
    )
    return (
        a.where("step IS NOT NULL")
        .join(b, ["run_id", "rn"])
        .select("run_id", "idx", q(F.col("step")).alias("step"), q(F.col("fix")).alias("fix"), q(F.col("step") + F.col("fix")).alias("total"))
    )


@query(
    "natural_sort",
    """WITH d AS (SELECT event_id, event_type || '_' || lpad(CAST(event_id % 1000 AS VARCHAR), 6, '0') || '.png' AS image FROM events)
SELECT event_id, image, regexp_extract(image, '^(.*)_(\\d+)\\.', 1) AS prefix, CAST(regexp_extract(image, '^(.*)_(\\d+)\\.', 2) AS BIGINT) AS number
FROM d ORDER BY prefix, number, event_id""",
)
def natural_sort(spark, sf):
    ev = table(spark, sf, "events").selectExpr(
        "event_id", "event_type || '_' || lpad(cast(event_id % 1000 AS string), 6, '0') || '.png' AS image"
    )
    return ev.select(
        "event_id",
        "image",
        F.regexp_extract("image", r"^(.*)_(\d+)\.", 1).alias("prefix"),
        F.regexp_extract("image", r"^(.*)_(\d+)\.", 2).cast("bigint").alias("number"),
    ).orderBy("prefix", "number", "event_id")


@query(
    "best_of",
    f"""WITH {POSES} SELECT run_id, arg_max(idx, (height, -idx)) AS best_idx, max(height) AS best FROM poses GROUP BY run_id""",
)
def best_of(spark, sf):
    p = poses(spark, sf)
    rank = F.struct("height", (-F.col("idx")).alias("tie"))
    return p.groupBy("run_id").agg(F.max_by("idx", rank).alias("best_idx"), F.max("height").alias("best"))
