"""Vision-sensor frames under their headers, in batch and on a stream; frames are made from the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import messages
from wayline.plans.geometry_plans import PAYLOAD, _int
from wayline.plans.inputs import DAY_US, HOUR_US, T_SPARK, T_SQL, table
from wayline.plans.registry import query
from wayline.plans.stream_plans import event_stream
from wayline.streaming import live, ordered

BLOCK_US = 5 * DAY_US

# a sign-up is an object header and the first lane; views and clicks are the three frames of an object, the rest lanes
CAN_ID = """CASE WHEN event_type = 'signup' THEN CASE f WHEN 0 THEN 1848 WHEN 1 THEN 1894 ELSE 1895 END
  WHEN event_id % 29 = 0 AND f = 1 THEN NULL
  WHEN event_type IN ('view', 'click') THEN 1849 + 3 * (event_id % 5) + f
  WHEN f < 2 THEN CASE event_id % 4 WHEN 0 THEN 1896 WHEN 1 THEN 1900 WHEN 2 THEN 1902 ELSE 1904 END + f END"""
FRAME_COLUMNS = [
    "user_id AS run_id",
    "{T} + f AS t_us",
    "event_id * 3 + f AS ord",
    f"{CAN_ID} AS can_id",
    "CASE WHEN event_type = 'signup' AND f = 0 THEN (1 + event_id % 5) * 16777216 ELSE ((event_id * 3 + f) * 2654435761 + 97) % 4294967296 END AS hi",
    "((event_id * 3 + f) * 1664525 * 4099 + 1013904223) % 4294967296 AS lo",
]
FRAMES = f"frames AS (SELECT * FROM (SELECT {', '.join(c.replace('{T}', T_SQL) for c in FRAME_COLUMNS)} FROM events, (SELECT unnest(range(0, 3)) AS f)) WHERE can_id IS NOT NULL)"


def can_frames(events):
    d = events.withColumn("f", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))))
    rest = [c for c in ("ts",) if c in events.columns]
    d = d.selectExpr(*rest, *[c.replace("{T}", T_SPARK) for c in FRAME_COLUMNS]).where("can_id IS NOT NULL")
    return d.selectExpr(*rest, "run_id", "t_us", "ord", "can_id", f"{PAYLOAD} AS data")


def _bytes(part: int) -> str:
    return ", ".join(f"({h}{part} >> {24 - 8 * i}) & 255 AS {'abc'[part]}{i + 4 * k}" for k, h in enumerate(("hi", "lo")) for i in range(4))


OBJECT_FIELDS = f"""{_int('a0', 'obj_id')}, ((a2 & 15) * 256 + a1) * 0.0625e0 AS pos_x, (CASE WHEN (a4 & 3) * 256 + a3 > 511 THEN (a4 & 3) * 256 + a3 - 1024 ELSE (a4 & 3) * 256 + a3 END) * 0.0625e0 AS pos_y,
 (CASE WHEN (a6 & 15) * 256 + a5 > 2047 THEN (a6 & 15) * 256 + a5 - 4096 ELSE (a6 & 15) * 256 + a5 END) * 0.0625e0 AS rel_vel_x, {_int('(a6 // 16) % 8', 'obj_type')}, {_int('a7 % 8', 'status')}, {_int('(a7 // 8) % 2', 'braking')},
 {_int('(a4 // 32) % 4', 'location')}, {_int('(a4 // 4) % 8', 'blinker')}, {_int('a7 // 64', 'valid')}, b0 * 0.05e0 AS length, b1 * 0.05e0 AS width, {_int('b2', 'age')}, {_int('b3 % 4', 'lane')},
 (CASE WHEN c4 > 127 THEN c4 - 256 ELSE c4 END) * 0.03e0 AS acceleration_x"""


def objects_sql(closed: str = "TRUE", part: str = "0") -> str:
    """Objects of the groups for which ``closed`` holds; ``part`` numbers stretches between silences."""
    return f"""WITH {FRAMES}, mark AS (SELECT (max({T_SQL}) // 1000 - 10000) * 1000 AS mark FROM events),
p AS (SELECT frames.*, mark, t_us - lag(t_us) OVER (PARTITION BY run_id ORDER BY t_us, ord) AS gap FROM frames, mark),
s AS (SELECT *, {part} AS stretch FROM p),
h AS (SELECT *, last(CASE WHEN can_id = 1848 THEN ord END IGNORE NULLS) OVER w AS header, last(CASE WHEN can_id = 1848 THEN t_us END IGNORE NULLS) OVER w AS header_time,
  last(CASE WHEN can_id = 1848 THEN hi >> 24 END IGNORE NULLS) OVER w AS announced, max(CASE WHEN can_id = 1848 THEN ord END) OVER v AS last_header, max(t_us) OVER v AS last_us
  FROM s WINDOW w AS (PARTITION BY run_id, stretch ORDER BY t_us, ord), v AS (PARTITION BY run_id, stretch)),
m AS (SELECT *, row_number() OVER (PARTITION BY run_id, header ORDER BY t_us, ord) - 1 AS pos, count(*) OVER (PARTITION BY run_id, header) AS n
  FROM h WHERE header IS NOT NULL AND can_id BETWEEN 1849 AND 1848 + 3 * announced AND {closed}),
u AS (SELECT run_id, header_time, pos // 3 AS unit, {', '.join(f'max(CASE WHEN pos % 3 = {k} THEN {h} END) AS {h}{k}' for k in range(3) for h in ('hi', 'lo'))} FROM m WHERE n % 3 = 0 GROUP BY run_id, header, header_time, pos // 3),
b AS (SELECT run_id, header_time, unit, {', '.join(_bytes(k) for k in range(3))} FROM u)
SELECT run_id, header_time, unit, {OBJECT_FIELDS} FROM b"""


@query("can_objects", objects_sql())
def can_objects(spark, sf):
    return messages.can_objects(can_frames(table(spark, sf, "events")), ["run_id"], "t_us", "ord", BLOCK_US)


LANE_FIELDS = f"""(CASE WHEN a2 > 127 THEN a2 * 256 + a1 - 65536 ELSE a2 * 256 + a1 END) / 256e0 AS c0, (b1 * 256 + b0 - 32767) / 1024e0 AS c1,
 (a4 * 256 + a3 - 32767) / 1024000e0 AS c2, (a6 * 256 + a5 - 32767) / 268435456e0 AS c3, {_int('a0 % 16', 'lane_type')}, {_int('(a0 // 16) % 4', 'quality')}, {_int('a0 // 64', 'model_degree')},
 {_int('b3 // 128', 'view_range_available')}, ((b3 % 128) * 256 + b2) / 256e0 AS view_range"""


@query(
    "can_lanes",
    f"""WITH {FRAMES}, h AS (SELECT *, last(CASE WHEN can_id = 1894 THEN ord END IGNORE NULLS) OVER w AS header, last(CASE WHEN can_id = 1894 THEN t_us END IGNORE NULLS) OVER w AS header_time FROM frames WINDOW w AS (PARTITION BY run_id ORDER BY t_us, ord)),
m AS (SELECT *, row_number() OVER (PARTITION BY run_id, header ORDER BY can_id, t_us, ord) - 1 AS pos, count(*) OVER (PARTITION BY run_id, header) AS n FROM h WHERE header IS NOT NULL AND (can_id BETWEEN 1894 AND 1897 OR can_id BETWEEN 1900 AND 1919)),
u AS (SELECT run_id, header, header_time, pos // 2 AS unit, {', '.join(f'max(CASE WHEN pos % 2 = {k} THEN {h} END) AS {h}{k}' for k in range(2) for h in ('hi', 'lo', 'can_id'))} FROM m WHERE n % 2 = 0 GROUP BY ALL), w AS (SELECT * FROM u QUALIFY bool_and(can_id1 - can_id0 = 1) OVER (PARTITION BY run_id, header)),
b AS (SELECT run_id, header_time, unit, can_id0, {', '.join(_bytes(k) for k in range(2))} FROM w)
SELECT run_id, header_time, {_int('CASE can_id0 WHEN 1894 THEN -1 WHEN 1896 THEN 1 WHEN 1900 THEN -2 WHEN 1902 THEN 2 END', 'lane_id')}, unit, {LANE_FIELDS} FROM b""",
)
def can_lanes(spark, sf):
    return messages.can_lanes(can_frames(table(spark, sf, "events")), ["run_id"], "t_us", "ord", BLOCK_US)


IDLE_HOURS = 60


@query(
    "live_can",
    objects_sql(
        f"t_us <= mark AND (header < last_header OR mark - last_us > {IDLE_HOURS * HOUR_US})",
        f"count(*) FILTER (gap > {IDLE_HOURS * HOUR_US}) OVER (PARTITION BY run_id ORDER BY t_us, ord)",
    ).replace("FROM frames, mark)", "FROM frames, mark WHERE t_us <= mark)"),
)
def live_can(spark, sf):
    """Objects on the stream: those of groups ended by the next header or by silence."""
    frames = can_frames(event_stream(spark, sf)).withColumn("ts", F.timestamp_micros("t_us"))
    return live.run_available(ordered.object_stream(frames, "run_id", "ord", idle_ms=IDLE_HOURS * 3_600_000), "append", spark, state_store=live.ROCKSDB)


@query(
    "counts_since_trigger",
    f"""WITH m AS (SELECT (max({T_SQL}) // 1000 - 10000) * 1000 AS mark FROM events), e AS (SELECT user_id, {T_SQL} AS t, event_id, event_type, {T_SQL} // {HOUR_US} * {HOUR_US} AS period_us FROM events, m WHERE {T_SQL} <= mark),
r AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY t, event_id) AS since FROM e),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id, since, event_type ORDER BY t, event_id) AS n FROM r WHERE event_type <> 'signup'),
p AS (SELECT user_id, period_us, event_type, arg_max(n, (t, event_id)) AS n, arg_max(since, (t, event_id)) AS since FROM c GROUP BY ALL),
l AS (SELECT user_id, period_us, max(since) AS since FROM r GROUP BY ALL)
SELECT user_id, period_us, event_type AS source, CAST(CASE WHEN p.since = l.since THEN n ELSE 0 END AS BIGINT) AS n_since_trigger FROM p JOIN l USING (user_id, period_us), m WHERE period_us + {HOUR_US} <= mark""",
)
def counts_since_trigger(spark, sf):
    """Events per type since the user's last sign-up, by hour."""
    e = event_stream(spark, sf)
    d = ordered.counts_since_trigger(e, "user_id", "event_type", "event_id", F.col("event_type") == "signup", every_ms=3_600_000)
    return live.run_available(d, "append", spark, state_store=live.ROCKSDB)
