"""Log formats: lines and bytes are built from the given tables, then read by the real parsers."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wayline.operators import blocks, timejoin
from wayline.operators import boxes as box_ops
from wayline.plans.inputs import BOXES, DAY_US, POSES, boxes, poses, q, qs, table
from wayline.plans.registry import query
from wayline.session import ensure_checkpoint_dir
from wayline.sources import annotations, logs, tables

# a pose line: 21 tokens, or 22 with an event id; every seventh is cut short and must drop out
POSE_LINE = """concat('head,', CASE event_id % 3 WHEN 0 THEN '#MARK1PVAA' WHEN 1 THEN '#MARK2PVAA' ELSE '#INSPVAA' END,
 ',COM1,0,0,0,0,0,0,0,FINESTEERING;', 1786 + event_id % 10, ',', value, ',', CASE WHEN event_id % 3 = 1 THEN '77,' ELSE '' END,
 event_id % 997, ',', -(event_id % 991), ',', user_id, ',1.5,-2.5,0.25,', event_id % 5, ',', event_id % 9, CASE WHEN event_id % 7 = 0 THEN '' ELSE concat(',', event_id % 360, ',*c0ffee') END)"""


@query(
    "gps_log_ingest",
    f"""SELECT event_id, value AS seconds, CAST(event_id % 997 AS DOUBLE) AS lat, CAST(-(event_id % 991) AS DOUBLE) AS lon, CAST(user_id AS DOUBLE) AS height, 1.5e0 AS v_north, -2.5e0 AS v_east, 0.25e0 AS v_up,
 CAST(event_id % 5 AS DOUBLE) AS rot_y, CAST(event_id % 9 AS DOUBLE) AS rot_x, CAST(event_id % 360 AS DOUBLE) AS azimuth, CAST(1786 + event_id % 10 AS INTEGER) AS week,
 CAST(floor(((1786 + event_id % 10) * 604800 + value + 315964800 - 16) * 1e6) AS BIGINT) AS t_us FROM events WHERE event_id % 7 <> 0""",
)
def gps_log_ingest(spark, sf):
    lines = table(spark, sf, "events").selectExpr("event_id", f"{POSE_LINE} AS value")
    return logs.parse_poses(lines)


@query(
    "mark_routing",
    """SELECT CAST(CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS INTEGER) AS mark, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS sum_ids FROM events GROUP BY 1""",
)
def mark_routing(spark, sf):
    lines = table(spark, sf, "events").selectExpr("event_id", f"{POSE_LINE} AS value")
    return logs.route_marks(lines).groupBy("mark").agg(F.count("*").alias("n"), F.sum("event_id").alias("sum_ids"))


@query(
    "covariance_ingest",
    f"""WITH l AS (SELECT conv_id, turn, role, length(text) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, {', '.join(f"{qs(f'sqrt(n + {k})', 6)} AS {c}" for c, k in (('tx', 7), ('ty', 11), ('tz', 15), ('rx', 16), ('ry', 20), ('rz', 24)))} FROM l WHERE before = 'user' AND role <> 'user'""",
)
def covariance_ingest(spark, sf):
    """User turns are marker lines, the others records of numbers."""
    numbers = "array_join(transform(sequence(0, 24), i -> cast(length(text) + i as string)), ' ')"
    lines = table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", f"CASE WHEN role = 'user' THEN '#INSCOVA,COM1' ELSE {numbers} END AS value"
    )
    d = logs.parse_covariances(lines, ["conv_id"], ["turn"], 1000)
    return d.select("conv_id", "turn", *[q(F.col(c), 6).alias(c) for c in logs.COVARIANCE_TOKENS])


@query(
    "lidar_sweep_decode",
    """WITH d AS (SELECT vec_id, embedding, unnest(range(0, 16)) AS i FROM embeddings)
SELECT vec_id * 100000 AS sweep_us, i AS point_no, CAST(embedding[4 * i + 1] AS DOUBLE) AS x, CAST(embedding[4 * i + 2] AS DOUBLE) AS y, CAST(embedding[4 * i + 3] AS DOUBLE) AS z,
 CAST(embedding[4 * i + 4] AS DOUBLE) AS intensity, CAST(i % 32 AS INTEGER) AS laser, CAST(i * 100 AS INTEGER) AS dt_us, vec_id * 100000 - i * 100 AS t_us FROM d""",
)
def lidar_sweep_decode(spark, sf):
    """Vectors written as binary sweeps of sixteen points with laser and time added, then decoded."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        points = np.zeros((len(v), 16, 6), "<f4")
        points[:, :, :4] = np.concatenate(v.to_list()).reshape(-1, 16, 4)
        points[:, :, 4], points[:, :, 5] = np.arange(16) % 32, np.arange(16) * 100
        rows = points.tobytes()
        size = points[0].nbytes
        return pd.Series([rows[at : at + size] for at in range(0, len(rows), size)])

    files = table(spark, sf, "embeddings").select((F.col("vec_id") * 100000).alias("sweep_us"), pack("embedding").alias("content"))
    d = logs.decode_sweeps(files, "content", "sweep_us")
    return d.select(
        "sweep_us", (F.col("dt_us") / 100).cast("bigint").alias("point_no"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "intensity")], "laser", "dt_us", "t_us"
    )


RADAR_LINE = """CASE WHEN event_id % 2 = 0 THEN concat('O ', event_id % 64, ' ', value, ' 1.5 -3 2 ', event_id % 12, ' 1.8 4.5')
 ELSE concat('T ', event_id % 64, ' ', value, ' -1.5 3 2 1 1.8 4.5 0.5 0.75 ', event_id % 4, ' 2 0') END"""


@query(
    "radar_ingest",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'O' ELSE 'T' END AS kind, CAST(event_id % 64 AS INTEGER) AS id, value AS dist, CASE WHEN event_id % 2 = 0 THEN 1.5e0 ELSE -1.5e0 END AS lat_dist,
 CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 12 AS DOUBLE) END AS rcs, CASE WHEN event_id % 2 = 1 THEN 0.75e0 END AS exist_probab, CASE WHEN event_id % 2 = 1 THEN CAST(event_id % 4 AS DOUBLE) END AS rel_acc, 4.5e0 AS l FROM events""",
)
def radar_ingest(spark, sf):
    d = logs.parse_radar(table(spark, sf, "events").selectExpr("event_id", f"{RADAR_LINE} AS value"))
    return d.select("event_id", "kind", "id", "dist", "lat_dist", "rcs", "exist_probab", "rel_acc", "l")


NMEA_LINE = """CASE WHEN event_id % 2 = 0 THEN concat('$GPGGA,', 120000 + event_id % 1000, '.00,37', lpad(cast(event_id % 60 as {S}), 2, '0'), '.5000,N,122', lpad(cast(event_id % 59 as {S}), 2, '0'), '.2500,W,4,', event_id % 12, ',0.9,', value, ',M,-30.0,M,,*47')
 ELSE concat('junk$GPHDT,', event_id % 360, '.5,T*1A') END"""


@query(
    "nmea_ingest",
    f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'GPGGA' ELSE 'GPHDT' END AS sentence, CASE WHEN event_id % 2 = 0 THEN {qs('37 + (event_id % 60 + 0.5e0) / 60', 8)} END AS lat, CASE WHEN event_id % 2 = 0 THEN {qs('122 + (event_id % 59 + 0.25e0) / 60', 8)} END AS lon,
 CASE WHEN event_id % 2 = 0 THEN TRUE END AS north, CASE WHEN event_id % 2 = 0 THEN FALSE END AS east, CASE WHEN event_id % 2 = 0 THEN 4 END AS fix, CAST(CASE WHEN event_id % 2 = 0 THEN event_id % 12 END AS INTEGER) AS satellites,
 CASE WHEN event_id % 2 = 0 THEN value END AS altitude, CASE WHEN event_id % 2 = 1 THEN event_id % 360 + 0.5e0 END AS heading FROM events""",
)
def nmea_ingest(spark, sf):
    d = logs.parse_nmea(table(spark, sf, "events").selectExpr("event_id", f"{NMEA_LINE.format(S='string')} AS value"))
    return d.select(
        "event_id", "sentence", q(F.col("lat"), 8).alias("lat"), q(F.col("lon"), 8).alias("lon"), "north", "east", "fix", "satellites", "altitude", "heading"
    )


@query(
    "run_catalogue",
    """SELECT c_custkey, 'route' || (c_custkey % 7) AS route, lower(c_mktsegment) || '_' || (c_custkey % 11) AS segment, chr(CAST(97 + c_custkey % 26 AS INTEGER)) AS split, lower(c_mktsegment) || '_' || (c_custkey % 11) || '_' || chr(CAST(97 + c_custkey % 26 AS INTEGER)) AS run_id,
 CAST(c_custkey % 6 + 601 AS INTEGER) AS camera FROM customer WHERE c_custkey % 5 <> 0""",
)
def run_catalogue(spark, sf):
    """Log names from customers; every fifth is another kind of file and drops out."""
    files = table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "concat('/data/route', c_custkey % 7, '/', lower(c_mktsegment), '_', c_custkey % 11, '_', chr(97 + c_custkey % 26), CASE WHEN c_custkey % 5 = 0 THEN '_radar.out' ELSE '_gps.out' END) AS file",
        "concat('drive_a', c_custkey % 6 + 601, '.zip') AS video",
    )
    d = logs.catalogue(files).withColumn("camera", logs.camera_number(F.col("video")))
    return d.select("c_custkey", "route", "segment", "split", "run_id", "camera")


LIST_LINE = """concat('"cam/img_', l_partkey, CASE WHEN l_partkey % 2 = 0 THEN concat('@', l_suppkey) ELSE '' END, '"', CASE WHEN l_linenumber = 7 THEN '' ELSE
 concat(': (', l_quantity, ', ', l_extendedprice, ', ', l_quantity + 20.25, ', ', l_extendedprice + 30, '):', l_discount, ', (1, 2, 3, 4)/', l_linenumber) END, ';')"""


@query(
    "annotation_lines",
    """WITH d AS (SELECT l_orderkey, 'cam/img_' || l_partkey AS image, CASE WHEN l_partkey % 2 = 0 THEN l_suppkey ELSE -1 END AS frame, l_linenumber AS k, l_quantity, l_extendedprice, l_discount FROM lineitem)
SELECT l_orderkey, image, frame, 0 AS box_no, round_even(l_quantity, 0) AS x1, round_even(l_extendedprice, 0) AS y1, round_even(l_quantity + 20.25, 0) AS x2, l_discount AS score, CAST(NULL AS INTEGER) AS silhouette FROM d WHERE k <> 7
UNION ALL SELECT l_orderkey, image, frame, 1, 1, 2, 3, NULL, k FROM d WHERE k <> 7 UNION ALL SELECT l_orderkey, image, frame, NULL, NULL, NULL, NULL, NULL, NULL FROM d WHERE k = 7""",
)
def annotation_lines(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey", f"{LIST_LINE} AS value")
    return annotations.parse_lines(lines).select("l_orderkey", "image", "frame", "box_no", "x1", "y1", "x2", "score", "silhouette")


XML_TEXT = """concat('<annotation><image><name>img_', l_partkey, '.png</name><frameNr>', l_suppkey, '</frameNr></image><annorect><x1>', l_quantity, '</x1><y1>1</y1><x2>', l_quantity + 20, '</x2><y2>9</y2><score>', l_discount,
 '</score><classID>', l_linenumber, '</classID></annorect><annorect><x1>5</x1><y1>6</y1><x2>7</x2><y2>8</y2></annorect></annotation>')"""


@query(
    "annotation_xml",
    """SELECT l_orderkey, 'img_' || l_partkey || '.png' AS image, l_suppkey AS frame, 0 AS box_no, l_quantity AS x1, l_quantity + 20 AS x2, l_discount AS score, l_linenumber AS class_id FROM lineitem
UNION ALL SELECT l_orderkey, 'img_' || l_partkey || '.png', l_suppkey, 1, 5, 7, NULL, NULL FROM lineitem""",
)
def annotation_xml(spark, sf):
    texts = table(spark, sf, "lineitem").selectExpr("l_orderkey", f"{XML_TEXT} AS value")
    return annotations.parse_xml(texts).select("l_orderkey", "image", "frame", "box_no", "x1", "x2", "score", "class_id")


@query(
    "track_dump",
    """SELECT l_orderkey, l_partkey AS frame, l_linenumber AS track_id, l_quantity AS x1, l_quantity + 9 AS x2 FROM lineitem WHERE l_linenumber % 2 = 0
UNION ALL SELECT l_orderkey, l_partkey + 1, l_linenumber, l_quantity + 1, l_quantity + 10 FROM lineitem""",
)
def track_dump(spark, sf):
    first = "named_struct('frame', l_partkey, 'xtl', l_quantity, 'ytl', 1d, 'xbr', l_quantity + 9, 'ybr', 2d, 'lost', l_linenumber % 2)"
    second = "named_struct('frame', l_partkey + 1, 'xtl', l_quantity + 1, 'ytl', 1d, 'xbr', l_quantity + 10, 'ybr', 2d, 'lost', 0)"
    dumps = table(spark, sf, "lineitem").selectExpr("l_orderkey", f"to_json(named_struct('track', l_linenumber, 'boxes', array({first}, {second}))) AS value")
    return annotations.parse_track_dump(dumps).select("l_orderkey", "frame", "track_id", "x1", "x2")


@query(
    "annotation_sink",
    f"""WITH {BOXES} SELECT 'img_' || frame AS image, frame, '"img_' || frame || '@' || frame || '":' || string_agg(' (' || CAST(floor(x1) AS BIGINT) || ', ' || CAST(floor(y1) AS BIGINT) || ', ' || CAST(floor(x2) AS BIGINT) || ', ' || CAST(floor(y2) AS BIGINT) || ')'
 || CASE WHEN class_id = 1 THEN ':' || CAST(class_id AS VARCHAR) ELSE '' END, ',' ORDER BY box_id) || ';' AS value FROM boxes GROUP BY frame""",
)
def annotation_sink(spark, sf):
    b = boxes(spark, sf).withColumns({"image": F.concat(F.lit("img_"), F.col("frame")), "score": F.when(F.col("class_id") == 1, F.col("class_id"))})
    return annotations.to_lines(b, "box_id")


@query(
    "calibration_flatten",
    """WITH s AS (SELECT s_suppkey, s_acctbal AS a, s_nationkey AS n FROM supplier),
r AS (SELECT s_suppkey, 'lidar/T_from_l_to_i' AS path, [a, 0e0, 0e0, 1e0] AS v FROM s UNION ALL SELECT s_suppkey, 'lidar/height', [CAST(n AS DOUBLE)] FROM s UNION ALL SELECT s_suppkey, 'radar/T', [a, CAST(n AS DOUBLE)] FROM s
UNION ALL SELECT s_suppkey, 'cam/' || k || '/KK', [a + k, 2e0, 3e0, 4e0] FROM s, (SELECT unnest(range(0, 2)) AS k) UNION ALL SELECT s_suppkey, 'cam/' || k || '/width', [1280e0] FROM s, (SELECT unnest(range(0, 2)) AS k))
SELECT s_suppkey, path, CAST(i - 1 AS INTEGER) AS place, v[i] AS value FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM r)""",
)
def calibration_flatten(spark, sf):
    text = """to_json(named_struct('lidar', named_struct('T_from_l_to_i', array(array(s_acctbal, 0d), array(0d, 1d)), 'height', s_nationkey),
 'radar', named_struct('T', array(s_acctbal, cast(s_nationkey as double))),
 'cam', transform(array(0, 1), k -> named_struct('KK', array(array(s_acctbal + k, 2d), array(3d, 4d)), 'width', 1280))))"""
    docs = table(spark, sf, "supplier").selectExpr("s_suppkey", f"{text} AS value")
    d = tables.flatten_calibration(docs)
    return d.select("s_suppkey", "path", F.posexplode("values").alias("place", "value"))


@query(
    "run_export",
    f"""WITH {POSES}, v AS (SELECT run_id, idx, t_us, row_number() OVER (PARTITION BY run_id ORDER BY t_us, idx) AS rn FROM poses WHERE kind = 'click'),
p AS (SELECT v.run_id, v.t_us, s.idx AS pose FROM v ASOF JOIN (SELECT * FROM poses WHERE kind = 'view') s ON v.run_id = s.run_id AND v.t_us >= s.t_us WHERE v.rn % 2 = 1)
SELECT run_id, 'gps' AS kind, t_us, '{{"pose":' || pose || '}}' AS payload FROM p UNION ALL SELECT run_id, 'radar', t_us, '{{"idx":' || idx || '}}' FROM poses WHERE kind = 'purchase'""",
)
def run_export(spark, sf):
    """Records of a run as JSON: radar by time, and the pose of every second frame by as-of join."""
    p = poses(spark, sf).select("run_id", "idx", "t_us", "kind")
    n = 5 * DAY_US
    frames = p.where("kind = 'click'").select("run_id", "idx", "t_us")
    second = blocks.row_index(frames, ["run_id"], ["t_us", "idx"], n).where("rn % 2 = 1").select("run_id", "t_us")
    views = p.where("kind = 'view'").select("run_id", F.col("idx").alias("pose"), F.col("t_us").alias("pose_us"))
    gps = timejoin.asof_backward(second, views, ["run_id"], "t_us", "pose_us", ["pose"], n, tie="pose")
    radar = p.where("kind = 'purchase'").select("run_id", "t_us", "idx")
    return tables.run_documents({"gps": gps, "radar": radar}, "run_id", "t_us")


MAP_SPARK = {"points": "kind IN ('click', 'signup', 'error')", "lanes": "kind IN ('view', 'purchase')", "planes": "kind = 'view'"}
MAP_FIELDS = "'drive' || (run_id % 16) AS drive, '{kind}' AS kind, {time} AS t_us, run_id, idx, lat AS x, lon AS y, height AS z"


@query(
    "run_export_map",
    f"WITH {POSES} " + " UNION ALL ".join(f"SELECT {MAP_FIELDS.format(kind=k, time='t_us' if k == 'points' else 'NULL')} FROM poses WHERE {rows}" for k, rows in MAP_SPARK.items()),
)
def run_export_map(spark, sf):
    """Map points by time, lanes and planes of every drive, exported in two calls and read back."""
    p = poses(spark, sf).selectExpr("concat('drive', run_id % 16) AS drive", "kind", "t_us", "run_id", "idx", "lat AS x", "lon AS y", "height AS z")
    kinds = {k: p.where(rows).drop("kind", *([] if k == "points" else ["t_us"])) for k, rows in MAP_SPARK.items()}
    folder = f"{ensure_checkpoint_dir(spark)}/export-{uuid.uuid4().hex}"
    tables.export_runs(tables.run_documents({"points": kinds["points"]}, "drive", "t_us"), "drive", folder)
    tables.export_runs(tables.run_documents(kinds, "drive", "t_us"), "drive", folder)
    fields = F.from_json("payload", "run_id bigint, idx bigint, x double, y double, z double")
    return tables.read_runs(spark, folder, "drive").select("drive", "kind", "t_us", fields.alias("f")).select("drive", "kind", "t_us", "f.*")


@query(
    "annotation_list_order",
    f"""WITH {BOXES} SELECT 'seq_' || (frame % 9) || '_' || lpad(CAST(frame AS VARCHAR), 6, '0') || '.png' AS image, box_id FROM boxes""",
)
def annotation_list_order(spark, sf):
    """Boxes sorted by image prefix and number."""
    b = boxes(spark, sf).selectExpr("concat('seq_', frame % 9, '_', lpad(cast(frame as string), 6, '0'), '.png') AS image", "box_id")
    return box_ops.image_order(b, "image")
