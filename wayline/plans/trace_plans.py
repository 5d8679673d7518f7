"""Drives: summaries, matching of traces, lanes, smoothing and registration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wayline.functions import rotation
from wayline.operators import blocks, filters, lanes, projection, registration, smoothing, spatial, trace
from wayline.plans.geometry_plans import CENTRE, DISTORT, FOCAL, IMAGE, R_NAMES, VISIBLE_SQL, attitude_sql, projected_sql, select_sql
from wayline.plans.inputs import DAY_US, POINTS, POSES, VECTORS, points, poses, q, qs, table, vectors
from wayline.plans.registry import query
from wayline.session import cut_lineage

XYZ = ["x", "y", "z"]
BLOCK_US = 5 * DAY_US

# traces in metres from the pose stand-in
TRACE_COLS = ["run_id", "idx", "t_us", "(lat - 37) * 1000 AS x", "(lon + 122) * 1000 AS y", "height / 10 AS z"]
TRACES = f"{POSES}, traces AS (SELECT {', '.join(TRACE_COLS)} FROM poses)"


def traces(spark, sf):
    return poses(spark, sf).selectExpr(*TRACE_COLS)


SUMMARY = f"""{TRACES}, step AS (SELECT *, lag(x) OVER w AS bx, lag(y) OVER w AS by_, lag(z) OVER w AS bz FROM traces WINDOW w AS (PARTITION BY run_id ORDER BY t_us, idx)),
summary0 AS (SELECT run_id, {', '.join(f'min({c}) AS {c}_min, max({c}) AS {c}_max, arg_max({c}, (t_us, idx)) - arg_min({c}, (t_us, idx)) AS d{c}' for c in XYZ)},
 sum(sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_) + (z - bz) * (z - bz))) AS path_length, count(*) AS n_points FROM step GROUP BY run_id),
summary AS (SELECT *, dx / nullif(sqrt(dx * dx + dy * dy + dz * dz), 0) AS dir_x, dy / nullif(sqrt(dx * dx + dy * dy + dz * dz), 0) AS dir_y, dz / nullif(sqrt(dx * dx + dy * dy + dz * dz), 0) AS dir_z FROM summary0)"""


def summaries(spark, sf):
    return trace.trace_summary(traces(spark, sf), ["run_id"], ["t_us", "idx"], XYZ, BLOCK_US)


@query(
    "trace_summary",
    f"""WITH {SUMMARY} SELECT run_id, {select_sql([(f'{c}_{e}', f'{c}_{e}') for c in XYZ for e in ('min', 'max')], 5)}, {select_sql([(f'dir_{c}', f'dir_{c}') for c in XYZ], 6)},
 {qs('path_length', 3)} AS path_length, {qs('path_length / (n_points - 1)')} AS mean_step, CAST(n_points AS BIGINT) AS n_points FROM summary""",
)
def trace_summary(spark, sf):
    d = summaries(spark, sf)
    return d.select(
        "run_id",
        *[q(F.col(f"{c}_{e}"), 5).alias(f"{c}_{e}") for c in XYZ for e in ("min", "max")],
        *[q(F.col(f"dir_{c}"), 6).alias(f"dir_{c}") for c in XYZ],
        q(F.col("path_length"), 3).alias("path_length"), q(F.col("mean_step")).alias("mean_step"), "n_points",
    )


@query(
    "footage_length",
    f"""WITH {POSES}, s AS (SELECT run_id, max(t_us) - min(t_us) AS length FROM poses GROUP BY run_id) SELECT run_id, CAST(sum(length) AS BIGINT) AS length FROM s GROUP BY ROLLUP (run_id)""",
)
def footage_length(spark, sf):
    return trace.footage_length(poses(spark, sf), "run_id", "t_us")


RUN_LABELS = "CASE c_nationkey % 4 WHEN 0 THEN '280N' WHEN 1 THEN '101N+280N' WHEN 2 THEN '101S+85N+280S' ELSE '85S' END"


@query(
    "freeway_counts",
    f"""SELECT label, CAST(count(*) AS BIGINT) AS n_runs FROM (SELECT unnest(string_split({RUN_LABELS}, '+')) AS label FROM customer) GROUP BY label""",
)
def freeway_counts(spark, sf):
    runs = table(spark, sf, "customer").selectExpr("c_custkey", f"{RUN_LABELS} AS labels")
    return trace.label_counts(runs, "labels")


@query(
    "catalogue_filter",
    f"""WITH r AS (SELECT c_custkey, (c_custkey % 12 + 1) || '-' || (c_custkey % 28 + 1) || '-14_drive' AS name, {RUN_LABELS} AS labels, make_date(2014, CAST(c_custkey % 12 + 1 AS INTEGER), CAST(c_custkey % 28 + 1 AS INTEGER)) AS d FROM customer)
SELECT c_custkey, name, CAST(d AS VARCHAR) AS run_date FROM r WHERE d BETWEEN DATE '2014-03-01' AND DATE '2014-08-15' AND list_contains(string_split(labels, '+'), '280N')""",
)
def catalogue_filter(spark, sf):
    runs = table(spark, sf, "customer").selectExpr(
        "c_custkey", "(c_custkey % 12 + 1) || '-' || (c_custkey % 28 + 1) || '-14_drive' AS name", f"{RUN_LABELS} AS labels"
    )
    d = trace.catalogue_filter(runs, "name", "labels", "280N", F.lit("2014-03-01").cast("date"), F.lit("2014-08-15").cast("date"))
    return d.select("c_custkey", "name", F.col("run_date").cast("string").alias("run_date"))


SHARE = (
    "(2 * "
    + " * ".join(f"greatest(least(a.{c}_max, b.{c}_max) - greatest(a.{c}_min, b.{c}_min), 0)" for c in XYZ)
    + " / (" + " * ".join(f"(a.{c}_max - a.{c}_min)" for c in XYZ) + " + " + " * ".join(f"(b.{c}_max - b.{c}_min)" for c in XYZ) + "))"
)
SAME = "(a.dir_x * b.dir_x + a.dir_y * b.dir_y + a.dir_z * b.dir_z >= 0)"
BEST_PAIRS = f"""{SUMMARY}, p AS (SELECT a.run_id AS ra, b.run_id AS rb, {SHARE} AS share, {SAME} AS same FROM summary a JOIN summary b ON a.run_id <> b.run_id),
best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY ra ORDER BY share DESC, rb) = 1),
pairs AS (SELECT DISTINCT least(ra, rb) AS run1, greatest(ra, rb) AS run2, share FROM best WHERE same AND share >= 0.25)"""


def pairs(spark, sf):
    return trace.best_overlaps(summaries(spark, sf), "run_id", XYZ)


@query("trace_overlaps", f"WITH {BEST_PAIRS} SELECT run1, run2, {qs('share', 6)} AS share FROM pairs")
def trace_overlaps(spark, sf):
    return pairs(spark, sf).select("run1", "run2", q(F.col("share"), 6).alias("share"))


@query(
    "trace_matches",
    f"""WITH {BEST_PAIRS}, m AS (SELECT run1, run2, s.idx AS idx2, t.idx AS idx1, (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z) AS d2
 FROM pairs JOIN traces s ON s.run_id = run2 JOIN traces t ON t.run_id = run1 QUALIFY row_number() OVER (PARTITION BY run1, run2, s.idx ORDER BY d2, t.idx) = 1)
SELECT run1, run2, idx1, idx2, {qs('sqrt(d2)')} AS dist FROM m WHERE d2 < 400""",
)
def trace_matches(spark, sf):
    p, t = pairs(spark, sf).select("run1", "run2"), traces(spark, sf)
    src = p.join(t.select(F.col("run_id").alias("run2"), F.col("idx").alias("idx2"), *XYZ), "run2")
    tgt = p.join(t.select(F.col("run_id").alias("run1"), F.col("idx").alias("idx1"), *XYZ), "run1")
    d = spatial.nearest_within(src, tgt, ["run1", "run2"], XYZ, 20.0, "idx1")
    return d.select("run1", "run2", "idx1", "idx2", q(F.col("dist")).alias("dist"))


@query(
    "label_propagation",
    f"""WITH {SUMMARY}, k AS (SELECT *, 'fw' || (run_id % 4) AS freeway FROM summary WHERE run_id % 3 = 0),
p AS (SELECT a.run_id, b.freeway, {SHARE} AS share, b.run_id AS rb FROM summary a JOIN k b ON a.run_id % 3 <> 0 AND {SAME}),
best AS (SELECT run_id, freeway FROM p WHERE share > 0.25 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY share DESC, rb) = 1)
SELECT s.run_id, coalesce(best.freeway, 'none') AS freeway FROM summary s LEFT JOIN best ON s.run_id = best.run_id WHERE s.run_id % 3 <> 0""",
)
def label_propagation(spark, sf):
    s = summaries(spark, sf)
    labels = s.where("run_id % 3 = 0").selectExpr("run_id", "'fw' || (run_id % 4) AS freeway")
    return trace.propagate_labels(s, labels, "run_id", XYZ, "freeway")


@query(
    "chunk_alignment",
    f"""WITH {TRACES}, c AS (SELECT *, floor(idx / 500) AS chunk FROM traces), m AS (SELECT run_id, chunk, avg(x) AS mx, avg(y) AS my FROM c WHERE chunk % 3 <> 0 GROUP BY ALL)
SELECT c.run_id, idx, {qs("CASE WHEN m.mx IS NULL THEN x ELSE cos(0.1e0) * (x - mx) - sin(0.1e0) * (y - my) + mx + 1.5e0 END")} AS x,
 {qs("CASE WHEN m.mx IS NULL THEN y ELSE sin(0.1e0) * (x - mx) + cos(0.1e0) * (y - my) + my - 0.5e0 END")} AS y, {qs("CASE WHEN m.mx IS NULL THEN z ELSE z + 0.25e0 END")} AS z
FROM c LEFT JOIN m ON c.run_id = m.run_id AND c.chunk = m.chunk""",
)
def chunk_alignment(spark, sf):
    t = traces(spark, sf).select("run_id", "idx", *XYZ)
    chunks = t.select("run_id", F.floor(F.col("idx") / 500).alias("chunk")).distinct().where("chunk % 3 <> 0")
    turn = rotation.turn(2, F.lit(0.1))
    chunks = chunks.select(
        "run_id", (F.col("chunk") * 500).alias("start"), (F.col("chunk") * 500 + 500).alias("end"),
        *[rotation.as_column(turn[i][j]).alias(n) for n, (i, j) in R_NAMES],
        F.lit(1.5).alias("tx"), F.lit(-0.5).alias("ty"), F.lit(0.25).alias("tz"),
    )
    d = trace.apply_alignment(t, chunks, ["run_id"], "idx", XYZ, 20000)
    return d.select("run_id", "idx", *[q(F.col(c)).alias(c) for c in XYZ])


D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


@query(
    "alignment_score",
    f"""WITH {VECTORS}, s AS (SELECT run_id // 2 AS pair, vec_id, x, y, z FROM vectors WHERE run_id % 2 = 1), t AS (SELECT run_id // 2 AS pair, vec_id, x, y, z FROM vectors WHERE run_id % 2 = 0),
n AS (SELECT a.pair, min(sqrt({D2})) AS d, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS f FROM s a JOIN t b ON a.pair = b.pair GROUP BY a.pair, a.vec_id)
SELECT pair, {qs('avg(d) FILTER (d < 8)')} AS mean, CAST(count(*) FILTER (d < 8) AS BIGINT) AS n, {qs('median(d) FILTER (d < 8)')} AS median,
 {qs('avg(f) FILTER (f < 8)')} AS mean_flat, CAST(count(*) FILTER (f < 8) AS BIGINT) AS n_flat, {qs('median(f) FILTER (f < 8)')} AS median_flat FROM n GROUP BY pair""",
)
def alignment_score(spark, sf):
    v = vectors(spark, sf).withColumn("pair", F.expr("run_id div 2"))
    s = v.where("run_id % 2 = 1").select("pair", "vec_id", *XYZ)
    t = v.where("run_id % 2 = 0").select("pair", F.col("vec_id").alias("target"), *XYZ)
    d = trace.alignment_score(s, t, ["pair"], XYZ, "target", 8.0)
    return d.select("pair", "n", "n_flat", *[q(F.col(c)).alias(c) for c in ("mean", "median", "mean_flat", "median_flat")])


# --- lanes ----------------------------------------------------------------------------------------

EMB = ["x", "y", "z", "rx", "ry", "rz"]


def lane_pair(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", *[(e[i].cast("double") * 10).alias(n) for i, n in enumerate(EMB)])


@query(
    "lane_candidates",
    f"""WITH d AS (SELECT vec_id AS seq, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) * 10 AS {n}' for i, n in enumerate(EMB))}, unnest(range(-1, 2)) AS k FROM embeddings)
SELECT seq, CAST(k + 1 AS INTEGER) AS lane_no, {select_sql([(c, f'r{c} + (r{c} - {c}) * k') for c in XYZ], 5)} FROM d""",
)
def lane_candidates(spark, sf):
    e = lane_pair(spark, sf)
    left = e.select(F.col("vec_id").alias("seq"), *XYZ)
    right = e.select(F.col("vec_id").alias("seq"), *[F.col("r" + c).alias(c) for c in XYZ])
    d = lanes.lane_candidates(left, right, ["seq"], 1, 2)
    return d.select("seq", "lane_no", *[q(F.col(c), 5).alias(c) for c in XYZ])


# lanes of a run: views are the lane curve (lane number from the id), other events the measured points
LANES = f"{TRACES}, kinds AS (SELECT t.*, p.kind FROM traces t JOIN poses p ON t.idx = p.idx), lane AS (SELECT run_id, idx % 3 AS lane_no, idx AS seq, t_us, x, y, z FROM kinds WHERE kind IN ('view', 'purchase')), pts AS (SELECT run_id, idx, t_us, x, y, z FROM kinds WHERE kind IN ('click', 'signup', 'error'))"


def lane_tables(spark, sf):
    t = poses(spark, sf).selectExpr(*TRACE_COLS, "kind")
    lane = t.where("kind IN ('view', 'purchase')").select("run_id", (F.col("idx") % 3).alias("lane_no"), F.col("idx").alias("seq"), "t_us", *XYZ)
    return lane, t.where("kind IN ('click', 'signup', 'error')").select("run_id", "idx", "t_us", *XYZ)


@query(
    "lane_assignment",
    f"""WITH {LANES}, last AS (SELECT run_id, max(seq) AS last FROM lane GROUP BY run_id), c AS (SELECT l.*, floor(seq * 4 / (last + 1)) AS segment FROM lane l JOIN last USING (run_id)),
ends AS (SELECT run_id, segment, max(t_us) AS end_us FROM c GROUP BY ALL), p AS (SELECT p.*, e.segment FROM pts p ASOF JOIN ends e ON p.run_id = e.run_id AND p.t_us <= e.end_us),
n AS (SELECT a.run_id, a.idx, b.lane_no, {D2} AS d2 FROM p a JOIN c b ON a.run_id = b.run_id AND a.segment = b.segment QUALIFY row_number() OVER (PARTITION BY a.idx ORDER BY d2, b.lane_no, b.seq) = 1)
SELECT run_id, idx, lane_no, {qs('sqrt(d2)')} AS dist FROM n WHERE sqrt(d2) < CASE lane_no WHEN 0 THEN 0.5 WHEN 1 THEN 1.2 ELSE 2.2 END""",
)
def lane_assignment(spark, sf):
    lane, pts = lane_tables(spark, sf)
    d = lanes.assign_to_lanes(pts, lane, ["run_id"], "idx", "t_us", "seq", BLOCK_US, n_segments=4)
    return d.select("run_id", "idx", "lane_no", q(F.col("dist")).alias("dist"))


ATT = attitude_sql("rot_x", "rot_y", "azimuth")


@query(
    "nearest_sides",
    f"""WITH {LANES}, po AS (SELECT p.run_id, p.idx, k.x, k.y, k.z, {ATT[1][0]} AS m0, {ATT[1][1]} AS m1, {ATT[1][2]} AS m2 FROM poses p JOIN kinds k ON p.idx = k.idx WHERE p.kind = 'click'),
n AS (SELECT a.run_id, a.idx, b.lane_no, b.seq, {D2} AS d2, m0 * (b.x - a.x) + m1 * (b.y - a.y) + m2 * (b.z - a.z) AS yy FROM po a JOIN lane b ON a.run_id = b.run_id QUALIFY row_number() OVER (PARTITION BY a.idx, b.lane_no ORDER BY d2, b.seq) = 1),
s AS (SELECT run_id, idx, CASE WHEN yy >= 0 THEN 'left' ELSE 'right' END AS side, lane_no, seq, d2 FROM n QUALIFY row_number() OVER (PARTITION BY idx, yy >= 0 ORDER BY d2, lane_no, seq) = 1)
SELECT run_id, idx, side, lane_no, seq, {qs('sqrt(d2)')} AS dist FROM s""",
)
def nearest_sides(spark, sf):
    lane, _ = lane_tables(spark, sf)
    m = rotation.transpose(rotation.attitude(F.col("rot_x"), F.col("rot_y"), F.col("azimuth")))
    p = poses(spark, sf).where("kind = 'click'").select(
        "run_id", "idx", *[F.expr(e).alias("p" + c) for c, e in zip(XYZ, ("(lat - 37) * 1000", "(lon + 122) * 1000", "height / 10"))],
        *[rotation.as_column(m[i][j]).alias(n) for n, (i, j) in R_NAMES],
    )
    d = lanes.nearest_sides(p, lane.drop("t_us"), ["run_id"], "idx", "lane_no", "seq")
    return d.select("run_id", "idx", "side", "lane_no", "seq", q(F.col("dist")).alias("dist"))


@query(
    "plane_snapping",
    f"""WITH {LANES}, pl AS (SELECT seq AS plane, run_id, x, y, z, 0.6e0 AS nx, 0e0 AS ny, 0.8e0 AS nz FROM lane),
n AS (SELECT a.run_id, a.idx, a.x, a.y, a.z, b.plane, {D2} AS d2, (a.x - b.x) * nx + (a.y - b.y) * ny + (a.z - b.z) * nz AS off, nx, ny, nz FROM pts a JOIN pl b ON a.run_id = b.run_id QUALIFY row_number() OVER (PARTITION BY a.idx ORDER BY d2, b.plane) = 1)
SELECT run_id, idx, plane, {select_sql([('offset', 'off'), ('x_flat', 'x - off * nx'), ('y_flat', 'y - off * ny'), ('z_flat', 'z - off * nz')], 4)} FROM n""".replace("AS offset", 'AS "offset"'),
)
def plane_snapping(spark, sf):
    lane, pts = lane_tables(spark, sf)
    planes = lane.select(
        F.col("seq").alias("plane"), "run_id", *[F.col(c).alias("p" + c) for c in XYZ],
        F.lit(0.6).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.8).alias("nz"),
    )
    d = lanes.snap_to_planes(pts, planes, ["run_id"], "plane")
    return d.select("run_id", "idx", "plane", *[q(F.col(c)).alias(c) for c in ("offset", "x_flat", "y_flat", "z_flat")])


@query(
    "rays_on_planes",
    f"""WITH {LANES}, pl AS (SELECT seq AS plane, run_id, x, y, z, 0.6e0 AS nx, 0e0 AS ny, 0.8e0 AS nz FROM lane),
r0 AS (SELECT run_id, idx, x AS ox, y AS oy, z + 20 AS oz, (idx % 13 - 6) / 10e0 AS a, (idx % 11 - 5) / 10e0 AS b, -1e0 AS c FROM pts),
r AS (SELECT run_id, idx, ox, oy, oz, a / sqrt(a * a + b * b + c * c) AS dx, b / sqrt(a * a + b * b + c * c) AS dy, c / sqrt(a * a + b * b + c * c) AS dz FROM r0),
t AS (SELECT r.*, pl.plane, pl.x, pl.y, pl.z, ((pl.x - ox) * nx + (pl.y - oy) * ny + (pl.z - oz) * nz) / nullif(dx * nx + dy * ny + dz * nz, 0) AS t FROM r JOIN pl ON r.run_id = pl.run_id),
h AS (SELECT *, sqrt((ox + t * dx - x) * (ox + t * dx - x) + (oy + t * dy - y) * (oy + t * dy - y) + (oz + t * dz - z) * (oz + t * dz - z)) AS d FROM t WHERE t IS NOT NULL)
SELECT run_id, idx, plane, {select_sql([('x', 'ox + t * dx'), ('y', 'oy + t * dy'), ('z', 'oz + t * dz'), ('dist', 'd')])} FROM h QUALIFY row_number() OVER (PARTITION BY idx ORDER BY d, plane) = 1""",
)
def rays_on_planes(spark, sf):
    lane, pts = lane_tables(spark, sf)
    planes = lane.select(
        F.col("seq").alias("plane"), "run_id", *[F.col(c).alias("p" + c) for c in XYZ],
        F.lit(0.6).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.8).alias("nz"),
    )
    rays = pts.select(
        "run_id", "idx", F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("z") + 20).alias("oz"),
        ((F.col("idx") % 13 - 6) / F.lit(10.0)).alias("dx"), ((F.col("idx") % 11 - 5) / F.lit(10.0)).alias("dy"), F.lit(-1.0).alias("dz"),
    )
    d = lanes.rays_to_planes(rays, planes, ["run_id"], "idx", "plane", finest=8.0)
    return d.select("run_id", "idx", "plane", *[q(F.col(c)).alias(c) for c in (*XYZ, "dist")])


# two cameras of a rig, one forward, one to the left, behind the lidar's mounting
CAMERAS = [(0, [0.1, -0.3, 0.2], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), (1, [0.1, 0.3, 0.2], [0.0, 0.0, 1.0, 0.0, 1.0, 0.0, -1.0, 0.0, 0.0])]
CAMERA_SCHEMA = "camera bigint, lidar_to_vehicle array<double>, displacement array<double>, rotation array<double>, extrinsic array<double>, matrix array<double>, distort array<double>, width int, height int"
SEEN_US = 3 * DAY_US


def rig(spark):
    c, s = float(np.cos(0.02)), float(np.sin(0.02))
    to_vehicle = [c, -s, 0.0, 1.6, s, c, 0.0, -0.2, 0.0, 0.0, 1.0, 1.9, 0.0, 0.0, 0.0, 1.0]
    extrinsic = [1.0, 0.0, 0.0, 0.01, 0.0, 1.0, 0.0, 0.02, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    matrix = [FOCAL[0], 0.0, CENTRE[0], 0.0, FOCAL[1], CENTRE[1], 0.0, 0.0, 1.0]
    return spark.createDataFrame([(n, to_vehicle, shift, turn, extrinsic, matrix, list(DISTORT), *IMAGE) for n, shift, turn in CAMERAS], CAMERA_SCHEMA)


@query(
    "map_projection",
    f"""WITH {POSES}, tr AS (SELECT {', '.join(TRACE_COLS)}, kind, {', '.join(f'{ATT[i][j]} AS w{i}{j}' for i in range(3) for j in range(3))} FROM poses),
i AS (SELECT f.run_id, f.idx AS frame, f.idx % 2 AS camera, p.idx, {', '.join(f'f.w{k}0 * (p.x - f.x) + f.w{k}1 * (p.y - f.y) + f.w{k}2 * (p.z - f.z) - {s} AS v{k}' for k, s in enumerate(('1.6e0', '(-0.2e0)', '1.9e0')))}
  FROM tr f JOIN tr p ON f.run_id = p.run_id AND f.kind = 'click' AND p.kind IN ('view', 'purchase') AND abs(p.t_us - f.t_us) < {SEEN_US}),
l AS (SELECT run_id, frame, camera, idx, cos(0.02e0) * v0 + sin(0.02e0) * v1 + 0.1e0 AS x, -sin(0.02e0) * v0 + cos(0.02e0) * v1 + CASE camera WHEN 0 THEN -0.3e0 ELSE 0.3e0 END AS y, v2 + 0.2e0 AS z FROM i),
k AS (SELECT run_id, frame, camera, idx, CASE camera WHEN 0 THEN -y ELSE x END + 0.01e0 AS a, -z + 0.02e0 AS b, CASE camera WHEN 0 THEN x ELSE y END AS c FROM l),
e AS (SELECT *, {projected_sql('a', 'b', 'c')} FROM k WHERE c > 0)
SELECT run_id, frame, camera, idx, CAST(round_even(u, 0) AS INTEGER) AS u, CAST(round_even(v, 0) AS INTEGER) AS v, {qs('c')} AS depth FROM e WHERE {VISIBLE_SQL}""",
)
def map_projection(spark, sf):
    """Points of a drive in the images taken within three days of them."""
    m = rotation.transpose(rotation.attitude(F.col("rot_x"), F.col("rot_y"), F.col("azimuth")))
    t = poses(spark, sf).selectExpr(*TRACE_COLS, "kind", "rot_x", "rot_y", "azimuth")
    frames = t.where("kind = 'click'").select(
        "run_id", F.col("idx").alias("frame"), (F.col("idx") % 2).alias("camera"), "t_us", *[F.col(c).alias("p" + c) for c in XYZ],
        *[rotation.as_column(m[i][j]).alias(n) for n, (i, j) in R_NAMES],
    )
    pts = t.where("kind IN ('view', 'purchase')").select("run_id", "idx", "t_us", *XYZ)
    d = projection.project_map(pts, frames, rig(spark), ["run_id"], "idx", "frame", time="t_us", window=SEEN_US)
    return d.withColumn("depth", q(F.col("depth")))


HALF = 2 * DAY_US


@query(
    "lane_sections",
    f"""WITH {LANES}, f AS (SELECT k.run_id, k.idx, k.t_us, k.x, k.y, k.z FROM kinds k WHERE kind = 'click'),
w AS (SELECT f.run_id, f.idx, any_value(f.x) AS fx, any_value(f.y) AS fy, any_value(f.z) AS fz, {', '.join(f'arg_min(t.{c}, t.t_us) AS n{c}, arg_max(t.{c}, t.t_us) AS a{c}' for c in XYZ)} FROM f JOIN traces t ON f.run_id = t.run_id AND t.t_us > f.t_us - {HALF} AND t.t_us < f.t_us + {HALF} GROUP BY f.run_id, f.idx),
c AS (SELECT w.run_id, w.idx, l.lane_no, l.seq, (l.x - nx) * (l.x - nx) + (l.y - ny) * (l.y - ny) + (l.z - nz) * (l.z - nz) AS dn, (l.x - ax) * (l.x - ax) + (l.y - ay) * (l.y - ay) + (l.z - az) * (l.z - az) AS df
 FROM w JOIN lane l ON w.run_id = l.run_id AND sqrt((l.x - fx) * (l.x - fx) + (l.y - fy) * (l.y - fy) + (l.z - fz) * (l.z - fz)) <= 40),
s AS (SELECT run_id, idx, lane_no, arg_min(seq, (dn, seq)) AS seq_from, arg_min(seq, (df, seq)) AS seq_to FROM c GROUP BY ALL)
SELECT s.run_id, s.idx, s.lane_no, s.seq_from, s.seq_to, CAST(count(*) AS BIGINT) AS n_points FROM s JOIN lane l ON s.run_id = l.run_id AND s.lane_no = l.lane_no AND l.seq BETWEEN seq_from AND seq_to GROUP BY ALL""",
)
def lane_sections(spark, sf):
    t = poses(spark, sf).selectExpr(*TRACE_COLS, "kind")
    lane, _ = lane_tables(spark, sf)
    frames = t.where("kind = 'click'").select("run_id", "idx", "t_us", *XYZ)
    ln = lane.select("run_id", "lane_no", "seq", *XYZ)
    s = lanes.section_in_view(frames, t.select("run_id", "t_us", *XYZ), ln, ["run_id"], "idx", "t_us", "seq", HALF, 40.0)
    d = lanes.points_of_sections(s, ln, ["run_id"], "idx", "seq")
    return d.groupBy("run_id", "idx", "lane_no", "seq_from", "seq_to").agg(F.count("*").alias("n_points"))


SIDES = "sides AS (SELECT run_id, idx, x, y, z, CASE WHEN idx % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM pts)"
SIDEWAYS = "v_north / nullif(sqrt(v_east * v_east + v_north * v_north), 0) AS sx, -v_east / nullif(sqrt(v_east * v_east + v_north * v_north), 0) AS sy, 0e0 AS sz"


def sided(spark, sf):
    _, pts = lane_tables(spark, sf)
    return pts.withColumn("side", F.when(F.col("idx") % 2 == 0, "left").otherwise("right")).drop("t_us")


def view_poses(spark, sf):
    s = trace.sideways(F.col("v_east"), F.col("v_north"))
    return poses(spark, sf).where("kind = 'view'").select(
        "run_id", F.col("idx").alias("pose"), "t_us",
        *[F.expr(e).alias(c) for c, e in zip(XYZ, ("(lat - 37) * 1000", "(lon + 122) * 1000", "height / 10"))],
        s[0].alias("sx"), s[1].alias("sy"), F.lit(0.0).alias("sz"),
    )


CROSS = ["((b.y - a.y) * a.sz - (b.z - a.z) * a.sy)", "((b.z - a.z) * a.sx - (b.x - a.x) * a.sz)", "((b.x - a.x) * a.sy - (b.y - a.y) * a.sx)"]
LINE_D = f"sqrt({CROSS[0]} * {CROSS[0]} + {CROSS[1]} * {CROSS[1]} + {CROSS[2]} * {CROSS[2]})"
VIEWS = f"views AS (SELECT p.run_id, p.idx AS pose, p.t_us, k.x, k.y, k.z, {SIDEWAYS} FROM poses p JOIN kinds k ON p.idx = k.idx WHERE p.kind = 'view')"


@query(
    "ego_lane_trace",
    f"""WITH {LANES}, {SIDES}, {VIEWS}, hit AS (SELECT a.run_id, a.pose, b.side, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM views a JOIN sides b ON a.run_id = b.run_id AND abs(b.x - a.x) < 30 AND {LINE_D} <= 8
 QUALIFY row_number() OVER (PARTITION BY a.pose, b.side ORDER BY {LINE_D}, b.idx) = 1),
d AS (SELECT v.run_id, v.pose, v.t_us, v.x, v.y, v.z, s.side, h.dx, h.dy, h.dz, row_number() OVER (PARTITION BY v.run_id, s.side ORDER BY v.t_us, v.pose) AS no FROM views v JOIN (SELECT DISTINCT run_id, side FROM hit) s ON v.run_id = s.run_id LEFT JOIN hit h ON v.pose = h.pose AND s.side = h.side),
e AS (SELECT *, last(CASE WHEN dx IS NOT NULL THEN {{'no': no, 'dx': dx, 'dy': dy, 'dz': dz}} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, first(CASE WHEN dx IS NOT NULL THEN {{'no': no, 'dx': dx, 'dy': dy, 'dz': dz}} END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n
 FROM d WINDOW w AS (PARTITION BY run_id, side ORDER BY no)),
f AS (SELECT *, CASE WHEN n.no > p.no THEN CAST(no - p.no AS DOUBLE) / (n.no - p.no) ELSE 0e0 END AS f FROM e),
g AS (SELECT run_id, pose, side, no, x, y, z, count(*) OVER (PARTITION BY run_id, side) AS cnt, {', '.join(f'round(CASE WHEN p IS NULL THEN n.d{c} WHEN n IS NULL THEN p.d{c} ELSE (1 - f) * p.d{c} + f * n.d{c} END * 1e6) AS u{c}' for c in XYZ)} FROM f),
h AS (SELECT *, {', '.join(f'sum(u{c}) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(3 - no, 0) * first(u{c}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + greatest(no + 2 - cnt, 0) * last(u{c}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s{c}' for c in XYZ)} FROM g WINDOW w AS (PARTITION BY run_id, side ORDER BY no))
SELECT run_id, side, pose, {select_sql([(f'lane_{c}', f'{c} + s{c} / 5e6') for c in XYZ], 4)} FROM h""",
)
def ego_lane_trace(spark, sf):
    v = view_poses(spark, sf)
    d = lanes.ego_lane_trace(v, sided(spark, sf), ["run_id"], "pose", ["t_us"], "idx", BLOCK_US, 30.0, 8.0, window=5)
    return d.select("run_id", "side", "pose", *[q(F.col(f"lane_{c}")).alias(f"lane_{c}") for c in XYZ])


@query(
    "far_lane_points",
    f"""WITH {LANES}, {SIDES}, f AS (SELECT run_id, idx AS frame, x, y, z FROM kinds WHERE kind = 'click'),
s AS (SELECT a.run_id, a.frame, b.side, {', '.join(f'median(b.{c}) AS {c}' for c in XYZ)} FROM f a JOIN sides b ON a.run_id = b.run_id AND b.idx > a.frame AND b.idx < a.frame + 4000 AND sqrt({D2}) BETWEEN 20 AND 60 GROUP BY ALL)
SELECT l.run_id, l.frame, {select_sql([(f'left_{c}', f'l.{c}') for c in XYZ] + [(f'right_{c}', f'r.{c}') for c in XYZ], 5)} FROM s l JOIN s r ON l.run_id = r.run_id AND l.frame = r.frame AND l.side = 'left' AND r.side = 'right'""",
)
def far_lane_points(spark, sf):
    t = poses(spark, sf).selectExpr(*TRACE_COLS, "kind")
    frames = t.where("kind = 'click'").select("run_id", F.col("idx").alias("frame"), *XYZ)
    d = lanes.far_lane_points(frames, sided(spark, sf), ["run_id"], "frame", "idx", 4000, 20.0, 60.0)
    return d.select("run_id", "frame", *[q(F.col(c), 5).alias(c) for c in d.columns[2:]])


@query(
    "lane_offsets",
    f"""WITH {LANES}, n AS (SELECT b.run_id, b.lane_no, b.seq, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz FROM lane b JOIN pts a ON a.run_id = b.run_id AND {D2} < 225 QUALIFY row_number() OVER (PARTITION BY b.seq ORDER BY {D2}, a.idx) = 1),
m AS (SELECT run_id, lane_no, {', '.join(f'median(d{c}) AS d{c}' for c in XYZ)} FROM n GROUP BY ALL)
SELECT l.run_id, l.lane_no, l.seq, {select_sql([(c, f'l.{c} + coalesce(m.d{c}, 0)') for c in XYZ], 5)} FROM lane l LEFT JOIN m ON l.run_id = m.run_id AND l.lane_no = m.lane_no""",
)
def lane_offsets(spark, sf):
    lane, pts = lane_tables(spark, sf)
    d = lanes.offset_by_median(lane.drop("t_us"), pts.drop("t_us"), ["run_id"], "lane_no", "idx", 15.0)
    return d.select("run_id", "lane_no", "seq", *[q(F.col(c), 5).alias(c) for c in XYZ])


AHEAD = f"""{LANES}, {SIDES}, pose0 AS (SELECT p.run_id, p.idx, k.x, k.y, k.z, p.height / 7 + 0.5e0 AS step, {SIDEWAYS}, row_number() OVER (PARTITION BY p.run_id ORDER BY p.idx) - 1 AS frame, {', '.join(f'{ATT[j][i]} AS r{i}{j}' for _, (i, j) in R_NAMES)} FROM poses p JOIN kinds k ON p.idx = k.idx),
pose1 AS (SELECT *, sum(step) OVER (PARTITION BY run_id ORDER BY frame) AS cum FROM pose0),
ahead0 AS (SELECT a.run_id, a.frame, m.mark, min(b.frame) AS ahead FROM pose1 a JOIN (SELECT unnest([10e0, 20e0, 30e0]) AS mark) m ON TRUE JOIN pose1 b ON a.run_id = b.run_id AND b.cum >= a.cum + m.mark + 2 GROUP BY ALL),
ahead AS (SELECT * FROM ahead0 QUALIFY count(*) OVER (PARTITION BY run_id, frame) = 3),
lanes2 AS (SELECT run_id, frame, unnest(['left', 'right']) AS side, x + unnest([3e0, -3e0]) AS x, y, z FROM pose1),
beside AS (SELECT a.run_id, a.frame, b.side, b.x, b.y, b.z FROM pose1 a JOIN lanes2 b ON a.run_id = b.run_id AND b.frame >= a.frame - 5 AND b.frame < a.frame + 5 QUALIFY row_number() OVER (PARTITION BY a.run_id, a.frame, b.side ORDER BY {LINE_D}, b.frame) = 1),
goal AS (SELECT run_id, frame, side AS what, x, y, z FROM beside UNION ALL SELECT run_id, frame, 'centre', x, y, z FROM pose1),
labels AS (SELECT h.run_id, h.frame, h.mark, g.what, {', '.join(f'o.r0{i} * (g.x - o.x) + o.r1{i} * (g.y - o.y) + o.r2{i} * (g.z - o.z) AS {c}' for i, c in enumerate(XYZ))} FROM ahead h JOIN goal g ON h.run_id = g.run_id AND h.ahead = g.frame JOIN pose1 o ON o.run_id = h.run_id AND o.frame = h.frame
 UNION ALL SELECT h.run_id, h.frame, h.mark, 'sideways', {', '.join(f'o.r0{i} * g.sx + o.r1{i} * g.sy + o.r2{i} * g.sz' for i in range(3))} FROM ahead h JOIN pose1 g ON h.run_id = g.run_id AND h.ahead = g.frame JOIN pose1 o ON o.run_id = h.run_id AND o.frame = h.frame)"""
MARKS = (10.0, 20.0, 30.0)


def ahead_labels(spark, sf):
    m = rotation.transpose(rotation.attitude(F.col("rot_x"), F.col("rot_y"), F.col("azimuth")))
    s = trace.sideways(F.col("v_east"), F.col("v_north"))
    p = poses(spark, sf).select(
        "run_id", "idx", *[F.expr(e).alias(c) for c, e in zip(XYZ, ("(lat - 37) * 1000", "(lon + 122) * 1000", "height / 10"))],
        (F.col("height") / 7 + 0.5).alias("step"), s[0].alias("sx"), s[1].alias("sy"), F.lit(0.0).alias("sz"),
        *[rotation.as_column(m[i][j]).alias(n) for n, (i, j) in R_NAMES],
    )
    p = blocks.row_index(p, ["run_id"], ["idx"], 20000, "_rn").withColumn("frame", F.col("_rn") - 1).drop("_rn", "idx")
    l = p.select("run_id", "frame", F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.lit(o).alias("o")) for n, o in (("left", 3.0), ("right", -3.0))])).alias("_s"), *XYZ)
    l = l.select("run_id", "frame", "_s.side", (F.col("x") + F.col("_s.o")).alias("x"), "y", "z")
    return lanes.labels_ahead(p, l, ["run_id"], "frame", "step", 500, MARKS, reach=5)


@query("labels_ahead", f"WITH {AHEAD} SELECT run_id, frame, CAST(mark AS DOUBLE) AS mark, what, {select_sql([(c, c) for c in XYZ], 4)} FROM labels")
def labels_ahead(spark, sf):
    d = ahead_labels(spark, sf)
    return d.select("run_id", "frame", "mark", "what", *[q(F.col(c)).alias(c) for c in XYZ])


@query(
    "label_vectors",
    f"""WITH {AHEAD}, v AS (SELECT run_id, frame, count(*) AS n, {', '.join(f"max(CASE WHEN what = '{w}' AND mark = {m}e0 THEN {c} END) AS s{i}" for i, (w, m, c) in enumerate((w, m, c) for w in ('left', 'centre', 'right', 'sideways') for m in (10, 20, 30) for c in XYZ))} FROM labels GROUP BY ALL)
SELECT run_id, frame, CAST(36 AS INTEGER) AS size, {qs('s0')} AS first_value, {qs('s13')} AS middle_value, {qs('s35')} AS last_value FROM v""",
)
def label_vectors(spark, sf):
    d = lanes.label_vectors(ahead_labels(spark, sf), ["run_id"], "frame", MARKS)
    at = {"first_value": 1, "middle_value": 14, "last_value": 36}
    return d.select("run_id", "frame", F.size("label").alias("size"), *[q(F.element_at("label", i)).alias(n) for n, i in at.items()])


@query(
    "smoothed_normals",
    f"""WITH RECURSIVE {TRACES}, o AS (SELECT run_id, idx, x, y, row_number() OVER (PARTITION BY run_id ORDER BY t_us, idx) AS rn FROM traces),
r(run_id, idx, rn, sx, sy) AS (SELECT run_id, idx, rn, x, y FROM o WHERE rn = 1 UNION ALL SELECT o.run_id, o.idx, o.rn, r.sx * 0.3e0 + o.x * 0.7e0, r.sy * 0.3e0 + o.y * 0.7e0 FROM r JOIN o ON o.run_id = r.run_id AND o.rn = r.rn + 1)
SELECT run_id, idx, {qs('sx', 5)} AS x_smooth, {qs('sy', 5)} AS y_smooth FROM r""",
)
def smoothed_normals(spark, sf):
    t = traces(spark, sf)
    d = lanes.smooth_normals(t, ["run_id"], ["t_us", "idx"], ["x", "y"], BLOCK_US)
    return d.select("run_id", "idx", q(F.col("x_smooth"), 5).alias("x_smooth"), q(F.col("y_smooth"), 5).alias("y_smooth"))


@query(
    "resampled_lanes",
    f"""WITH RECURSIVE {LANES}, k AS (SELECT run_id, lane_no, t_us, {', '.join(f'avg(l.{c}) AS {c}' for c in XYZ)} FROM (SELECT l.*, t.t_us FROM lane l JOIN poses t ON l.run_id = t.run_id AND l.seq = t.idx) l GROUP BY ALL),
a AS (SELECT run_id, lane_no, t_us, a.axis, a.v FROM k, LATERAL (VALUES ('x', x), ('y', y), ('z', z)) AS a(axis, v)),
o AS (SELECT *, row_number() OVER w AS rn, min(t_us) OVER (PARTITION BY run_id, lane_no, axis) AS t0, lead(t_us) OVER w AS nt, lead(v) OVER w AS nv, (t_us - lag(t_us) OVER w) / 1e6 AS h0, (lead(t_us) OVER w - t_us) / 1e6 AS h1,
  6 * ((lead(v) OVER w - v) / ((lead(t_us) OVER w - t_us) / 1e6) - (v - lag(v) OVER w) / ((t_us - lag(t_us) OVER w) / 1e6)) AS s FROM a WINDOW w AS (PARTITION BY run_id, lane_no, axis ORDER BY t_us)),
f(run_id, lane_no, axis, rn, up, g) AS (
  SELECT run_id, lane_no, axis, rn, h1 / (2 * (h0 + h1)), s / (2 * (h0 + h1)) FROM o WHERE rn = 2 AND nt IS NOT NULL
  UNION ALL SELECT o.run_id, o.lane_no, o.axis, o.rn, o.h1 / (2 * (o.h0 + o.h1) - o.h0 * f.up), (o.s - o.h0 * f.g) / (2 * (o.h0 + o.h1) - o.h0 * f.up) FROM f JOIN o ON o.run_id = f.run_id AND o.lane_no = f.lane_no AND o.axis = f.axis AND o.rn = f.rn + 1 AND o.nt IS NOT NULL),
b(run_id, lane_no, axis, rn, m) AS (
  SELECT run_id, lane_no, axis, rn, g FROM f QUALIFY row_number() OVER (PARTITION BY run_id, lane_no, axis ORDER BY rn DESC) = 1
  UNION ALL SELECT f.run_id, f.lane_no, f.axis, f.rn, f.g - f.up * b.m FROM b JOIN f ON f.run_id = b.run_id AND f.lane_no = b.lane_no AND f.axis = b.axis AND f.rn = b.rn - 1),
i AS (SELECT o.*, coalesce(b.m, 0) AS m, coalesce(n.m, 0) AS nm FROM o LEFT JOIN b USING (run_id, lane_no, axis, rn) LEFT JOIN b n ON n.run_id = o.run_id AND n.lane_no = o.lane_no AND n.axis = o.axis AND n.rn = o.rn + 1),
e AS (SELECT *, unnest(range((t_us - t0 + {DAY_US // 4 - 1}) // {DAY_US // 4}, (coalesce(nt, t_us + 1) - t0 + {DAY_US // 4 - 1}) // {DAY_US // 4})) AS seq FROM i),
c AS (SELECT *, t0 + seq * {DAY_US // 4} AS tt, (nt - (t0 + seq * {DAY_US // 4})) / 1e6 AS p, (t0 + seq * {DAY_US // 4} - t_us) / 1e6 AS q FROM e),
d AS (SELECT run_id, lane_no, seq, tt, axis, CASE WHEN nt IS NULL THEN v ELSE m * p * p * p / (6 * h1) + nm * q * q * q / (6 * h1) + (v / h1 - m * h1 / 6) * p + (nv / h1 - nm * h1 / 6) * q END AS y FROM c)
SELECT run_id, lane_no, seq, tt AS t_us, {', '.join(f"{qs(f'max(CASE WHEN axis = {chr(39)}{c}{chr(39)} THEN y END)')} AS {c}" for c in XYZ)} FROM d GROUP BY ALL""",
)
def resampled_lanes(spark, sf):
    """Natural cubic curves by time."""
    lane, _ = lane_tables(spark, sf)
    d = lanes.resample_lanes(lane, ["run_id", "lane_no"], "t_us", BLOCK_US, step_us=DAY_US // 4, block_rows=16)
    return d.select("run_id", "lane_no", "seq", "t_us", *[q(F.col(c)).alias(c) for c in XYZ])


@query(
    "fixed_lane_points",
    f"""WITH RECURSIVE {LANES}, near AS (SELECT a.run_id, a.lane_no, a.seq, {', '.join(f'b.{c}' for c in XYZ)} FROM lane a JOIN pts b ON a.run_id = b.run_id AND {D2} < 25 QUALIFY row_number() OVER (PARTITION BY a.run_id, a.lane_no, a.seq ORDER BY {D2}, b.idx) = 1),
r AS (SELECT l.run_id, l.lane_no, l.seq, n.x IS NOT NULL AS snapped, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l.run_id, l.lane_no) AS n, {', '.join(f'coalesce(n.{c}, l.{c}) AS {c}' for c in XYZ)}
  FROM lane l LEFT JOIN near n USING (run_id, lane_no, seq) WINDOW w AS (PARTITION BY l.run_id, l.lane_no ORDER BY l.seq)),
a AS (SELECT run_id, lane_no, seq, snapped, i, n, a.axis, a.s, a.v, CASE WHEN snapped THEN 2e0 ELSE 1e0 END AS w FROM r, LATERAL (VALUES ('x', 10e0, x), ('y', 10e0, y), ('z', 20e0, z)) AS a(axis, s, v)),
o AS (SELECT *, w * v AS rhs, w + CASE WHEN n < 3 THEN 0 ELSE s * (CASE WHEN i <= n - 3 THEN 1 ELSE 0 END + CASE WHEN i >= 1 AND i <= n - 2 THEN 4 ELSE 0 END + CASE WHEN i >= 2 THEN 1 ELSE 0 END) END AS a0,
  CASE WHEN n < 3 THEN 0 ELSE s * (CASE WHEN i <= n - 3 THEN -2 ELSE 0 END + CASE WHEN i >= 1 AND i <= n - 2 THEN -2 ELSE 0 END) END AS a1, CASE WHEN n >= 3 AND i <= n - 3 THEN s ELSE 0e0 END AS a2 FROM a),
f(run_id, lane_no, axis, i, c, e, f, z, c1, f1, z1) AS (
  SELECT run_id, lane_no, axis, i, a0, a1 / a0, a2 / a0, rhs, 0e0, 0e0, 0e0 FROM o WHERE i = 0
  UNION ALL SELECT run_id, lane_no, axis, i, c, (a1 - c0 * e0 * f0) / c, a2 / c, z, c0, f0, z0 FROM (
    SELECT o.run_id, o.lane_no, o.axis, o.i, o.a1, o.a2, f.c AS c0, f.e AS e0, f.f AS f0, f.z AS z0, o.a0 - f.c * f.e * f.e - f.c1 * f.f1 * f.f1 AS c, o.rhs - f.e * f.z - f.f1 * f.z1 AS z
    FROM f JOIN o ON o.run_id = f.run_id AND o.lane_no = f.lane_no AND o.axis = f.axis AND o.i = f.i + 1)),
b(run_id, lane_no, axis, i, x, x1) AS (
  SELECT run_id, lane_no, axis, i, z / c, 0e0 FROM f QUALIFY row_number() OVER (PARTITION BY run_id, lane_no, axis ORDER BY i DESC) = 1
  UNION ALL SELECT f.run_id, f.lane_no, f.axis, f.i, f.z / f.c - f.e * b.x - f.f * b.x1, b.x FROM b JOIN f ON f.run_id = b.run_id AND f.lane_no = b.lane_no AND f.axis = b.axis AND f.i = b.i - 1)
SELECT run_id, lane_no, seq, snapped, {', '.join(f"{qs(f'max(CASE WHEN axis = {chr(39)}{c}{chr(39)} THEN b.x END)')} AS {c}_fixed" for c in XYZ)} FROM b JOIN r USING (run_id, lane_no, i) GROUP BY ALL""",
)
def fixed_lane_points(spark, sf):
    """Lane points moved to measured ones and smoothed along the whole lane, in small blocks."""
    lane, pts = lane_tables(spark, sf)
    d = lanes.fix_lanes(lane.drop("t_us"), pts.drop("t_us"), ["run_id"], ["run_id", "lane_no"], "seq", "idx", 20000, limit=5.0, block_rows=16)
    return d.select("run_id", "lane_no", "seq", "snapped", *[q(F.col(f"{c}_fixed")).alias(f"{c}_fixed") for c in XYZ])


@query("fixed_lanes")
def fixed_lanes(spark, sf):
    lane, pts = lane_tables(spark, sf)
    d = cut_lineage(lanes.fix_lanes(lane.drop("t_us"), pts.drop("t_us"), ["run_id"], ["run_id", "lane_no"], "seq", "idx", 20000, limit=5.0))
    k = ["run_id", "lane_no"]
    before = lanes.lane_error(d, pts, ["run_id"], k, "idx", 30.0).withColumnRenamed("median_error", "error_before")
    after = lanes.lane_error(d, pts, ["run_id"], k, "idx", 30.0, [f"{c}_fixed" for c in XYZ]).withColumnRenamed("median_error", "error_after")
    return before.join(after, k, "full")


# --- smoothing and registration -------------------------------------------------------------------


@query("smoothed_trajectory")
def smoothed_trajectory(spark, sf):
    """Kalman filter and smoother; the scan match gives an increment on every fifth row."""
    t = traces(spark, sf)
    d = t.withColumns({f"i{c}": F.when(F.col("idx") % 5 == 0, F.col(c) / 100) for c in XYZ})
    return smoothing.smooth_trajectory(d, ["run_id"], ["t_us", "idx"], BLOCK_US)


FILTER_SQL = f"""
WITH RECURSIVE {TRACES},
axes AS (
  SELECT run_id, idx, t_us, a.axis, a.pos, a.start_var FROM traces, LATERAL (VALUES ('x', x, 0.01e0), ('y', y, 0.3e0), ('z', z, 0.3e0)) AS a(axis, pos, start_var)),
o AS (
  SELECT *, row_number() OVER w AS rn, abs(pos - lag(pos) OVER w) AS way, lead(pos) OVER w AS nxt,
    CASE WHEN idx % 5 = 0 THEN (pos + (pos + pos / 100) * 10) / 11 ELSE pos END AS seen, CASE WHEN idx % 5 = 0 THEN 1e0 / 11 ELSE 1e0 END AS var
  FROM axes WINDOW w AS (PARTITION BY run_id, axis ORDER BY t_us, idx)),
f(run_id, axis, rn, idx, m, v, p, c, w) AS (
  SELECT run_id, axis, rn, idx, pos, coalesce(nxt - pos, 0), start_var, 0e0, 0.5e0 FROM o WHERE rn = 1
  UNION ALL
  SELECT run_id, axis, rn, idx, pm + pp / s * (seen - pm), v + pc / s * (seen - pm), pp - pp * pp / s, pc - pp * pc / s, pw - pc * pc / s
  FROM (
    SELECT o.run_id, o.axis, o.rn, o.idx, o.seen, f.m + f.v AS pm, f.v, f.p + 2 * f.c + f.w + 10 * o.way AS pp, f.c + f.w AS pc, f.w + o.way AS pw,
      f.p + 2 * f.c + f.w + 10 * o.way + o.var AS s
    FROM f JOIN o ON o.run_id = f.run_id AND o.axis = f.axis AND o.rn = f.rn + 1))
SELECT run_id, idx, axis, {qs("m")} AS position, {qs("p")} AS variance FROM f"""


@query("filtered_trajectory", FILTER_SQL)
def filtered_trajectory(spark, sf):
    """The filter's part of the smoothed trajectory, in small blocks."""
    d = traces(spark, sf).withColumns({f"i{c}": F.when(F.col("idx") % 5 == 0, F.col(c) / 100) for c in XYZ})
    d = smoothing.smooth_trajectory(d, ["run_id"], ["t_us", "idx"], BLOCK_US, block_rows=16)
    per = F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(f"{c}_f").alias("m"), F.col(f"var_f_{c}").alias("p")) for c in XYZ]))
    return d.select("run_id", "idx", per.alias("a")).select("run_id", "idx", "a.axis", q(F.col("a.m")).alias("position"), q(F.col("a.p")).alias("variance"))


@query("corrected_trajectory")
def corrected_trajectory(spark, sf):
    p = poses(spark, sf).selectExpr(*TRACE_COLS, "v_east", "v_north", "v_up")
    d = smoothing.corrected_trajectory(p, ["run_id"], ["t_us", "idx"], BLOCK_US).drop("residual")
    angles = poses(spark, sf).select("run_id", "idx", "rot_x", "rot_y", "azimuth")
    return smoothing.with_transforms(d.join(angles, ["run_id", "idx"]), "rot_x", "rot_y", "azimuth").drop("rot_x", "rot_y", "azimuth")


@query(
    "corrected_residuals",
    f"WITH {POSES} SELECT run_id, count(*) AS n, 0e0 AS largest, 0 AS beyond FROM poses GROUP BY run_id",
)
def corrected_residuals(spark, sf):
    """The solution is the minimum: no free bias has a gradient left and none is beyond its limit."""
    p = poses(spark, sf).selectExpr(*TRACE_COLS, "v_east", "v_north", "v_up")
    d = smoothing.corrected_trajectory(p, ["run_id"], ["t_us", "idx"], BLOCK_US, block_rows=48)
    over = F.greatest(*[F.abs(f"b_{c}") for c in XYZ]) > smoothing.BIAS_LIMIT + 1e-9
    return d.groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.max("residual"), 6).alias("largest"), F.sum(over.cast("int")).alias("beyond"))


@query("offset_deskew")
def offset_deskew(spark, sf):
    """Older deskew by pose spacing; rotations have no plain SQL form here."""
    p = poses(spark, sf)
    quat = rotation.attitude_quat(F.col("rot_x"), F.col("rot_y"), F.col("azimuth"))
    names = [f"q{i}" for i in range(4)]
    ps = p.select(
        "run_id", "idx", *[rotation.as_column(c).alias(n) for n, c in zip(names, quat)],
        *[F.expr(e).alias("p" + c) for c, e in zip(XYZ, ("(lat - 37) * 1000", "(lon + 122) * 1000", "height / 10"))],
    )
    ps = blocks.row_index(ps, ["run_id"], ["idx"], 20000, "_rn").withColumn("row", F.col("_rn") - 1).drop("_rn")
    pts = ps.select("run_id", "idx", F.col("row").alias("frame"), (F.col("idx") % 300000 * 7 % 250000).alias("dt_us"), *[F.col("p" + c).alias(c) for c in XYZ])
    d = filters.deskew_by_offset(pts, ps.drop("idx"), ["run_id"], "frame", "dt_us", "row", names, ["px", "py", "pz"], XYZ)
    return d.select("run_id", "idx", *[f"{c}_map" for c in XYZ])


@query("ground_planes")
def ground_planes(spark, sf):
    p = points(spark, sf).select("sweep", "point_id", *XYZ)
    at = p.groupBy("sweep").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z")).withColumn("pose", F.col("sweep"))
    return registration.ground_planes(at, p, ["sweep"], "pose", "point_id", radius=60.0, threshold=1.0)


@query("support_plane_objects")
def support_plane_objects(spark, sf):
    p = points(spark, sf).select("sweep", "point_id", *XYZ)
    planes = registration.support_planes(p, ["sweep"], "point_id", threshold=1.5, min_points=8, max_tilt_deg=25.0, highest=True)
    return registration.objects_above_plane(p, planes, ["sweep"], "point_id", 0.5, 6.0, eps=20.0, min_size=2, max_size=5000)


@query(
    "support_plane_inliers",
    f"WITH {POINTS} SELECT sweep, count(*) AS n_points, 0 AS n_wrong, 0 AS too_small FROM points GROUP BY sweep",
)
def support_plane_inliers(spark, sf):
    """Each point counted for the first plane of its scan that it lies on: no plane's count differs, none is too small."""
    p = points(spark, sf).select("sweep", "point_id", *XYZ)
    planes = cut_lineage(registration.find_planes(p, ["sweep"], "point_id", threshold=1.5, min_points=8, max_tilt_deg=25.0))
    on = p.join(planes, "sweep").where(F.abs(registration.plane_offset()) < 1.5)
    first = on.groupBy("sweep", "point_id", *XYZ).agg(F.min("round").alias("round"))
    copies = p.groupBy("sweep", "point_id", *XYZ).agg(F.count("*").alias("_n"))
    counted = first.join(copies, ["sweep", "point_id", *XYZ]).groupBy("sweep", "round").agg(F.sum("_n").alias("_seen"))
    checked = planes.join(counted, ["sweep", "round"], "left").groupBy("sweep").agg(
        F.sum((~F.col("n_inliers").eqNullSafe(F.col("_seen"))).cast("int")).alias("n_wrong"), F.sum((F.col("n_inliers") < 8).cast("int")).alias("too_small")
    )
    n = p.groupBy("sweep").agg(F.count("*").alias("n_points"))
    return n.join(checked, "sweep", "left").select("sweep", "n_points", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_wrong", "too_small")])


@query("aligned_chunks")
def aligned_chunks(spark, sf):
    """Each chunk of points against a shifted copy of itself."""
    v = vectors(spark, sf).withColumn("chunk", F.col("run_id"))
    target = v.select("chunk", F.col("vec_id").alias("target"), *[(F.col(c) + s).alias(c) for c, s in zip(XYZ, (0.6, -0.4, 0.2))], "intensity")
    weights = {"x": 1.0, "y": 1.0, "z": 1.0, "intensity": 10.0}
    return registration.align_chunks(v, target, "chunk", "vec_id", "target", weights, 5.0, final_dist=0.5)


CAL_POINT = "l_partkey % 10 AS cam, l_quantity - 25 AS x, l_extendedprice / 3000 - 17 AS y, 20 + l_discount * 100 AS z"
TURNS = "SELECT CAST(a * 9 + b * 3 + c AS INTEGER) AS candidate, (a - 1) * 0.003e0 AS rx, (b - 1) * 0.003e0 AS ry, (c - 1) * 0.003e0 AS rz FROM (SELECT unnest(range(0, 3)) AS a) JOIN (SELECT unnest(range(0, 3)) AS b) ON TRUE JOIN (SELECT unnest(range(0, 3)) AS c) ON TRUE"


@query(
    "calibration_scores",
    f"""WITH p AS (SELECT {CAL_POINT} FROM lineitem), e AS (SELECT l_partkey % 10 AS cam, CAST(l_quantity * 6 + 4 AS BIGINT) AS u, CAST(floor(l_extendedprice / 600) AS BIGINT) AS v, max(l_linenumber) * 1e0 AS strength FROM lineitem GROUP BY ALL),
t AS ({TURNS}), r AS (SELECT candidate, cam, cos(rz) * cos(ry) * x + (cos(rz) * sin(ry) * sin(rx) - sin(rz) * cos(rx)) * y + (cos(rz) * sin(ry) * cos(rx) + sin(rz) * sin(rx)) * z AS a,
 sin(rz) * cos(ry) * x + (sin(rz) * sin(ry) * sin(rx) + cos(rz) * cos(rx)) * y + (sin(rz) * sin(ry) * cos(rx) - cos(rz) * sin(rx)) * z AS b, -sin(ry) * x + cos(ry) * sin(rx) * y + cos(ry) * cos(rx) * z AS c FROM p, t),
px AS (SELECT candidate, cam, CAST(round_even(120e0 * a / c + 160e0, 0) AS BIGINT) AS u, CAST(round_even(120e0 * b / c + 90.3e0, 0) AS BIGINT) AS v FROM r WHERE c > 0),
s AS (SELECT candidate, sum(strength) AS score FROM px JOIN e USING (cam, u, v) WHERE u > 4 AND v > 4 AND u < 316 AND v < 176 GROUP BY candidate),
z AS (SELECT t.candidate, coalesce(score, 0e0) AS score FROM t LEFT JOIN s USING (candidate)),
k AS (SELECT max(CASE WHEN candidate = 13 THEN score END) AS now, arg_max(candidate, (score, -candidate)) AS best FROM z), n AS (SELECT count(*) AS better FROM z, k WHERE score > now)
SELECT candidate, score, candidate = CASE WHEN better >= 13 THEN best ELSE 13 END AS accepted FROM z, k, n""",
)
def calibration_scores(spark, sf):
    li = table(spark, sf, "lineitem")
    p = li.selectExpr(*CAL_POINT.split(", "))
    e = li.selectExpr("l_partkey % 10 AS cam", "cast(l_quantity * 6 + 4 as bigint) AS u", "floor(l_extendedprice / 600) AS v", "l_linenumber")
    e = e.groupBy("cam", "u", "v").agg(F.max("l_linenumber").cast("double").alias("strength"))
    return registration.score_calibration(p, e, ["cam"], (120.0, 120.0), (160.0, 90.3), (320, 180))


@query(
    "coloured_points",
    f"""WITH {TRACES}, fr AS (SELECT run_id, idx AS frame, x AS fx, y AS fy FROM traces WHERE idx % 3 = 0), pt AS (SELECT run_id, idx, x, y, z FROM traces WHERE idx % 3 <> 0),
px AS (SELECT run_id, idx AS frame, unnest(range(0, 50)) AS u, idx % 5 AS v, idx % 256 AS r, idx % 101 AS g, idx % 17 AS b FROM traces WHERE idx % 3 = 0),
s AS (SELECT pt.run_id, pt.idx, fr.frame, CAST(floor((pt.x - fr.fx + 100) / 4) AS BIGINT) AS u, CAST(floor(abs(pt.y - fr.fy)) AS BIGINT) % 5 AS v FROM pt JOIN fr ON pt.run_id = fr.run_id AND fr.frame < pt.idx AND fr.frame > pt.idx - 2000),
c AS (SELECT s.idx, arg_max(px.r, s.frame) AS r, arg_max(px.g, s.frame) AS g, arg_max(px.b, s.frame) AS b FROM s JOIN px ON s.run_id = px.run_id AND s.frame = px.frame AND s.u = px.u AND s.v = px.v GROUP BY s.idx)
SELECT pt.run_id, pt.idx, c.r, c.g, c.b FROM pt LEFT JOIN c ON pt.idx = c.idx""",
)
def coloured_points(spark, sf):
    """Points take the colour of the last earlier frame that sees them; the pixel grid here is a coarse one."""
    t = traces(spark, sf)
    frames = t.where("idx % 3 = 0").select("run_id", F.col("idx").alias("frame"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    pts = t.where("idx % 3 <> 0").select("run_id", "idx", *XYZ)
    pixels = t.where("idx % 3 = 0").selectExpr(
        "run_id", "idx AS frame", "explode(sequence(0L, 49L)) AS u", "idx % 5 AS v", "idx % 256 AS r", "idx % 101 AS g", "idx % 17 AS b"
    )

    def to_pixel(d):
        return d.withColumns({"u": F.floor((F.col("x") - F.col("fx") + 100) / 4), "v": F.floor(F.abs(F.col("y") - F.col("fy"))) % 5})

    d = registration.colour_points(pts, frames, pixels, ["run_id"], "idx", "idx", "frame", 2000, to_pixel)
    return d.select("run_id", "idx", "r", "g", "b")
