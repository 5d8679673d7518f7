"""Image boxes: overlap joins, evaluation, tracking. A part is a frame, its 'F' lines truths, its 'O' lines detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import boxes as bx
from wayline.operators import boxes as ops
from wayline.operators import matching
from wayline.plans.inputs import BOXES, boxes, q, qs, table
from wayline.plans.registry import query

FRAME = ["frame"]


def side(spark, sf, which):
    return boxes(spark, sf).where(F.col("side") == which)


# pair measures in SQL over boxes a and b
W, H = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0e0)", "greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0e0)"
INTER = f"({W} * {H})"
AREA_A, AREA_B = "((a.x2 - a.x1) * (a.y2 - a.y1))", "((b.x2 - b.x1) * (b.y2 - b.y1))"
IOU = f"({INTER} / ({AREA_A} + {AREA_B} - {INTER}))"
COVER_AB, COVER_BA = f"({INTER} / {AREA_A})", f"({INTER} / {AREA_B})"
DX, DY = "((a.x1 + a.x2 - b.x1 - b.x2) / (a.x2 - a.x1))", "((a.y1 + a.y2 - b.y1 - b.y2) / (a.y2 - a.y1))"
DIST = f"sqrt({DX} * {DX} + {DY} * {DY})"
MATCH_IOU = f"({IOU} >= 0.5 AND (a.class_id = b.class_id OR a.class_id = -1 OR b.class_id = -1))"
MATCH_COVER = f"({COVER_BA} >= 0.5 AND {COVER_AB} >= 0.5 AND {DIST} <= 0.5 AND a.class_id = b.class_id)"


@query(
    "box_geometry",
    f"""WITH {BOXES}, d AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM boxes)
SELECT frame, box_id, {qs('w')} AS w, {qs('h')} AS h, {qs('cx', 5)} AS cx, {qs('cy', 5)} AS cy,
 {qs('CASE WHEN w / h > 1.3 THEN x1 ELSE cx - h * 1.3e0 / 2 END', 6)} AS fx1, {qs('CASE WHEN w / h > 1.3 THEN cy - w / 1.3e0 / 2 ELSE y1 END', 6)} AS fy1,
 {qs('least(greatest(x2, 0e0), 320e0)')} AS clip_x2, {qs('y1 * 0.37e0', 5)} AS small_y1, {qs('cx + w * 1.21e0 / 2', 6)} AS wide_x2 FROM d""",
)
def box_geometry(spark, sf):
    b = bx.corners()
    cx, cy = bx.centre(b)
    forced = bx.force_aspect(b, 1.3)
    return boxes(spark, sf).select(
        "frame", "box_id", q(bx.width(b)).alias("w"), q(bx.height(b)).alias("h"), q(cx, 5).alias("cx"), q(cy, 5).alias("cy"),
        q(forced[0], 6).alias("fx1"), q(forced[1], 6).alias("fy1"),
        q(bx.clip(b, 0, 0, 320, 240)[2]).alias("clip_x2"),
        q(bx.rescale(b, 0.37)[1], 5).alias("small_y1"), q(bx.resize(b, 1.21)[2], 6).alias("wide_x2"),
    )


@query(
    "box_pair_measures",
    f"""WITH {BOXES} SELECT a.frame, a.box_id AS truth_id, b.box_id AS det_id, {qs(INTER, 3)} AS shared, {qs(COVER_AB)} AS cover, {qs(IOU)} AS iou, {qs(DIST)} AS dist,
 {MATCH_IOU} AS match_iou, {MATCH_COVER} AS match_cover FROM boxes a JOIN boxes b ON a.frame = b.frame AND a.side = 'F' AND b.side = 'O' AND {INTER} > 0""",
)
def box_pair_measures(spark, sf):
    a, b = ops.pair_sides()
    pairs = ops.overlapping_pairs(side(spark, sf, "F"), side(spark, sf, "O"), FRAME)
    ca, cb = F.col("a_class_id"), F.col("b_class_id")
    return pairs.select(
        "frame", F.col("a_box_id").alias("truth_id"), F.col("b_box_id").alias("det_id"), q(bx.intersection(a, b), 3).alias("shared"),
        q(bx.cover(a, b)).alias("cover"), q(bx.iou(a, b)).alias("iou"), q(bx.centre_distance(a, b)).alias("dist"),
        bx.match_iou(a, b, ca, cb).alias("match_iou"), bx.match_cover(a, b, ca, cb).alias("match_cover"),
    )


@query(
    "box_filters",
    f"""WITH {BOXES} SELECT frame, box_id FROM boxes WHERE score >= 20000 AND class_id IN (1, -1) AND x2 - x1 >= 30 AND x2 - x1 < 80 AND y2 - y1 <= 60""",
)
def box_filters(spark, sf):
    keep = ops.box_filter(min_score=20000, classes=[1], width_bin=(30, 80), max_height=60)
    return boxes(spark, sf).where(keep).select("frame", "box_id")


@query(
    "occlusion_filter",
    f"""WITH {BOXES} SELECT frame, box_id FROM boxes a WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE a.frame = b.frame
 AND (b.y2, b.x2 - b.x1, b.box_id) > (a.y2, a.x2 - a.x1, a.box_id) AND {COVER_AB} > 0.4)""",
)
def occlusion_filter(spark, sf):
    return ops.drop_occluded(boxes(spark, sf), FRAME, "box_id").select("frame", "box_id")


@query(
    "size_sort_out",
    f"""WITH {BOXES}, t AS (SELECT *, (x2 - x1 >= 35 AND y2 - y1 >= 25) AS ok FROM boxes),
p AS (SELECT a.frame, a.box_id, {IOU} AS iou, {MATCH_IOU} AS m, b.ok FROM t a JOIN t b ON a.frame = b.frame AND a.side = 'O' AND b.side = 'F' AND {INTER} > 0),
d AS (SELECT frame, box_id, max(iou) AS best, max(CASE WHEN m AND NOT ok THEN iou END) AS lost, bool_or(m AND ok) AS backed FROM p GROUP BY ALL)
SELECT frame, box_id, 'truth' AS part FROM t WHERE side = 'F' AND ok
UNION ALL SELECT t.frame, t.box_id, 'detection' FROM t LEFT JOIN d ON t.frame = d.frame AND t.box_id = d.box_id
WHERE side = 'O' AND NOT coalesce(lost >= best, FALSE) AND (ok OR coalesce(backed, FALSE))""",
)
def size_sort_out(spark, sf):
    ok = ops.box_filter(min_width=35, min_height=25)
    truths, dets = ops.sort_out_sizes(side(spark, sf, "F"), side(spark, sf, "O"), FRAME, "box_id", ok)
    return truths.select("frame", "box_id", F.lit("truth").alias("part")).unionByName(
        dets.select("frame", "box_id", F.lit("detection").alias("part"))
    )


@query(
    "merged_detections",
    f"""WITH {BOXES} SELECT frame, box_id, side FROM boxes WHERE side = 'F'
UNION ALL SELECT a.frame, a.box_id, a.side FROM boxes a WHERE a.side = 'O' AND NOT EXISTS (SELECT 1 FROM boxes b WHERE a.frame = b.frame AND b.side = 'F' AND {IOU} > 0.5)""",
)
def merged_detections(spark, sf):
    return ops.merge_lists(side(spark, sf, "F"), side(spark, sf, "O"), FRAME, "box_id").select("frame", "box_id", "side")


@query(
    "common_and_missing",
    f"""WITH {BOXES}, p AS (SELECT a.frame, a.box_id AS t, b.box_id AS det, {DIST} AS d FROM boxes a JOIN boxes b ON a.frame = b.frame AND a.side = 'F' AND b.side = 'O' AND {MATCH_COVER}),
own AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY frame, t ORDER BY d, det) = 1),
won AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY frame, det ORDER BY d, t) = 1)
SELECT b.frame, b.box_id, won.t IS NOT NULL AS found FROM boxes b LEFT JOIN won ON b.frame = won.frame AND b.box_id = won.t WHERE side = 'F'""",
)
def common_and_missing(spark, sf):
    d = ops.common_and_missing(side(spark, sf, "F"), side(spark, sf, "O"), FRAME, "box_id")
    return d.select("frame", "box_id", "found")


IMAGES = "'route/' || {c} || '/cam_' || lpad(CAST(event_id % 500 AS {S}), 4, '0') || '.png'"


@query(
    "suffix_frames",
    """WITH a AS (SELECT event_id, 'run/' || event_type || '/cam_' || lpad(CAST(event_id % 500 AS VARCHAR), 4, '0') || '.png' AS image, event_id % 50 AS frame FROM events),
b AS (SELECT event_id AS pos, event_type || '/cam_' || lpad(CAST(event_id % 500 AS VARCHAR), 4, '0') || '.png' AS image, event_id % 50 AS frame FROM events)
SELECT a.event_id, a.image, a.frame, arg_min(b.image, b.pos) AS other_image FROM a LEFT JOIN b ON a.frame = b.frame AND (ends_with(a.image, b.image) OR ends_with(b.image, a.image)) GROUP BY ALL""",
)
def suffix_frames(spark, sf):
    ev = table(spark, sf, "events")
    name = "event_type || '/cam_' || lpad(cast(event_id % 500 AS string), 4, '0') || '.png'"
    a = ev.selectExpr("event_id", f"'run/' || {name} AS image", "event_id % 50 AS frame")
    b = ev.selectExpr("event_id AS pos", f"{name} AS image", "event_id % 50 AS frame")
    return ops.suffix_frame_join(a, b, "image", "frame", "pos")


@query(
    "merged_lists",
    f"""WITH {BOXES} SELECT frame, box_id, side, x1, y1, x2, y2 FROM boxes ORDER BY frame, box_id""",
)
def merged_lists(spark, sf):
    cols = ["frame", "box_id", "side", "x1", "y1", "x2", "y2"]
    return side(spark, sf, "F").select(*cols).unionByName(side(spark, sf, "O").select(*cols)).orderBy("frame", "box_id")


@query(
    "box_statistics",
    f"""WITH {BOXES}, d AS (SELECT x2 - x1 AS w, y2 - y1 AS h FROM boxes)
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count_if(h < 36) AS BIGINT) AS n_tiny, CAST(count_if(h < 128) AS BIGINT) AS n_small, CAST(count_if(w = 0) AS BIGINT) AS n_zero_width, CAST(count_if(h / w < 1.5) AS BIGINT) AS n_degenerate,
 {', '.join(f"{qs(f + '(' + c + ')')} AS {n}_{t}" for t, c in (('width', 'w'), ('height', 'h')) for n, f in (('min', 'min'), ('max', 'max'), ('mean', 'avg'), ('sd', 'stddev_samp')))} FROM d""",
)
def box_statistics(spark, sf):
    d = ops.box_statistics(boxes(spark, sf))
    return d.select(*[c if c.startswith("n") else q(F.col(c)).alias(c) for c in d.columns])


@query(
    "precision_recall",
    f"""WITH {BOXES}, s AS (SELECT score, count(*) AS n, count_if(class_id = 1) AS m, count_if(class_id = 2 AND box_id % 5 = 0) AS i FROM boxes WHERE side = 'O' GROUP BY score),
t AS (SELECT count(*) AS n_truths, count(DISTINCT frame) AS n_images FROM boxes WHERE side = 'F'),
c AS (SELECT score, sum(n) OVER w AS seen, sum(m) OVER w AS matched, sum(i) OVER w AS ignored FROM s WINDOW w AS (ORDER BY score DESC))
SELECT score, CAST(matched AS BIGINT) AS matched, CAST(seen - ignored AS BIGINT) AS considered, CAST(ignored AS BIGINT) AS ignored, {qs('matched / (n_truths - ignored)', 6)} AS recall,
 {qs('matched / nullif(seen - ignored, 0)', 6)} AS precision, {qs('(seen - ignored - matched) / n_images', 6)} AS fppi FROM c, t""",
)
def precision_recall(spark, sf):
    """The curve alone, from flags of the detections, so that it can be stated in SQL."""
    dets = side(spark, sf, "O").select(
        "score",
        (F.col("class_id") == 1).cast("bigint").alias("d_matched"),
        ((F.col("class_id") == 2) & (F.col("box_id") % 5 == 0)).cast("bigint").alias("d_ignored"),
    )
    d = _curve(dets, side(spark, sf, "F"))
    return d.select("score", "matched", "considered", "ignored", *[q(F.col(c), 6).alias(c) for c in ("recall", "precision", "fppi")])


def _curve(scored, truths):
    totals = truths.agg(F.count("*").alias("n_truths"), F.countDistinct("frame").alias("n_images"))
    return ops.precision_recall(scored, totals)


@query("matched_detections")
def matched_detections(spark, sf):
    """Largest one-to-one matching per frame; which of several largest ones is found is free."""
    ignore = side(spark, sf, "F").where("class_id = 2")
    d = matching.match_detections(side(spark, sf, "F"), side(spark, sf, "O"), FRAME, "box_id", 0.3, ignore=ignore)
    return d.select("frame", "box_id", "score", "truth_id", "d_matched", "d_ignored")


@query("recall_curve")
def recall_curve(spark, sf):
    """Matching and curve from end to end."""
    truths = side(spark, sf, "F")
    d = matching.match_detections(truths, side(spark, sf, "O"), FRAME, "box_id", 0.3)
    return _curve(d, truths)


@query("recall_by_width")
def recall_by_width(spark, sf):
    return matching.recall_by_width(side(spark, sf, "F"), side(spark, sf, "O"), FRAME, "box_id")


@query(
    "radar_association",
    f"""WITH {BOXES}, b AS (SELECT frame, box_id, box_id % 20 AS track, frame // 50 AS block, (x1 + x2) / 2 AS u, y2 AS v FROM boxes WHERE side = 'F'),
r AS (SELECT frame, track_id % 7 AS radar_id, x1 AS u, y1 AS v, score AS dist FROM boxes WHERE side = 'O'),
near AS (SELECT b.block, b.track, r.radar_id FROM b JOIN r ON b.frame = r.frame QUALIFY row_number() OVER (PARTITION BY b.frame, b.box_id ORDER BY (b.u - r.u) * (b.u - r.u) + (b.v - r.v) * (b.v - r.v), r.radar_id) = 1),
votes AS (SELECT block, track, radar_id, count(*) AS n FROM near GROUP BY ALL),
chosen AS (SELECT block, track, radar_id FROM votes QUALIFY row_number() OVER (PARTITION BY block, track ORDER BY n DESC, radar_id) = 1 AND n > 0.2 * sum(n) OVER (PARTITION BY block, track)),
o AS (SELECT frame, radar_id, arg_min(dist, (dist, u, v)) AS dist, arg_min(u, (dist, u, v)) AS u, arg_min(v, (dist, u, v)) AS v FROM r GROUP BY ALL),
won AS (SELECT b.frame, b.box_id, o.radar_id, o.dist AS radar_dist FROM b JOIN chosen c ON b.block = c.block AND b.track = c.track JOIN o ON o.frame = b.frame AND o.radar_id = c.radar_id
 QUALIFY row_number() OVER (PARTITION BY b.frame, o.radar_id ORDER BY (b.u - o.u) * (b.u - o.u) + (b.v - o.v) * (b.v - o.v), b.box_id) = 1)
SELECT b.frame, b.box_id, won.radar_id, won.radar_dist FROM b LEFT JOIN won ON b.frame = won.frame AND b.box_id = won.box_id""",
)
def radar_association(spark, sf):
    b = side(spark, sf, "F").withColumn("track", F.col("box_id") % 20)
    r = side(spark, sf, "O").select(
        "frame", (F.col("track_id") % 7).alias("radar_id"), F.col("x1").alias("u"), F.col("y1").alias("v"), F.col("score").alias("dist")
    )
    d = ops.radar_association(b, r, "frame", "track", "box_id", min_share=0.2)
    return d.select("frame", "box_id", "radar_id", "radar_dist")


@query(
    "miss_rates",
    f"""WITH {BOXES}, d AS (SELECT x2 - x1 AS w, EXISTS (SELECT 1 FROM boxes b WHERE b.frame = a.frame AND b.side = 'O' AND b.track_id % 7 = a.box_id % 7) AS found FROM boxes a WHERE side = 'F'),
l AS (SELECT min(w) AS lo, max(w) AS hi FROM d), e AS (SELECT least(CAST(floor((w - lo) / (hi - lo) * 20) AS BIGINT) + 1, 20) AS bin, found FROM d, l)
SELECT bin, CAST(count(*) AS BIGINT) AS n, CAST(count_if(NOT found) AS BIGINT) AS n_missing, {qs('count_if(NOT found) / count(*)', 6)} AS miss_rate FROM e GROUP BY bin""",
)
def miss_rates(spark, sf):
    b = side(spark, sf, "F").select("frame", (F.col("box_id") % 7).alias("radar_id"), bx.width(bx.corners()).alias("w"))
    r = side(spark, sf, "O").select("frame", (F.col("track_id") % 7).alias("radar_id"), F.lit(True).alias("_seen")).distinct()
    d = b.join(r, ["frame", "radar_id"], "left")
    return ops.miss_rates(d, "w", F.col("_seen").isNull(), 20).select("bin", "n", "n_missing", q(F.col("miss_rate"), 6).alias("miss_rate"))


@query(
    "radar_miss_rates",
    f"""WITH {BOXES}, d AS (SELECT score AS w, EXISTS (SELECT 1 FROM boxes b WHERE b.frame = a.frame AND b.side = 'F' AND b.box_id % 7 = a.track_id % 7) AS found FROM boxes a WHERE side = 'O'),
l AS (SELECT min(w) AS lo, max(w) AS hi FROM d), e AS (SELECT least(CAST(floor((w - lo) / (hi - lo) * 10) AS BIGINT) + 1, 10) AS bin, found FROM d, l)
SELECT bin, CAST(count(*) AS BIGINT) AS n, CAST(count_if(NOT found) AS BIGINT) AS n_missing, {qs('count_if(NOT found) / count(*)', 6)} AS miss_rate FROM e GROUP BY bin""",
)
def radar_miss_rates(spark, sf):
    """The other way round: radar objects without a box, by distance."""
    r = side(spark, sf, "O").select("frame", (F.col("track_id") % 7).alias("radar_id"), F.col("score").alias("dist"))
    b = side(spark, sf, "F").select("frame", (F.col("box_id") % 7).alias("radar_id"), F.lit(True).alias("_seen")).distinct()
    d = r.join(b, ["frame", "radar_id"], "left")
    return ops.miss_rates(d, "dist", F.col("_seen").isNull(), 10).select("bin", "n", "n_missing", q(F.col("miss_rate"), 6).alias("miss_rate"))


MATCHES = ["l_suppkey AS box", "l_quantity AS x_a", "l_discount * 100 AS y_a", "l_quantity * 1.1e0 + l_tax * 400 AS x_b", "l_discount * 110 + l_linenumber AS y_b", "l_orderkey AS row_id"]
MATCH_CTE = f"m AS (SELECT {', '.join(MATCHES)} FROM lineitem)"


def _modal_sql(source: str, out: str, bins: int | None) -> str:
    """CTEs: matches of ``source`` near the modal motion bin of their box."""
    n = bins or 0
    w = {c: f"CASE WHEN {c}hi = {c}lo THEN 1e0 / {n} ELSE ({c}hi - {c}lo) / {n} END" if bins else "1e0" for c in "xy"}
    lo = {c: f"CASE WHEN {c}hi = {c}lo THEN {c}lo - 0.5e0 ELSE {c}lo END" if bins else f"{c}lo" for c in "xy"}

    def bin_(c):
        no = f"floor((d{c} - {c}l) / {c}w)"
        return f"least({no}, {n - 1})" if bins else no

    return f"""{out}_r AS (SELECT box, min(x_b - x_a) AS xlo, max(x_b - x_a) AS xhi, min(y_b - y_a) AS ylo, max(y_b - y_a) AS yhi FROM {source} GROUP BY box),
 {out}_q AS (SELECT box, {lo['x']} AS xl, {w['x']} AS xw, {lo['y']} AS yl, {w['y']} AS yw FROM {out}_r),
 {out}_d AS (SELECT s.*, x_b - x_a AS dx, y_b - y_a AS dy, xl, xw, yl, yw FROM {source} s JOIN {out}_q USING (box)),
 {out}_x AS (SELECT box, bin FROM (SELECT box, bin, count(*) AS n FROM (SELECT box, {bin_('x')} AS bin FROM {out}_d) GROUP BY box, bin) QUALIFY row_number() OVER (PARTITION BY box ORDER BY n DESC, bin) = 1),
 {out}_y AS (SELECT box, bin FROM (SELECT box, bin, count(*) AS n FROM (SELECT box, {bin_('y')} AS bin FROM {out}_d) GROUP BY box, bin) QUALIFY row_number() OVER (PARTITION BY box ORDER BY n DESC, bin) = 1),
 {out} AS (SELECT d.box, x_a, y_a, x_b, y_b, row_id FROM {out}_d d JOIN {out}_x x ON d.box = x.box JOIN {out}_y y ON d.box = y.box
  WHERE dx BETWEEN xl + x.bin * xw - greatest(xw, 2e0) AND xl + x.bin * xw + greatest(xw, 2e0) AND dy BETWEEN yl + y.bin * yw - greatest(yw, 2e0) AND yl + y.bin * yw + greatest(yw, 2e0))"""


def matches(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*MATCHES)


@query(
    "modal_motion",
    f"""WITH {MATCH_CTE}, {_modal_sql('m', 'k', 10)} SELECT box, CAST(count(*) AS BIGINT) AS n, CAST(sum(row_id) AS BIGINT) AS sum_ids FROM k GROUP BY box""",
)
def modal_motion(spark, sf):
    d = ops.modal_motion(matches(spark, sf), ["box"])
    return d.groupBy("box").agg(F.count("*").alias("n"), F.sum("row_id").alias("sum_ids"))


@query(
    "similarity_motion",
    f"""WITH {MATCH_CTE}, {_modal_sql('m', 'k', 10)}, {_modal_sql('k', 'f', None)},
good AS (SELECT box FROM (SELECT box, count(*) AS n FROM k GROUP BY box) JOIN (SELECT box, count(*) AS c FROM f GROUP BY box) USING (box) WHERE c > 0.8 * n),
u AS (SELECT * FROM f WHERE box IN (SELECT box FROM good) UNION ALL SELECT * FROM k WHERE box NOT IN (SELECT box FROM good)),
s AS (SELECT box, count(*) AS n, avg(x_a) AS xa, avg(y_a) AS ya, avg(x_b) AS xb, avg(y_b) AS yb, avg(x_a * x_b + y_a * y_b) AS ab, avg(x_a * x_a + y_a * y_a) AS aa FROM u GROUP BY box HAVING count(*) >= 2),
z AS (SELECT *, (ab - xa * xb - ya * yb) / nullif(aa - xa * xa - ya * ya, 0) AS scale FROM s)
SELECT box, CAST(n AS BIGINT) AS n, {qs('scale', 5)} AS scale, {qs('xb - scale * xa', 5)} AS shift_x, {qs('yb - scale * ya', 5)} AS shift_y FROM z""",
)
def similarity_motion(spark, sf):
    d = ops.robust_motion(matches(spark, sf), ["box"])
    return d.select("box", "n", *[q(F.col(c), 5).alias(c) for c in ("scale", "shift_x", "shift_y")])


TRACK_BOX = BOXES.replace("l_partkey AS frame", "l_suppkey % 10 AS seq, l_partkey % 500 AS frame").replace("l_orderkey AS track_id", "l_suppkey % 7 AS track_id")


def tracked(spark, sf):
    from wayline.plans.inputs import BOX_COLUMNS

    cols = ["l_suppkey % 10 AS seq", "l_partkey % 500 AS frame", *BOX_COLUMNS[1:-1], "l_suppkey % 7 AS track_id"]
    return table(spark, sf, "lineitem").selectExpr(*cols)


@query(
    "gap_fill",
    f"""WITH {TRACK_BOX}, b AS (SELECT * FROM boxes WHERE side = 'F'), r AS (SELECT DISTINCT seq, frame, track_id FROM boxes WHERE side = 'O'),
known AS (SELECT seq, frame, track_id, {', '.join(f'arg_min({c}, (x1, y1, x2, y2)) AS {c}' for c in ('x1', 'y1', 'x2', 'y2'))} FROM b GROUP BY ALL),
want AS (SELECT * FROM r ANTI JOIN known USING (seq, frame, track_id)),
c AS (SELECT w.seq, w.frame, w.track_id, p.frame AS fp, n.frame AS fn, {', '.join(f'p.{c} AS p{c}, n.{c} AS n{c}' for c in ('x1', 'y1', 'x2', 'y2'))} FROM want w
 ASOF JOIN known p ON w.seq = p.seq AND w.track_id = p.track_id AND w.frame > p.frame ASOF JOIN known n ON w.seq = n.seq AND w.track_id = n.track_id AND w.frame < n.frame),
a AS (SELECT seq, frame, track_id, {', '.join(f'floor(p{c} * (1 - (frame - fp) / (fn - fp)) + n{c} * ((frame - fp) / (fn - fp))) AS {c}' for c in ('x1', 'y1', 'x2', 'y2'))} FROM c WHERE frame - fp <= 10 AND fn - frame <= 9)
SELECT seq, frame, track_id, x1, y1, x2, y2 FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.seq = b.seq AND a.frame = b.frame AND ({COVER_AB} > 0.7 OR {COVER_BA} > 0.7))""",
)
def gap_fill(spark, sf):
    t = tracked(spark, sf)
    b, r = t.where("side = 'F'"), t.where("side = 'O'")
    return ops.fill_gaps(b, r, ["seq"], "frame", "track_id", 200)


@query(
    "track_merge",
    f"""WITH {TRACK_BOX}, n AS (SELECT seq, max(frame) + 1 AS n FROM boxes GROUP BY seq), d AS (SELECT b.*, (side = 'F') = (frame <= n // 2) AS main FROM boxes b JOIN n USING (seq))
SELECT seq, frame, box_id, CASE WHEN side = 'F' THEN 'forward' ELSE 'backward' END AS track FROM d WHERE main
UNION ALL SELECT seq, frame, box_id, CASE WHEN side = 'F' THEN 'forward' ELSE 'backward' END FROM d a WHERE NOT main AND frame > 0
 AND NOT EXISTS (SELECT 1 FROM d b WHERE b.main AND a.seq = b.seq AND a.frame = b.frame AND ({COVER_AB} > 0.5 OR {COVER_BA} > 0.5))""",
)
def track_merge(spark, sf):
    t = tracked(spark, sf)
    d = ops.merge_tracks(t.where("side = 'F'"), t.where("side = 'O'"), ["seq"], "frame", "box_id")
    return d.select("seq", "frame", "box_id", "track")


@query("track_ids")
def track_ids(spark, sf):
    """Ids handed out along chains of nearest boxes; a state machine, checked against brute force in the tests."""
    t = tracked(spark, sf).where("side = 'F'").drop("track_id")
    return matching.assign_track_ids(t, ["seq"], "frame", "box_id").select("seq", "frame", "box_id", "track_id")


LANE_PIX = "lane AS (SELECT l_partkey AS frame, l_linenumber % 2 AS side, ((l_orderkey * 8 + l_linenumber) * 2000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS seq, l_quantity * 10 AS u, l_extendedprice / 100 AS v, 5 + l_discount * 500 AS z FROM lineitem WHERE l_linestatus = 'O')"


def lane_pixels(spark, sf):
    return table(spark, sf, "lineitem").where("l_linestatus = 'O'").selectExpr(
        "l_partkey AS frame", "l_linenumber % 2 AS side", "((l_orderkey * 8 + l_linenumber) * 2000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS seq",
        "l_quantity * 10 AS u", "l_extendedprice / 100 AS v", "5 + l_discount * 500 AS z",
    )


@query(
    "box_depth",
    f"""WITH {BOXES}, {LANE_PIX}, p AS (SELECT *, lead(u) OVER w AS u2, lead(v) OVER w AS v2, lead(z) OVER w AS z2 FROM lane WINDOW w AS (PARTITION BY frame, side ORDER BY seq)),
h AS (SELECT b.frame, b.box_id, p.side, p.u, p.u2, p.v, p.v2, p.z, p.z2, b.y2, (b.x1 + b.x2) / 2 AS cx, CASE WHEN v = v2 THEN 0.5e0 ELSE (b.y2 - v2) / nullif(v - v2, 0) END AS s
 FROM (SELECT * FROM boxes WHERE side = 'F') b JOIN p ON b.frame = p.frame AND p.v >= b.y2 AND p.v2 <= b.y2 QUALIFY row_number() OVER (PARTITION BY b.frame, b.box_id, p.side ORDER BY p.seq) = 1),
d AS (SELECT frame, box_id, arg_min(z2 * (1 - s) + z * s, (abs(cx - (u2 * (1 - s) + u * s)), side)) AS depth FROM h GROUP BY ALL)
SELECT b.frame, b.box_id, {qs('d.depth')} AS depth FROM boxes b LEFT JOIN d ON b.frame = d.frame AND b.box_id = d.box_id WHERE b.side = 'F'""",
)
def box_depth(spark, sf):
    d = ops.depth_from_lanes(side(spark, sf, "F"), lane_pixels(spark, sf), "frame", "box_id", width=2e9)
    return d.select("frame", "box_id", q(F.col("depth")).alias("depth"))


@query(
    "box_depth_sideways",
    f"""WITH {BOXES}, s AS (SELECT frame, box_id AS seq, x1 AS u1, y1 AS v1, x2 + 40 AS u2, y1 + 10 AS v2, score / 1000 AS z FROM boxes WHERE side = 'O'),
b AS (SELECT frame, box_id, (x1 + x2) / 2 AS px, y2 AS py FROM boxes WHERE side = 'F'),
t AS (SELECT b.frame, b.box_id, s.seq, s.z, px, py, u1, v1, u2 - u1 AS dx, v2 - v1 AS dy, greatest(0e0, least(1e0, ((px - u1) * (u2 - u1) + (py - v1) * (v2 - v1)) / ((u2 - u1) * (u2 - u1) + (v2 - v1) * (v2 - v1)))) AS t FROM b JOIN s ON b.frame = s.frame),
e AS (SELECT *, sqrt((px - (u1 + t * dx)) * (px - (u1 + t * dx)) + (py - (v1 + t * dy)) * (py - (v1 + t * dy))) AS d FROM t),
m AS (SELECT frame, box_id, arg_min(z, (d, seq)) AS depth FROM e WHERE d <= 64 GROUP BY ALL)
SELECT b.frame, b.box_id, {qs('m.depth')} AS depth FROM b LEFT JOIN m ON b.frame = m.frame AND b.box_id = m.box_id""",
)
def box_depth_sideways(spark, sf):
    s = side(spark, sf, "O").selectExpr("frame", "box_id AS seq", "x1 AS u1", "y1 AS v1", "x2 + 40 AS u2", "y1 + 10 AS v2", "score / 1000 AS z")
    d = ops.depth_from_sideways(side(spark, sf, "F"), s, "frame", "box_id")
    return d.select("frame", "box_id", q(F.col("depth")).alias("depth"))
