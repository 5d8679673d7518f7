"""Image boxes per frame: overlap joins, filters, list merging, statistics and curves.

Box tables hold x1, y1, x2, y2 in pixels, a frame key and a box id. Overlap
joins cut the image into tiles, so boxes meet only where they share a tile; a
pair is counted in the tile of its overlap's top left corner and nowhere else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wayline.functions import boxes as bx
from wayline.functions import text
from wayline.operators import blocks, spatial, timejoin
from wayline.session import cut_lineage

C = list(bx.CORNERS)


def _tiles(df: DataFrame, x1: str, y1: str, x2: str, y2: str, tile: float) -> DataFrame:
    def span(a, b):
        return F.explode(F.sequence(F.floor(F.col(a) / F.lit(float(tile))), F.floor(F.col(b) / F.lit(float(tile)))))

    return df.withColumn("_tx", span(x1, x2)).withColumn("_ty", span(y1, y2))


def _prefixed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def overlapping_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], tile: float = 128.0) -> DataFrame:
    """Every pair of boxes of the same key that overlaps, once; columns get ``a_`` and ``b_``."""
    keys = list(keys)
    left = _tiles(_prefixed(a, keys, "a_"), "a_x1", "a_y1", "a_x2", "a_y2", tile)
    right = _tiles(_prefixed(b, keys, "b_"), "b_x1", "b_y1", "b_x2", "b_y2", tile)
    x, y = F.greatest("a_x1", "b_x1"), F.greatest("a_y1", "b_y1")
    return (
        left.join(right, [*keys, "_tx", "_ty"])
        .where((x < F.least("a_x2", "b_x2")) & (y < F.least("a_y2", "b_y2")))
        .where((F.floor(x / F.lit(float(tile))) == F.col("_tx")) & (F.floor(y / F.lit(float(tile))) == F.col("_ty")))
        .drop("_tx", "_ty")
    )


def pair_sides() -> tuple[list[Column], list[Column]]:
    return [F.col("a_" + c) for c in C], [F.col("b_" + c) for c in C]


def box_filter(
    min_score=None, classes=None, min_width=None, max_width=None, min_height=None, max_height=None, width_bin=None
) -> Column:
    """Positive area and whatever limits are given; class -1 always passes; the width bin is half open."""
    b = bx.corners()
    w, h = bx.width(b), bx.height(b)
    keep = (w > 0) & (h > 0)
    if min_score is not None:
        keep = keep & (F.col("score") >= min_score)
    if classes is not None:
        keep = keep & F.col("class_id").isin([*classes, -1])
    for value, low, high in ((w, min_width, max_width), (h, min_height, max_height)):
        if low is not None:
            keep = keep & (value >= low)
        if high is not None:
            keep = keep & (value <= high)
    if width_bin is not None:
        keep = keep & (w >= width_bin[0]) & (w < width_bin[1])
    return keep


def drop_occluded(boxes: DataFrame, keys: Sequence[str], ident: str, threshold: float = 0.4) -> DataFrame:
    """Drop a box when one nearer the camera (lower edge, then wider) covers more than ``threshold`` of it."""
    keys = list(keys)
    a, b = pair_sides()

    def rank(side, prefix):
        return F.struct(side[3], bx.width(side), F.col(prefix + ident))

    slim = boxes.select(*keys, ident, *C)
    hidden = overlapping_pairs(slim, slim, keys).where((rank(b, "b_") > rank(a, "a_")) & (bx.cover(a, b) > threshold))
    hidden = hidden.select(*keys, F.col("a_" + ident).alias(ident)).distinct()
    return boxes.join(hidden, [*keys, ident], "left_anti")


def merge_lists(first: DataFrame, second: DataFrame, keys: Sequence[str], ident: str, max_iou: float = 0.5) -> DataFrame:
    """First list plus the boxes of the second that no box of the first overlaps by more than ``max_iou``."""
    keys = list(keys)
    a, b = pair_sides()
    slim = [*keys, ident, *C]
    covered = overlapping_pairs(second.select(*slim), first.select(*slim), keys).where(bx.iou(a, b) > max_iou)
    covered = covered.select(*keys, F.col("a_" + ident).alias(ident)).distinct()
    return first.unionByName(second.join(covered, [*keys, ident], "left_anti"))


def common_and_missing(truths: DataFrame, detections: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """Truths with ``found``: each takes its nearest matching detection, each detection its nearest such truth."""
    keys = list(keys)
    a, b = pair_sides()
    slim = [*keys, ident, "class_id", *C]
    match = bx.match_cover(a, b, F.col("a_class_id"), F.col("b_class_id"))
    pairs = overlapping_pairs(truths.select(*slim), detections.select(*slim), keys).where(match)
    pairs = pairs.withColumn("_d", bx.centre_distance(a, b))
    own = pairs.groupBy(*keys, F.col("a_" + ident).alias("_t")).agg(
        F.min(F.struct("_d", F.col("b_" + ident).alias("det"))).alias("_best")
    )
    taken = own.groupBy(*keys, F.col("_best.det").alias("_det")).agg(
        F.min(F.struct(F.col("_best._d").alias("_d"), F.col("_t").alias("_t"))).alias("_win")
    )
    found = taken.select(*keys, F.col("_win._t").alias(ident), F.lit(True).alias("found"))
    return truths.join(found, [*keys, ident], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def sort_out_sizes(
    truths: DataFrame, detections: DataFrame, keys: Sequence[str], ident: str, in_range: Column, min_iou: float = 0.5, style: str = "iou"
) -> tuple[DataFrame, DataFrame]:
    """Truths and detections left for an evaluation limited to boxes of some size.

    Out-of-range truths go. A detection that matches one goes with it, unless
    another truth overlaps it better. Out-of-range detections stay only if they
    match a truth that is left.
    """
    keys = list(keys)
    a, b = pair_sides()
    ca, cb = F.col("a_class_id"), F.col("b_class_id")
    flags = [*keys, ident, "class_id", *C, in_range.alias("ok")]
    pairs = overlapping_pairs(detections.select(*flags), truths.select(*flags), keys).withColumn("_iou", bx.iou(a, b))
    match = bx.match_iou(a, b, ca, cb, min_iou) if style == "iou" else bx.match_cover(a, b, ca, cb)
    pairs = pairs.withColumn("_match", match)
    det = F.col("a_" + ident).alias(ident)
    per_det = pairs.groupBy(*keys, det).agg(
        F.max("_iou").alias("_best"),
        F.max(F.when(F.col("_match") & ~F.col("b_ok"), F.col("_iou"))).alias("_lost_to"),
        F.max(F.when(F.col("_match") & F.col("b_ok"), F.lit(True))).alias("_backed"),
    )
    d = detections.withColumn("_ok", in_range).join(per_det, [*keys, ident], "left")
    gone = F.coalesce(F.col("_lost_to") >= F.col("_best"), F.lit(False))
    kept = d.where(~gone & (F.col("_ok") | F.coalesce("_backed", F.lit(False))))
    return truths.where(in_range), kept.drop("_ok", "_best", "_lost_to", "_backed")


def suffix_frame_join(first: DataFrame, second: DataFrame, image: str, frame: str, order: str) -> DataFrame:
    """Frames of the first list with the first frame of the second whose name matches by suffix.

    One name must end with the other, and frame numbers agree. Unmatched frames
    keep a null ``other_image``. The last path part is the join key.
    """
    part = F.substring_index(F.col(image), "/", -1)
    left = first.withColumn("_part", part)
    right = second.select(part.alias("_part"), F.col(frame), F.col(image).alias("other_image"), F.col(order).alias("_pos")).groupBy(
        "_part", frame, "other_image"
    ).agg(F.min("_pos").alias("_pos"))
    either = F.col(image).endswith(F.col("other_image")) | F.col("other_image").endswith(F.col(image))
    hits = (
        left.select("_part", frame, image).distinct().join(right, ["_part", frame]).where(either)
        .groupBy("_part", frame, image)
        .agg(F.min_by("other_image", "_pos").alias("other_image"))
    )
    return left.join(hits, ["_part", frame, image], "left").drop("_part")


def box_statistics(boxes: DataFrame) -> DataFrame:
    """Counts and size statistics of a list; zero widths count as 1 and are reported apart."""
    b = bx.corners()
    h = bx.height(b)
    w = F.when(bx.width(b) == 0, F.lit(1.0)).otherwise(bx.width(b))
    sizes = [
        f(c).alias(f"{n}_{t}")
        for t, c in (("width", w), ("height", h))
        for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("sd", F.stddev_samp))
    ]
    return boxes.agg(
        F.count("*").alias("n"),
        F.count_if(h < 36).alias("n_tiny"),
        F.count_if(h < 128).alias("n_small"),
        F.count_if(bx.width(b) == 0).alias("n_zero_width"),
        F.count_if((bx.width(b) > 0) & (h / w < 1.5)).alias("n_degenerate"),
        *sizes,
    )


def precision_recall(scored: DataFrame, totals: DataFrame) -> DataFrame:
    """Curve over descending score from per-detection columns score, d_matched, d_ignored.

    ``totals`` is one row with ``n_truths`` and ``n_images``. Equal scores are
    merged first; the running sums go through ranges of scores, one a task.
    """
    per_score = scored.groupBy("score").agg(
        F.count("*").alias("_n"), F.sum("d_matched").alias("_m"), F.sum("d_ignored").alias("_i")
    )
    d = blocks.global_running_sum(per_score, F.col("score").desc(), {"matched": F.col("_m"), "seen": F.col("_n"), "ignored": F.col("_i")})
    considered = F.col("seen") - F.col("ignored")
    d = d.crossJoin(F.broadcast(totals.agg(F.first("n_truths").alias("_truths"), F.first("n_images").alias("_images"))))  # one row
    truths, images = F.col("_truths"), F.col("_images")
    return d.select(
        "score",
        "matched",
        considered.alias("considered"),
        "ignored",
        F.try_divide(F.col("matched").cast("double"), (truths - F.col("ignored")).cast("double")).alias("recall"),
        F.try_divide(F.col("matched").cast("double"), considered.cast("double")).alias("precision"),
        F.try_divide((considered - F.col("matched")).cast("double"), images.cast("double")).alias("fppi"),
    )


def equal_bins(df: DataFrame, value: str, n: int, low: str = "_low", high: str = "_high", floor_at: float | None = None) -> DataFrame:
    """Add ``bin`` (1..n) of equal width between the smallest and largest value; the last bin is closed."""
    smallest = F.min(value) if floor_at is None else F.greatest(F.min(value), F.lit(float(floor_at)))
    limits = df.agg(smallest.alias(low), F.max(value).alias(high))
    d = df.join(F.broadcast(limits))  # one row
    bin_ = F.floor((F.col(value) - F.col(low)) / (F.col(high) - F.col(low)) * n) + 1
    return d.withColumn("bin", F.when(F.col(high) > F.col(low), F.least(bin_, F.lit(n))).otherwise(F.lit(1)).cast("bigint"))


def miss_rates(df: DataFrame, value: str, missing: Column, n: int) -> DataFrame:
    """Per value bin: rows, missing rows and their share."""
    d = equal_bins(df.withColumn("_missing", missing), value, n)
    return d.groupBy("bin").agg(F.count("*").alias("n"), F.count_if(F.col("_missing")).alias("n_missing")).withColumn(
        "miss_rate", F.col("n_missing") / F.col("n")
    )


def modal_motion(matches: DataFrame, group: Sequence[str], bins: int | None = 10, least: float = 2.0) -> DataFrame:
    """Keep key-point matches whose motion lies near the fullest bin of both dx and dy.

    ``bins`` equal bins over the range, or bins of one pixel when None. Near is
    within one bin width (at least ``least`` pixels) of the bin's lower edge.
    """
    group = list(group)
    d = matches.withColumns({"_dx": F.col("x_b") - F.col("x_a"), "_dy": F.col("y_b") - F.col("y_a")})
    ranges = d.groupBy(*group).agg(*[f(c).alias(f"{c}_{n}") for c in ("_dx", "_dy") for n, f in (("lo", F.min), ("hi", F.max))])
    for c in ("_dx", "_dy"):
        flat = F.col(f"{c}_hi") == F.col(f"{c}_lo")
        if bins is None:
            ranges = ranges.withColumn(f"{c}_w", F.lit(1.0))
        else:
            ranges = ranges.withColumn(f"{c}_w", F.when(flat, F.lit(1.0 / bins)).otherwise((F.col(f"{c}_hi") - F.col(f"{c}_lo")) / bins))
            ranges = ranges.withColumn(f"{c}_lo", F.when(flat, F.col(f"{c}_lo") - 0.5).otherwise(F.col(f"{c}_lo")))
    d = d.join(ranges, group)
    for c in ("_dx", "_dy"):
        no = F.floor((F.col(c) - F.col(f"{c}_lo")) / F.col(f"{c}_w"))
        d = d.withColumn(f"{c}_bin", no if bins is None else F.least(no, F.lit(bins - 1)))
    axes = F.array(*[F.struct(F.lit(c).alias("axis"), F.col(f"{c}_bin").alias("bin")) for c in ("_dx", "_dy")])
    counts = d.select(*group, F.explode(axes).alias("_a")).groupBy(*group, "_a.axis", "_a.bin").agg(F.count("*").alias("_n"))

    def fullest(axis):
        rank = F.struct("_n", (-F.col("bin")).alias("neg"))
        return F.max_by("bin", F.when(F.col("axis") == axis, rank)).alias(f"{axis}_mode")

    d = d.join(counts.groupBy(*group).agg(fullest("_dx"), fullest("_dy")), group)
    keep = F.lit(True)
    for c in ("_dx", "_dy"):
        edge = F.col(f"{c}_lo") + F.col(f"{c}_mode") * F.col(f"{c}_w")
        reach = F.greatest(F.col(f"{c}_w"), F.lit(least))
        keep = keep & F.col(c).between(edge - reach, edge + reach)
    return d.where(keep).select(*matches.columns)


def similarity_motion(matches: DataFrame, group: Sequence[str]) -> DataFrame:
    """Least-squares scale and shift per group, from sums alone; groups of one match drop out."""
    xa, ya, xb, yb = (F.col(c) for c in ("x_a", "y_a", "x_b", "y_b"))
    s = matches.groupBy(*group).agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"_m_{c}") for c in ("x_a", "y_a", "x_b", "y_b")],
        F.avg(xa * xb + ya * yb).alias("_ab"),
        F.avg(xa * xa + ya * ya).alias("_aa"),
    ).where("n >= 2")
    cross = F.col("_ab") - F.col("_m_x_a") * F.col("_m_x_b") - F.col("_m_y_a") * F.col("_m_y_b")
    own = F.col("_aa") - F.col("_m_x_a") * F.col("_m_x_a") - F.col("_m_y_a") * F.col("_m_y_a")
    s = s.withColumn("scale", F.try_divide(cross, own))
    return s.select(
        *group, "n", "scale",
        (F.col("_m_x_b") - F.col("scale") * F.col("_m_x_a")).alias("shift_x"),
        (F.col("_m_y_b") - F.col("scale") * F.col("_m_y_a")).alias("shift_y"),
    )


def robust_motion(matches: DataFrame, group: Sequence[str]) -> DataFrame:
    """Motion after both outlier filters; the finer one counts where it keeps more than 80 %."""
    group = list(group)
    coarse = cut_lineage(modal_motion(matches, group, 10))
    fine = cut_lineage(modal_motion(coarse, group, None))
    n = coarse.groupBy(*group).agg(F.count("*").alias("_n")).join(fine.groupBy(*group).agg(F.count("*").alias("_k")), group)
    trusted = n.where(F.col("_k") > 0.8 * F.col("_n")).select(*group)
    used = fine.join(trusted, group, "left_semi").unionByName(coarse.join(trusted, group, "left_anti"))
    return similarity_motion(used, group)


def radar_association(
    boxes: DataFrame, radar: DataFrame, frame: str, track: str, box: str, block_frames: int = 50, min_share: float = 0.5
) -> DataFrame:
    """Radar id and distance of each tracked box.

    ``radar`` holds frame, radar_id, u, v (projected) and dist. Per frame each
    box takes the nearest radar object; per block of frames and track the most
    frequent id counts if it holds more than ``min_share``; of two boxes of a
    frame with one id the nearer keeps it.
    """
    b = boxes.withColumns(
        {"u": (F.col("x1") + F.col("x2")) / 2, "v": F.col("y2"), "_block": F.floor(F.col(frame) / block_frames)}
    )
    near = spatial.nearest(b.select(frame, "_block", track, box, "u", "v"), radar.select(frame, "radar_id", "u", "v"), [frame], ["u", "v"], 8192.0, "radar_id")
    votes = near.groupBy("_block", track, "radar_id").agg(F.count("*").alias("_n"))
    total = votes.groupBy("_block", track).agg(
        F.sum("_n").alias("_all"), F.max(F.struct("_n", (-F.col("radar_id")).alias("_neg"))).alias("_top")
    )
    chosen = total.where(F.col("_top._n") > min_share * F.col("_all")).select("_block", track, (-F.col("_top._neg")).alias("radar_id"))
    objects = radar.groupBy(frame, "radar_id").agg(F.min(F.struct("dist", "u", "v")).alias("_r"))
    named = b.join(chosen, ["_block", track]).join(objects, [frame, "radar_id"])
    du, dv = F.col("u") - F.col("_r.u"), F.col("v") - F.col("_r.v")
    named = named.withColumn("_d", du * du + dv * dv)
    winner = named.groupBy(frame, "radar_id").agg(F.min(F.struct("_d", box)).alias("_w"), F.first("_r.dist").alias("radar_dist"))
    won = winner.select(frame, F.col("_w")[box].alias(box), "radar_id", "radar_dist")
    return boxes.join(won, [frame, box], "left")


def fill_gaps(
    boxes: DataFrame, radar: DataFrame, keys: Sequence[str], frame: str, ident: str, width: float, before: int = 10, after: int = 9, max_overlap: float = 0.7
) -> DataFrame:
    """Boxes to add: ids the radar sees, missing in this frame but known shortly before and after.

    Corners are mixed linearly and cut to whole pixels. A box that covers, or is
    covered by, more than ``max_overlap`` of an existing one is left out.
    """
    keys = list(keys)
    seen = radar.select(*keys, frame, ident).distinct().join(boxes.select(*keys, frame, ident).distinct(), [*keys, frame, ident], "left_anti")
    known = boxes.groupBy(*keys, frame, ident).agg(F.min(F.struct(*C)).alias("_b"))

    def side(tag):
        return known.select(*keys, ident, F.col(frame).alias(f"_f{tag}"), *[F.col("_b")[c].alias(f"{c}{tag}") for c in C])

    k = [*keys, ident]
    d = timejoin.asof_backward(seen, side("_p"), k, frame, "_f_p", ["_f_p", *[f"{c}_p" for c in C]], width, allow_equal=False)
    d = timejoin.asof_forward(d, side("_n"), k, frame, "_f_n", ["_f_n", *[f"{c}_n" for c in C]], width)
    d = d.where((F.col(frame) - F.col("_f_p") <= before) & (F.col("_f_n") - F.col(frame) <= after))
    share = (F.col(frame) - F.col("_f_p")) / (F.col("_f_n") - F.col("_f_p"))
    d = d.select(*keys, frame, ident, *[F.floor(F.col(f"{c}_p") * (1 - share) + F.col(f"{c}_n") * share).cast("double").alias(c) for c in C])
    a, b = pair_sides()
    hidden = overlapping_pairs(d, boxes.select(*keys, frame, *C), [*keys, frame]).where(
        (bx.cover(a, b) > max_overlap) | (bx.cover(b, a) > max_overlap)
    )
    return d.join(hidden.select(*keys, frame, F.col("a_" + ident).alias(ident)).distinct(), [*keys, frame, ident], "left_anti")


def merge_tracks(forward: DataFrame, backward: DataFrame, keys: Sequence[str], frame: str, ident: str, same: float = 0.5) -> DataFrame:
    """First half of a stretch from the forward track, second half from the backward one.

    ``frame`` counts from 0 in each stretch. The other track's boxes join where
    they share at most half of either area with every box already there.
    """
    keys = list(keys)
    both = forward.withColumn("_fwd", F.lit(True)).unionByName(backward.withColumn("_fwd", F.lit(False)))
    n = both.groupBy(*keys).agg((F.max(frame) + 1).alias("_n"))
    both = both.join(n, keys).withColumn("_main", F.col("_fwd") == (F.col(frame) <= F.floor(F.col("_n") / 2)))
    main, more = both.where("_main"), both.where(~F.col("_main") & (F.col(frame) > 0))
    a, b = pair_sides()
    slim = [*keys, frame, ident, *C]
    same_box = overlapping_pairs(more.select(*slim), main.select(*slim), [*keys, frame]).where(
        (bx.cover(a, b) > same) | (bx.cover(b, a) > same)
    )
    gone = same_box.select(*keys, frame, F.col("a_" + ident).alias(ident)).distinct()
    added = more.join(gone, [*keys, frame, ident], "left_anti")
    return main.unionByName(added).withColumn("track", F.when(F.col("_fwd"), "forward").otherwise("backward")).drop("_fwd", "_n", "_main")


def depth_from_lanes(boxes: DataFrame, lane_pixels: DataFrame, frame: str, box: str, width: float = 1000.0, band: float = 32.0) -> DataFrame:
    """Depth of each box from the projected lane its lower edge stands on; null when neither lane gives one.

    ``lane_pixels`` holds frame, side, seq, u, v, z going away from the car. On
    each side the first piece whose v range holds the box's lower edge counts;
    the side nearer to the box centre wins. Pieces and boxes meet in image bands.
    """
    k = [frame, "side"]
    pieces = blocks.next_row(lane_pixels, k, ["seq"], ["u", "v", "z"], width, "_e").where("_e IS NOT NULL AND v >= _e.v")
    pieces = pieces.withColumn("_band", F.explode(F.sequence(F.floor(F.col("_e.v") / F.lit(band)), F.floor(F.col("v") / F.lit(band)))))
    b = boxes.select(frame, box, F.col("y2").alias("_y"), ((F.col("x1") + F.col("x2")) / 2).alias("_cx"))
    b = b.withColumn("_band", F.floor(F.col("_y") / F.lit(band)))
    hit = b.join(pieces, [frame, "_band"]).where((F.col("v") >= F.col("_y")) & (F.col("_e.v") <= F.col("_y")))
    share = F.when(F.col("v") == F.col("_e.v"), F.lit(0.5)).otherwise(F.try_divide(F.col("_y") - F.col("_e.v"), F.col("v") - F.col("_e.v")))
    hit = hit.withColumn("_s", share).select(
        frame, box, "side", "seq",
        F.abs(F.col("_cx") - (F.col("_e.u") * (1 - F.col("_s")) + F.col("u") * F.col("_s"))).alias("_off"),
        (F.col("_e.z") * (1 - F.col("_s")) + F.col("z") * F.col("_s")).alias("_z"),
    )
    first = hit.groupBy(frame, box, "side").agg(F.min_by(F.struct("_off", "_z"), "seq").alias("_h"))
    depth = first.groupBy(frame, box).agg(F.min_by("_h._z", F.struct("_h._off", "side")).alias("depth"))
    return boxes.join(depth, [frame, box], "left")


def depth_from_sideways(boxes: DataFrame, segments: DataFrame, frame: str, box: str, reach: float = 64.0, tile: float = 128.0) -> DataFrame:
    """Depth of the sideways segment nearest to a box's lower centre, within ``reach`` pixels; else null.

    ``segments`` holds frame, seq, u1, v1, u2, v2, z. Segments are laid on every
    tile within reach of them, so each box looks at one tile only.
    """
    s = segments.withColumns(
        {
            "_x1": F.least("u1", "u2") - reach, "_x2": F.greatest("u1", "u2") + reach,
            "_y1": F.least("v1", "v2") - reach, "_y2": F.greatest("v1", "v2") + reach,
        }
    )
    s = _tiles(s, "_x1", "_y1", "_x2", "_y2", tile)
    b = boxes.select(frame, box, ((F.col("x1") + F.col("x2")) / 2).alias("_px"), F.col("y2").alias("_py"))
    b = b.withColumns({"_tx": F.floor(F.col("_px") / F.lit(tile)), "_ty": F.floor(F.col("_py") / F.lit(tile))})
    dx, dy = F.col("u2") - F.col("u1"), F.col("v2") - F.col("v1")
    along = F.try_divide((F.col("_px") - F.col("u1")) * dx + (F.col("_py") - F.col("v1")) * dy, dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    ex, ey = F.col("_px") - (F.col("u1") + t * dx), F.col("_py") - (F.col("v1") + t * dy)
    hit = b.join(s, [frame, "_tx", "_ty"]).withColumn("_d", F.sqrt(ex * ex + ey * ey)).where(F.col("_d") <= reach)
    depth = hit.groupBy(frame, box).agg(F.min_by("z", F.struct("_d", "seq")).alias("depth"))
    return boxes.join(depth, [frame, box], "left")


def image_order(boxes: DataFrame, image: str) -> DataFrame:
    """Sort by image prefix, then image number.

    Both are columns of their own, as a sort works its expressions out again in every comparison.
    """
    d = boxes.withColumns({"_prefix": text.image_prefix(F.col(image)), "_number": text.image_number(F.col(image))})
    return d.orderBy("_prefix", "_number").drop("_prefix", "_number")
