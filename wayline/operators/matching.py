"""One-to-one matching of detections and truths, and track ids."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wayline.functions import boxes as bx
from wayline.operators import clustering, spatial
from wayline.operators.boxes import C, equal_bins, overlapping_pairs, pair_sides
from wayline.session import cut_lineage

#: pairs of a frame up to which one task matches it whole
LARGEST = 20_000
#: pairs that one task takes, of as many frames as it needs
BUCKET = 200_000
#: boxes of a frame up to which one task searches it whole
LARGEST_FRAME = 200_000
#: boxes of the frames whose chains are followed together
PART = 50_000
PLACE = ["_cx", "_cy", "_w", "_h"]


def grow_matching(dets: Sequence, edges: dict) -> dict:
    """Largest matching grown detection by detection; det -> truth newly covered when it was added.

    Breadth-first augmenting paths: a truth once covered stays covered, so each
    detection adds one truth or none.
    """
    held_by: dict = {}
    owns: dict = {}
    gained: dict = {}
    for start in dets:
        came_from: dict = {}
        queue, end = deque([start]), None
        while queue and end is None:
            d = queue.popleft()
            for t in edges[d]:
                if t in came_from:
                    continue
                came_from[t] = d
                if t not in held_by:
                    end = t
                    break
                queue.append(held_by[t])
        if end is None:
            continue
        gained[start] = end
        t = end
        while True:
            d = came_from[t]
            before = owns.get(d)
            held_by[t], owns[d] = d, t
            if d == start:
                break
            t = before
    return gained


def matching_pairs(truths: DataFrame, detections: DataFrame, keys: Sequence[str], ident: str, min_iou: float, style: str, also: Sequence[str] = ()) -> DataFrame:
    """Pairs that may be matched: keys, ``_d``, ``_t``, ``_score`` and the truths' columns ``also``."""
    keys = list(keys)
    a, b = pair_sides()
    ca, cb = F.col("a_class_id"), F.col("b_class_id")
    slim = [*keys, ident, "class_id", *C]
    pairs = overlapping_pairs(detections.select(*slim, "score"), truths.select(*slim, *also), keys)
    pairs = pairs.where(bx.match_iou(a, b, ca, cb, min_iou) if style == "iou" else bx.match_cover(a, b, ca, cb))
    return pairs.select(
        *keys,
        F.col("a_" + ident).cast("bigint").alias("_d"),
        F.col("b_" + ident).cast("bigint").alias("_t"),
        F.col("a_score").cast("double").alias("_score"),
        *[F.col("b_" + c).alias(c) for c in also],
    )


def solve_matching(edges: DataFrame, keys: Sequence[str], largest: int = LARGEST) -> DataFrame:
    """Largest matching of each key in descending score: keys, ``_d`` and ``truth_id`` of the detections that are matched.

    Keys of up to ``largest`` edges are solved many in a task. Those of larger
    keys fall apart into connected groups first, and each is solved on its own,
    so no task holds a crowded frame.
    """
    keys = list(keys)
    edges = cut_lineage(edges)
    types = dict(edges.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "_d bigint", "truth_id bigint"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        order = np.lexsort((pdf["_t"], pdf["_d"], -pdf["_score"], key))
        pdf, key = pdf.iloc[order], key[order]
        # detections and truths of different frames never meet, so all frames are grown as one
        first: dict = {}
        ends: dict = {}
        for at, (k, d, t) in enumerate(zip(key.tolist(), pdf["_d"].tolist(), pdf["_t"].tolist(), strict=True)):
            first.setdefault((k, d), at)
            ends.setdefault((k, d), []).append((k, t))
        gained = grow_matching(list(first), ends)
        out = pdf[keys].iloc[[first[d] for d in gained]].reset_index(drop=True)
        return out.assign(_d=[d for _, d in gained], truth_id=[t for _, t in gained.values()])

    counts = edges.groupBy(*keys).agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    small, large = edges, None
    if (most or 0) > largest:
        crowded = cut_lineage(counts.where(F.col("_n") > largest).select(*keys))
        small, large = edges.join(crowded, keys, "left_anti"), edges.join(crowded, keys, "left_semi")
    tasks = max(1, -(-(total or 0) // BUCKET))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(tasks))
    gained = small.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandas(solve, schema)
    if large is None:
        return gained
    name = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    large = large.withColumns({"a": F.concat_ws(":", name, F.lit("d"), "_d"), "b": F.concat_ws(":", name, F.lit("t"), "_t")})
    groups = clustering.connected_components(large)
    large = large.join(groups, large["a"] == groups["node"]).select(*keys, "_d", "_t", "_score", "root")
    return gained.unionByName(large.groupBy("root").applyInPandas(solve, schema))


def match_detections(
    truths: DataFrame,
    detections: DataFrame,
    keys: Sequence[str],
    ident: str,
    min_iou: float = 0.5,
    ignore: DataFrame | None = None,
    ignore_iou: float = 0.9,
    style: str = "iou",
) -> DataFrame:
    """Match per frame in descending score: detection rows with d_matched, d_ignored and truth_id.

    Overlapping pairs come from a tile join, see :func:`solve_matching` for what
    is done with them.
    """
    keys = list(keys)
    a, b = pair_sides()
    slim = [*keys, ident, "class_id", *C]
    gained = solve_matching(matching_pairs(truths, detections, keys, ident, min_iou, style), keys).withColumnRenamed("_d", ident)
    out = detections.join(gained, [*keys, ident], "left")
    if ignore is None:
        out = out.withColumn("_ign", F.lit(False))
    else:
        hidden = overlapping_pairs(truths.select(*slim), ignore.select(*keys, *C), keys).where(bx.iou(a, b) > ignore_iou)
        hidden = hidden.select(*keys, F.col("a_" + ident).alias("truth_id"), F.lit(True).alias("_ign")).distinct()
        out = out.join(hidden, [*keys, "truth_id"], "left")
    flagged = F.coalesce("_ign", F.lit(False))
    got = F.col("truth_id").isNotNull()
    return out.withColumns(
        {
            "d_matched": F.when(got & ~flagged, 1).otherwise(0).cast("bigint"),
            "d_ignored": F.when(got & flagged, 1).otherwise(0).cast("bigint"),
        }
    ).drop("_ign")


def recall_by_width(truths: DataFrame, detections: DataFrame, keys: Sequence[str], ident: str, bins: int = 14, floor_at: float = 20.0) -> DataFrame:
    """Truths and recall per width bin, each bin matched against all detections; bin 0 is the whole list.

    Pairs are sought once; those of a bin are the ones with its truths.
    """
    keys = list(keys)
    sized = equal_bins(truths.withColumn("_w", bx.width(bx.corners())), "_w", bins, floor_at=floor_at)
    sized = sized.withColumn("bin", F.when(F.col("_w") >= F.col("_low"), F.col("bin"))).select(*truths.columns, "bin")

    def by_bin(rows):
        each = F.filter(F.array(F.lit(0).cast("bigint"), F.col("bin")), lambda x: x.isNotNull())
        return rows.withColumn("bin", F.explode(each))

    pairs = by_bin(matching_pairs(sized, detections, keys, ident, 0.5, "iou", ["bin"]))
    matched = solve_matching(pairs, [*keys, "bin"]).groupBy("bin").agg(F.count("*").alias("n_found"))
    n = by_bin(sized.select("bin")).groupBy("bin").agg(F.count("*").alias("n_truths"))
    return n.join(matched, "bin", "left").select(
        "bin", "n_truths", (F.coalesce("n_found", F.lit(0)) / F.col("n_truths")).alias("recall")
    )


def _places(boxes: DataFrame, keys: list[str], frame: str, ident: str) -> DataFrame:
    """Keys, frame and id as whole numbers, centre and size."""
    b = bx.corners()
    (cx, cy), w, h = bx.centre(b), bx.width(b), bx.height(b)
    return boxes.select(*keys, F.col(frame).cast("bigint").alias("_f"), F.col(ident).cast("bigint").alias("_i"), *[c.cast("double").alias(n) for c, n in zip((cx, cy, w, h), PLACE)])


def _links_by_cells(now: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`link_frames` of frames that no task should hold."""
    old = old.select(*keys, "_f", F.col("_i").alias("prev"), *PLACE)
    near = spatial.nearest(now, old, [*keys, "_f"], PLACE[:2], 16384.0, "prev", levels=(128, 16, 1), extra=PLACE[2:])
    best = near.groupBy(*keys, "_f", "prev").agg(F.min(F.struct("dist", (-F.col("_i")).alias("_neg"))).alias("_b"))
    best = best.select(*keys, "_f", (-F.col("_b._neg")).alias("_i"), "prev")
    return now.select(*keys, "_f", "_i").join(best, [*keys, "_f", "_i"], "left").select(*keys, "_f", "_i", F.coalesce("prev", F.lit(0)).alias("_p"), F.col("prev").isNotNull().alias("_linked"))


def link_frames(places: DataFrame, keys: Sequence[str], largest: int = LARGEST_FRAME) -> DataFrame:
    """Each box (``_f``, ``_i`` and place) with the box ``_p`` of the frame before it continues, if it is ``_linked`` to one.

    Nearest by centre and size; of several claimants of one box the nearest
    keeps it (the later box on a tie), the others start anew. Frames of up to
    ``largest`` boxes are searched whole, several in a task; the others by cells.
    """
    keys = list(keys)
    types = dict(places.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "_f bigint, _i bigint, _p bigint, _linked boolean"])

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        code = pdf.groupby([*keys, "_f"], sort=False, dropna=False).ngroup().to_numpy()
        old, ids, at = pdf["_old"].to_numpy(bool), pdf["_i"].to_numpy(), pdf[PLACE].to_numpy(float)
        order = np.lexsort((old, code))
        ends = np.flatnonzero(np.r_[np.diff(code[order]) != 0, True]) + 1
        before, linked = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
        start = 0
        for end in ends:
            rows, start = order[start:end], end
            new, was = rows[~old[rows]], rows[old[rows]]
            if not len(new) or not len(was):
                continue
            to, d2 = spatial.nearest_rows(at[new], at[was], ids[was])
            some = np.flatnonzero(to >= 0)
            some = some[np.lexsort((-ids[new[some]], np.sqrt(d2[some]), ids[was[to[some]]]))]
            prev = ids[was[to[some]]]
            keeps = np.r_[True, prev[1:] != prev[:-1]] if len(some) else np.zeros(0, bool)
            before[new[some[keeps]]], linked[new[some[keeps]]] = prev[keeps], True
        return pdf[[*keys, "_f", "_i"]].assign(_p=before, _linked=linked)[~old]

    counts = places.groupBy(*keys, "_f").agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    both = F.explode(F.array(F.lit(False), F.lit(True)))
    rows = places.select(*places.columns, both.alias("_old")).withColumn("_f", F.col("_f") + F.col("_old").cast("int"))
    large = None
    if (most or 0) > largest:
        crowded = counts.where(F.col("_n") > largest)
        crowded = cut_lineage(crowded.select(*keys, "_f").unionByName(crowded.select(*keys, (F.col("_f") + 1).alias("_f"))).distinct())
        large = rows.join(crowded, [*keys, "_f"], "left_semi")
        rows = rows.join(crowded, [*keys, "_f"], "left_anti")
        large = _links_by_cells(large.where("NOT _old").drop("_old"), large.where("_old").drop("_old"), keys)
    bucket = F.pmod(F.xxhash64(*keys, "_f"), F.lit(max(1, -(-2 * (total or 0) // BUCKET))))
    found = rows.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandas(link, schema)
    return found if large is None else found.unionByName(large)


def chain_starts(links: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """First frame ``_cf`` and box ``_ci`` of the chain of links that each box is on.

    Chains are followed within ``width`` frames first, several such parts in a
    task; what goes from part to part is one link a box at their edges.
    """
    keys = list(keys)
    types = dict(links.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "_f bigint, _i bigint, _cf bigint, _ci bigint, _cp bigint, _open boolean"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates([*keys, "_f", "_i"], ignore_index=True)
        code = pdf.groupby(keys, sort=False, dropna=False).ngroup() if keys else 0
        own = pd.DataFrame({"k": code, "f": pdf["_f"], "i": pdf["_i"], "at": np.arange(len(pdf))})
        asked = pd.DataFrame({"k": code, "f": pdf["_f"] - 1, "i": pdf["_p"]})
        at = asked.merge(own, "left", ["k", "f", "i"])["at"].to_numpy()
        first = np.where(pdf["_linked"].to_numpy(bool) & ~np.isnan(at), np.nan_to_num(at), np.arange(len(pdf))).astype(np.int64)
        while True:
            after = first[first]
            if (after == first).all():
                break
            first = after
        start = pdf.iloc[first]
        return pdf[[*keys, "_f", "_i"]].assign(_cf=start["_f"].to_numpy(), _ci=start["_i"].to_numpy(), _cp=start["_p"].to_numpy(), _open=start["_linked"].to_numpy())

    tasks = max(1, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64(*keys, F.floor(F.col("_f") / width)), F.lit(tasks * 8))
    parts = cut_lineage(links.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandas(walk, schema))
    across = parts.where(F.col("_open") & (F.col("_f") == F.col("_cf")) & (F.col("_i") == F.col("_ci")))
    if across.isEmpty():
        return parts.drop("_cp", "_open")

    def node(f, i):
        return F.struct(*keys, F.col(f).alias("f"), F.col(i).alias("i"))

    ends = parts.select(*keys, F.col("_f").alias("_at"), F.col("_i").alias("_cp"), node("_cf", "_ci").alias("b"))
    edges = across.select(*keys, (F.col("_cf") - 1).alias("_at"), "_cp", node("_cf", "_ci").alias("a")).join(ends, [*keys, "_at", "_cp"])
    roots = clustering.connected_components(edges.select("a", "b"))
    roots = roots.select(*[F.col("node")[k].alias(k) for k in keys], F.col("node.f").alias("_cf"), F.col("node.i").alias("_ci"), F.col("root.f").alias("_rf"), F.col("root.i").alias("_ri"))
    return parts.join(roots, [*keys, "_cf", "_ci"], "left").select(*keys, "_f", "_i", F.coalesce("_rf", "_cf").alias("_cf"), F.coalesce("_ri", "_ci").alias("_ci"))


def assign_track_ids(boxes: DataFrame, keys: Sequence[str], frame: str, ident: str, idle: int = 50, part: int = PART) -> DataFrame:
    """Box rows with ``track_id``.

    Frames are linked and chains followed many frames in a task. Only one row per chain
    (first and last frame) goes through the sequential rule that hands out ids:
    the lowest id unused for more than ``idle`` frames, else a new one.
    """
    keys = list(keys)
    places = _places(boxes, keys, frame, ident)
    total, frames = places.groupBy(*keys, "_f").agg(F.count("*").alias("_n")).agg(F.sum("_n"), F.count("*")).first()
    links = link_frames(places, keys)
    d = cut_lineage(chain_starts(links, keys, max(1, part * frames // max(total or 0, 1))))
    spans = d.groupBy(*keys, "_cf", "_ci").agg(F.min("_f").alias("start"), F.max("_f").alias("end"))

    def hand_out(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "_ci"]).reset_index(drop=True)
        busy: list[tuple[int, int]] = []  # (last frame, id) of ids in use
        free: list[int] = []
        ids = []
        for start, end in zip(pdf["start"], pdf["end"]):
            while busy and start - busy[0][0] > idle:
                heapq.heappush(free, heapq.heappop(busy)[1])
            pick = heapq.heappop(free) if free else len(busy)
            heapq.heappush(busy, (end, pick))
            ids.append(pick)
        return pdf.assign(track_id=ids)[[*keys, "_cf", "_ci", "track_id"]]

    types = dict(boxes.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "_cf bigint", "_ci bigint", "track_id bigint"])
    ids = spans.groupBy(*keys).applyInPandas(hand_out, schema)
    d = d.join(ids, [*keys, "_cf", "_ci"]).select(*keys, F.col("_f").alias(frame), F.col("_i").alias(ident), "track_id")
    return boxes.join(d, [*keys, frame, ident])
