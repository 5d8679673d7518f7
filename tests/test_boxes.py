"""Box joins, matching and tracking against brute force."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import boxes as bx
from wayline.operators import boxes as ops
from wayline.operators import clustering, matching, spatial

SCHEMA = "frame bigint, id bigint, x1 double, y1 double, x2 double, y2 double, score double, class_id int"


def some_boxes(seed, frames, per_frame, start=0, spread=150):
    rng = random.Random(seed)
    rows = []
    for f in range(frames):
        for _ in range(per_frame):
            x, y, w, h = rng.uniform(0, spread), rng.uniform(0, spread), rng.uniform(20, 60), rng.uniform(20, 60)
            rows.append((f, start + len(rows), x, y, x + w, y + h, round(rng.random(), 3), rng.choice([1, 2, -1])))
    return rows


def area(b):
    return (b[4] - b[2]) * (b[5] - b[3])


def shared(a, b):
    return max(0.0, min(a[4], b[4]) - max(a[2], b[2])) * max(0.0, min(a[5], b[5]) - max(a[3], b[3]))


def iou(a, b):
    return shared(a, b) / (area(a) + area(b) - shared(a, b))


def test_each_overlap_once_whatever_the_tile(spark):
    a, b = some_boxes(1, 3, 12), some_boxes(2, 3, 12, start=1000)
    want = sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and shared(p, q) > 0)
    for tile in (16.0, 128.0, 4096.0):
        d = ops.overlapping_pairs(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["frame"], tile)
        assert sorted((r.a_id, r.b_id) for r in d.collect()) == want


def largest(dets, truths, at_least):
    """Size of the largest one-to-one matching, by trying all assignments."""
    edges = {d[1]: [t[1] for t in truths if iou(d, t) >= at_least and (d[7] == t[7] or -1 in (d[7], t[7]))] for d in dets}
    best = 0
    for order in permutations(edges, len(edges)):
        taken = set()
        for d in order:
            free = [t for t in edges[d] if t not in taken]
            if free:
                taken.add(free[0])
        best = max(best, len(taken))
    return best


def test_matching_size_and_order(spark):
    truths, dets = some_boxes(3, 12, 5, spread=60), some_boxes(4, 12, 5, start=1000, spread=60)
    d = matching.match_detections(spark.createDataFrame(truths, SCHEMA), spark.createDataFrame(dets, SCHEMA), ["frame"], "id", 0.25)
    rows = d.collect()
    assert len(rows) == len(dets)
    used = [(r.frame, r.truth_id) for r in rows if r.truth_id is not None]
    assert len(used) == len(set(used))
    for f in range(12):
        ordered = sorted((b for b in dets if b[0] == f), key=lambda b: (-b[6], b[1]))
        own = [t for t in truths if t[0] == f]
        for k in range(1, len(ordered) + 1):  # after each score the matching so far is a largest one
            ids = {b[1] for b in ordered[:k]}
            assert sum(r.d_matched for r in rows if r.id in ids) == largest(ordered[:k], own, 0.25)


def test_ignored_truths(spark):
    truth = [(0, 1, 0.0, 0.0, 10.0, 10.0, 1.0, 1), (0, 2, 50.0, 0.0, 60.0, 10.0, 1.0, 1)]
    dets = [(0, 11, 0.0, 0.0, 10.0, 10.0, 0.9, 1), (0, 12, 50.0, 0.0, 60.0, 10.0, 0.8, 1), (0, 13, 90.0, 0.0, 99.0, 9.0, 0.7, 1)]
    ignore = spark.createDataFrame([truth[1]], SCHEMA)
    d = matching.match_detections(spark.createDataFrame(truth, SCHEMA), spark.createDataFrame(dets, SCHEMA), ["frame"], "id", ignore=ignore)
    assert {r.id: (r.d_matched, r.d_ignored) for r in d.collect()} == {11: (1, 0), 12: (0, 1), 13: (0, 0)}
    curve = {round(r.score, 1): r for r in ops.precision_recall(d, spark.createDataFrame([(2, 1)], "n_truths long, n_images long")).collect()}
    assert curve[0.9].recall == 0.5 and curve[0.8].recall == 1.0 and curve[0.8].considered == 1
    assert curve[0.7].precision == 0.5 and curve[0.7].fppi == 1.0


def test_recall_by_width_bins(spark):
    truths, dets = some_boxes(5, 6, 5, spread=60), some_boxes(6, 6, 5, start=1000, spread=60)
    rows = matching.recall_by_width(spark.createDataFrame(truths, SCHEMA), spark.createDataFrame(dets, SCHEMA), ["frame"], "id", bins=3).collect()
    widths = [t[4] - t[2] for t in truths]
    low, high = max(min(widths), 20), max(widths)
    for r in rows:
        inside = [t for t in truths if r.bin == 0 or min(int((t[4] - t[2] - low) / (high - low) * 3), 2) + 1 == r.bin]
        assert r.n_truths == len(inside)
        hits = sum(largest([d for d in dets if d[0] == f], [t for t in inside if t[0] == f], 0.5) for f in range(6))
        assert r.recall == pytest.approx(hits / len(inside))


def brute_tracks(rows, idle):
    """Frame by frame: nearest box before, nearest claimant keeps it, ids unused for long are taken again."""
    frames = sorted({r[0] for r in rows})
    used, before, before_frame, out = [], [], None, {}
    for f in frames:
        new = sorted(r for r in rows if r[0] == f)
        size = [((r[2] + r[4]) / 2, (r[3] + r[5]) / 2, r[4] - r[2], r[5] - r[3]) for r in new]
        claim = {}
        if before_frame == f - 1:
            for n, s in enumerate(size):
                d, j = min((sum((p - q) ** 2 for p, q in zip(s, b[0])), i) for i, b in enumerate(before))
                if j not in claim or (d, -new[n][1]) < claim[j][0]:
                    claim[j] = ((d, -new[n][1]), n)
        ids = {n: before[j][1] for j, (_, n) in claim.items()}
        for n in ids:
            used[ids[n]] = f
        for n in range(len(new)):
            if n not in ids:
                pick = next((j for j, u in enumerate(used) if f - u > idle), len(used))
                if pick == len(used):
                    used.append(f)
                used[pick] = f
                ids[n] = pick
        before, before_frame = [(size[n], ids[n]) for n in range(len(new))], f
        out.update({new[n][1]: ids[n] for n in ids})
    return out


def test_track_ids(spark):
    rng = random.Random(8)
    rows = [r for r in some_boxes(7, 60, 4, spread=300) if rng.random() < 0.6 and not 20 <= r[0] < 28]
    d = matching.assign_track_ids(spark.createDataFrame(rows, SCHEMA).withColumn("seq", F.lit(1)), ["seq"], "frame", "id", idle=5)
    assert {r.id: r.track_id for r in d.collect()} == brute_tracks(rows, 5)


def test_similarity_motion_recovers_scale_and_shift(spark):
    rng = random.Random(1)
    good = [(1, x, y, 1.5 * x + 4, 1.5 * y - 2) for x, y in ((rng.uniform(0, 4), rng.uniform(0, 4)) for _ in range(60))]
    noise = [(1, 0.0, 0.0, 300.0 + i, -200.0) for i in range(5)]
    d = spark.createDataFrame(good + noise, "box int, x_a double, y_a double, x_b double, y_b double")
    r = ops.robust_motion(d, ["box"]).first()
    assert (r.scale, r.shift_x, r.shift_y) == pytest.approx((1.5, 4.0, -2.0), abs=1e-6)


def test_gap_fill_interpolates_and_skips_overlaps(spark):
    def row(f, i, x):
        return (1, f, i, x, 0.0, x + 10, 10.0)

    schema = "seq int, frame bigint, track_id bigint, x1 double, y1 double, x2 double, y2 double"
    boxes = spark.createDataFrame([row(0, 7, 0.0), row(4, 7, 40.0), row(2, 9, 20.0), row(30, 7, 0.0)], schema)
    radar = spark.createDataFrame([(1, f, 7) for f in (1, 2, 3, 15)], "seq int, frame bigint, track_id bigint")
    got = ops.fill_gaps(boxes, radar, ["seq"], "frame", "track_id", 10).collect()
    assert {(r.frame, r.x1) for r in got} == {(1, 10.0), (3, 30.0)}


def test_occlusion_keeps_the_nearer_box(spark):
    rows = [(0, 1, 0.0, 0.0, 10.0, 10.0, 1.0, 1), (0, 2, 2.0, 0.0, 12.0, 12.0, 1.0, 1), (1, 3, 0.0, 0.0, 10.0, 10.0, 1.0, 1)]
    d = ops.drop_occluded(spark.createDataFrame(rows, SCHEMA), ["frame"], "id")
    assert {r.id for r in d.collect()} == {2, 3}


def test_equal_bins_close_the_last(spark):
    d = ops.equal_bins(spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "w double"), "w", 2)
    assert {r.w: r.bin for r in d.collect()} == {0.0: 1, 5.0: 2, 10.0: 2}
    assert bx.CORNERS == ("x1", "y1", "x2", "y2")


@pytest.mark.parametrize("largest", [0, 20_000])
def test_frames_are_matched_many_in_a_task_or_group_by_group(spark, largest):
    """Crowded frames go by connected groups, the others whole; both find the same, and frames with equal ids stay apart."""
    rng = random.Random(5)
    edges = sorted({(f, rng.randrange(12), rng.randrange(100, 110)) for f in range(6) for _ in range(25)})
    rows = [(f, d, t, float((d * 7) % 5)) for f, d, t in edges]
    df = spark.createDataFrame(rows, "frame bigint, _d bigint, _t bigint, _score double")
    got = sorted(map(tuple, matching.solve_matching(df, ["frame"], largest).select("frame", "_d", "truth_id").collect()))
    want = []
    for f in range(6):
        ends = {}
        for _, d, t, _ in [r for r in rows if r[0] == f]:
            ends.setdefault(d, []).append(t)
        order = sorted(ends, key=lambda d: (-float((d * 7) % 5), d))
        want += [(f, d, t) for d, t in matching.grow_matching(order, ends).items()]
    assert got == sorted(want)


def test_recall_by_width_seeks_pairs_once(spark):
    """Detections are not repeated for every bin: one join of tiles, on the frame alone."""
    truths = [(f, i, 0, float(30 * i), 0.0, 30.0 * i + 21 + i, 30.0, 1.0, 1) for f in range(3) for i in range(4)]
    df = spark.createDataFrame([t[:2] + t[3:] for t in truths], SCHEMA)
    seen = []
    before = matching.overlapping_pairs
    matching.overlapping_pairs = lambda a, b, keys, **kw: seen.append(list(keys)) or before(a, b, keys, **kw)
    try:
        rows = {r["bin"]: (r["n_truths"], r["recall"]) for r in matching.recall_by_width(df, df, ["frame"], "id", bins=3).collect()}
    finally:
        matching.overlapping_pairs = before
    assert seen == [["frame"]] and rows[0] == (12, 1.0) and sum(n for b, (n, _) in rows.items() if b) == 12


def test_nearest_rows_against_brute_force():
    rng = np.random.default_rng(3)
    for n, m in ((5, 3), (400, 700), (1500, 900)):
        source, target = (np.stack([rng.integers(0, 30, k) * 10.0, rng.uniform(0, 500, k), rng.integers(2, 9, k) * 10.0, rng.integers(2, 9, k) * 5.0], axis=1) for k in (n, m))
        source[: n // 3] = target[rng.integers(0, m, n // 3)]
        target[m // 2 : m // 2 + m // 5] = target[: m // 5]
        target[-1, 0] = source[-1, 1] = np.nan
        ids = rng.permutation(m)
        at, d2 = spatial.nearest_rows(source, target, ids)
        every = sum((source[:, None, c] - target[None, :, c]) ** 2 for c in range(4))
        for k in range(n - 1):
            want = min((every[k, j], ids[j], j) for j in range(m - 1))
            assert (d2[k], at[k]) == (want[0], want[2])
        assert at[-1] == -1


@pytest.mark.parametrize("largest, part", [(0, 1), (3, 40), (200_000, 400)])
def test_track_ids_however_frames_are_parted(spark, largest, part, monkeypatch):
    """Chains cross the parts, crowded frames go by cells; ids are the same, and no box takes part in rounds over single links."""
    rows = [r for r in some_boxes(9, 40, 6, spread=300) if r[1] % 7]
    before = matching.link_frames
    monkeypatch.setattr(matching, "link_frames", lambda places, keys: before(places, keys, largest))
    seen = []
    rounds = clustering.connected_components
    monkeypatch.setattr(clustering, "connected_components", lambda e: seen.append(e.count()) or rounds(e))
    d = matching.assign_track_ids(spark.createDataFrame(rows, SCHEMA).withColumn("seq", F.lit(1)), ["seq"], "frame", "id", idle=5, part=part)
    assert {r.id: r.track_id for r in d.collect()} == brute_tracks(rows, 5)
    assert part == 1 or sum(seen) < len(rows) / 2
