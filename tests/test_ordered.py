"""Two-level windows and time joins against plain windows and brute force, hot keys included."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window as W, functions as F

from wayline.operators import blocks, lanes, messages, segments, timejoin


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(3)
    rows = [(("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}"), rng.randrange(0, 4000), i, rng.randrange(100)) for i in range(900)]
    return spark.createDataFrame(rows, "k string, t bigint, i bigint, v bigint").cache()


def test_running_sum_index_and_neighbours(series):
    w = W.partitionBy("k").orderBy("t", "i")
    d = blocks.running_sum(series, ["k"], ["t", "i"], {"s": F.col("v")}, 37)
    d = blocks.row_index(d, ["k"], ["t", "i"], 37)
    d = blocks.previous_row(d, ["k"], ["t", "i"], ["v"], 37)
    d = blocks.next_row(d, ["k"], ["t", "i"], ["v"], 37)
    d = d.withColumns({"ws": F.sum("v").over(w), "wr": F.row_number().over(w), "wp": F.lag("v").over(w), "wn": F.lead("v").over(w)})
    bad = d.where("s <> ws OR rn <> wr OR NOT (prev.v <=> wp) OR NOT (next.v <=> wn)")
    assert d.count() == series.count() and bad.isEmpty()


def test_fill_last_and_next(series):
    sparse = F.when(F.col("v") % 9 == 0, F.col("v"))
    w = W.partitionBy("k").orderBy("t", "i")
    d = blocks.fill_last(series, ["k"], ["t", "i"], {"l": sparse}, 37)
    d = blocks.fill_next(d, ["k"], ["t", "i"], {"n": sparse}, 37)
    d = d.withColumns(
        {
            "wl": F.last(sparse, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)),
            "wn": F.first(sparse, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)),
        }
    )
    assert d.where("NOT (l <=> wl) OR NOT (n <=> wn)").isEmpty()


def test_halo_blocks_hold_every_row_once_and_its_neighbours(series):
    d = blocks.halo_blocks(series, ["k"], ["t", "i"], 37, 50, 8).collect()
    own = [(r.k, r.pos) for r in d if r.own]
    assert len(own) == len(set(own)) == series.count()
    held = {(r.k, r.block, r.pos) for r in d}
    last = {}
    for k, pos in own:
        last[k] = max(last.get(k, 0), pos)
    for k, pos in own:
        for near in range(max(0, pos - 8), min(last[k], pos + 8) + 1):
            assert (k, pos // 50, near) in held


@pytest.mark.parametrize("values,median,upper", [([1, 2, 3, 4], 2.5, 3.0), ([5], 5.0, 5.0), ([1, 1, 1, 9, 9], 1.0, 1.0)])
def test_medians(spark, values, median, upper):
    d = spark.createDataFrame([("a", float(v)) for v in values], "k string, x double")
    assert blocks.grouped_median(d, ["k"], ["x"], 1.5).first().x == median
    assert blocks.grouped_median(d, ["k"], ["x"], 1.5, upper=True).first().x == upper


def test_asof_known_answers(spark):
    sweeps = spark.createDataFrame([("r", t) for t in (100, 200, 300)], "run string, s bigint")
    asked = spark.createDataFrame([("r", n, t) for n, t in enumerate((50, 100, 250, 300))], "run string, n int, t bigint")
    back = timejoin.asof_backward(asked, sweeps, ["run"], "t", "s", ["s"], 64)
    assert {(r.t, r.s) for r in back.collect()} == {(100, 100), (250, 200), (300, 300)}
    ahead = timejoin.asof_forward(asked, sweeps, ["run"], "t", "s", ["s"], 64, how="left")
    assert {(r.t, r.s) for r in ahead.collect()} == {(50, 100), (100, 200), (250, 300), (300, None)}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    left=st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60)), min_size=1, max_size=25),
    right=st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60)), min_size=1, max_size=25, unique=True),
    width=st.sampled_from([1, 7, 1000]),
)
def test_asof_against_brute_force(spark, left, right, width):
    l = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(left)], "k string, i int, t bigint")
    r = spark.createDataFrame(right, "k string, s bigint")
    got = {x.i: x.s for x in timejoin.asof_backward(l, r, ["k"], "t", "s", ["s"], width, how="left").collect()}
    want = {i: max((s for q, s in right if q == k and s <= t), default=None) for i, (k, t) in enumerate(left)}
    assert got == want


def test_middle_of_window(spark):
    recs = spark.createDataFrame([("r", t, t) for t in (10, 20, 30, 40, 90)], "k string, e bigint, id bigint")
    asked = spark.createDataFrame([("r", 0, 10), ("r", 1, 15), ("r", 2, 50), ("r", 3, 95)], "k string, n int, t bigint")
    got = timejoin.middle_of_window(asked, recs, ["k"], "t", "e", ["id"], 30, 25, "id")
    assert {(r.n, r.id) for r in got.collect()} == {(0, 30), (1, 30)}


def test_nearest_key_prefers_the_lower_side(spark):
    recs = spark.createDataFrame([("r", 3), ("r", 5), ("r", 12)], "k string, key bigint")
    asked = spark.createDataFrame([("r", 4), ("r", 9), ("r", 20), ("r", 5)], "k string, want bigint")
    got = {r.want: r.found_key for r in timejoin.nearest_key(asked, recs, ["k"], "want", "key").collect()}
    assert got == {4: 3, 9: 12, 5: 5}


def test_interpolation_ends(spark):
    poses = spark.createDataFrame([("r", 0, 0.0), ("r", 10, 5.0)], "k string, t bigint, x double")
    pts = spark.createDataFrame([("r", t) for t in (-1, 0, 4, 10, 11)], "k string, t bigint")
    d = timejoin.bracket_join(pts, poses, ["k"], "t", "t", ["x"], 100).withColumn("p", timejoin.lerp("x_1", "x_2"))
    assert {(r.t, r.p) for r in d.collect()} == {(0, 0.0), (4, 2.0), (10, 5.0)}


def test_warm_up_drop(spark):
    d = spark.createDataFrame([("s", f) for f in (1, 2, 3, 4, 5, 6, 9, 10, 11, 12, 13, 15)], "k string, f bigint")
    assert sorted(r.f for r in segments.drop_warm_up(d, ["k"], "f", 4).collect()) == [5, 6, 13]


def test_smoothing_fold_matches_the_recursion(spark):
    values = [float((i * 37) % 11) for i in range(300)]
    d = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "k string, i bigint, v double")
    got = {r.i: r.v_smooth for r in lanes.smooth_normals(d, ["k"], ["i"], ["v"], 40).collect()}
    mix = values[0]
    for i, v in enumerate(values):
        mix = v if i == 0 else 0.3 * mix + 0.7 * v
        assert got[i] == pytest.approx(mix, rel=1e-14)


def test_points_across_a_pose_meet_it_by_wide_blocks(spark):
    rng = random.Random(14)
    poses = [("r", i, rng.uniform(-90, 90), rng.uniform(-20, 20), 0.0, 0.6, 0.8, 0.0) for i in range(40)]
    pts = [("r", rng.choice(["left", "right"]), i, rng.uniform(-90, 90), rng.uniform(-20, 20), rng.uniform(-1, 1)) for i in range(300)]
    p = spark.createDataFrame(poses, "run string, pose bigint, x double, y double, z double, sx double, sy double, sz double")
    q = spark.createDataFrame(pts, "run string, side string, idx bigint, x double, y double, z double")
    d = lanes.across_hits(p, q, ["run"], "pose", "idx", 30.0, 2.0)
    best = {}
    for _, pose, x, y, z, sx, sy, sz in poses:
        for _, side, i, u, v, w in pts:
            a, b, c = u - x, v - y, w - z
            off = ((b * sz - c * sy) ** 2 + (c * sx - a * sz) ** 2 + (a * sy - b * sx) ** 2) ** 0.5
            if abs(a) < 30 and off <= 2:
                best[pose, side] = min(best.get((pose, side), (9.0, 0)), (off, i))
    assert {(r.pose, r.side): r.idx for r in d.collect()} == {k: i for k, (_, i) in best.items()} and len(best) > 20
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    copies = next(line for line in plan.splitlines() if "Generate explode(sequence(" in line)
    assert "/ 60" in copies or "/ cast(60" in copies  # a block of 60 cells, no column of single cells


def test_running_sums_over_all_rows(spark):
    rng = random.Random(8)
    rows = [(rng.random(), rng.randrange(10)) for _ in range(5000)]
    d = spark.createDataFrame(rows, "score double, n bigint").repartition(9)
    got = {r.score: r.total for r in blocks.global_running_sum(d, F.col("score").desc(), {"total": F.col("n")}).collect()}
    total = 0
    for score, n in sorted(rows, reverse=True):
        total += n
        assert got[score] == total
    assert blocks.global_running_sum(d.limit(0), F.col("score"), {"total": F.col("n")}).collect() == []


def brute_objects(frames):
    """Objects per header as the frames arrive: (time, parts)."""
    out, header, announced, members = [], None, 0, []

    def finish():
        if header is not None and len(members) % 3 == 0:
            out.extend((header, i // 3, *members[i : i + 3]) for i in range(0, len(members), 3))

    for t, _, ident, data in sorted(frames):
        if ident == 0x738:
            finish()
            header, announced, members = t, data[0], []
        elif header is not None and 0x739 <= ident < 0x739 + 3 * announced:
            members.append(data)
    finish()
    return out


def can_rows(seed, n, step=7, runs=("a", "b")):
    rng = random.Random(seed)
    rows = []
    for run in runs:
        t = 0
        for i in range(n):
            t += step if rng.random() < 0.1 else rng.choice([0, 1, 3])
            ident = 0x738 if i % 11 == 3 else 0x739 + rng.randrange(14) if rng.random() < 0.8 else rng.choice([0x100, 0x766, 0x7FF])
            rows.append((run, t, i, ident, bytes([rng.randrange(5) if ident == 0x738 else rng.randrange(256)]) + rng.randbytes(7)))
    return rows


@pytest.mark.parametrize("width", [5, 1000])
def test_can_objects_match_a_plain_reader(spark, width):
    rows = can_rows(4, 400)
    d = spark.createDataFrame(rows, "run string, t bigint, ord bigint, can_id int, data binary")
    got = sorted((r.run, r.header_time, r.unit, r.obj_id, r.age, round(r.length, 2)) for r in messages.can_objects(d, ["run"], "t", "ord", width).collect())
    want = sorted((run, t, k, a[0], b[2], round(b[0] * 0.05, 2)) for run in "ab" for t, k, a, b, _ in brute_objects([r[1:] for r in rows if r[0] == run]))
    assert got == want and len(want) > 10


def test_can_lanes_drop_broken_groups(spark):
    groups = [
        [0x766, 0x767, 0x769, 0x768, 0x76E, 0x76F],  # whole, out of order
        [0x766, 0x767, 0x768],  # odd
        [0x766, 0x767, 0x76C, 0x76E],  # a pair that does not belong together
        [0x766, 0x767, 0x770, 0x771, 0x76A, 0x500],  # a lane without a number, and foreign frames
    ]
    rows = [("r", 0, 0, 0x767, bytes(8))]
    for g, ids in enumerate(groups):
        rows += [("r", 100 * g + 10 + i, i, ident, bytes([i, 0, g, 0, 0, 0, 0, 0])) for i, ident in enumerate(ids)]
    d = spark.createDataFrame(rows, "run string, t bigint, ord bigint, can_id int, data binary")
    got = {(r.header_time, r.unit, r.lane_id, r.c0) for r in messages.can_lanes(d, ["run"], "t", "ord", 50).collect()}
    assert got == {(10, 0, -1, 0.0), (10, 1, 1, 0.0), (10, 2, 2, 0.0), (310, 0, -1, 3.0), (310, 1, None, 3.0)}
