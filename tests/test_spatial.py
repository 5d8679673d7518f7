"""Grid joins, clusters and voxel folds against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayline.operators import clustering, spatial, voxels

XYZ = ["x", "y", "z"]


def cloud(seed, n, spread=10.0, hot=0.4):
    """Points of which a share sits in one tight, partly duplicated spot."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rng.random() < hot:
            rows.append((i, round(rng.uniform(1.0, 1.4), 1), round(rng.uniform(2.0, 2.4), 1), round(rng.uniform(0, 0.3), 1)))
        else:
            rows.append((i, rng.uniform(-spread, spread), rng.uniform(-spread, spread), rng.uniform(-2, 2)))
    return rows


def frame(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} bigint, x double, y double, z double")


def test_nearest_within(spark):
    a, b = cloud(1, 250), cloud(2, 250)
    got = {r.id: r.t for r in spatial.nearest_within(frame(spark, a), frame(spark, b, "t"), [], XYZ, 1.5, "t", levels=(16, 4, 1)).collect()}
    want = {}
    for i, *p in a:
        d, j = min((math.dist(p, q), j) for j, *q in b)
        if d < 1.5:
            want[i] = j
    assert got == want


def test_radius_join(spark):
    a, b = cloud(3, 80), cloud(4, 120)
    got = {(r.c_id, r.id) for r in spatial.radius_join(frame(spark, a), frame(spark, b), [], XYZ, 2.0).collect()}
    assert got == {(i, j) for i, *p in a for j, *q in b if math.dist(p, q) <= 2.0}


def test_k_nearest(spark):
    a = cloud(5, 120, hot=0.3)
    rows = spatial.k_nearest(frame(spark, a), XYZ, "id", 6, 0.2).collect()
    at = {i: tuple(p) for i, *p in a}
    for i, *p in a:
        got = sorted(math.dist(p, (r.n_x, r.n_y, r.n_z)) for r in rows if r.id == i)
        want = sorted(math.dist(p, q) for q in at.values())[:6]
        assert got == pytest.approx(want)


def test_k_nearest_in_a_crowd(spark):
    """All points lie inside the first radius, most of them in one spot, some of them at one place."""
    rng = random.Random(11)
    a = [(i, rng.gauss(0, 1e-4), rng.gauss(0, 1e-4), 0.0) for i in range(1500)] + [(2000 + i, rng.uniform(-1, 1), rng.uniform(-1, 1), 0.5) for i in range(40)]
    a += [(3000 + i, 0.25, 0.25, 0.25) for i in range(90)] + [(4000, None, 0.0, 0.0), (4001, float("nan"), 0.0, 0.0)]
    rows = spatial.k_nearest(frame(spark, a), XYZ, "id", 7, 50.0, crowd=16).collect()
    at = {i: tuple(p) for i, *p in a if i < 4000}
    got = {}
    for r in rows:
        got.setdefault(r.id, {})[r["rank"]] = (r.n_x, r.n_y, r.n_z)
    assert got.keys() == at.keys()
    for i in [*range(0, 1500, 60), *range(2000, 2040), 3000, 3050, 3089]:
        want = [at[j] for _, j in sorted((math.dist(at[i], q), j) for j, q in at.items())[:7]]
        assert [got[i][k] for k in range(1, 8)] == want
    assert spatial.k_nearest(frame(spark, a[-1:]), XYZ, "id", 7, 1.0).collect() == []
    assert {(r.id, r["rank"]) for r in spatial.k_nearest(frame(spark, a[:3]), XYZ, "id", 7, 1e-6).collect()} == {(i, k) for i in range(3) for k in (1, 2, 3)}


@pytest.mark.parametrize("few", [0, 4, 64])
def test_nearest_at_any_distance(spark, few):
    """Crowded and sparse keys, far targets, and targets or sources that have no place."""
    rng = random.Random(12)
    nan, inf = float("nan"), float("inf")
    a = [("k", i, *p) for i, *p in cloud(6, 60)] + [("far", 100, 0.0, 0.0, 0.0), ("bare", 101, 0.0, 0.0, 0.0), ("void", 102, 1.0, 1.0, 1.0)]
    a += [("k", 103, None, 0.0, 0.0), ("k", 104, nan, 0.0, 0.0), ("k", 105, 0.0, inf, 0.0), ("k", 106, 1e16, 0.0, 0.0)]
    b = [("k", i, *p) for i, *p in cloud(7, 150)] + [("far", 1, 3e9, -2e9, 5.0), ("far", 2, 3e9, -2e9, 6.0)] + [("far", 10 + i, 4e9 + rng.random(), 0.0, 0.0) for i in range(9)]
    b += [("bare", 1, None, 0.0, 0.0), ("bare", 2, nan, 0.0, 0.0), ("bare", 3, 0.0, -inf, 0.0), ("k", 990, nan, nan, nan), ("other", 1, 0.0, 0.0, 0.0)]
    schema = "key string, {} bigint, x double, y double, z double"
    d = spatial.nearest(spark.createDataFrame(a, schema.format("id")), spark.createDataFrame(b, schema.format("t")), ["key"], XYZ, 0.5, "t", few=few)
    got = {r.id: (r.t, r.dist) for r in d.collect()}
    want = {}
    for key, i, *p in a:
        pairs = [(math.dist(p, q), t) for k, t, *q in b if k == key and all(isinstance(v, float) and math.isfinite(v) for v in (*p, *q))]
        if pairs:
            want[i] = min(pairs)
    assert got.keys() == want.keys() and 101 not in got
    for i, (dist, t) in want.items():
        assert got[i][1] == pytest.approx(dist) and (got[i][0] == t or i == 106)
    none = spark.createDataFrame([], schema.format("t"))
    assert spatial.nearest(spark.createDataFrame(a, schema.format("id")), none, ["key"], XYZ, 0.5, "t", few=few).collect() == []


def brute_clusters(rows, eps, least):
    near = {i: [j for j, *q in rows if math.dist(p, q) <= eps] for i, *p in rows}
    core = {i for i in near if len(near[i]) >= least}
    label = {}
    for i in sorted(core):
        if i in label:
            continue
        todo = [i]
        while todo:
            c = todo.pop()
            if c in label:
                continue
            label[c] = i
            todo += [j for j in near[c] if j in core and j not in label]
    for i in near:
        if i not in core:
            found = [label[j] for j in near[i] if j in core]
            if found:
                label[i] = min(found)
    return label


@pytest.mark.parametrize("eps,least,hot", [(1.0, 8, 0.5), (0.12, 4, 0.9), (2.5, 1, 0.2)])
def test_density_clusters(spark, eps, least, hot):
    rows = cloud(6, 300, spread=8.0, hot=hot)
    d = clustering.density_clusters(frame(spark, rows), [], XYZ, "id", eps, least)
    assert {r.id: r.cluster for r in d.collect()} == brute_clusters(rows, eps, least)


def test_crowded_cells_far_apart_by_points_only(spark):
    """Two crowds in neighbouring cells whose boxes leave the link open."""
    rng = random.Random(9)
    left = [(i, rng.uniform(0, 0.05), rng.uniform(0, 0.5), 0.0) for i in range(40)]
    right = [(100 + i, rng.uniform(0.95, 1.1), rng.uniform(0, 0.5), 0.0) for i in range(40)]
    for gap in (0.0, 0.3):
        rows = left + [(i, x + gap, y, z) for i, x, y, z in right]
        d = clustering.density_clusters(frame(spark, rows), [], XYZ, "id", 1.0, 5)
        assert {r.id: r.cluster for r in d.collect()} == brute_clusters(rows, 1.0, 5)


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    hub = [(1000, 1000 + i) for i in range(1, 150)]
    e = spark.createDataFrame(chain + hub, "a bigint, b bigint")
    got = {r.node: r.root for r in clustering.connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(150)}}


def test_clamped_occupancy_known_values(spark):
    """One voxel, five hits and then two misses; folded in blocks of two scans."""
    hits = [(s, 5.5, 0.5, 0.5) for s in range(5)]
    through = [(s, 9.5, 0.5, 0.5) for s in (5, 6)]
    d = spark.createDataFrame(hits + through, "scan bigint, x double, y double, z double")
    for scans in (2, 1024):
        v = voxels.occupancy(d, "scan", [F.lit(0.5)] * 3, 1.0, scans_per_block=scans)
        row = v.where("vx = 5").select(voxels.probability(F.col("log_odds")).alias("p"), "n_scans").first()
        assert row.p == pytest.approx(0.93494, abs=1e-5) and row.n_scans == 7


def test_ray_stops_before_its_own_voxel(spark):
    d = spark.createDataFrame([(1, 3.5, 2.5, 0.5), (2, -1.5, 0.5, 0.5), (3, 0.6, 0.6, 0.6)], "id int, x double, y double, z double")
    got = voxels.explode_rays(d, [F.lit(0.5)] * 3, ["id"], 1.0).collect()
    assert {(r.vx, r.vy) for r in got if r.id == 2} == {(0, 0), (-1, 0)}
    assert not [r for r in got if r.id == 3]
    first = [(r.vx, r.vy) for r in got if r.id == 1]
    assert (0, 0) in first and (3, 2) not in first and len(first) == len(set(first)) == 5


def test_downsample_and_split(spark):
    d = spark.createDataFrame([(1, 0.1, 0.1, 0.1, 2.0), (2, 0.3, 0.3, 0.3, 4.0), (3, 1.1, 0.0, 0.0, 6.0)], "id int, x double, y double, z double, i double")
    got = {(r.vx, r.n_points, round(r.i, 6)) for r in voxels.downsample(d, 1.0, ["x", "i"]).collect()}
    assert got == {(0, 2, 3.0), (1, 1, 6.0)}
    known = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, -1.0)], "vx bigint, vy bigint, vz bigint, log_odds double")
    assert {r.id for r in voxels.split_static(d, known, 1.0).collect()} == {1, 2}
    assert {r.id for r in voxels.split_static(d, known, 1.0, static=False).collect()} == {3}


def test_nearest_of_few_targets_forms_no_pair_rows(spark, monkeypatch):
    rng = random.Random(12)
    a = [(k, i, float(rng.randrange(40)), float(rng.randrange(40))) for k in range(12) for i in range(60)]
    b = [(k, j, float(rng.randrange(40)), float(rng.randrange(40))) for k in range(12) for j in range(5 * k)]  # key 0 has none
    source = spark.createDataFrame(a, "k bigint, i bigint, x double, y double")
    target = spark.createDataFrame(b, "k bigint, t bigint, x double, y double")
    plans, cut = [], spatial.cut_lineage
    monkeypatch.setattr(spatial, "cut_lineage", lambda d: (plans.append(d._jdf.queryExecution().optimizedPlan().toString()), cut(d))[1])
    got = {(r.k, r.i): (r.t, r.dist) for r in spatial.nearest(source, target, ["k"], ["x", "y"], 8.0, "t").collect()}
    assert any("_d2" in p for p in plans) and not any("min(struct(_d2" in p for p in plans)
    want = {}
    for k, i, x, y in a:
        near = [((x - u) ** 2 + (y - v) ** 2, t) for q, t, u, v in b if q == k]
        if near:
            want[(k, i)] = (min(near)[1], math.sqrt(min(near)[0]))
    assert got == want


def test_nearest_has_no_limit(spark):
    rng = random.Random(8)
    a = [(i % 3, i, rng.uniform(-1, 1) * 10 ** rng.randrange(0, 9), rng.uniform(-50, 50)) for i in range(120)]
    b = [(i % 2, i, rng.uniform(-1, 1) * 10 ** rng.randrange(0, 9), rng.uniform(-50, 50)) for i in range(60)]
    s = spark.createDataFrame([*a, (0, 999, float("nan"), 1.0)], "k int, id bigint, u double, v double")
    t = spark.createDataFrame(b, "k int, tid bigint, u double, v double")
    got = {r.id: (r.tid, r.dist) for r in spatial.nearest(s, t, ["k"], ["u", "v"], 100.0, "tid").collect()}
    want = {}
    for k, i, u, v in a:
        if k < 2:
            d, tid = min(((u - x) ** 2 + (v - y) ** 2, j) for q, j, x, y in b if q == k)
            want[i] = (tid, pytest.approx(d**0.5))
    assert got == want


def test_overlaps_of_named_runs(spark):
    from wayline.operators import trace

    cols = "run string, x_min double, x_max double, y_min double, y_max double, dir_x double, dir_y double"
    rows = [("north", 0.0, 10.0, 0.0, 10.0, 1.0, 0.0), ("bay", 1.0, 11.0, 0.0, 10.0, 1.0, 0.1), ("coast", 1.0, 11.0, 0.0, 10.0, 1.0, 0.0), ("far", 900.0, 910.0, 0.0, 9.0, 1.0, 0.0)]
    d = spark.createDataFrame(rows, cols)
    got = {(r.run1, r.run2) for r in trace.best_overlaps(d, "run", ["x", "y"]).collect()}
    assert got == {("bay", "coast"), ("bay", "north")}  # of equal shares the first name
    labels = spark.createDataFrame([("coast", "101"), ("bay", "280")], "run string, road string")
    assert {r.run: r.road for r in trace.propagate_labels(d, labels, "run", ["x", "y"], "road").collect()} == {"north": "280", "far": "none"}


@pytest.mark.parametrize("few", [0, 6, 64])
def test_nearest_within_few_targets_a_key(spark, few):
    """Keys with few targets are compared without cells, with the same result and the place of the target."""
    rng = random.Random(5)
    sizes = {0: 3, 1: 6, 2: 40, 3: 0}
    a = [(k, i, *[rng.randrange(0, 40) / 4 for _ in XYZ]) for i, k in enumerate([0, 1, 2, 3, None] * 30)]
    b = [(k, 1000 * k + i, *[rng.randrange(0, 40) / 4 for _ in XYZ]) for k, n in sizes.items() for i in range(n)] + [(None, 1, 1.0, 1.0, 1.0), (0, 2, None, 1.0, 1.0)]
    src = spark.createDataFrame(a, "k int, id int, x double, y double, z double")
    tgt = spark.createDataFrame(b, "k int, t int, x double, y double, z double")
    got = {r.id: (r.t, r._e_x, r._e_y, r._e_z) for r in spatial.nearest_within(src, tgt, ["k"], XYZ, 3.0, "t", few=few, place="_e_").collect()}
    want = {}
    for k, i, *p in a:
        near = [(sum((u - v) ** 2 for u, v in zip(p, c)), t, *c) for n, t, *c in b if k is not None and n == k and None not in c]
        if near and min(near)[0] < 9.0:
            want[i] = min(near)[1:]
    assert got == want and len(got) > 20
    if few == 64:
        few_only = spatial.nearest_within(src, tgt, ["k"], XYZ, 3.0, "t", few=few)
        # the cells' search is left for keys without a list, so their rows alone are copied to cells
        assert "array_min" in few_only._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("min_points", [1, 4])
def test_small_keys_cluster_as_large_ones(spark, min_points):
    """Keys of few points are compared whole, the others by cells, with the same clusters; other columns stay as they are."""
    rng = random.Random(8)
    rows = []
    for key, n in enumerate([1, 2, 3, 30, 30, 60, 200]):
        for _ in range(n):
            rows.append((key, 1000 - len(rows) * 2 + (len(rows) % 7), rng.randrange(12) * 1.0, rng.uniform(0, 60), rng.randrange(3) * 0.7, None if len(rows) % 3 else len(rows)))
    rows.append((3, 5000, float("nan"), 1.0, 1.0, 1))
    df = spark.createDataFrame(rows, "key bigint, id bigint, x double, y double, z double, note int")
    found = [clustering.density_clusters(df, ["key"], ["x", "y", "z"], "id", 2.5, min_points, few=few) for few in (0, 100, 256)]
    want, *got = [sorted(tuple(r) for r in f.select("key", "id", "note", "cluster").collect()) if False else sorted(map(repr, f.select("key", "id", "note", "cluster").collect())) for f in found]
    assert want and got == [want, want]
    assert "Generate" not in found[2]._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("same_way", [False, True])
def test_best_overlaps_of_alike_runs_form_few_pairs(spark, same_way, monkeypatch):
    """Runs whose boxes are all alike, some equal, some without extent: every best pair, and few others."""
    from wayline.operators import trace

    monkeypatch.setattr(trace, "GROUP", 8)
    rng = random.Random(6)
    rows = []
    for i in range(500):
        lo, hi = [rng.expovariate(0.7) for _ in XYZ], [100 - rng.expovariate(0.7) for _ in XYZ]
        if i % 90 == 0:
            hi = lo
        if i % 50 == 1:
            lo, hi = [5000 + v for v in lo], [5000 + v for v in hi]
        if 300 <= i < 400:
            lo, hi = [1.0] * 3, [95.0] * 3
        way = [None] * 3 if i % 90 == 0 else [rng.uniform(-1, 1) for _ in XYZ]
        rows.append((f"r{i}", *[v for pair in zip(lo, hi) for v in pair], *way))
    rows.append(("nan", *[float("nan")] * 6, 1.0, 0.0, 0.0))
    names = ["run", *[c + e for c in XYZ for e in ("_min", "_max")], *[f"dir_{c}" for c in XYZ]]
    df = spark.createDataFrame(rows, "run string, " + ", ".join(f"{n} double" for n in names[1:]))
    likely = trace.likely_best(df, df, "run", XYZ, 0.25, same_way)

    def best(pairs):
        found = pairs.groupBy("a_run").agg(F.min_by(F.struct("b_run", "share"), F.struct(-F.col("share"), "b_run")).alias("m"))
        return {r.a_run: tuple(r.m) for r in found.collect()}

    a, b = (df.where("run <> 'nan'").select(*[F.col(c).alias(p + c) for c in names]) for p in ("a_", "b_"))
    every = a.join(b, F.col("a_run") != F.col("b_run")).withColumn("share", trace.overlap_share(XYZ, "a_", "b_"))
    every = every.where(trace.same_direction(XYZ) & (F.col("share") > 0.25) if same_way else F.col("share") >= 0.25)
    want = best(every)
    assert best(likely) == want and len(want) > 450
    assert likely.count() < every.count() / 10


def test_best_overlaps_are_written_once(spark):
    """What is joined to the pairs several times does not compare the runs anew each time."""
    from wayline.operators import trace

    rows = [(f"r{i}", i * 0.1, 10.0 + i, 0.0, 10.0, 0.0, 5.0, 1.0, 0.0, 0.0) for i in range(6)]
    names = [*[c + e for c in XYZ for e in ("_min", "_max")], *[f"dir_{c}" for c in XYZ]]
    d = spark.createDataFrame(rows, "run string, " + ", ".join(f"{n} double" for n in names))
    pairs = trace.best_overlaps(d, "run", XYZ)
    assert pairs.count() == 5
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
