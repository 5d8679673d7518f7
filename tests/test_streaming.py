"""Streams against their batch operators, over several triggers."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_ordered import brute_objects, can_rows
from wayline.operators import matching
from wayline.streaming import live, ordered

START = 1_700_000_000


def as_stream(spark, rows, schema, folder, parts=4):
    """Write the rows, in order, as several files and read one file a trigger."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        d = spark.createDataFrame(rows[i * size : (i + 1) * size], schema)
        d.coalesce(1).write.mode("append").parquet(str(folder))
    full = spark.read.parquet(str(folder)).schema
    return spark.readStream.schema(full).option("maxFilesPerTrigger", 1).parquet(str(folder))


def sweeps_of(spark, rows, folder, parts):
    s = as_stream(spark, rows, "run string, sec double, id bigint, what string", folder, parts)
    s = s.withColumn("ts", F.timestamp_micros((F.col("sec") * 1_000_000).cast("bigint")))
    out = live.run_available(live.sweep_stream(s, "run", F.col("what") == "start", F.col("what") == "object", "id"), "append", spark)
    return sorted((r.run, r.sweep_us, r.n_objects, r.sum_ids, r.closed_us) for r in out.collect())


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_sweeps_do_not_depend_on_triggers(spark, tmp_path, parts):
    rng = random.Random(1)
    rows, sec = [], float(START)
    for i in range(300):
        sec += rng.choice([0.1, 0.25, 0.5]) if rng.random() < 0.93 else rng.choice([1.0, 1.5, 30.0])  # some gaps of over a second
        rows.append((f"r{i % 2}", sec, i, "start" if i % 17 < 2 else rng.choice(["object", "object", "drop"])))
    rows.append(("end", START + 100000.0, 9999, "object"))  # moves the watermark past everything else
    want = []
    for run in ("r0", "r1"):
        open_, last = None, None
        for _, sec, i, what in (r for r in rows if r[0] == run):
            t = int(sec * 1_000_000)
            if open_ and t - last > 1_000_000:
                want.append((run, *open_, last))
                open_ = None
            if what == "start":
                if open_:
                    want.append((run, *open_, t))
                open_ = [t - 66_000, 0, 0]
            elif what == "object" and open_:
                open_[1] += 1
                open_[2] += i
            last = t
        if open_:
            want.append((run, *open_, last))
    assert sweeps_of(spark, rows, tmp_path, parts) == sorted(want)


def test_tracks_equal_the_batch_operator(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for f in range(60):
        for _ in range(rng.randrange(0, 5) if not 25 <= f < 30 else 0):
            x, y = rng.uniform(0, 300), rng.uniform(0, 300)
            rows.append((f % 1, f, len(rows), x, y, x + rng.uniform(20, 50), y + rng.uniform(20, 50)))
    end = [(9, 100000, 10**6, 0.0, 0.0, 1.0, 1.0)]
    schema = "seq int, frame bigint, id bigint, x1 double, y1 double, x2 double, y2 double"
    s = as_stream(spark, rows + end, schema, tmp_path).withColumn("ts", F.timestamp_seconds(F.lit(START) + F.col("frame") * 5))
    got = {r.id: r.track_id for r in live.run_available(live.track_stream(s, "seq", "frame", "id", idle=4), "append", spark).where("seq = 0").collect()}
    batch = matching.assign_track_ids(spark.createDataFrame(rows, schema), ["seq"], "frame", "id", idle=4)
    assert got == {r.id: r.track_id for r in batch.collect()}


def test_late_rows_are_dropped_and_windows_close(spark, tmp_path):
    rows = [(START + t, "cam") for t in (0, 1, 2, 60, 61, 1, 120, 180)]  # the second 1 comes after the watermark
    s = as_stream(spark, rows, "sec bigint, source string", tmp_path, parts=8).withColumn("ts", F.timestamp_seconds("sec"))
    out = live.run_available(live.capture_health(s, "source", "10 seconds"), "append", spark)
    got = {(int(r.window_start.timestamp()) - START, r.n_messages) for r in out.collect()}
    assert got == {(0, 3), (60, 2), (120, 1)}


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_can_objects_do_not_depend_on_triggers(spark, tmp_path, parts):
    rows = sorted(can_rows(5, 1500, step=400_000), key=lambda r: (r[1], r[2]))
    end = max(r[1] for r in rows)
    rows = [(run, START * 1_000_000 + t, i, ident, data) for run, t, i, ident, data in rows]
    last = [("z", START * 1_000_000 + end + 10**9, 0, 0x100, bytes(8))]  # moves the watermark past everything else
    s = as_stream(spark, rows + last, "run string, t bigint, ord bigint, can_id int, data binary", tmp_path, parts).withColumn("ts", F.timestamp_micros("t"))
    out = live.run_available(ordered.object_stream(s, "run", "ord", idle_ms=300), "append", spark, state_store=live.ROCKSDB)
    got = sorted((r.run, r.header_time, r.unit, r.obj_id, r.age) for r in out.collect())
    want = []
    for run in "ab":
        stretch, before = [], None
        for r in [*(r[1:] for r in rows if r[0] == run), None]:
            if r is None or (before is not None and r[0] - before > 300_000):
                want += [(run, t, k, a[0], b[2]) for t, k, a, b, _ in brute_objects(stretch)]
                stretch = []
            if r is not None:
                stretch.append(r)
                before = r[0]
    assert got == sorted(want) and len(want) > 10


class KeyState:
    """A key's state in a list, its calls counted."""

    def __init__(self):
        self.value, self.mark, self.wake, self.calls, self.hasTimedOut = None, 0, None, 0, False

    exists = property(lambda self: self.value is not None)

    @property
    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.value, self.calls = value, self.calls + 1

    def remove(self):
        self.value, self.calls = None, self.calls + 1

    def setTimeoutTimestamp(self, at):
        assert at >= max(self.mark, 1)
        self.wake = at

    def getCurrentWatermarkMs(self):
        return self.mark


def test_a_call_reads_and_writes_the_state_of_a_key_once():
    rows = sorted((t, i, ident, data) for _, t, i, ident, data in can_rows(9, 1500, step=1000, runs=("a",)))
    machine = ordered._Objects("run string", 300_000)
    state, got = KeyState(), []
    for at in [*range(0, 1500, 40), None]:  # the last call is a timeout
        state.calls = 0
        batch = [pd.DataFrame(rows[at : at + 40], columns=["t", "ord", "can_id", "data"])] if at is not None else []
        state.hasTimedOut, state.mark = at is None, (max(rows[at][0] // 1000 - 1, 0) if at is not None else rows[-1][0] // 1000 + 301)
        if at is None:
            assert state.wake < state.mark
        for out in machine.take(("a",), iter(batch), state):
            got += list(zip(out["header_time"], out["unit"], out["a"], out["b"], out["c"]))
        assert state.calls <= 2
    want, stretch = [], []
    for r in [*rows, None]:
        if stretch and (r is None or r[0] - stretch[-1][0] > 300_000):
            want, stretch = want + brute_objects(stretch), []
        stretch.append(r)
    assert sorted(got) == sorted(want) and len(want) > 5 and not state.exists


@pytest.mark.parametrize("parts", [1, 4])
def test_counts_since_a_trigger(spark, tmp_path, parts):
    rng = random.Random(6)
    rows, sec = [], float(START)
    for i in range(200):
        sec += rng.choice([0.1, 0.3, 0.0, 2.5])
        rows.append((f"r{i % 2}", sec, i, rng.choice(["cam", "cam", "gps", "control"])))
    rows.append(("end", START + 100000.0, 9999, "cam"))
    s = as_stream(spark, rows, "run string, sec double, id bigint, source string", tmp_path, parts)
    s = s.withColumn("ts", F.timestamp_micros((F.col("sec") * 1_000_000).cast("bigint")))
    out = live.run_available(ordered.counts_since_trigger(s, "run", "source", "id", F.col("source") == "control"), "append", spark, state_store=live.ROCKSDB)
    want = {}
    for run in ("r0", "r1"):
        counts = {}
        mine = sorted((int(sec * 1_000_000), i, source) for r, sec, i, source in rows if r == run)
        for k, (t, _, source) in enumerate(mine):
            period = t // 1_000_000 * 1_000_000
            counts = {} if source == "control" else {**counts, source: counts.get(source, 0) + 1}
            if k + 1 == len(mine) or mine[k + 1][0] // 1_000_000 * 1_000_000 != period:
                active = {x for u, _, x in mine if u // 1_000_000 * 1_000_000 == period and x != "control"}
                want |= {(run, period, x): counts.get(x, 0) for x in active}
    assert {(r.run, r.period_us, r.source): r.n_since_trigger for r in out.where("run <> 'end'").collect()} == want


def test_tracks_of_a_crowded_frame():
    """Thousands of boxes a frame are linked in seconds, as by comparing all pairs."""
    rng = np.random.default_rng(4)
    frames = []
    for f in range(3):
        rows = np.zeros(4000, live.TRACK_ROW)
        rows["frame"], rows["id"] = f, rng.permutation(4000)
        rows["cx"], rows["cy"] = rng.integers(0, 97, 4000) * 10.0, rng.integers(0, 89, 4000) * 10.0
        rows["w"], rows["h"] = 30.0, 20.0
        frames.append(rows)
    used, began = live.continue_tracks(frames[0], frames[0][:0], np.zeros(0, np.int64), 5), time.time()
    assert list(frames[0]["track"]) == list(range(4000))
    for before, new in zip(frames, frames[1:]):
        used = live.continue_tracks(new, before, used, 5)
    assert time.time() - began < 15
    new, old = frames[2], frames[1]
    d2 = (new["cx"][:, None] - old["cx"]) ** 2 + (new["cy"][:, None] - old["cy"]) ** 2
    order = np.argsort(old["id"])
    to = order[d2[:, order].argmin(axis=1)]
    kept = {}
    for n in np.lexsort((-new["id"], d2[np.arange(4000), to])):
        kept.setdefault(int(to[n]), n)
    assert all(new["track"][n] == old["track"][t] for t, n in kept.items())
    assert len(set(new["track"].tolist())) == 4000 and len(used) == len(set(frames[1]["track"].tolist()) | set(new["track"].tolist()) | set(range(4000)))


class _Store:
    """What a state machine asks of its handle, kept in dictionaries."""

    def __init__(self):
        self.one, self.many, self.timers, self.largest = {}, {}, [], 0

    def getValueState(self, name, schema):  # noqa: N802
        store = self

        class Value:
            exists = staticmethod(lambda: name in store.one)
            get = staticmethod(lambda: store.one[name])
            update = staticmethod(lambda value: store.one.__setitem__(name, value))

        return Value

    def getMapState(self, name, key, value):  # noqa: N802
        store = self

        def put(key, value):
            store.many[key] = value
            store.largest = max(store.largest, len(value[0]))

        class Map:
            getValue = staticmethod(lambda key: store.many[key])  # noqa: N815
            updateValue = staticmethod(put)  # noqa: N815
            removeKey = staticmethod(lambda key: store.many.pop(key))  # noqa: N815

        return Map

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


@pytest.mark.parametrize("marks", [[0, 10**9], [0, 20_500, 10**9], [10**9]])
def test_waiting_boxes_are_kept_frame_by_frame(monkeypatch, marks):
    """However many rows a trigger brings, no value of the state and no result holds more than a frame and the rows of a call."""
    monkeypatch.setattr(live, "HELD", 300)
    rng = np.random.default_rng(3)
    frames = np.sort(rng.integers(0, 40, 6000))
    rows = np.zeros(6000, live.TRACK_ROW)
    rows["frame"], rows["ms"], rows["id"] = frames, frames * 1000 + rng.integers(0, 1000, 6000), rng.permutation(6000)
    for c in live.PLACE:
        rows[c] = rng.integers(0, 500, 6000)
    want, done, used = {}, rows[:0], np.zeros(0, np.int64)
    for f in range(40):
        new = rows[rows["frame"] == f]
        new = new[np.lexsort((new["id"], new["ms"]))]
        used = live.continue_tracks(new, done, used.copy(), 3)
        want |= dict(zip(new["id"].tolist(), new["track"].tolist()))
        done = new
    table = pd.DataFrame({c: rows[c] for c in ("frame", "ms", "id", *live.PLACE)}).sample(frac=1, random_state=1)
    store, machine, got = _Store(), live._Tracks("seq", "frame", "id", 3), []
    machine.init(store)
    for n, mark in enumerate(marks):
        times = type("Times", (), {"getCurrentWatermarkInMs": staticmethod(lambda mark=mark: mark)})
        batches = (table.iloc[at : at + 100] for at in range(0, 6000, 100))
        got += list(machine.handleInputRows((7,), batches, times) if n == 0 else machine.handleExpiredTimer((7,), times, None))
        waiting = len(np.frombuffer(store.one["kept"][2], live.WAITING))
        assert waiting == (40 if mark == 0 else 20 if mark < 10**9 else 0) and bool(store.many) == bool(waiting)
        assert not waiting or store.timers[-1] > mark
    assert store.largest <= 400 * live.TRACK_ROW.itemsize
    assert max(map(len, got)) <= 300 + max(np.bincount(frames)) and all(set(g["seq"]) == {7} for g in got)
    assert {i: t for g in got for i, t in zip(g["id"], g["track_id"])} == want
