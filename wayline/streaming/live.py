"""Live versions of the log operators on Structured Streaming.

Late data: rows more than the watermark delay behind the newest event are
dropped. All functions take streaming (or static) DataFrames with a ``ts``
timestamp column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from wayline.operators import spatial
from wayline.session import ensure_checkpoint_dir

DELAY = "10 seconds"


def stream_table(spark: SparkSession, folder: str, pattern: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number of files a trigger."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: MB a store gathers before it writes; the default of 64, a few times over in each store that is open, is much of an executor
STORE_BUFFER = "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB", "16"


def run_available(stream: DataFrame, mode: str, spark: SparkSession, latest_only: bool = False, state_store: str | None = None) -> DataFrame:
    """Run a stream over all data there is and return what it wrote.

    Batches go to a folder of their own each, so a repeated batch replaces
    itself. ``latest_only`` returns the last batch (complete mode).
    ``state_store`` names the provider of this stream's state; state machines
    with timers and named state need :data:`ROCKSDB` and get it by default, which
    also keeps state out of the heap.
    """
    if state_store is None and "TransformWithState" in stream._jdf.queryExecution().analyzed().toString():
        state_store = ROCKSDB
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    settings = {STATE_STORE: state_store} if state_store else {}
    if state_store == ROCKSDB:
        settings[STORE_BUFFER[0]] = spark.conf.get(*STORE_BUFFER)
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{root}/state")
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            if value is not None:
                spark.conf.set(name, value)
            else:
                spark.conf.unset(name)
    if query.exception() is not None:
        raise query.exception()
    out = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{root}/out")
    if latest_only:
        last = out.agg(F.max("batch").alias("_last"))
        out = out.join(F.broadcast(last)).where("batch = _last").drop("_last")  # one row
    return out.drop("batch")


def capture_health(messages: DataFrame, source: str, every: str = "1 second", delay: str = DELAY) -> DataFrame:
    """Messages per source and tumbling window."""
    return (
        messages.withWatermark("ts", delay)
        .groupBy(F.window("ts", every).alias("_w"), source)
        .agg(F.count("*").alias("n_messages"))
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), source, "n_messages")
    )


def latest_state(messages: DataFrame, source: str, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last value of the fields per source, by time; complete or update mode."""
    d = messages.groupBy(source).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_l"), F.count("*").alias("n_seen"))
    return d.select(source, "n_seen", *[F.col("_l")[f].alias(f) for f in fields])


def processing_delay(messages: DataFrame, camera: str, start: str, end: str, every: str = "1 minute", delay: str = DELAY) -> DataFrame:
    """Processing time (end - start) and total delay (end - camera stamp) per window, in microseconds."""
    d = messages.withColumns({"_p": F.col(end) - F.col(start), "_d": F.col(end) - F.col(camera)})
    return (
        d.withWatermark("ts", delay)
        .groupBy(F.window("ts", every).alias("_w"))
        .agg(
            F.count("*").alias("n"), F.avg("_p").alias("mean_processing"), F.max("_p").alias("max_processing"), F.avg("_d").alias("mean_delay"),
            F.percentile_approx("_d", 0.95).alias("p95_delay"),
        )
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "n", "mean_processing", "max_processing", "mean_delay", "p95_delay")
    )


def sensor_join(frames: DataFrame, sensors: DataFrame, key: str, tolerance: str, delay: str = DELAY) -> DataFrame:
    """Sensor messages up to ``tolerance`` before each frame; both sides streams.

    ``frames`` holds frame, ts; ``sensors`` sensor, sensor_ts. State is bounded
    by the watermarks and the time bound.
    """
    f = frames.withWatermark("ts", delay).alias("f")
    s = sensors.withWatermark("sensor_ts", delay).alias("s")
    near = (
        (F.col(f"f.{key}") == F.col(f"s.{key}"))
        & (F.col("s.sensor_ts") <= F.col("f.ts"))
        & (F.col("s.sensor_ts") >= F.col("f.ts") - F.expr(f"INTERVAL {tolerance}"))
    )
    return f.join(s, near).select(F.col(f"f.{key}").alias(key), "frame", "sensor", "ts", "sensor_ts")


SWEEP_STATE = "open_us bigint, n bigint, total bigint, last_us bigint, waiting array<struct<t: bigint, id: bigint, start: boolean, keep: boolean>>"


def _close(open_us, n, total, end):
    return {"sweep_us": open_us, "n_objects": n, "sum_ids": total, "closed_us": end}


def sweep_stream(messages: DataFrame, key: str, is_start: Column, keep: Column, ident: str, delay: str = DELAY, idle_ms: int = 1000, lead_us: int = 66_000) -> DataFrame:
    """Sweep summaries from an arriving stream: a start closes the open sweep, as does silence.

    Messages wait in state until the watermark passes them, so they are taken
    in order of time; the waiting list is bounded by the delay. A gap of more
    than ``idle_ms`` closes the sweep at the last message before it, whether the
    next one came in the same trigger or not, so the result does not depend on
    how the input falls into triggers. Output: sweep time, kept objects, sum of
    their ids, closing time.
    """
    d = messages.withWatermark("ts", delay).select(
        key, "ts", F.unix_micros("ts").alias("t"), F.col(ident).cast("bigint").alias("id"), is_start.alias("start"), keep.alias("keep")
    )
    key_type = dict(messages.dtypes)[key]

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_us, n, total, last_us, waiting = state.get if state.exists else (None, 0, 0, None, [])
        rows = [tuple(w) for w in waiting]
        out = []
        if not state.hasTimedOut:
            for pdf in batches:
                rows.extend(zip(pdf["t"], pdf["id"], pdf["start"], pdf["keep"]))
        mark_ms = state.getCurrentWatermarkMs()
        rows.sort(key=lambda r: (r[0], r[1]))
        later = []
        for t, i, start, kept in rows:
            if t > mark_ms * 1000:
                later.append((int(t), int(i), bool(start), bool(kept)))
                continue
            if open_us is not None and t - last_us > idle_ms * 1000:
                out.append(_close(open_us, n, total, last_us))
                open_us, n, total = None, 0, 0
            if start:
                if open_us is not None:
                    out.append(_close(open_us, n, total, int(t)))
                open_us, n, total = int(t) - lead_us, 0, 0
            elif kept and open_us is not None:
                n, total = n + 1, total + int(i)
            last_us = int(t)
        # rows still waiting are later than the watermark, so the silence up to there is certain
        silent = last_us is not None and mark_ms * 1000 - last_us > idle_ms * 1000
        if silent and open_us is not None:
            out.append(_close(open_us, n, total, last_us))
            open_us, n, total = None, 0, 0
        if silent and not later:
            state.remove()
        else:
            state.update((open_us, n, total, last_us, later))
            wake = [later[0][0] // 1000 + 1] if later else []
            if last_us is not None and not silent:
                wake.append(last_us // 1000 + idle_ms + 2)
            state.setTimeoutTimestamp(max(min(wake), mark_ms + 1))
        if out:
            yield pd.DataFrame(out).assign(**{key: k[0]})[[key, "sweep_us", "n_objects", "sum_ids", "closed_us"]]

    schema = f"{key} {key_type}, sweep_us bigint, n_objects bigint, sum_ids bigint, closed_us bigint"
    return d.groupBy(key).applyInPandasWithState(step, schema, SWEEP_STATE, "append", GroupStateTimeout.EventTimeTimeout)


#: rows of boxes as they are kept: whole numbers stay exact
TRACK_ROW = np.dtype([("frame", "i8"), ("ms", "i8"), ("id", "i8"), ("cx", "f8"), ("cy", "f8"), ("w", "f8"), ("h", "f8"), ("track", "i8")])
PLACE = ["cx", "cy", "w", "h"]
#: what is known of a frame that waits: first and last time of its boxes, and in how many parts they are kept
WAITING = np.dtype([("frame", "i8"), ("first", "i8"), ("last", "i8"), ("parts", "i8")])
#: rows that a call holds before it puts them away, or hands them on
HELD = 1 << 18


def continue_tracks(new: np.ndarray, before: np.ndarray, used: np.ndarray, idle: int) -> np.ndarray:
    """Set the track ids of one frame's boxes, given those of the frame before; returns the last use of each id."""
    frame = new["frame"][0]
    linked = np.zeros(len(new), bool)
    if len(before) and before["frame"][0] == frame - 1:
        to, d2 = spatial.nearest_rows(*[np.stack([x[c] for c in PLACE], axis=1) for x in (new, before)], before["id"])
        some = np.flatnonzero(to >= 0)
        some = some[np.lexsort((some, -new["id"][some], d2[some], to[some]))]
        some = some[np.r_[True, np.diff(to[some]) != 0]] if len(some) else some
        new["track"][some], linked[some] = before["track"][to[some]], True
    used[new["track"][linked]] = frame
    fresh = np.flatnonzero(~linked)
    free = np.flatnonzero(frame - used > idle)[: len(fresh)]
    more = len(fresh) - len(free)
    new["track"][fresh] = np.r_[free, len(used) + np.arange(more)]
    used = np.r_[used, np.full(more, frame)]
    used[new["track"][fresh]] = frame
    return used


class _Tracks(StatefulProcessor):
    """Boxes of a sequence wait in the state store, frame by frame, so a call holds one frame and ``HELD`` rows, however many wait."""

    def __init__(self, key: str, frame: str, ident: str, idle: int) -> None:
        self.key, self.frame, self.ident, self.idle = key, frame, ident, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "boxes binary, used binary, waiting binary")
        self.boxes = handle.getMapState("boxes", "frame bigint, part bigint", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        done, used, waiting = self._read()
        parts: list[np.ndarray] = []
        for pdf in rows:
            new = np.zeros(len(pdf), TRACK_ROW)
            for c in ("frame", "ms", "id", *PLACE):
                new[c] = pdf[c].to_numpy()
            parts.append(new)
            if sum(map(len, parts)) >= HELD:
                self._put_away(np.concatenate(parts), waiting)
                parts = []
        if parts:
            self._put_away(np.concatenate(parts), waiting)
        yield from self._settle(key, done, used, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, *self._read(), timerValues.getCurrentWatermarkInMs())

    def _read(self) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, int, int]]]:
        done, used, waiting = self.kept.get() if self.kept.exists() else (b"", b"", b"")
        frames = np.frombuffer(waiting, WAITING).tolist()
        return np.frombuffer(done, TRACK_ROW), np.frombuffer(used, np.int64), {f: tuple(rest) for f, *rest in frames}

    def _put_away(self, rows: np.ndarray, waiting: dict[int, tuple[int, int, int]]) -> None:
        rows = rows[np.argsort(rows["frame"], kind="stable")]
        for own in np.split(rows, np.flatnonzero(np.diff(rows["frame"]) != 0) + 1):
            if len(own):
                frame, first, last = (int(v) for v in (own["frame"][0], own["ms"].min(), own["ms"].max()))
                before = waiting.get(frame, (first, last, 0))
                self.boxes.updateValue((frame, before[2]), (own.tobytes(),))
                waiting[frame] = min(first, before[0]), max(last, before[1]), before[2] + 1

    def _settle(self, key: tuple, done: np.ndarray, used: np.ndarray, waiting: dict[int, tuple[int, int, int]], mark: int) -> Iterator[pd.DataFrame]:
        """Frames in their order, as far as the watermark has passed them."""
        out: list[np.ndarray] = []
        for frame in sorted(waiting):
            if waiting[frame][1] > mark:
                break
            parts = range(waiting.pop(frame)[2])
            new = np.concatenate([np.frombuffer(self.boxes.getValue((frame, part))[0], TRACK_ROW) for part in parts])
            for part in parts:
                self.boxes.removeKey((frame, part))
            new = new[np.lexsort([new[c] for c in ("h", "w", "cy", "cx", "id", "ms")])]
            used = continue_tracks(new, done, used.copy(), self.idle)
            done = new
            out.append(new)
            if sum(map(len, out)) >= HELD:
                yield self._found(key, out)
                out = []
        left = np.array([(frame, *rest) for frame, rest in sorted(waiting.items())], WAITING)
        self.kept.update((done.tobytes(), used.tobytes(), left.tobytes()))
        if len(left):  # called once the watermark is beyond this time
            self.handle.registerTimer(max(int(left["first"][0]) + 1, mark + 1) + 1)
        if out:
            yield self._found(key, out)

    def _found(self, key: tuple, frames: list[np.ndarray]) -> pd.DataFrame:
        rows = np.concatenate(frames)
        return pd.DataFrame({self.key: [key[0]] * len(rows), self.frame: rows["frame"], self.ident: rows["id"], "track_id": rows["track"]})


def track_stream(boxes: DataFrame, key: str, frame: str, ident: str, delay: str = DELAY, idle: int = 50) -> DataFrame:
    """Track ids per sequence on an arriving stream of boxes (x1, y1, x2, y2, ts).

    ``ts`` rises with the frame. A frame is settled when the watermark passes
    it; the state holds the last settled frame, the last use of each id and the
    boxes still waiting, each frame's under its own name. Needs the state store :data:`ROCKSDB`.
    """
    d = boxes.withWatermark("ts", delay).select(
        key, "ts", F.unix_millis("ts").alias("ms"), F.col(frame).cast("bigint").alias("frame"), F.col(ident).cast("bigint").alias("id"),
        ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"),
        F.abs(F.col("x2") - F.col("x1")).alias("w"), F.abs(F.col("y2") - F.col("y1")).alias("h"),
    )
    key_type = dict(boxes.dtypes)[key]

    schema = f"{key} {key_type}, {frame} bigint, {ident} bigint, track_id bigint"
    return d.groupBy(key).transformWithStateInPandas(_Tracks(key, frame, ident, idle), schema, "append", "eventTime")
