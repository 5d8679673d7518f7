"""State machines over arriving rows that are taken in order of time.

Rows wait in the state until the watermark has passed them, so what comes out
does not depend on how the input falls into triggers. A key's state is two packed
values, read and written once a call; a call to the state store for every
variable costs more than the work on a key's few rows.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayline.functions import can
from wayline.streaming.live import DELAY

Row = tuple


class InOrder:
    """Hands the rows of a key to :meth:`step` by their first field, a time in microseconds.

    ``row`` names the fields of a row, the time first; ``out`` is the schema of
    the results, the key column first. The rows that wait are bounded by the
    watermark's delay.
    """

    def __init__(self, row: Sequence[str], out: str) -> None:
        self.row, self.out = list(row), out

    def step(self, rows: list[Row], mark_us: int, own: Any) -> tuple[list[tuple], Any, int | None]:
        """Results of the rows up to the watermark, what the machine keeps (None: nothing), and when to be called again without further rows."""
        raise NotImplementedError

    def take(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, own = (pickle.loads(v) for v in state.get) if state.exists else ([], None)
        if not state.hasTimedOut:
            for pdf in batches:
                waiting.extend(zip(*(pdf[c].tolist() for c in self.row), strict=True))
        mark = state.getCurrentWatermarkMs()
        waiting.sort()
        cut = bisect_right(waiting, mark * 1000, key=lambda r: r[0])
        out, own, again = self.step(waiting[:cut], mark * 1000, own)
        later = waiting[cut:]
        if not later and own is None:
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps(later), pickle.dumps(own)))
            wake = [t for t in (later[0][0] if later else None, again) if t is not None]
            if wake:  # called once the watermark is beyond this time, and so has reached the row's
                state.setTimeoutTimestamp(max(-(-min(wake) // 1000) - 1, mark, 1))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=[part.split()[0] for part in self.out.split(", ")])

    def over(self, rows: DataFrame, key: str) -> DataFrame:
        """Results of arriving rows, each key on its own."""

        def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            return self.take(k, batches, state)

        return rows.groupBy(key).applyInPandasWithState(run, self.out, "waiting binary, own binary", "append", GroupStateTimeout.EventTimeTimeout)


class _Objects(InOrder):
    """Members of the open group wait in a list until the next header or silence ends it."""

    def __init__(self, key: str, idle_us: int) -> None:
        super().__init__(["t", "ord", "can_id", "data"], f"{key}, header_time bigint, unit bigint, a binary, b binary, c binary")
        self.idle_us = idle_us

    def step(self, rows: list[Row], mark_us: int, own: Any) -> tuple[list[tuple], Any, int | None]:
        header, announced, last, members = own or (None, 0, None, [])
        out: list[tuple] = []

        def finish() -> None:
            nonlocal header
            if header is not None and len(members) % 3 == 0:
                out.extend((header, i // 3, *members[i : i + 3]) for i in range(0, len(members), 3))
            members.clear()
            header = None

        for t, _, ident, data in rows:
            if last is not None and t - last > self.idle_us:
                finish()
            if ident == can.OBJECT_HEADER_ID:
                finish()
                header, announced = t, data[0]
            elif header is not None and can.OBJECT_FIRST_ID <= ident < can.OBJECT_FIRST_ID + 3 * announced:
                members.append(data)
            last = t
        silent = last is not None and mark_us - last > self.idle_us
        if silent:
            finish()
        if header is None:
            return out, None, None
        return out, (header, announced, last, members), last + self.idle_us + 1000


def object_stream(frames: DataFrame, key: str, order: str, delay: str = DELAY, idle_ms: int = 1000) -> DataFrame:
    """Objects of the vision sensor from arriving CAN frames (``ts``, ``order``, ``can_id``, ``data``).

    As in the batch operator a header announces how many objects follow, three
    frames make one, and groups whose frames are no multiple of three drop out as
    a whole. A group ends with the next header or after ``idle_ms`` without any
    frame of its key, whatever the triggers; groups still open stay in the state.
    """
    key_type = dict(frames.dtypes)[key]
    rows = frames.withWatermark("ts", delay).select(
        key, "ts", F.unix_micros("ts").alias("t"), F.col(order).cast("bigint").alias("ord"), F.col("can_id").cast("int").alias("can_id"), "data"
    )
    units = _Objects(f"{key} {key_type}", idle_ms * 1000).over(rows, key)
    fields = can.decode_object(F.col("a"), F.col("b"), F.col("c"))
    return units.select(key, "header_time", "unit", *[c.alias(n) for n, c in fields.items()])


class _Counts(InOrder):
    """Messages of each source since the last trigger, reported per period."""

    def __init__(self, key: str, period_us: int) -> None:
        super().__init__(["t", "ord", "source", "trigger"], f"{key}, period_us bigint, source string, n_since_trigger bigint")
        self.period_us = period_us

    def step(self, rows: list[Row], mark_us: int, own: Any) -> tuple[list[tuple], Any, int | None]:
        counts, active = own or ({}, {})
        out: list[tuple] = []

        def report(until: int) -> None:
            for source, start in sorted(active.items()):
                if start + self.period_us <= until:
                    out.append((start, source, counts.get(source, 0)))
                    del active[source]

        for t, _, source, trigger in rows:
            start = t // self.period_us * self.period_us
            report(start)
            if trigger:
                counts.clear()
            else:
                counts[source] = counts.get(source, 0) + 1
                active[source] = start
        report(mark_us)
        kept = (counts, active) if counts or active else None
        return out, kept, min(active.values()) + self.period_us if active else None


def counts_since_trigger(
    messages: DataFrame, key: str, source: str, order: str, is_trigger: Column, every_ms: int = 1000, delay: str = DELAY
) -> DataFrame:
    """Messages per source since the last trigger of the same key, one row per period in which the source sent any.

    A trigger is a message like the others, on any source, and resets the counts
    of all sources of its key. ``n_since_trigger`` holds at the end of the period
    that starts at ``period_us``. Messages of one time go by ``order``.
    """
    key_type = dict(messages.dtypes)[key]
    rows = messages.withWatermark("ts", delay).select(
        key, "ts", F.unix_micros("ts").alias("t"), F.col(order).cast("bigint").alias("ord"), F.col(source).cast("string").alias("source"),
        F.coalesce(is_trigger, F.lit(False)).alias("trigger"),
    )
    return _Counts(f"{key} {key_type}", every_ms * 1000).over(rows, key)
