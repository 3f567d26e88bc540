"""Identities as a stream: frames that come late are held and taken in order.

A frame waits in state until the watermark has passed its time; then no earlier one can
come any more, and it is tracked. One timer for each observation, at its earliest frame
held, wakes it. An observation ends when no frame came for ``idle`` beyond its last one:
frames that still wait for first marks are settled then, and its state goes. Over the
same frames the result is that of ``operators.tracking.track``, whatever the batches.

State lives in the RocksDB store (``stream_settings``), not in the workers' memory: of an
observation the frames within the watermark's delay, and at most ``scan`` frames that
wait for first marks. Frames later than the watermark allows are dropped by Spark.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracking import DETECTED, Tracker, detected

_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OUT = ["frame_idx", "animal", "x", "y", "mark_x", "mark_y"]


@contextlib.contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """State with timers needs the RocksDB store: queries started inside have it."""
    before = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)
    try:
        yield
    finally:
        spark.conf.set(_STORE[0], before) if before else spark.conf.unset(_STORE[0])


class Identities(StatefulProcessor):
    def __init__(self, key: str, width: float, height: float, longest: float, scan: int, idle_ms: int):
        self.key, self.options, self.idle_ms = key, (width, height, longest, scan), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, frame long, row string")
        self.tracked = handle.getValueState("tracked", "marks string, waiting string, last_at long")

    def _load(self) -> tuple[Tracker, int]:
        tracker = Tracker(*self.options)
        if not self.tracked.exists():
            return tracker, -1
        marks, waiting, last_at = self.tracked.get()
        if marks:
            tracker.marks = {a: tuple(p) for a, p in json.loads(marks).items()}
        tracker.waiting = [tuple(w) for w in json.loads(waiting)]
        return tracker, last_at

    def _save(self, tracker: Tracker, last_at: int) -> None:
        self.tracked.update((json.dumps(tracker.marks) if tracker.marks else "", json.dumps(tracker.waiting), last_at))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, kind = [], dict(DETECTED)
        for pdf in rows:
            for at, frame, *row in zip(pdf["at_ms"].tolist(), pdf["frame_idx"].tolist(), *(pdf[c].tolist() for c in DETECTED)):
                new.append((int(at), int(frame), json.dumps([_plain(v, t) for v, t in zip(row, kind.values())])))
        if new:
            before = min((x[0] for x in self.held.get()), default=None)
            # one call to the store, however many frames
            self.held.appendList(new)
            first = min(x[0] for x in new)
            if before is None or first < before:
                self._wake_at(first)
        yield from ()

    def _wake_at(self, at: int) -> None:
        """One timer only."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        tracker, last_at = self._load()
        frames = sorted(tuple(x) for x in self.held.get())
        due, left, out = [x for x in frames if x[0] <= now], [x for x in frames if x[0] > now], []
        for at, frame, row in due:
            out += tracker.frame(frame, *json.loads(row))
            last_at = max(last_at, at)
        if left:
            self.held.put(left)
            self._wake_at(left[0][0])
        elif due:
            self.held.clear()
        ended = not left and last_at + self.idle_ms <= now
        if ended:
            out += tracker.finish()
            self.tracked.clear()
        else:
            self._save(tracker, last_at)
            if not left:
                self._wake_at(last_at + self.idle_ms)
        made = pd.DataFrame(out, columns=_OUT)
        made.insert(0, self.key, key[0])
        yield made

    def close(self) -> None:
        pass


def _plain(value, kind: str):
    """A value as JSON can hold it; missing ones are null."""
    if kind.startswith("array"):
        return None if value is None else [int(v) if "int" in kind else float(v) for v in value]
    if value is None or pd.isna(value):
        return None
    return int(value) if kind == "int" else float(value)


def identities(
    detections: DataFrame, width: float = 400.0, height: float = 300.0, longest: float = 100.0, scan: int = 300, key: str = "obs",
    time: str = "ts", late: str = "1 minute", idle: float = 60.0,
) -> DataFrame:
    """The rows of ``track`` for a stream of frames (columns as there, and ``time``) that
    are at most ``late`` out of order. ``idle``: seconds without frames that end an
    observation."""
    kind = detections.schema[key].dataType.simpleString()
    rows = detections.select(key, F.col("frame_idx").cast("long").alias("frame_idx"), time, *detected(detections)).withWatermark(time, late)
    rows = rows.withColumn("at_ms", F.unix_millis(time))
    processor = Identities(key, width, height, longest, scan, int(idle * 1000))
    schema = f"{key} {kind}, frame_idx long, animal string, x double, y double, mark_x double, mark_y double"
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")
