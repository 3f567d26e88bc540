"""Folds over an observation's frames: identities, leash and proximity."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import distance
from .folds import fold, fold_stretches

#: The animals, in the order in which marks claim blobs; the last one has no mark.
ANIMALS = ("blue", "yellow", "focal")


def proximity(n_blobs: Column, gap: Column, near: float) -> Column:
    """1 for one blob, by distance for two or more, 0 for none."""
    return F.when(n_blobs == 1, 1).when(n_blobs >= 2, (gap < near).cast("int")).otherwise(0)


def with_proximity(df: DataFrame, near: float) -> DataFrame:
    def gap(a: str) -> Column:
        return distance(F.col("focal_x"), F.col("focal_y"), F.col(f"{a}_x"), F.col(f"{a}_y"))

    return df.withColumns({"B2F": proximity(F.col("n_blobs"), gap("blue"), near), "Y2F": proximity(F.col("n_blobs"), gap("yellow"), near)})


def held(raw: tuple | None, last: tuple, body: tuple, longest: float) -> tuple:
    """A mark's next place: the raw detection if there is one; else the last place
    while it lies within ``longest`` of the body; else the body itself."""
    if raw is not None:
        return raw
    return last if math.dist(last, body) <= longest else body


def leash(df: DataFrame, longest: float, key: str = "obs", order: str = "frame_idx") -> DataFrame:
    """The mark of each frame (raw_x, raw_y, x, y), held as by ``held``. Before any
    detection the body stands in. Null bodies are taken as out of reach."""

    def begin():
        last = None

        def step(_, rx, ry, x, y):
            nonlocal last
            x, y = np.where(np.isnan(x), np.inf, x), np.where(np.isnan(y), np.inf, y)
            out = np.empty((2, len(x)))
            starts = np.flatnonzero(~np.isnan(rx))
            k = 0
            while k < len(x):
                if not np.isnan(rx[k]):
                    last = (rx[k], ry[k])
                elif last is None or not math.dist(last, (x[k], y[k])) <= longest:
                    last = (x[k], y[k])
                # up to the next detection, or the first body out of reach
                i = np.searchsorted(starts, k, "right")
                end, to, reach = int(starts[i]) if i < len(starts) else len(x), k + 1, 16
                while to < end:
                    stop = min(end, to + reach)
                    with np.errstate(invalid="ignore"):
                        far = np.flatnonzero(~(np.hypot(x[to:stop] - last[0], y[to:stop] - last[1]) <= longest))
                    if len(far):
                        end = to + int(far[0])
                        break
                    to, reach = stop, 2 * reach
                out[:, k:end] = np.array(last)[:, None]
                k = end
            out[np.isinf(out)] = np.nan
            return np.arange(len(x)), tuple(out)

        return step

    doubles = [F.col(c).cast("double").alias(c) for c in ("raw_x", "raw_y", "x", "y")]
    return fold_stretches(df.select(key, order, *doubles), key, order, ("raw_x", "raw_y", "x", "y"), {"mark_x": "double", "mark_y": "double"}, begin)


def assign(slots: list[tuple], claims: dict[str, int], last: dict[str, tuple]) -> dict[str, tuple]:
    """Each animal's slot: a marked animal takes the first free one of its blob, the
    others take, nearest pair of slot and last place first, what is left; an animal for
    whom nothing is left stays where it was. ``slots``: (blob, place) of each."""
    free, out = dict(enumerate(slots)), {}
    for animal in ANIMALS[:-1]:
        own = next((k for k, (blob, _) in free.items() if blob == claims.get(animal)), None)
        if own is not None:
            out[animal] = free.pop(own)[1]
    open_ = [a for a in ANIMALS if a not in out]
    near = sorted((math.dist(place, last[a]), k, i) for k, (_, place) in free.items() for i, a in enumerate(open_))
    for _, k, i in near:
        if k in free and open_[i] not in out:
            out[open_[i]] = free.pop(k)[1]
    return {a: out.get(a, last[a]) for a in ANIMALS}


#: What a frame of detections may have beside its number, with types.
DETECTED = {"xs": "array<double>", "ys": "array<double>", "sizes": "array<int>", "blue_blob": "int", "yellow_blob": "int", "blue_x": "double", "blue_y": "double", "yellow_x": "double", "yellow_y": "double"}


def detected(df: DataFrame) -> list[Column]:
    """The columns of ``DETECTED``, null where ``df`` lacks them."""
    return [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in DETECTED.items()]


class Tracker:
    """One observation's identities, frame by frame. State is the last marks alone, and
    the frames of the scan for the first ones, which wait for its end."""

    def __init__(self, width: float, height: float, longest: float, scan: int):
        self.plain = {a: (width * q, height * q) for a, q in zip(ANIMALS, (0.25, 0.5, 0.75))}
        self.longest, self.scan = longest, scan
        self.marks: dict[str, tuple] | None = None
        self.waiting: list[tuple] = []

    @staticmethod
    def _slots(xs, ys, sizes) -> list[tuple]:
        return [(b, p) for b, (p, n) in enumerate(zip(zip(xs or (), ys or ()), sizes or [1] * len(xs or ()))) for _ in range(n)]

    def _placed(self, frame, xs, ys, sizes, blue, yellow, bx, by, yx, yy) -> list[tuple]:
        at = assign(self._slots(xs, ys, sizes), {"blue": blue, "yellow": yellow}, self.marks)
        raw = {"blue": None if bx is None else (bx, by), "yellow": None if yx is None else (yx, yy)}
        self.marks = {a: held(raw[a], self.marks[a], at[a], self.longest) for a in ANIMALS[:-1]} | {"focal": at["focal"]}
        return [(frame, a, *at[a], *self.marks[a]) for a in ANIMALS]

    def _release(self) -> list[tuple]:
        waiting, self.waiting = self.waiting, []
        return [made for w in waiting for made in self._placed(*w)]

    def frame(self, frame, *row) -> list[tuple]:
        """Rows (frame, animal, x, y, mark_x, mark_y) of the frames that are settled now."""
        if self.marks is not None:
            return self._placed(frame, *row)
        self.waiting.append((frame, *row))
        xs, ys, sizes, blue, yellow, bx, by, yx, yy = row
        both = bx is not None and yx is not None
        if not both and len(self.waiting) < self.scan:
            return []
        self.marks = self.plain
        if both:
            # the focal animal starts where this frame has it
            focal = assign(self._slots(xs, ys, sizes), {"blue": blue, "yellow": yellow}, self.plain)["focal"]
            self.marks = {"blue": (bx, by), "yellow": (yx, yy), "focal": focal}
        return self._release()

    def finish(self) -> list[tuple]:
        """The frames that still wait, at an observation's end."""
        if self.marks is None:
            self.marks = self.plain
        return self._release()


def track(detections: DataFrame, width: float = 400.0, height: float = 300.0, longest: float = 100.0, scan: int = 300, key: str = "obs") -> DataFrame:
    """Identities through an observation's frames: (key, frame_idx, animal, x, y,
    mark_x, mark_y), one row for each animal.

    ``detections`` has a row for each frame: ``xs`` and ``ys`` of its blobs, and where
    marks were seen ``blue_blob`` and ``yellow_blob`` (the marked blob, from 0) with
    ``blue_x``, ``blue_y``, ``yellow_x``, ``yellow_y``; ``sizes`` (animals in each
    blob) if blobs may be merged. Missing columns count as never seen, sizes as 1.
    Blobs go to animals as by ``assign``, marks follow as by ``held``. The first marks
    are those of the first of ``scan`` frames that shows both, for the frames up to it
    too; without one, places on the frame's diagonal stand in.
    """
    rows = detections.select(key, "frame_idx", *detected(detections))
    made = {"frame": rows.schema["frame_idx"].dataType.simpleString(), "animal": "string", "x": "double", "y": "double", "mark_x": "double", "mark_y": "double"}
    # the end of each observation is a row too: it lets the waiting frames go
    ends = rows.groupBy(key).agg((F.max("frame_idx") + 1).cast(made["frame"]).alias("frame_idx")).withColumn("last", F.lit(True))
    rows = rows.withColumn("last", F.lit(False)).unionByName(ends, allowMissingColumns=True)

    def begin():
        tracker = Tracker(width, height, longest, scan)

        def step(frame, *row):
            return tracker.finish() if row[-1] else tracker.frame(frame, *row[:-1])

        return step

    out = fold(rows, key, "frame_idx", (*DETECTED, "last"), made, begin)
    return out.select(key, F.col("frame").alias("frame_idx"), "animal", "x", "y", "mark_x", "mark_y")
