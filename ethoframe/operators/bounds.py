"""The best bounds of a colour among candidates: a cheap score of all, then exact scores
with early stop.

Points (pixels) of frames have h, s and v, may lie on a body (``body``, 0 or 1), and
belong to a ``blob`` of their frame. A candidate (h_low, h_high, s_low, v_low) takes the
points with h_low <= h <= h_high, s >= s_low and v >= v_low.

* Cheap score: the mean over frames of the share of taken points that are on a body (a
  frame without taken points counts 0). Candidates below ``share`` of the best, and all
  but the best ``top``, go.
* Exact score of a frame: of the blobs with ``area`` points taken on a body, the largest
  one's share of all their points, less ``none`` if there is no such blob, less ``over``
  if there are two or more.
  A candidate's score is the mean over all frames.

Candidates are given in the call and few. Points are counted once by frame, blob and the
place of h, s and v between all candidates' bounds, and a frame's counts are kept in one
row: candidates meet these rows, never the points, and only sums by candidate are
shuffled. The exact scores are summed in blocks of frames: the candidate with the best
cheap score first, over all frames; then, block by block, all others that are left. One
whose score would stay below the best known even if all frames to come were perfect is
dropped: the result is that of the full grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import staging

Candidate = tuple[float, float, float, float]
_AXES = ("h_low", "h_high", "s_low", "v_low")


@dataclass
class Found:
    """The best candidate and its figures, the order of exact candidates by cheap score,
    and how many frames were scored for how many candidates."""

    best: Candidate | None
    score: float
    precision: float
    no_detection: float
    over_detection: float
    tried: int
    scored: int
    full: int


def _place(value: Column, cuts: list[float], above: bool) -> Column:
    """How many of the cuts lie at or below a value (``above``: strictly below)."""
    at = F.array(*[F.lit(float(c)) for c in cuts])
    return F.size(F.filter(at, lambda c: (value > c) if above else (value >= c)))


def counted(points: DataFrame, candidates: list[Candidate], frame: str, blocks: int) -> DataFrame:
    """A row for each frame: its blobs, each with its cells (place between bounds, n and
    n_body), and its block."""
    cuts = [sorted({float(c[i]) for c in candidates}) for i in range(4)]
    h, s, v = (F.col(c).cast("double") for c in ("h", "s", "v"))
    places = [_place(h, cuts[0], False), _place(h, cuts[1], True), _place(s, cuts[2], False), _place(v, cuts[3], False)]
    at = [p.alias(n) for p, n in zip(places, _AXES)]
    body = F.coalesce(F.col("body").cast("int"), F.lit(0))
    cells = points.groupBy(F.col(frame).alias("frame"), "blob", *at).agg(F.count(F.lit(1)).alias("n"), F.sum(body).alias("n_body"))
    cell = F.struct(*_AXES, "n", "n_body")
    # dealt out by frame once, for both groupings
    blobs = cells.repartition("frame").groupBy("frame", "blob").agg(F.collect_list(cell).alias("cells"))
    frames = blobs.groupBy("frame").agg(F.collect_list("cells").alias("blobs"))
    return frames.withColumn("_block", F.pmod(F.xxhash64("frame"), F.lit(blocks)).cast("int"))


def _needs(candidates: list[Candidate], chosen: list[int]) -> list[tuple[int, ...]]:
    """Candidates by number, with the places that a cell must reach."""
    cuts = [sorted({float(c[i]) for c in candidates}) for i in range(4)]
    return [(k, cuts[0].index(c[0]) + 1, cuts[1].index(c[1]), cuts[2].index(c[2]) + 1, cuts[3].index(c[3]) + 1) for k in chosen for c in [tuple(map(float, candidates[k]))]]


def _sums(needs: list[tuple[int, ...]], area: tuple[int, int] | None):
    """Sums over a batch of frames by candidate: with ``area`` the exact ones, else the
    shares of points on a body."""
    schema = pa.schema([("k", pa.int32()), ("share", pa.float64()), ("seen", pa.int64()), ("over", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, out = batch.column(0), []
            cells = blobs.flatten()
            n_frames, n_blobs = len(blobs), len(cells)
            frame_of = np.repeat(np.arange(n_frames), blobs.value_lengths().to_numpy(zero_copy_only=False))
            blob_of = np.repeat(np.arange(n_blobs), cells.value_lengths().to_numpy(zero_copy_only=False))
            h_low, h_high, s_low, v_low, n, n_body = (x.to_numpy(zero_copy_only=False) for x in cells.flatten().flatten())
            for k, *need in needs:
                taken = (h_low >= need[0]) & (h_high <= need[1]) & (s_low >= need[2]) & (v_low >= need[3])
                blob, body = blob_of[taken], n_body[taken]
                if area is None:
                    frame = frame_of[blob]
                    number = np.bincount(frame, minlength=n_frames)
                    top, whole = np.bincount(frame, body, n_frames), np.bincount(frame, n[taken], n_frames)
                else:
                    size = np.bincount(blob, body, n_blobs)
                    good = np.flatnonzero((np.bincount(blob, minlength=n_blobs) > 0) & (size >= area[0]) & (size <= area[1]))
                    frame, size = frame_of[good], size[good]
                    number, whole, top = np.bincount(frame, minlength=n_frames), np.bincount(frame, size, n_frames), np.zeros(n_frames)
                    np.maximum.at(top, frame, size)
                share = float((top[whole > 0] / whole[whole > 0]).sum())
                out.append((k, share, int((number > 0).sum()), int((number > 1).sum())))
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _summed(cells: DataFrame, needs: list[tuple[int, ...]], area: tuple[int, int] | None) -> DataFrame:
    each = cells.select("blobs").mapInArrow(_sums(needs, area), "k int, share double, seen long, over long")
    return each.groupBy("k").agg(F.sum("share").alias("share"), F.sum("seen").alias("seen"), F.sum("over").alias("over")).where("seen > 0")


def cheap_scores(cells: DataFrame, needs: list[tuple[int, ...]], frames: int) -> DataFrame:
    """(k, cheap) of the candidates that take any point."""
    return _summed(cells, needs, None).select("k", (F.col("share") / F.lit(float(frames))).alias("cheap"))


def exact_sums(cells: DataFrame, needs: list[tuple[int, ...]], area: tuple[int, int]) -> DataFrame:
    """(k, share, seen, over): sums over the given frames of the largest blob's share,
    and the frames with any and with two or more blobs."""
    return _summed(cells, needs, area)


def search(
    points: DataFrame, candidates: list[Candidate], frame: str = "frame", area: tuple[int, int] = (10, 100), weights: tuple[float, float, float] = (1.0, 2.0, 2.0),
    top: int = 500, share: float = 0.2, blocks: int = 8, early_stop: bool = True,
) -> Found:
    """The candidate with the best exact score (ties: the better cheap score, then the
    order given). Frames are those with any point; without points there is none."""
    spark, (gain, none, over) = points.sparkSession, weights
    candidates = [tuple(map(float, c)) for c in candidates]
    cells, path = staging.staged(counted(points, candidates, frame, blocks), "_block")
    try:
        frames = {r["_block"]: r["n"] for r in cells.groupBy("_block").agg(F.count("frame").alias("n")).collect()}
        n = sum(frames.values())
        if not n or not candidates:
            return Found(None, float("-inf"), 0.0, 0.0, 0.0, 0, 0, 0)
        cheap = dict.fromkeys(range(len(candidates)), 0.0)
        cheap.update({r["k"]: r["cheap"] for r in cheap_scores(cells, _needs(candidates, list(cheap)), n).collect()})
        order = sorted((k for k in cheap if cheap[k] >= share * max(cheap.values())), key=lambda k: (-cheap[k], k))[:top]
        sums = {k: [0.0, 0, 0] for k in order}
        scored = 0

        def add(rows: DataFrame, chosen: list[int], n_frames: int) -> None:
            nonlocal scored
            scored += n_frames * len(chosen)
            found = {r["k"]: r for r in exact_sums(rows, _needs(candidates, chosen), area).collect()}
            for k in chosen:
                seen = found[k]["seen"] if k in found else 0
                if k in found:
                    sums[k][0] += found[k]["share"]
                    sums[k][2] += found[k]["over"]
                sums[k][1] += n_frames - seen

        def score(k: int, to_come: int = 0) -> float:
            """With frames to come all perfect."""
            return (gain * (sums[k][0] + to_come) - none * sums[k][1] - over * sums[k][2]) / n

        add(cells, order[:1], n)
        best, left, to_come = score(order[0]), order[1:], n
        for block in sorted(frames):
            if not left:
                break
            add(cells.where(F.col("_block") == block), left, frames[block])
            to_come -= frames[block]
            if early_stop:
                # what rounds differently by sums in another order is not dropped
                left = [k for k in left if score(k, to_come) >= best - 1e-9]
        whole = [order[0], *left]
        k = max(whole, key=lambda k: (round(score(k), 9), -order.index(k)))
        return Found(candidates[k], score(k), sums[k][0] / n, sums[k][1] / n, sums[k][2] / n, len(order), scored, n * len(order))
    finally:
        staging.remove(spark, path)
