"""Folds against plain loops, on short and on long observations."""

import math
import time

import numpy as np
from pyspark.sql import functions as F

from ethoframe.operators import resample, tracking, windows


def greedy(slots, claims, last):
    """One-to-one by the least distance left, marked animals first."""
    out, free = {}, list(range(len(slots)))
    for animal in ("blue", "yellow"):
        for k in free:
            if claims[animal] is not None and slots[k][0] == claims[animal]:
                out[animal] = slots[k][1]
                free.remove(k)
                break
    while free and len(out) < 3:
        rest = [a for a in tracking.ANIMALS if a not in out]
        d, k, a = min((math.dist(slots[k][1], last[a]), k, rest.index(a)) for k in free for a in rest)
        out[rest[a]] = slots[k][1]
        free.remove(k)
    return {a: out.get(a, last[a]) for a in tracking.ANIMALS}


def plain_track(frames, width, height, longest):
    """frames: (xs, ys, blue blob, yellow blob, blue place, yellow place)."""
    marks = {a: (width * q, height * q) for a, q in zip(tracking.ANIMALS, (0.25, 0.5, 0.75))}

    def slots(f):
        return [(b, p) for b, p in enumerate(zip(f[0], f[1]))]

    for f in frames[:300]:
        if f[4] and f[5]:
            at = greedy(slots(f), {"blue": f[2], "yellow": f[3]}, marks)
            marks = {"blue": f[4], "yellow": f[5], "focal": at["focal"]}
            break
    out = []
    for f in frames:
        at = greedy(slots(f), {"blue": f[2], "yellow": f[3]}, marks)
        new = {}
        for a, raw in (("blue", f[4]), ("yellow", f[5])):
            new[a] = raw or (marks[a] if math.dist(marks[a], at[a]) <= longest else at[a])
        marks = new | {"focal": at["focal"]}
        out.append((at, marks))
    return out


def test_identities_with_few_and_many_blobs(spark):
    rng = np.random.default_rng(3)
    rows, frames = [], {}
    for obs in range(6):
        for t in range(60):
            n = int(rng.choice([0, 1, 2, 3, 8]))
            xs, ys = (rng.uniform(0, s, n).round(3).tolist() for s in (400, 300))
            blue = 0 if n and rng.random() < 0.3 and obs else None
            yellow = n - 1 if n > 1 and rng.random() < 0.3 and obs else None
            at = [None if b is None else (xs[b], ys[b]) for b in (blue, yellow)]
            frames.setdefault(obs, []).append((xs, ys, blue, yellow, *at))
            rows.append((obs, t, xs, ys, blue, yellow, *(at[0] or (None, None)), *(at[1] or (None, None))))
    df = spark.createDataFrame(rows, "obs long, frame_idx long, xs array<double>, ys array<double>, blue_blob int, yellow_blob int, blue_x double, blue_y double, yellow_x double, yellow_y double")
    got = {(r.obs, r.frame_idx, r.animal): (r.x, r.y, r.mark_x, r.mark_y) for r in tracking.track(df).collect()}
    assert len(got) == 6 * 60 * 3
    for obs, own in frames.items():
        for t, (at, marks) in enumerate(plain_track(own, 400.0, 300.0, 100.0)):
            for a in tracking.ANIMALS:
                assert got[obs, t, a] == (*at[a], *marks[a]), (obs, t, a)


def test_merged_blobs_have_room_for_several(spark):
    df = spark.createDataFrame([("o", 0, [10.0], [10.0], [3])], "obs string, frame_idx long, xs array<double>, ys array<double>, sizes array<int>")
    assert {(r.x, r.y) for r in tracking.track(df).collect()} == {(10.0, 10.0)}


def _long(spark, n):
    return spark.range(n).select(
        F.lit("o").alias("obs"), F.col("id").alias("frame_idx"), (F.col("id") * 37 % 400).cast("double").alias("x"), (F.col("id") * 53 % 300).cast("double").alias("y"),
        F.when(F.col("id") % 9 == 0, 5.0).alias("raw_x"), F.when(F.col("id") % 9 == 0, 5.0).alias("raw_y"),
    )


def _seconds(make):
    began = time.time()
    make().write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_long_observations_take_time_in_proportion(spark):
    for make in (lambda n: tracking.leash(_long(spark, n), 150.0), lambda n: resample.min_gap(_long(spark, n), 3)):
        make(100).count()
        took = [min(_seconds(lambda n=n: make(n)) for _ in range(2)) for n in (60_000, 240_000)]
        assert took[1] < 8 * max(took[0], 0.2), took


def test_leash_and_gaps_by_loops(spark):
    """Several keys, null ones too, over the bounds of batches; bodies and detections missing."""
    rng = np.random.default_rng(7)
    rows = []
    for obs in ("a", "b", "c", None):
        x, y = 200.0, 150.0
        for t in range(700):
            x, y = x + rng.normal(0, 25), y + rng.normal(0, 25)
            seen, there = rng.random() < 0.05, rng.random() < 0.95
            rows.append((obs, t, *((round(x + 3, 3), round(y, 3)) if seen else (None, None)), *((round(x, 3), round(y, 3)) if there else (None, None))))
    df = spark.createDataFrame(rows, "obs string, frame_idx long, raw_x double, raw_y double, x double, y double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {(r.obs, r.frame_idx): (r.mark_x, r.mark_y) for r in tracking.leash(df, 60.0).collect()}
        kept = sorted((r.obs or "", r.frame_idx) for r in resample.min_gap(df.where("frame_idx % 7 <> 3"), 5).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    wanted, gaps = {}, []
    for obs in ("a", "b", "c", None):
        last, free = None, -1
        for _, t, rx, ry, x, y in (r for r in rows if r[0] == obs):
            body = (math.inf if x is None else x, math.inf if y is None else y)
            last = tracking.held(None if rx is None else (rx, ry), last or body, body, 60.0)
            wanted[obs, t] = tuple(None if math.isinf(v) else v for v in last)
            if t % 7 != 3 and t >= free:
                gaps.append((obs or "", t))
                free = t + 5
    assert got == wanted and kept == sorted(gaps)


def test_cumulative_minutes_without_a_nested_loop(spark):
    df = _long(spark, 500).select("obs", (F.col("frame_idx") % 50).alias("minute"), "x", F.lit("a").alias("arm"))
    plan = windows.cumulative_minutes(df, "x", "arm")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("NestedLoop") <= 1  # the clock by the one row of arms


def test_permutations_keep_the_arms_sizes(spark):
    df = spark.range(997).select(F.col("id").alias("obs"), F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("T"))
    out = resample.permuted(df, "obs", "T", 6, 1)
    assert {(r._rep, r.T): r["count"] for r in out.groupBy("_rep", "T").count().collect()} == {(k, t): n for k in range(1, 7) for t, n in (("a", 200), ("b", 797))}
    drawn = {frozenset(r.obs for r in out.where(f"_rep = {k} and T = 'a'").collect()) for k in (1, 2, 3)}
    assert len(drawn) == 3
