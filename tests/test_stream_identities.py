"""Identities of shuffled batches against the whole table at once."""

import numpy as np
from pyspark.sql import functions as F

from conftest import DATA
from ethoframe.operators import tracking
from ethoframe.plans import catalog
from ethoframe.streaming import identities, twins

SCHEMA = "obs long, frame_idx long, xs array<double>, ys array<double>, sizes array<int>, blue_blob int, yellow_blob int, blue_x double, blue_y double, yellow_x double, yellow_y double"


def test_late_frames_are_taken_in_order(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for obs in range(4):
        for t in range(40):
            n = int(rng.choice([0, 1, 2, 3, 5]))
            xs, ys = (rng.uniform(0, s, n).round(3).tolist() for s in (400, 300))
            # observation 0 never shows both marks: its frames wait for the end of the scan, or its own
            blue = 0 if n and rng.random() < 0.4 else None
            yellow = n - 1 if n > 1 and rng.random() < 0.4 and obs else None
            at = [None if b is None else (xs[b], ys[b]) for b in (blue, yellow)]
            rows.append((obs, t, xs, ys, [1] * n if t % 2 else None, blue, yellow, *(at[0] or (None, None)), *(at[1] or (None, None))))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("frame_idx") + 1_700_000_000))
    source = f"file://{tmp_path}/in"
    # each batch has frames of 20 seconds, in no order, and later batches go back by 15
    lag = {(o, t): int(rng.integers(0, 16)) for o, t, *_ in rows}
    order = sorted(rows, key=lambda r: r[1] + lag[r[0], r[1]])
    for k in range(0, len(order), 40):
        keys = spark.createDataFrame([(r[0], r[1]) for r in order[k : k + 40]], "obs long, frame_idx long")
        df.join(keys, ["obs", "frame_idx"]).select(df.columns).orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(source)
    # far ahead, so that the watermark passes all others
    df.limit(1).withColumns({"obs": F.lit(-1).cast("long"), "ts": F.timestamp_seconds(F.lit(1_800_000_000))}).write.mode("append").parquet(source)
    schema = df.schema
    with identities.stream_settings(spark):
        out = twins.run_to_end(
            spark, source, schema, lambda s: identities.identities(s, scan=25, late="60 seconds", idle=30.0), f"file://{tmp_path}/state", f"file://{tmp_path}/out", each=1
        )
    found = {(r.obs, r.frame_idx, r.animal): (r.x, r.y, r.mark_x, r.mark_y) for r in out.where("obs >= 0").collect()}
    whole = {(r.obs, r.frame_idx, r.animal): (r.x, r.y, r.mark_x, r.mark_y) for r in tracking.track(df, scan=25).collect()}
    assert len(whole) == 4 * 40 * 3 and found == whole


def test_the_streamed_query_is_the_batch_query(spark, duck):
    rows = [sorted(map(tuple, catalog.QUERIES[q](spark, str(DATA)).select("obs", "frame_idx", "animal", "x", "y", "mark_x", "mark_y").collect())) for q in ("identity_stream", "identity_fold")]
    assert rows[0] == rows[1] and len(rows[0]) > 1000
