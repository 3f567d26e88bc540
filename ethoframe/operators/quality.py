"""Data quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vector_report(df: DataFrame, vector: str) -> DataFrame:
    zero, bad = F.forall(vector, lambda v: v == 0), F.exists(vector, lambda v: F.isnan(v))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(zero).alias("n_zero"), F.count_if(bad).alias("n_nan"), F.countDistinct(F.size(vector)).alias("n_lengths"))


def annotation_report(df: DataFrame, outcomes: tuple[str, ...], by: str) -> DataFrame:
    """How many frames of each group have all outcomes, and lack each."""
    full = F.lit(True)
    for y in outcomes:
        full = full & F.col(y).isNotNull()
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(full).alias("n_annotated"), *[F.count_if(F.col(y).isNull()).alias(f"n_missing_{y}") for y in outcomes])


def missing_keys(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys of one side that the other lacks."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    only = a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left"))
    return only.unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right")))


def run_states(wanted: DataFrame, started: DataFrame, done: DataFrame, broken: DataFrame, key: str) -> DataFrame:
    """The state of each wanted run: done with a result, whatever else is known; pending
    where it never started; of the rest failed with an error on record, or running."""
    state = wanted.select(key).distinct()
    for name, rows in (("_started", started), ("_done", done), ("_broken", broken)):
        state = state.join(rows.select(key).distinct().withColumn(name, F.lit(True)), key, "left")
    return state.select(key, F.when(F.col("_done"), "done").when(F.col("_started").isNull(), "pending").when(F.col("_broken"), "failed").otherwise("running").alias("status"))


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Which of the wanted runs have a result: done or pending."""
    marked = done.select(key).distinct().withColumn("_done", F.lit(True))
    return wanted.join(marked, key, "left").select(key, F.when(F.col("_done"), "done").otherwise("pending").alias("status"))


def recordings(observations: DataFrame, files: DataFrame, fps: float, source_fps: float, key: str = "obs") -> DataFrame:
    """Each observation (start_frame and end_frame of its source) against its file (fps,
    frames): missing, fps (another rate), duration (another number of whole seconds), or ok."""
    there = files.select(key, F.col("fps").alias("_fps"), F.col("frames").alias("_frames"), F.lit(True).alias("_there"))
    rows = observations.join(there, key, "left")
    expected = ((F.col("end_frame") - F.col("start_frame")) / F.lit(float(source_fps))).cast("long")
    actual = F.when(F.col("_fps") > 0, (F.col("_frames") / F.col("_fps")).cast("long")).otherwise(0)
    state = F.when(F.col("_there").isNull(), "missing").when(~F.col("_fps").eqNullSafe(F.lit(float(fps))), "fps").when(~expected.eqNullSafe(actual), "duration").otherwise("ok")
    return rows.select(key, expected.alias("expected"), F.when(F.col("_there"), actual).alias("actual"), state.alias("status"))


def selected_share(df: DataFrame, selected: str, total: str, by: tuple[str, ...] = ()) -> DataFrame:
    """How much of a total was selected, in all: null where the total is 0."""
    return df.groupBy(*by).agg(F.sum(selected).alias("n_selected"), F.sum(total).alias("n_total"), (F.sum(selected) / F.nullif(F.sum(total), F.lit(0))).alias("share"))
