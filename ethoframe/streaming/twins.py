"""Streaming forms of the frame windows.

Each takes a streaming (or bounded) DataFrame and gives a plan for ``writeStream``;
over the same rows from 1970 on (where watermarks begin) it agrees with its batch twin.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.tracking import held


def tumbling(events: DataFrame, width: str, by: tuple[str, ...], value: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Counts and sums in windows of one width, final once the watermark passes."""
    w = F.window(time, width)
    out = events.withWatermark(time, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, width: str, slide: str, by: tuple[str, ...], value: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark(time, late).groupBy(F.window(time, width, slide), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Bouts: rows of a key less than ``gap`` apart."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def without_repeats(events: DataFrame, keys: tuple[str, ...], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """First of rows with equal keys that come within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def marks(bodies: DataFrame, longest: float, key: str = "obs") -> DataFrame:
    """The leash of raw marks (raw_x, raw_y, x, y) with the last mark as state: rows of
    a key are taken in frame order within a batch, and later batches are taken to be
    later frames. Without columns of raw marks the bodies are the detections."""
    kind = dict(bodies.dtypes)[key]
    seen = ("raw_x", "raw_y") if {"raw_x", "raw_y"} <= set(bodies.columns) else ("x", "y")

    def fold(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = tuple(state.get) if state.exists else None
        pdf = pd.concat(list(frames)).sort_values("frame_idx")
        rows = []
        for frame, rx, ry, x, y in zip(*(pdf[c].tolist() for c in ("frame_idx", *seen, "x", "y"))):
            last = held(None if pd.isna(rx) else (float(rx), float(ry)), last or (float(x), float(y)), (float(x), float(y)), longest)
            rows.append((name[0], frame, *last))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(rows, columns=[key, "frame_idx", "mark_x", "mark_y"])

    return bodies.groupBy(key).applyInPandasWithState(
        fold, f"{key} {kind}, frame_idx long, mark_x double, mark_y double", "x double, y double", "append", "NoTimeout"
    )


def run_to_end(spark: SparkSession, source: str, schema: StructType, make, checkpoint: str, target: str, mode: str = "append", each: int | None = None) -> DataFrame:
    """Streams Parquet files, ``each`` of them in a batch, through ``make`` into
    ``target`` until all that is there has been read, and reads the result."""
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", each) if each else reader).parquet(source)
    query = make(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target)
