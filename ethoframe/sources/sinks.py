"""Sinks: tables, one CSV for each observation, JSON, and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, overwrite: bool = False, by: tuple[str, ...] = ()) -> None:
    """Parquet; an existing table stays unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "ignore").partitionBy(*by).parquet(path)


def save_vectors(df: DataFrame, path: str, vector: str = "x") -> None:
    """Parquet, after checking that no vector is null, all zeros or holds null or
    non-finite numbers. Spark's commit makes the files visible once all are written."""
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    bad = df.agg(F.count_if(F.col(vector).isNull() | F.forall(vector, lambda v: v == 0) | odd).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} vectors are null, all zeros or not finite")
    df.write.parquet(path)


def save_per_observation(df: DataFrame, path: str, key: str = "obs", order: str = "frame_idx", digits: int = 6) -> None:
    """A folder of CSVs, one for each observation, in frame order, doubles with a
    fixed number of digits."""
    shown = df.select(*[F.format_string(f"%.{digits}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    shown.repartition(key).sortWithinPartitions(key, order).write.partitionBy(key).csv(path, header=True)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_run(df: DataFrame, path: str) -> None:
    """One more run to a leaderboard."""
    df.write.mode("append").parquet(path)
