"""Frames to observations to arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_of, mean_of
from ..functions.roles import roles
from ..functions.stats import t_ppf


def combined(outcomes: tuple[str, ...], task: str) -> Column:
    """One number of several outcomes: their chance of any (or), sum or mean."""
    values = [F.col(c).cast("double") for c in outcomes]
    if task == "or":
        return any_of(*values)
    if task == "sum":
        return sum(values[1:], values[0])
    if task == "mean":
        return mean_of(*values)
    raise ValueError(f"unknown task {task!r}")


def observation_level(frames: DataFrame, key: str = "obs", treatment: str = "T", task: str | None = None) -> DataFrame:
    """One row for each observation: means of outcomes and predictions, treatment
    and covariates, ``has_annotations`` (every frame has all outcomes), n_frames.

    With ``task`` outcomes and predictions are first combined within each frame.
    """
    r = roles(frames)
    annotated = F.lit(1)
    for y in r.outcomes:
        annotated = annotated * F.col(y).isNotNull().cast("int")
    df = frames.withColumn("_annotated", annotated)
    means = {c: F.col(c) for c in (*r.outcomes, *r.predictions)} | {"Y_avg": combined(r.outcomes, "mean")}
    if task:
        means = {f"Y_{task}": combined(r.outcomes, task), f"Yhat_{task}": combined(r.predictions, task)}
    out = [F.avg(v).alias(c) for c, v in means.items()]
    return df.groupBy(key).agg(
        F.min(treatment).alias(treatment), *[F.min(w).alias(w) for w in r.covariates], *out,
        F.min("_annotated").alias("has_annotations"), F.count(F.lit(1)).alias("n_frames"),
    )


def arm_summary(observations: DataFrame, value: str, arm: str = "T") -> DataFrame:
    """n, mean, std and se of each arm."""
    per = observations.groupBy(arm).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return per.withColumn("se", F.col("std") / F.sqrt("n"))


def with_interval(summary: DataFrame, level: float = 0.95, kind: str = "t") -> DataFrame:
    """Adds low and high: by Student's t or by the normal quantile 1.96."""
    q = t_ppf(0.5 + level / 2, F.col("n") - 1) if kind == "t" else F.lit(1.96)
    return summary.withColumns({"low": F.col("mean") - q * F.col("se"), "high": F.col("mean") + q * F.col("se")})
