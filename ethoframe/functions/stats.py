"""Distribution functions: Student's t, and average ranks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _continued(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 / np.where(np.abs(q := 1 - (a + b) * x / (a + 1)) < tiny, tiny, q)
    h = d.copy()
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            change = c * d
            h *= change
        if np.nanmax(np.abs(change - 1), initial=0) < 1e-15:
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.where(np.isnan(x) | np.isnan(a) | np.isnan(b), np.nan, np.where(x <= 0, 0.0, 1.0))
    ok = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    a, b, x = a[ok], b[ok], x[ok]
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) if len(x) else x
    direct = x < (a + 1) / (a + b + 2)
    out[ok] = np.where(direct, front * _continued(a, b, x) / a, 1 - front * _continued(b, a, 1 - x) / b)
    return out


def t_cdf_array(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    tail = 0.5 * incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))
    return np.where(t > 0, 1 - tail, tail)


def t_quantile(p: float, df: float) -> float:
    """By bisection; for use on the driver with a handful of values."""
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf_array(np.array([mid]), np.array([df]))[0] < p else (low, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def _t_cdf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_cdf_array(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def _t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    known: dict = {}
    for key in set(zip(p, df)):
        known[key] = t_quantile(*key) if key[1] and key[1] > 0 else math.nan
    return pd.Series([known[key] for key in zip(p, df)])


def t_cdf(t: Column, df: Column) -> Column:
    return F.when(t.isNotNull() & (df > 0), _t_cdf(t.cast("double"), df.cast("double")))


def t_ppf(p: float, df: Column) -> Column:
    return F.when(df > 0, _t_quantile(F.lit(p), df.cast("double")))


@F.pandas_udf(DoubleType())
def _f_tail(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    x = b / (b + a * f)
    return pd.Series(incomplete_beta(b.to_numpy(float) / 2, a.to_numpy(float) / 2, x.to_numpy(float)))


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """The chance that F with these degrees of freedom is at least ``f``."""
    return F.when(f.isNotNull() & (df1 > 0) & (df2 > 0), _f_tail(f.cast("double"), df1.cast("double"), df2.cast("double")))


def t_two_sided(t: Column, df: Column) -> Column:
    return 2 * (F.lit(1.0) - t_cdf(F.abs(t), df))


@F.pandas_udf(DoubleType())
def _normal_tail(z: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(abs(x) / math.sqrt(2)) for x in z])


def normal_two_sided(z: Column) -> Column:
    """The chance of a standard normal value at least as far from 0."""
    return F.when(z.isNotNull(), _normal_tail(z.cast("double")))


def same_keys(by: tuple[str, ...], prefix: str) -> Column:
    """Whether the columns of ``by`` are those named ``prefix`` and their number, nulls
    being equal."""
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"{prefix}{i}"))
    return same


def with_places(values: DataFrame, column: str, n: str, by: tuple[str, ...] = (), buckets: int = 64, bucket: str | None = None) -> DataFrame:
    """Adds ``_before`` to a table of distinct values (within ``by``) with their counts
    ``n``: how many rows come before each; and its bucket's number under the name
    ``bucket``, if one is given. Values are dealt into buckets by approximate quantiles,
    whose counts are added up apart, so no task sorts all of them."""
    shares = [i / buckets for i in range(1, buckets)]
    bounds = values.groupBy(*by).agg(F.percentile_approx(column, shares, 10_000).alias("_bounds"))
    if by:
        bounds = bounds.select("_bounds", *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)])
        dealt = values.join(bounds, same_keys(by, "_g")).drop(*[f"_g{i}" for i in range(len(by))])
    else:
        dealt = values.crossJoin(F.broadcast(bounds))  # one row
    dealt = dealt.withColumn("_bucket", F.size(F.filter(F.coalesce("_bounds", F.array()), lambda b: b < F.col(column)))).drop("_bounds")
    counts = dealt.groupBy(*by, "_bucket").agg(F.sum(n).alias("_s"))
    lower = F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_b"), lower.alias("_lower"))
    up = Window.partitionBy(*by, "_bucket").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(n).over(up), F.lit(0))
    placed = dealt.withColumn("_own", own).join(offsets, same_keys(by, "_g") & (F.col("_bucket") == F.col("_b")))
    placed = placed.withColumn("_before", F.col("_own") + F.col("_lower")).drop("_b", "_own", "_lower", *[f"_g{i}" for i in range(len(by))])
    return placed.withColumnRenamed("_bucket", bucket) if bucket else placed.drop("_bucket")


def with_average_rank(df: DataFrame, column: str, name: str, by: tuple[str, ...] = (), buckets: int = 64) -> DataFrame:
    """Ranks from 1 (within ``by``), equal values sharing the mean of theirs; nulls get
    none. Equal values are counted first and ranked as one, so neither a very common
    value nor a very large group is one task's."""
    values = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    placed = with_places(values, column, "_n", by, buckets)
    keys = [*by, column]
    ranks = placed.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(keys)], (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(name))
    on = same_keys(by, "_r") & (F.col(column) == F.col(f"_r{len(by)}"))
    return df.join(ranks, on, "left").drop(*[f"_r{i}" for i in range(len(keys))])
