"""Environments, weights, datasets and scorers."""

from __future__ import annotations

import warnings
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.columns import sigmoid
from ..functions.roles import roles


def encode(df: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """Codes from 0 of the columns' joined strings in string order. The codes are
    made from the distinct keys and joined back, so rows are never sorted in one
    place; distinct keys are, so this is for environments and classes. Columns that
    the table lacks are left out with a warning; with none left, all codes are 0."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        warnings.warn(f"no columns {missing}: left out of {name}", stacklevel=2)
    key = F.concat_ws("_", *[F.col(c).cast("string") for c in columns if c not in missing])
    keys = df.select(key.alias("_key")).distinct().withColumn(name, (F.dense_rank().over(Window.partitionBy().orderBy("_key")) - 1).cast("int"))
    return df.withColumn("_key", key).join(keys, "_key").drop("_key")


def derm_weights(df: DataFrame, y: str, env: str, name: str = "weight") -> DataFrame:
    """Var(y | env) over the share of (round(y), env), with mean 1; environments of
    one row have variance 0."""
    cls = F.rint(F.col(y))
    # all moments come from one row for each environment and class
    cells = df.groupBy(env, cls.alias("_cls")).agg(F.count(F.lit(1)).alias("_n"), F.count(y).alias("_k"), F.avg(y).alias("_m"), F.var_pop(y).alias("_v"))
    own, whole = Window.partitionBy(env), Window.partitionBy()
    cells = cells.withColumns({"_all": F.sum("_k").over(own), "_mean": F.sum(F.col("_k") * F.col("_m")).over(own) / F.sum("_k").over(own)})
    squares = F.sum(F.col("_k") * (F.col("_v") + (F.col("_m") - F.col("_mean")) * (F.col("_m") - F.col("_mean")))).over(own)
    var = F.coalesce(squares / F.nullif(F.col("_all") - 1, F.lit(0)), F.lit(0.0))
    cells = cells.withColumns({"_raw": var / F.greatest(F.col("_n") / F.sum("_n").over(whole), F.lit(1e-6))})
    mean = F.sum(F.col("_raw") * F.col("_n")).over(whole) / F.sum("_n").over(whole)
    cells = cells.select(env, "_cls", (F.col("_raw") / F.nullif(mean, F.lit(0.0))).alias(name))
    return df.withColumn("_cls", cls).join(cells, [env, "_cls"]).drop("_cls")


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """N / (classes * n) of each class."""
    per = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return per.crossJoin(F.broadcast(total)).select(y, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))  # one row


def concat(datasets: list[DataFrame], key: str = "obs", env: str = "E") -> DataFrame:
    """One dataset of several: observation ids get a prefix ds{i}_, environments are
    numbered on, covariates are those of the first (0 where missing)."""
    first = roles(datasets[0])
    out, base = [], F.lit(0)
    sizes = [d.agg((F.coalesce(F.max(env), F.lit(-1)) + 1).alias(f"_n{i}")) for i, d in enumerate(datasets)]
    for i, d in enumerate(datasets):
        r = roles(d)
        if r.outcomes != first.outcomes or r.predictions != first.predictions:
            raise ValueError("datasets differ in outcomes or predictions")
        before = [F.col(f"_n{j}") for j in range(i)]
        rows = reduce(lambda a, s: a.crossJoin(F.broadcast(s)), sizes[:i], d)  # one row each
        w = [(F.col(c) if c in d.columns else F.lit(0)).cast("double").alias(c) for c in first.covariates]
        rest = [c for c in datasets[0].columns if c not in (key, env, *first.covariates)]
        shift = reduce(lambda a, b: a + b, before, base)
        out.append(rows.select(F.concat(F.lit(f"ds{i}_"), F.col(key).cast("string")).alias(key), (F.col(env) + shift).cast("int").alias(env), *w, *rest))
    return reduce(lambda a, b: a.unionByName(b), out)


def grid(spark, axes: dict[str, tuple], *keep: str) -> DataFrame:
    """All combinations of parameters, without those that fail a rule."""
    rows = list(product(*axes.values()))
    df = spark.createDataFrame(rows, list(axes))
    return reduce(lambda d, rule: d.where(rule), keep, df)


def linear_scores(df: DataFrame, vector: str, weights: list[float], bias: float, name: str = "score") -> DataFrame:
    w = F.array(*[F.lit(float(x)) for x in weights])
    logit = F.aggregate(F.zip_with(F.col(vector), w, lambda x, y: x * y), F.lit(float(bias)), lambda a, x: a + x)
    return df.withColumn(name, sigmoid(logit))


def mlp_scorer(layers: list[tuple[np.ndarray, np.ndarray]]):
    """A UDF of vectors: ReLU between layers, a sigmoid after the last."""

    @F.pandas_udf(DoubleType())
    def score(x: pd.Series) -> pd.Series:
        h = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, len(layers[0][0])))
        for k, (w, b) in enumerate(layers):
            h = h @ w + b
            if k + 1 < len(layers):
                h = np.maximum(h, 0)
        return pd.Series(1 / (1 + np.exp(-h[:, 0])))

    return score


def attention_scorer(query: np.ndarray, key: np.ndarray, value: np.ndarray, out: np.ndarray):
    """A UDF of windows of vectors (arrays of arrays, odd length): the middle one
    asks, softmax weighs, the answer is added to it, normalised and scored."""

    @F.pandas_udf(DoubleType())
    def score(windows: pd.Series) -> pd.Series:
        x = np.stack([np.stack(w) for w in windows]).astype(float) if len(windows) else np.zeros((0, 1, len(query)))
        middle = x[:, x.shape[1] // 2]
        logits = np.einsum("nd,nkd->nk", middle @ query, x @ key) / np.sqrt(query.shape[1])
        p = np.exp(logits - logits.max(1, keepdims=True)) if len(x) else logits
        p = p / p.sum(1, keepdims=True)
        h = middle + np.einsum("nk,nkd->nd", p, x @ value)
        h = (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5)
        return pd.Series(1 / (1 + np.exp(-(h @ out))))

    return score


def temperature_grid(df: DataFrame, y: str, logit: str, temperatures: tuple[float, ...]) -> DataFrame:
    """The mean cross entropy at each temperature, in one pass."""
    def loss(t: float) -> Column:
        p = F.least(F.greatest(sigmoid(F.col(logit), t), F.lit(1e-7)), F.lit(1 - 1e-7))
        return -(F.col(y) * F.log(p) + (1 - F.col(y)) * F.log(1 - p))

    per = df.agg(*[F.avg(loss(t)).alias(f"_{i}") for i, t in enumerate(temperatures)])
    return per.select(F.explode(F.array(*[F.struct(F.lit(t).alias("temperature"), F.col(f"_{i}").alias("loss")) for i, t in enumerate(temperatures)])).alias("x")).select("x.*")


def temperature(df: DataFrame, y: str, logit: str, low: float = -3.0, high: float = 3.0, passes: int = 4, points: int = 17) -> DataFrame:
    """(temperature, loss): the temperature with the least mean cross entropy, its log
    between ``low`` and ``high``. Each pass tries ``points`` temperatures in one
    aggregation and goes on between the best one's neighbours."""
    from math import exp

    for _ in range(passes):
        step = (high - low) / (points - 1)
        tried = temperature_grid(df, y, logit, tuple(exp(low + k * step) for k in range(points)))
        best = tried.orderBy("loss", "temperature").limit(1)
        found = best.collect()
        if not found or found[0]["loss"] is None:
            return tried.limit(0)
        at = np.log(found[0]["temperature"])
        low, high = max(low, at - step), min(high, at + step)
    return best


def noisy(df: DataFrame, vector: str, scale: float, unit: str, seed: int) -> DataFrame:
    """Gaussian noise on each number of a vector, the same in each run: by Box and
    Muller from two hashes of the row's ``unit`` and the number's place."""

    def uniform(i: Column, side: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(side), F.col(unit), i), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))

    def add(x: Column, i: Column) -> Column:
        return x + scale * F.sqrt(-2 * F.log(uniform(i, 0))) * F.cos(2 * np.pi * uniform(i, 1))

    return df.withColumn(vector, F.transform(vector, add))
