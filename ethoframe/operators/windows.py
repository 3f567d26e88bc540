"""Temporal context of scalars and vectors, and clock windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _per(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def context_mean(df: DataFrame, value: str, k: int, key: str = "obs", order: str = "frame_idx", name: str = "context") -> DataFrame:
    """The mean of 2k + 1 rows around each, the edge rows standing in for those
    beyond the edges."""
    w = _per(key, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(key))
    inside = F.sum(value).over(w.rowsBetween(-k, k))
    before = F.greatest(F.lit(k) - (at - 1), F.lit(0)) * F.first(value).over(whole)
    after = F.greatest(F.lit(k) - (n - at), F.lit(0)) * F.last(value).over(whole)
    return df.withColumn(name, (inside + before + after) / F.lit(2.0 * k + 1))


def context_rows(df: DataFrame, value: str, k: int, key: str = "obs", order: str = "frame_idx", name: str = "context") -> DataFrame:
    """The 2k + 1 values around each row as an array, edges repeated."""
    w = _per(key, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    parts = [F.coalesce(F.lag(value, i).over(w), first) for i in range(k, 0, -1)] + [F.col(value)]
    parts += [F.coalesce(F.lead(value, i).over(w), last) for i in range(1, k + 1)]
    return df.withColumn(name, F.array(*parts))


def context_concat(df: DataFrame, vector: str, k: int, key: str = "obs", order: str = "frame_idx", name: str = "context") -> DataFrame:
    """The vectors of ``context_rows`` end to end."""
    return context_rows(df, vector, k, key, order, name).withColumn(name, F.flatten(name))


def vector_context_mean(df: DataFrame, vector: str, k: int, key: str = "obs", order: str = "frame_idx", name: str = "context") -> DataFrame:
    """The clamped mean of vectors, element by element, without exploding them."""

    def add(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    rows = context_rows(df.withColumn(vector, F.col(vector).cast("array<double>")), vector, k, key, order, "_rows")
    rest = F.slice("_rows", 2, 2 * k)
    total = F.aggregate(rest, F.element_at("_rows", 1), add)
    return rows.withColumn(name, F.transform(total, lambda x: x / F.lit(2.0 * k + 1))).drop("_rows")


def context_truncated(df: DataFrame, value: str, k: int, key: str = "obs", order: str = "frame_idx", name: str = "context") -> DataFrame:
    """Values of up to 2k + 1 rows around each, fewer at the edges, and a padding
    mask of 2k + 1 flags (true past the end)."""
    near = F.collect_list(value).over(_per(key, order).rowsBetween(-k, k))
    df = df.withColumn(name, near)
    return df.withColumn(f"{name}_padding", F.transform(F.sequence(F.lit(1), F.lit(2 * k + 1)), lambda i: i > F.size(name)))


def cumulative_minutes(df: DataFrame, value: str, arm: str, minute: str = "minute", key: str = "obs") -> DataFrame:
    """For each arm and minute: the mean over observations of their means of all
    rows up to that minute. Observations keep their last mean in minutes without
    rows; before their first row they don't count."""
    per = df.groupBy(key, arm, minute).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    upto = Window.partitionBy(key, arm).orderBy(minute)
    mean = F.sum("s").over(upto) / F.nullif(F.sum("n").over(upto), F.lit(0))
    # a mean only changes in minutes with rows: an arm's sum of means is the running
    # sum of its observations' changes, so minutes without rows are never made
    run = per.withColumn("_mean", mean).withColumn("_last", F.lag("_mean").over(upto))
    change = F.coalesce("_mean", F.lit(0.0)) - F.coalesce("_last", F.lit(0.0))
    new = F.count_if(F.col("_mean").isNotNull() & F.col("_last").isNull())
    moved = run.groupBy(arm, minute).agg(F.sum(change).alias("_c"), new.alias("_new"))
    # every arm has every minute of the clock from its first on
    clock = moved.select(minute).distinct().crossJoin(F.broadcast(moved.agg(F.collect_set(arm).alias("_arms"))))  # one row
    grid = clock.select(F.explode("_arms").alias(arm), minute)
    so_far = Window.partitionBy(arm).orderBy(minute)
    full = grid.join(moved, [arm, minute], "left").withColumns({"_n": F.sum("_new").over(so_far), "_s": F.sum("_c").over(so_far)})
    return full.where("_n is not null").select(arm, minute, (F.col("_s") / F.nullif("_n", F.lit(0))).alias("mean"), F.col("_n").alias("n_obs"))
