"""Choosing estimators and parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import effects, meta

#: Estimators by name: (observations, value, arm, control, treated, covariates) -> table.
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {
    "ead": lambda df, y, arm, c, t, w: effects.difference_in_means(df.where(F.col(arm).isin(c, t)), y, arm),
    "welch": lambda df, y, arm, c, t, w: effects.matrix(df.where(F.col(arm).isin(c, t)), y, arm),
    "aipw": lambda df, y, arm, c, t, w: effects.doubly_robust(df, y, arm, c, t, w[0]),
    "aipw_forest": meta.aipw_forest,
    "s_learner": meta.s_learner,
    "t_learner": meta.t_learner,
    "x_learner": meta.x_learner,
    "dr_learner": meta.dr_learner,
}


def estimate(observations: DataFrame, method: str, value: str, arm: str, control: object, treated: object, covariates: tuple[str, ...] = ()) -> DataFrame:
    """The effect of ``treated`` against ``control``. Arms are compared as strings;
    with an arm absent the result is empty, never a number."""
    if method not in ESTIMATORS:
        raise ValueError(f"unknown method {method!r}; known: {sorted(ESTIMATORS)}")
    rows = observations.withColumn(arm, F.col(arm).cast("string"))
    return ESTIMATORS[method](rows, value, arm, str(control), str(treated), covariates)


def bound_grid(points: DataFrame, value: str, target: str, lows: tuple[float, ...], highs: tuple[float, ...]) -> DataFrame:
    """For every pair low < high: how well low <= value <= high finds the target
    (F1). A point meets only the cells of the sorted cuts, so the grid is counted
    from one histogram and never joined with the points."""
    lows, highs = tuple(sorted(lows)), tuple(sorted(highs))
    at_low = sum(((F.col(value) >= c).cast("int") for c in lows[1:]), (F.col(value) >= lows[0]).cast("int"))
    at_high = sum(((F.col(value) > c).cast("int") for c in highs[1:]), (F.col(value) > highs[0]).cast("int"))
    cells = points.where(F.col(value).isNotNull()).groupBy(at_low.alias("a"), at_high.alias("b")).agg(F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg"))
    spark = points.sparkSession
    grid = spark.createDataFrame([(i + 1, j, float(low), float(high)) for i, low in enumerate(lows) for j, high in enumerate(highs) if low < high], "i int, j int, low double, high double")
    # at least i lows reached and at most j highs passed
    hit = (F.col("a") >= F.col("i")) & (F.col("b") <= F.col("j"))
    rows = cells.crossJoin(F.broadcast(grid)).groupBy("low", "high").agg(  # the grid is given in the call
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn")
    )
    return rows.withColumn("f1", 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)))


def two_stage_bounds(points: DataFrame, value: str, target: str, lows: tuple[float, ...], highs: tuple[float, ...], floor: float = 0.0, points_each: int = 9) -> DataFrame:
    """The best bounds of a coarse grid, then of a finer one between its neighbours;
    ``floor`` is the least that a lower bound may be. One row, or none without a
    target."""
    for stage in range(2):
        rows = bound_grid(points, value, target, tuple(x for x in lows if x >= floor), highs).where("f1 is not null").orderBy(F.desc("f1"), "low", "high").limit(1)
        found = rows.collect()
        if not found or stage:
            return rows

        def near(grid: tuple[float, ...], best: float) -> tuple[float, ...]:
            grid = sorted(grid)
            at = grid.index(best)
            a, b = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
            return tuple(sorted({a + (b - a) * k / (points_each - 1) for k in range(points_each)} | {best}))

        lows, highs = near(lows, found[0]["low"]), near(highs, found[0]["high"])
    return rows


def suite(observations: DataFrame, value: str, arm: str = "T", control: object | None = None) -> DataFrame:
    """All tests of one outcome: the overall F, and each pair of arms (or each arm
    against ``control``) by Welch, with p and p after Holm. Rows: test, t0, t1, effect,
    statistic, df, p, p_holm."""
    from ..functions.stats import f_tail
    from . import multiplicity
    from .resample import anova

    each = effects.versus_control(observations, value, control, arm) if control is not None else effects.matrix(observations, value, arm)
    each = multiplicity.holm(effects.with_p(each, sides=2))
    none = F.lit(None)
    overall = anova(observations, value, arm).select(
        F.lit("anova").alias("test"), none.cast("string").alias("t0"), none.cast("string").alias("t1"), none.cast("double").alias("effect"), F.col("f").alias("statistic"),
        F.col("df2").cast("double").alias("df"), f_tail(F.col("f"), F.col("df1"), F.col("df2")).alias("p"), none.cast("double").alias("p_holm"),
    )
    pairs = each.select(F.lit("welch").alias("test"), F.col("t0").cast("string").alias("t0"), F.col("t1").cast("string").alias("t1"), F.col("ate").alias("effect"), F.col("t").alias("statistic"), "df", "p", "p_holm")
    return overall.unionByName(pairs)


def near_best(df: DataFrame, score: str, share: float, most: int, *tie: Column) -> DataFrame:
    """Rows within ``share`` of the best score, at most ``most`` of them."""
    best = df.agg(F.max(score).alias("_best"))
    rows = df.crossJoin(F.broadcast(best)).where(F.col(score) >= share * F.col("_best"))  # one row
    return rows.drop("_best").orderBy(F.desc(score), *tie).limit(most)


def staged(stages: list[tuple[str, tuple]], start: dict, run: Callable[[dict], float], known: dict | None = None) -> tuple[dict, list[tuple[dict, float]]]:
    """Greedy search: each stage tries the values of one parameter with the best of
    those before it. ``run`` gives a score for a setting; settings in ``known`` (by
    sorted items) aren't run again. Returns the best setting and all runs."""
    known, best, runs = dict(known or {}), dict(start), []
    for name, values in stages:
        tried = []
        for v in values:
            setting = best | {name: v}
            key = tuple(sorted(setting.items()))
            if key not in known:
                known[key] = run(setting)
            tried.append((setting, known[key]))
        runs += tried
        best = max(tried, key=lambda x: x[1])[0]
    return best, runs


def merged(*settings: dict) -> dict:
    """Nested settings, later ones winning key by key."""
    out: dict = {}
    for s in settings:
        for k, v in s.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
