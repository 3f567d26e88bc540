"""Treatment effects from observation-level tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import t_cdf, t_two_sided
from .aggregate import arm_summary


def moments(df: DataFrame, value: str, by: tuple[str, ...] = ("T",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def pairs(arms: DataFrame, arm: str = "T", keep: tuple[str, ...] = ()) -> DataFrame:
    """All pairs (t0 < t1) of rows of a table with a row for each arm (and values
    of ``keep``, which both share); columns of the two sides end in 0 and 1."""
    rest = [c for c in arms.columns if c != arm and c not in keep]
    a = arms.select(F.col(arm).alias("t0"), *keep, *[F.col(c).alias(f"{c}0") for c in rest])
    b = arms.select(F.col(arm).alias("t1"), *[F.col(c).alias(f"_{c}") for c in keep], *[F.col(c).alias(f"{c}1") for c in rest])
    on = F.col("t0") < F.col("t1")
    for c in keep:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return a.join(b, on).drop(*[f"_{c}" for c in keep])


def difference(paired: DataFrame) -> DataFrame:
    """ate and its Welch standard error from (n, mean, var) of both sides."""
    return paired.withColumns(
        {"ate": F.col("mean1") - F.col("mean0"), "se": F.sqrt(F.col("var1") / F.col("n1") + F.col("var0") / F.col("n0"))}
    )


def _pseudo_effects(paired: DataFrame) -> DataFrame:
    """Statistic and degrees of freedom of the one-sample t over {y1 - mean0} and
    {mean1 - y0}, from the two sides' moments alone: all have mean ate, so their
    squares about it are those of the sides about their own means."""
    n = F.col("n0") + F.col("n1")
    squares = (F.col("n0") - 1) * F.coalesce("var0", F.lit(0.0)) + (F.col("n1") - 1) * F.coalesce("var1", F.lit(0.0))
    sd = F.sqrt(squares / F.nullif(n - 1, F.lit(0)))
    return paired.withColumns({"t": F.col("ate") / F.nullif(sd / F.sqrt(n), F.lit(0.0)), "df": (n - 1).cast("double")})


def difference_in_means(observations: DataFrame, value: str, arm: str = "T") -> DataFrame:
    """All pairs of arms: ate, se, and t and df of the pseudo-effects."""
    return _pseudo_effects(difference(pairs(moments(observations, value, (arm,)), arm)))


def with_p(df: DataFrame, sides: int = 1, name: str = "p") -> DataFrame:
    """Adds the p-value of (t, df): one-sided in the direction of t, or two-sided."""
    p = F.lit(1.0) - t_cdf(F.abs("t"), F.col("df")) if sides == 1 else t_two_sided(F.col("t"), F.col("df"))
    return df.withColumn(name, p)


def bias_of_predictions(observations: DataFrame, outcomes: dict[str, str], arm: str = "T", annotated: str = "has_annotations") -> DataFrame:
    """For each pair of arms and outcome: the effect in true outcomes (annotated
    observations only), in predictions (all), and their difference."""
    each = F.explode(F.array(*[F.struct(F.lit(y).alias("outcome"), F.col(y).alias("y"), F.col(p).alias("yhat")) for y, p in outcomes.items()]))
    rows = observations.select(arm, annotated, each.alias("o")).select(arm, annotated, "o.*")
    true = F.when(F.col(annotated) == 1, F.col("y"))
    arms = rows.groupBy("outcome", arm).agg(
        F.count(true).alias("n"), F.avg(true).alias("mean"), F.var_samp(true).alias("var"),
        F.count("yhat").alias("m"), F.avg("yhat").alias("guess"), F.var_samp("yhat").alias("spread"),
    )
    both = pairs(arms, arm, ("outcome",))
    return both.select(
        "t0", "t1", "outcome",
        (F.col("mean1") - F.col("mean0")).alias("ate_true"),
        F.sqrt(F.col("var1") / F.nullif("n1", F.lit(0)) + F.col("var0") / F.nullif("n0", F.lit(0))).alias("ate_true_std"),
        (F.col("guess1") - F.col("guess0")).alias("ate_pred"),
        F.sqrt(F.col("spread1") / F.nullif("m1", F.lit(0)) + F.col("spread0") / F.nullif("m0", F.lit(0))).alias("ate_pred_std"),
        (F.col("guess1") - F.col("guess0") - (F.col("mean1") - F.col("mean0"))).alias("bias"),
        (F.col("n0") + F.col("n1")).alias("n_true"), (F.col("m0") + F.col("m1")).alias("n_pred"),
    )


def average_bias(effects: DataFrame) -> DataFrame:
    """Means over pairs, of the bias in absolute value with its 1.96 se."""
    return effects.groupBy("outcome").agg(
        F.avg("ate_true").alias("ate_true"), F.avg("ate_pred").alias("ate_pred"), F.avg(F.abs("bias")).alias("abs_bias"),
        (F.lit(1.96) * F.stddev_samp(F.abs("bias")) / F.sqrt(F.count("bias"))).alias("abs_bias_ci"), F.count(F.lit(1)).alias("n_pairs"),
    )


def welch(paired: DataFrame) -> DataFrame:
    """Adds t and df of Welch's test to (n, mean, var) of both sides."""
    a, b = F.col("var0") / F.col("n0"), F.col("var1") / F.col("n1")
    df = difference(paired)
    return df.withColumns(
        {
            "t": F.col("ate") / F.nullif("se", F.lit(0.0)),
            "df": (a + b) * (a + b) / F.nullif(a * a / (F.col("n0") - 1) + b * b / (F.col("n1") - 1), F.lit(0.0)),
        }
    )


def cohens_d() -> Column:
    """The difference over the pooled standard deviation; 0 where that is 0. For
    tables with (n, mean, var) of both sides."""
    pooled = ((F.col("n0") - 1) * F.col("var0") + (F.col("n1") - 1) * F.col("var1")) / F.nullif(F.col("n0") + F.col("n1") - 2, F.lit(0))
    return F.when(pooled > 0, (F.col("mean1") - F.col("mean0")) / F.sqrt(pooled)).when(pooled.isNotNull(), 0.0)


def matrix(observations: DataFrame, value: str, arm: str = "T") -> DataFrame:
    """Welch's test for each pair of arms."""
    return welch(pairs(moments(observations, value, (arm,)), arm)).select("t0", "t1", "ate", "se", "t", "df")


def paired_change(df: DataFrame, value: str, unit: str, phase: str, before: object, after: object, by: tuple[str, ...] = ()) -> DataFrame:
    """The change of units seen in both phases: n, ate, se, t, df and d."""
    deltas = unit_changes(df, value, unit, phase, before, after, by)
    return _one_sample(deltas.groupBy(*by).agg(F.count("delta").alias("n"), F.avg("delta").alias("ate"), F.stddev_samp("delta").alias("sd")))


def unit_changes(df: DataFrame, value: str, unit: str, phase: str, before: object, after: object, by: tuple[str, ...] = ()) -> DataFrame:
    a, b = (F.avg(F.when(F.col(phase) == p, F.col(value))) for p in (before, after))
    return df.groupBy(unit, *by).agg((b - a).alias("delta")).where("delta is not null")


def _one_sample(stats: DataFrame) -> DataFrame:
    return stats.where("n >= 2").withColumns(
        {
            "se": F.col("sd") / F.sqrt("n"),
            "t": F.col("ate") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0)),
            "df": (F.col("n") - 1).cast("double"),
            "d": F.col("ate") / F.nullif("sd", F.lit(0.0)),
        }
    ).drop("sd")


def contrast(df: DataFrame, value: str, group: str, control: object, treated: object, stratum: str | None = None) -> DataFrame:
    """Welch's test and d of two groups, over all and within each stratum, by
    grouping sets in one pass."""
    two = df.where(F.col(group).isin(control, treated))
    if stratum:
        two = two.withColumn("_s", F.explode(F.array(F.lit("All"), F.col(stratum).cast("string"))))
    else:
        two = two.withColumn("_s", F.lit("All"))
    out = []
    for k, g in enumerate((control, treated)):
        y = F.when(F.col(group) == g, F.col(value))
        out += [F.count(y).alias(f"n{k}"), F.avg(y).alias(f"mean{k}"), F.var_samp(y).alias(f"var{k}")]
    tested = welch(two.groupBy(F.col("_s").alias("stratum")).agg(*out).where("n0 > 0 and n1 > 0"))
    return tested.withColumn("d", cohens_d()).select("stratum", "n0", "n1", "ate", "se", "t", "df", "d")


def interaction(df: DataFrame, value: str, unit: str, phase: str, before: object, after: object, group: str, control: object, treated: object) -> DataFrame:
    """The difference between two groups in their units' changes."""
    deltas = unit_changes(df, value, unit, phase, before, after, (group,))
    return contrast(deltas, "delta", group, control, treated)


def doubly_robust(observations: DataFrame, value: str, arm: str, control: object, treated: object, cell: str) -> DataFrame:
    """AIPW with cell means: within each cell of the covariate the propensity is the
    share treated, kept in [0.05, 0.95], and outcomes are the arms' means there (the
    overall ones where an arm is absent)."""
    two = observations.where(F.col(arm).isin(control, treated) & F.col(value).isNotNull())
    t, y = (F.col(arm) == treated).cast("double"), F.col(value).cast("double")
    y1, y0 = F.when(t == 1, y), F.when(t == 0, y)
    cells = two.groupBy(F.col(cell).alias("_cell")).agg(F.avg(t).alias("e"), F.avg(y1).alias("m1"), F.avg(y0).alias("m0"))
    whole = two.agg(F.avg(y1).alias("a1"), F.avg(y0).alias("a0"))
    rows = two.join(cells, F.col(cell).eqNullSafe(F.col("_cell"))).crossJoin(F.broadcast(whole))  # one row
    m1, m0 = F.coalesce("m1", "a1"), F.coalesce("m0", "a0")
    e = F.least(F.greatest("e", F.lit(0.05)), F.lit(0.95))
    effect = m1 - m0 + t * (y - m1) / e - (1 - t) * (y - m0) / (1 - e)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(effect).alias("ate"), F.sqrt(F.var_samp(effect) / F.count(F.lit(1))).alias("se"))
    return stats.withColumns({"t": F.col("ate") / F.nullif("se", F.lit(0.0)), "df": (F.col("n") - 1).cast("double")})


def versus_control(observations: DataFrame, value: str, control: object, arm: str = "T") -> DataFrame:
    """Each other arm against one."""
    arms = arm_summary(observations, value, arm).withColumn("var", F.col("std") * F.col("std")).select(arm, "n", "mean", "var")
    base = arms.where(F.col(arm) == control).select(F.col(arm).alias("t0"), *[F.col(c).alias(f"{c}0") for c in ("n", "mean", "var")])
    rest = arms.where(F.col(arm) != control).select(F.col(arm).alias("t1"), *[F.col(c).alias(f"{c}1") for c in ("n", "mean", "var")])
    return welch(rest.crossJoin(F.broadcast(base))).select("t0", "t1", "ate", "se", "t", "df")  # one row
