"""Effects with learned nuisances: meta-learners, AIPW with forests, and linear
probes. Models are Spark's own; rows stay distributed."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import staging


def _prepared(df: DataFrame, value: str, arm: str, control: object, treated: object, covariates: tuple[str, ...]) -> DataFrame:
    two = df.where(F.col(arm).isin(control, treated) & F.col(value).isNotNull())
    rows = two.select(F.col(value).cast("double").alias("y"), (F.col(arm) == treated).cast("double").alias("t"), *[F.col(c).cast("double").alias(c) for c in covariates])
    rows = rows.withColumn("w", F.xxhash64(*covariates, "y", "t"))
    # a fit runs some ten passes: over the few columns written aside each takes few tasks,
    # and the driver hears from tasks in proportion to these, not to what made them
    rows, _ = staging.staged(rows)
    assembled = VectorAssembler(inputCols=list(covariates), outputCol="x").transform(rows)
    return VectorAssembler(inputCols=[*covariates, "t"], outputCol="xt").transform(assembled)


def _regressor(features: str, label: str, trees: int):
    return GBTRegressor(featuresCol=features, labelCol=label, predictionCol="_p", maxIter=trees, maxDepth=3, seed=1)


def _predict(model, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).withColumn(name, F.col("_p")).drop("_p")


def _summary(rows: DataFrame, effect: Column) -> DataFrame:
    n = F.count(F.lit(1))
    out = rows.agg(n.alias("n"), F.avg(effect).alias("ate"), F.sqrt(F.var_samp(effect) / n).alias("se"))
    return out.withColumns({"t": F.col("ate") / F.nullif("se", F.lit(0.0)), "df": (F.col("n") - 1).cast("double")})


def propensity(rows: DataFrame) -> DataFrame:
    """Adds e, kept in [0.05, 0.95]."""
    model = RandomForestClassifier(featuresCol="x", labelCol="t", numTrees=50, maxDepth=4, minInstancesPerNode=5, seed=1).fit(rows)
    p = vector_to_array(F.col("probability"))[1]
    return model.transform(rows).withColumn("e", F.least(F.greatest(p, F.lit(0.05)), F.lit(0.95))).drop("rawPrediction", "probability", "prediction")


def aipw_forest(df: DataFrame, value: str, arm: str, control: object, treated: object, covariates: tuple[str, ...]) -> DataFrame:
    rows = propensity(_prepared(df, value, arm, control, treated, covariates))
    model = RandomForestRegressor(featuresCol="xt", labelCol="y", predictionCol="_p", numTrees=50, maxDepth=4, minInstancesPerNode=5, seed=1).fit(rows)
    for t in (0, 1):
        rows = _predict(model, _with_arm(rows, covariates, t), f"m{t}")
    t, y, e = F.col("t"), F.col("y"), F.col("e")
    return _summary(rows, F.col("m1") - F.col("m0") + t * (y - F.col("m1")) / e - (1 - t) * (y - F.col("m0")) / (1 - e))


def _with_arm(rows: DataFrame, covariates: tuple[str, ...], t: int) -> DataFrame:
    """``xt`` as if all were in this arm."""
    return rows.withColumn("xt", array_to_vector(F.array(*[F.col(c) for c in covariates], F.lit(float(t)))))


def s_learner(df: DataFrame, value: str, arm: str, control: object, treated: object, covariates: tuple[str, ...], trees: int = 10) -> DataFrame:
    rows = _prepared(df, value, arm, control, treated, covariates)
    model = _regressor("xt", "y", trees).fit(rows)
    for t in (0, 1):
        rows = _predict(model, _with_arm(rows, covariates, t), f"m{t}")
    return _summary(rows, F.col("m1") - F.col("m0"))


def _per_arm(rows: DataFrame, trees: int) -> DataFrame:
    for t in (0, 1):
        rows = _predict(_regressor("x", "y", trees).fit(rows.where(F.col("t") == t)), rows, f"m{t}")
    return rows


def t_learner(df: DataFrame, value: str, arm: str, control: object, treated: object, covariates: tuple[str, ...], trees: int = 10) -> DataFrame:
    return _summary(_per_arm(_prepared(df, value, arm, control, treated, covariates), trees), F.col("m1") - F.col("m0"))


def x_learner(df: DataFrame, value: str, arm: str, control: object, treated: object, covariates: tuple[str, ...], trees: int = 10) -> DataFrame:
    rows = propensity(_per_arm(_prepared(df, value, arm, control, treated, covariates), trees))
    rows = rows.withColumn("d", F.when(F.col("t") == 1, F.col("y") - F.col("m0")).otherwise(F.col("m1") - F.col("y")))
    for t in (0, 1):
        rows = _predict(_regressor("x", "d", trees).fit(rows.where(F.col("t") == t)), rows, f"d{t}")
    return _summary(rows, F.col("e") * F.col("d0") + (1 - F.col("e")) * F.col("d1"))


def dr_learner(df: DataFrame, value: str, arm: str, control: object, treated: object, covariates: tuple[str, ...], trees: int = 10) -> DataFrame:
    rows = propensity(_per_arm(_prepared(df, value, arm, control, treated, covariates), trees))
    t, y, e = F.col("t"), F.col("y"), F.col("e")
    rows = rows.withColumn("d", F.col("m1") - F.col("m0") + t * (y - F.col("m1")) / e - (1 - t) * (y - F.col("m0")) / (1 - e))
    return _summary(_predict(_regressor("x", "d", trees).fit(rows), rows, "tau"), F.col("tau"))


def linear_probe(df: DataFrame, vector: str, y: str, weight: str | None = None, rounds: int = 20):
    """A fitted logistic regression on vectors, weighted if asked (as by DERM)."""
    rows = df.where(F.col(y).isNotNull()).withColumn("_x", array_to_vector(F.col(vector).cast("array<double>"))).withColumn("_y", F.col(y).cast("double"))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=rounds, regParam=0.01)
    return (model.setWeightCol(weight) if weight else model).fit(rows)


def probe_scores(model, df: DataFrame, vector: str, name: str = "yhat") -> DataFrame:
    rows = df.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>")))
    scored = model.transform(rows).withColumn(name, vector_to_array(F.col("probability"))[1])
    return scored.drop("_x", "rawPrediction", "probability", "prediction")


def invariant_probe(df: DataFrame, features: tuple[str, ...], y: str, env: str, penalty: float = 1.0, rounds: int = 30, rate: float = 1.0, kind: str = "variance", tries: int = 2) -> list[float]:
    """Logistic weights (bias last) that make small the mean loss of environments and
    ``penalty`` times what differs among them: the variance of their losses, or, with
    ``kind`` irm, the square of each one's slope in a common scale of the logits.

    A round is one aggregation that sums losses and slopes by environment; the weights
    of the best round are kept. A run whose last loss is above its first is tried again,
    up to ``tries`` times, at a third of the rate.
    """
    if kind not in ("variance", "irm"):
        raise ValueError(f"unknown penalty {kind!r}")
    rows = df.where(F.col(y).isNotNull()).select(F.col(env).alias("e"), F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in features]).cache()

    def summed(w: list[float]) -> tuple[float, list[float]]:
        x = [*[F.col(c) for c in features], F.lit(1.0)]
        logit = sum((F.lit(a) * c for a, c in zip(w, x)), F.lit(0.0))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
        safe = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
        loss = -(F.col("y") * F.log(safe) + (1 - F.col("y")) * F.log(1 - safe))
        off = p - F.col("y")
        # the slope of the loss in a factor of the logits, and how it moves with each weight
        turn = [F.avg(c * (off + p * (1 - p) * logit)).alias(f"t{i}") for i, c in enumerate(x)]
        sums = rows.groupBy("e").agg(F.avg(loss).alias("loss"), F.avg(off * logit).alias("s"), *[F.avg(off * c).alias(f"g{i}") for i, c in enumerate(x)], *turn).collect()
        mean, at = sum(s["loss"] for s in sums) / len(sums), range(len(w))
        if kind == "irm":
            total = mean + penalty * sum(s["s"] ** 2 for s in sums) / len(sums)
            return total, [sum(s[f"g{i}"] + 2 * penalty * s["s"] * s[f"t{i}"] for s in sums) / len(sums) for i in at]
        total = mean + penalty * sum((s["loss"] - mean) ** 2 for s in sums) / len(sums)
        return total, [sum((1 + 2 * penalty * (s["loss"] - mean)) * s[f"g{i}"] for s in sums) / len(sums) for i in at]

    try:
        for _ in range(tries + 1):
            w, seen = [0.0] * (len(features) + 1), []
            for _ in range(rounds):
                total, grad = summed(w)
                seen.append((total, w))
                w = [a - rate * g for a, g in zip(w, grad)]
            seen.append((summed(w)[0], w))
            if seen[-1][0] <= seen[0][0]:
                break
            rate /= 3
    finally:
        rows.unpersist()
    return min(seen, key=lambda x: x[0])[1]


def mixed_up(df: DataFrame, vector: str, y: str, share: float, seed: int, unit: str = "frame_idx") -> DataFrame:
    """Each row mixed with the next one, by a hash of ``unit``, of the same of 256
    buckets: x and y move ``share`` of the way to their partner's; the last of a bucket
    stays."""
    from pyspark.sql import Window

    from .resample import hash_order

    w = Window.partitionBy(F.substring(hash_order(unit, seed=seed), 1, 2)).orderBy(hash_order(unit, seed=seed + 1), unit)
    rows = df.withColumns({"_x": F.coalesce(F.lead(vector).over(w), F.col(vector)), "_y": F.coalesce(F.lead(y).over(w), F.col(y))})
    mixed = F.zip_with(vector, "_x", lambda a, b: a * (1 - share) + b * share)
    return rows.withColumns({vector: mixed, y: F.col(y) * (1 - share) + F.col("_y") * share}).drop("_x", "_y")


def two_pass(df: DataFrame, fit, loss, is_val: str, epochs: tuple[int, ...]) -> tuple[int, object]:
    """The number of epochs with the least loss on validation rows of a model fitted to
    the others, and a model fitted to all rows with it. ``fit(rows, epochs)`` gives a
    model, ``loss(model, rows)`` a number."""
    train, val = df.where(~F.col(is_val)), df.where(is_val)
    best = min(epochs, key=lambda n: (loss(fit(train, n), val), n))
    return best, fit(df, best)
