"""Classification and regression metrics, and agreement of raters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(y: Column, guess: Column) -> dict[str, Column]:
    """Counts of 0/1 values; rows with a null on either side don't count."""
    return {
        "tp": F.count_if((y == 1) & (guess == 1)), "fp": F.count_if((y == 0) & (guess == 1)),
        "fn": F.count_if((y == 1) & (guess == 0)), "tn": F.count_if((y == 0) & (guess == 0)),
    }


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    r = a / F.nullif(b, F.lit(0))
    return r if empty is None else F.coalesce(r, F.lit(empty))


def with_rates(counts: DataFrame, empty: float | None = None) -> DataFrame:
    """accuracy, balanced accuracy, recall, precision, specificity, fpr and fnr of
    tp, fp, fn and tn; ``empty`` where a denominator is 0 (null by default)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = ratio(tp, tp + fn, empty), ratio(tn, tn + fp, empty)
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + fn + tn, empty), "balanced": (recall + specificity) / 2, "recall": recall,
            "precision": ratio(tp, tp + fp, empty), "specificity": specificity, "fpr": ratio(fp, fp + tn, empty), "fnr": ratio(fn, fn + tp, empty),
        }
    )


def binary_metrics(df: DataFrame, outcomes: dict[str, str], by: tuple[str, ...] = (), empty: float | None = 0.0) -> DataFrame:
    """Metrics of each outcome against its prediction, which rounds half to even."""
    each = F.explode(F.array(*[F.struct(F.lit(y).alias("outcome"), F.col(y).cast("double").alias("y"), F.rint(F.col(p)).alias("g")) for y, p in outcomes.items()]))
    rows = df.select(*by, each.alias("o")).select(*by, "o.*")
    counts = rows.groupBy(*by, "outcome").agg(*[c.cast("long").alias(n) for n, c in confusion(F.col("y"), F.col("g")).items()])
    return with_rates(counts, empty)


def continuous_metrics(df: DataFrame, y: str, guess: str, by: tuple[str, ...] = ()) -> DataFrame:
    gap = F.col(y) - F.col(guess)
    return df.groupBy(*by).agg(F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"), F.count(gap).alias("n"))


def outcome_metrics(df: DataFrame, outcomes: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Metrics of each outcome against its prediction by the kind of the outcome: rates
    where all its values (of the whole table) are 0 or 1, mse and mae otherwise; the other
    ones are null."""
    each = F.explode(F.array(*[F.struct(F.lit(y).alias("outcome"), F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("g")) for y, p in outcomes.items()]))
    rows = df.select(*by, each.alias("o")).select(*by, "o.*")
    gap, binary = F.col("y") - F.col("g"), F.bool_and(F.col("y").isin(0.0, 1.0))
    counts = rows.groupBy(*by, "outcome").agg(
        *[c.cast("long").alias(n) for n, c in confusion(F.col("y"), F.rint("g")).items()], F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"), binary.alias("_own")
    )
    kinds = counts.groupBy("outcome").agg(F.coalesce(F.bool_and("_own"), F.lit(True)).alias("binary"))
    rated = with_rates(counts.drop("_own"), 0.0).join(kinds, "outcome")
    shown = {c: F.when(F.col("binary"), F.col(c)) for c in ("accuracy", "balanced", "recall", "precision")} | {c: F.when(~F.col("binary"), F.col(c)) for c in ("mse", "mae")}
    return rated.select(*by, "outcome", "binary", *[c.alias(n) for n, c in shown.items()])


def macro(metrics: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Means over outcomes; nulls don't count."""
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def multiclass(df: DataFrame, y: str, guess: str, classes: int) -> DataFrame:
    """Recall and precision of every class, 0 for those that never come, with n."""
    numbers = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    actual = df.groupBy(F.col(y).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == F.col(guess)).alias("hits"))
    given = df.groupBy(F.col(guess).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n_given"))
    rows = numbers.join(actual, "class", "left").join(given, "class", "left").na.fill(0)
    return rows.select(
        "class", "n", (F.col("hits") / F.greatest("n", F.lit(1))).alias("recall"), (F.col("hits") / F.greatest("n_given", F.lit(1))).alias("precision")
    )


def rater_agreement(ratings: DataFrame, unit: str = "video", frame: str = "frame_idx", rater: str = "rater", y: str = "y") -> DataFrame:
    """For each unit and pair of raters, over the frames both rated: balanced
    accuracy either way, the smaller of them, kappa, and the share in which they
    differ of the frames that either marks."""
    a = ratings.select(unit, frame, F.col(rater).alias("a"), F.col(y).alias("y1"))
    b = ratings.select(unit, frame, F.col(rater).alias("b"), F.col(y).alias("y2"))
    both = a.join(b, [unit, frame]).where("a < b")
    n = confusion(F.col("y1"), F.col("y2"))
    per = both.groupBy(unit, "a", "b").agg(*[v.cast("long").alias(k) for k, v in n.items()])
    return _agreement(per)


def _agreement(per: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    forward = (ratio(tp, tp + fn, 0.0) + ratio(tn, tn + fp, 0.0)) / 2
    back = (ratio(tp, tp + fp, 0.0) + ratio(tn, tn + fn, 0.0)) / 2
    chance = ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n)
    return per.withColumns(
        {
            "n": n.cast("long"), "ba_12": forward, "ba_21": back, "ia_ba": F.least(forward, back),
            "kappa": ratio((tp + tn) / n - chance, 1 - chance), "disagree_pos": ratio(fp + fn, tp + fp + fn), "disagree": (fp + fn) / n,
        }
    ).drop("tp", "fp", "fn", "tn")


def worst_pair(agreement: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The least, over pairs of raters, of their mean agreement over units."""
    per = agreement.groupBy(*by, "a", "b").agg(F.avg("ia_ba").alias("mean"))
    return per.groupBy(*by).agg(F.min("mean").alias("worst"), F.avg("mean").alias("mean"), F.max("mean").alias("best"))


def mixed_bound(shares: DataFrame, agreement: DataFrame) -> DataFrame:
    """The accuracy that one of raters with these shares of the frames can reach
    against another drawn the same way: 1 with oneself, else their agreement."""
    a, b = shares.select(F.col("rater").alias("a"), F.col("share").alias("f")), shares.select(F.col("rater").alias("b"), F.col("share").alias("g"))
    means = agreement.groupBy("a", "b").agg(F.avg("ia_ba").alias("m"))
    either = means.unionByName(means.select(F.col("b").alias("a"), F.col("a").alias("b"), "m")).unionByName(shares.select(F.col("rater").alias("a"), F.col("rater").alias("b"), F.lit(1.0).alias("m")))
    rows = either.join(a, "a").join(b, "b")
    w = F.col("f") * F.col("g")
    return rows.agg((F.sum(w * F.col("m")) / F.sum(w)).alias("bound"))


def both_ways(pairs: DataFrame, value: str) -> DataFrame:
    """The long form of a symmetric matrix, ones on its diagonal left out."""
    there = pairs.select(F.col("a").alias("row"), F.col("b").alias("column"), value)
    return there.unionByName(pairs.select(F.col("b").alias("row"), F.col("a").alias("column"), value))


def disagreement_tags(ratings: DataFrame, k: int, key: str = "video", order: str = "frame_idx") -> DataFrame:
    """For each frame where raters y1 and y2 differ: event (one marks nothing within
    k rows), boundary (both do), and start or end by which side the other's marks
    lie on."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order).rowsBetween(-k, k)
    ahead, behind = Window.partitionBy(key).orderBy(order).rowsBetween(1, k), Window.partitionBy(key).orderBy(order).rowsBetween(-k, -1)
    both = F.least(F.col("y1"), F.col("y2"))
    rows = ratings.withColumns(
        {"m1": F.max("y1").over(w), "m2": F.max("y2").over(w), "after": F.max(both).over(ahead), "before": F.max(both).over(behind)}
    ).where("y1 <> y2")
    tags = F.array_compact(
        F.array(
            F.when((F.col("m1") == 0) | (F.col("m2") == 0), "event"),
            F.when((F.col("m1") == 1) & (F.col("m2") == 1), "boundary"),
            F.when((F.col("after") == 1) & (F.coalesce("before", F.lit(0)) == 0), "start"),
            F.when((F.col("before") == 1) & (F.coalesce("after", F.lit(0)) == 0), "end"),
        )
    )
    return rows.select(key, order, "y1", "y2", tags.alias("tags"))
