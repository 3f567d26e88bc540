"""Corrections for many tests.

Equal p-values get equal corrections, so the distinct ones are counted, dealt into
buckets (``stats.with_places``) and worked on there; what a bucket needs of the others
is one row a bucket. No task sorts a family, however many tests it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import same_keys, with_places


def _corrected(df: DataFrame, p: str, by: tuple[str, ...], name: str, step: Column, most: bool) -> DataFrame:
    """``step`` of ``_before``, ``_n`` (rows before a p-value, and with it) and
    ``_all`` (the family's); its largest value up to a p-value, or its smallest from it
    on, at most 1. A null p-value is no test and gets null."""
    known = df.where(F.col(p).isNotNull())
    values = known.groupBy(*by, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = values.groupBy(*by).agg(F.sum("_n").alias("_all"))
    placed = with_places(values, "_p", "_n", by, bucket="_bucket")
    placed = placed.join(sizes.toDF(*[f"_g{i}" for i in range(len(by))], "_all"), same_keys(by, "_g")) if by else placed.crossJoin(F.broadcast(sizes))  # one row
    placed = placed.select(*by, "_p", "_bucket", step.alias("_step"))
    best, first, past = (F.max, "_bucket", "_p") if most else (F.min, F.desc("_bucket"), F.desc("_p"))
    own = best("_step").over(Window.partitionBy(*by, "_bucket").orderBy(past).rowsBetween(Window.unboundedPreceding, 0))
    tops = placed.groupBy(*by, "_bucket").agg(best("_step").alias("_top"))
    carried = best("_top").over(Window.partitionBy(*by).orderBy(first).rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_b"), carried.alias("_carried"))
    within = placed.withColumn("_own", own).join(tops, same_keys(by, "_g") & (F.col("_bucket") == F.col("_b")))
    # greatest and least pass over the null that the first bucket carries
    over = F.greatest("_own", "_carried") if most else F.least("_own", "_carried")
    found = within.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(by)], "_p", F.least(F.lit(1.0), over).alias(name))
    joined = df.join(found, same_keys(by, "_r") & (F.col(p) == F.col("_p")), "left")
    return joined.drop("_p", *[f"_r{i}" for i in range(len(by))])


def holm(df: DataFrame, p: str = "p", by: tuple[str, ...] = (), name: str = "p_holm") -> DataFrame:
    """Holm's correction within each family of ``by``."""
    # of equal p-values the first has the largest step
    return _corrected(df, p, by, name, (F.col("_all") - F.col("_before")) * F.col("_p"), True)


def benjamini_hochberg(df: DataFrame, p: str = "p", by: tuple[str, ...] = (), name: str = "q") -> DataFrame:
    """Benjamini and Hochberg's correction within each family of ``by``."""
    # of equal p-values the last has the smallest step
    return _corrected(df, p, by, name, F.col("_all") * F.col("_p") / (F.col("_before") + F.col("_n")), False)
