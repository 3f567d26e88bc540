"""Permutation tests, bootstrap, splits and samples from hashes, so that they are the
same in each run and on any cluster. Tests and intervals work on the sums by arm that
``replicates`` makes; ``permuted`` gives the dealt rows themselves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import normal_two_sided, with_places
from .folds import fold_stretches
from .replicates import bootstrap_sums, permuted_sums


def hash_order(*columns: str, seed: int | str = 0) -> Column:
    """A pseudo-random order that other engines can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def with_hash_rank(df: DataFrame, unit: str, seed: int | str, name: str = "_k") -> DataFrame:
    """The place (from 1) of each row in the hash order of its unit. Rows are ranked
    within the 4096 buckets of the hash's first digits, whose counts are added up
    apart, so that no task has to order all rows."""
    dealt = df.withColumn("_h", hash_order(unit, seed=seed)).withColumn("_bucket", F.substring("_h", 1, 3))
    counts = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    lower = F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("_bucket").alias("_b"), lower.alias("_lower"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", unit))
    ranked = dealt.withColumn("_own", own).join(F.broadcast(offsets), F.col("_bucket") == F.col("_b"))  # 4096 rows at most
    return ranked.withColumn(name, F.col("_own") + F.col("_lower")).drop("_h", "_bucket", "_b", "_lower", "_own")


def anova(df: DataFrame, value: str, arm: str, by: tuple[str, ...] = ()) -> DataFrame:
    """F and its degrees of freedom."""
    return _anova_of(df.groupBy(*by, arm).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")), *by)


def permuted(df: DataFrame, unit: str, arm: str, n: int, seed: int = 0, blocks: tuple[str, ...] = ()) -> DataFrame:
    """``n`` copies of ``df`` with the arms dealt anew (within blocks): in a random
    order of the units, the first ones get the first arm, as many as have it, and so
    on. Places are found in the 256 buckets of each order's hash, whose counts are
    added up apart, so a replicate is never sorted in one task."""
    rows = df.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_h", hash_order("_rep", unit, seed=seed))
    rows = rows.withColumn("_bucket", F.substring("_h", 1, 2))
    own = ["_rep", *blocks]
    counts = rows.groupBy(*own, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*own).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    lower = counts.select(*own, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lower"))
    place = F.row_number().over(Window.partitionBy(*own, "_bucket").orderBy("_h", unit))
    placed = rows.withColumn("_k", place).join(lower, [*own, "_bucket"]).withColumn("_k", F.col("_k") + F.col("_lower"))
    # how many units the arms up to each have; arms are few
    arms = df.groupBy(*blocks, arm).agg(F.count(F.lit(1)).alias("_n"))
    upto = arms.select(*blocks, F.struct(F.sum("_n").over(Window.partitionBy(*blocks).orderBy(arm)).alias("upto"), F.col(arm).alias("arm")).alias("_a"))
    line = upto.groupBy(*blocks).agg(F.array_sort(F.collect_list("_a")).alias("_arms"))
    dealt = placed.join(line, list(blocks)) if blocks else placed.crossJoin(F.broadcast(line))  # one row
    new = F.get(F.filter("_arms", lambda x: x["upto"] >= F.col("_k")), 0)["arm"]
    return dealt.withColumn(arm, new).drop("_k", "_h", "_bucket", "_lower", "_arms")


def _anova_of(sums: DataFrame, *by: str) -> DataFrame:
    """F and its degrees of freedom from n, s and q by arm."""
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")
    within = F.sum("q") - F.sum(F.col("s") * F.col("s") / F.col("n"))
    k, n = F.count(F.lit(1)), F.sum("n")
    return sums.where("n > 0").groupBy(*by).agg(
        ((between / (k - 1)) / F.nullif(within / (n - k), F.lit(0.0))).alias("f"), (k - 1).cast("long").alias("df1"), (n - k).cast("long").alias("df2")
    )


def permutation_anova(df: DataFrame, value: str, unit: str, arm: str, n: int = 20000, seed: int = 0, blocks: tuple[str, ...] = ()) -> DataFrame:
    """F with p = (1 + replicates at least as large) / (n + 1)."""
    seen = anova(df, value, arm)
    reps = _anova_of(permuted_sums(df, value, unit, arm, n, seed, blocks), "_rep").select(F.col("f").alias("f_rep"))
    joined = reps.crossJoin(F.broadcast(seen))  # one row
    larger = F.count_if(F.col("f_rep") >= F.col("f") - 1e-12)
    return joined.groupBy("f", "df1", "df2").agg(((larger + 1) / F.lit(n + 1.0)).alias("p"), F.count(F.lit(1)).alias("n_replicates"))


def permutation_pairwise(df: DataFrame, value: str, unit: str, arm: str, n: int = 20000, seed: int = 0) -> DataFrame:
    """Each pair's mean difference with a two-sided p; arms are dealt anew over all."""
    from .effects import pairs

    def gaps(means: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return pairs(means, arm, by).withColumn("gap", F.col("m1") - F.col("m0"))

    seen = gaps(df.groupBy(arm).agg(F.avg(value).alias("m")), ()).select("t0", "t1", "gap")
    means = permuted_sums(df, value, unit, arm, n, seed).where("n > 0").select("_rep", arm, (F.col("s") / F.col("n")).alias("m"))
    reps = gaps(means, ("_rep",)).select(F.col("t0").alias("_0"), F.col("t1").alias("_1"), F.col("gap").alias("rep"))
    joined = reps.join(seen, (F.col("_0") == F.col("t0")) & (F.col("_1") == F.col("t1")))
    larger = F.count_if(F.abs("rep") >= F.abs("gap") - 1e-12)
    return joined.groupBy("t0", "t1", "gap").agg(((larger + 1) / F.lit(n + 1.0)).alias("p"))


def bootstrap(df: DataFrame, value: str, unit: str, arm: str, n: int = 20000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Percentile intervals of the arms' means. Each row is drawn a Poisson(1) number
    of times in each replicate, from a hash: no draws need to be coordinated."""
    means = bootstrap_sums(df, value, unit, arm, n, seed).withColumn("m", F.col("s") / F.nullif("n", F.lit(0)))
    low, high = (1 - level) / 2, (1 + level) / 2
    return means.groupBy(arm).agg(F.percentile("m", F.lit(low)).alias("low"), F.avg("m").alias("mean"), F.percentile("m", F.lit(high)).alias("high"))


def split_by_unit(df: DataFrame, unit: str, share: float, seed: int = 0, name: str = "is_val") -> DataFrame:
    """Marks all rows of a share of units, at least one."""
    units = df.select(unit).distinct()
    n = units.agg(F.count(F.lit(1)).alias("_n"))
    ranked = with_hash_rank(units, unit, seed).crossJoin(F.broadcast(n))  # one row
    chosen = ranked.select(unit, (F.col("_k") <= F.greatest(F.floor(F.col("_n") * share), F.lit(1))).alias(name))
    return df.join(chosen, unit)


def top_per_group(df: DataFrame, group: tuple[str, ...], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def round_robin(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """``n`` rows, one from each group in turn."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("turn", turn).orderBy("turn", group).limit(n)


def sample_negatives(df: DataFrame, label: str, unit: str, ratio: float, seed: int) -> DataFrame:
    """All rows with a label and ``ratio`` times as many without one."""
    n = df.agg((F.count_if(F.col(label) > 0) * ratio).cast("long").alias("_most"))
    none = with_hash_rank(df.where(F.col(label) == 0), unit, seed)
    kept = none.crossJoin(F.broadcast(n)).where("_k <= _most").drop("_k", "_most")  # one row
    return df.where(F.col(label) > 0).unionByName(kept)


def evenly_spaced(df: DataFrame, n: int, key: str = "obs", order: str = "frame_idx") -> DataFrame:
    """``n`` rows of each key at equal distances, first and last among them."""
    per = Window.partitionBy(key)
    ranked = df.withColumns({"_k": F.row_number().over(per.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(per)})
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.floor(j * (F.col("_n") - 1) / F.lit(max(n - 1, 1))))
    return ranked.where(F.array_contains(picks.cast("array<long>"), F.col("_k").cast("long"))).drop("_k", "_n")


def slice_rows(df: DataFrame, start: int, n: int, key: str = "obs", order: str = "frame_idx") -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k").between(start + 1, start + n)).drop("_k")


def min_gap(df: DataFrame, gap: int, key: str = "obs", order: str = "frame_idx") -> DataFrame:
    """Greedily keeps rows that come at least ``gap`` after the last one kept; nulls
    go, and of equal positions one stays."""

    def begin():
        free = None  # the first position that may be kept

        def step(at):
            nonlocal free
            k = 0 if free is None else int(np.searchsorted(at, free))
            following, kept = np.searchsorted(at, at + gap).tolist(), []
            while k < len(at):
                kept.append(k)
                k = following[k]
            if kept:
                free = int(at[kept[-1]]) + gap
            return kept, ()

        return step

    rows = df.where(F.col(order).isNotNull()).select(key, F.col(order).cast("long").alias(order)).distinct()
    return fold_stretches(rows, key, order, (), {}, begin)


def mann_whitney(df: DataFrame, value: str, arm: str, first: object, second: object) -> DataFrame:
    """Mann and Whitney's test of two arms, two-sided, by the normal distribution with
    the variance corrected for ties and half a unit for continuity: n0, n1, u (of the
    first), z and p. Null values take no part; all values equal give z null and p 1."""
    two = df.where(F.col(arm).isin(first, second) & F.col(value).isNotNull()).select(F.col(value).alias("_v"), (F.col(arm) == first).alias("_first"))
    # equal values are one row: a tie costs nothing, and no task ranks all rows
    each = two.groupBy("_v").agg(F.count_if("_first").alias("_a"), F.count(F.lit(1)).alias("_n"))
    placed = with_places(each, "_v", "_n")
    n0, n1, n = F.sum("_a"), F.sum(F.col("_n") - F.col("_a")), F.sum("_n")
    sums = placed.agg(
        n0.alias("n0"), n1.alias("n1"), n.cast("double").alias("_all"), F.sum(F.col("_a") * (F.col("_before") + (F.col("_n") + 1) / 2.0)).alias("_ranks"),
        F.sum(F.col("_n").cast("double") * (F.col("_n") * F.col("_n") - 1)).alias("_ties"),
    )
    u = F.col("_ranks") - F.col("n0") * (F.col("n0") + 1) / 2
    far = F.col("u") - F.col("n0") * F.col("n1") / 2
    spread = F.col("n0") * F.col("n1") / 12.0 * (F.col("_all") + 1 - F.col("_ties") / (F.col("_all") * (F.col("_all") - 1)))
    out = sums.where("n0 > 0 and n1 > 0").withColumn("u", u)
    out = out.withColumn("z", F.signum(far) * F.greatest(F.abs(far) - 0.5, F.lit(0.0)) / F.sqrt(F.nullif(spread, F.lit(0.0))))
    return out.withColumn("p", F.coalesce(normal_two_sided(F.col("z")), F.lit(1.0))).select("n0", "n1", "u", "z", "p")
