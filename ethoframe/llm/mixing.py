"""Mixing sources to target weights by entropy balancing, with Spark functions only.

Targets. Sources share the words to take by weight; no source may be asked for more
than ``most`` times what it has, and what it can't take is shared anew by weight
among the others until none is above. The same is reached at once by sorting
sources by capacity over weight and filling them in that order.

Rates. Among all document rates between 0 and ``most`` that meet every source's
token constraint, the ones of least relative entropy to "each document once" are
min(most, exp(lambda * size / scale)) with one multiplier for each source: the dual
is convex and separable, and safeguarded Newton steps solve it. A step is one
aggregation over the table of (source, size, count), which stands for the documents
exactly and has far fewer rows; multipliers stay in a table with a row a source.

Copies. Rates become whole copies by group of equal source and size, and groups are
then corrected, largest sizes first, until a source misses its target by less than
its smallest correctable document. Which documents of a group take the extra copy
is settled by a hash, in buckets, so that a group that holds a third of all rows is
still dealt out in parallel. Reruns agree.

Defined results: null texts have no words and are taken zero times; a null source
is a source of its own, after all others; sources without words get target 0; rows
with equal ids each count; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, number_of_words, row_of, stage

#: Buckets into which the documents of one source and size are dealt.
BUCKETS = 256
#: A source's words may miss its target by this share when Newton ends.
TOLERANCE = 1e-7
#: exp() is cut here; rates beyond are the most or nothing anyway.
_FAR = 60.0


def targets(sources: DataFrame, total: Column | None = None, most: float = 3.0, weight: Column | None = None) -> DataFrame:
    """Adds ``target`` to (source, source_size, ...): one row for each source.

    ``weight``: by default 1, 2, 3, repeating, in the order of code points, null
    last. ``total``: by default all sizes.
    """
    everything = Window.partitionBy()
    ordered = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    given = weight if weight is not None else (F.pmod(F.row_number().over(ordered) - 1, F.lit(3)) + 1).cast("double")
    df = sources.withColumn("_w", given)
    df = df.withColumn("_t", (total if total is not None else F.sum("source_size").over(everything)).cast("double"))
    df = df.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    # by capacity over weight: the first ones are full, the rest share what is left
    full = Window.partitionBy().orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    df = df.withColumns(
        {
            "_before": F.coalesce(F.sum("_cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_after": F.sum("_w").over(full.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    df = df.withColumn("_level", (F.col("_t") - F.col("_before")) / F.col("_after"))
    # the level at the first source that isn't full holds for all after it
    open_ = F.col("_cap") > F.col("_level") * F.col("_w")
    df = df.withColumn("_open", F.min(F.when(open_, F.struct(F.col("_cap") / F.col("_w"), F.col("_level")))).over(everything)["_level"])
    share = F.least("_cap", F.col("_open") * F.col("_w"))
    return df.withColumn("target", F.coalesce(share, F.col("_cap"))).drop("_w", "_t", "_cap", "_before", "_after", "_level", "_open")


def _rate(most: float) -> Column:
    x = F.least(F.greatest(F.col("lambda") * F.col("size") / F.col("scale"), F.lit(-_FAR)), F.lit(_FAR))
    return F.least(F.lit(float(most)), F.exp(x))


def solve(groups: DataFrame, sources: DataFrame, most: float = 3.0, rounds: int = 60, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``lambda`` and ``scale`` to ``sources`` (source, source_size, target)
    such that the rates of ``groups`` (source, size, n) meet the targets."""
    state = stage(
        sources.withColumns(
            {
                "scale": F.greatest(F.col("source_size") / F.greatest(F.col("n_full"), F.lit(1)), F.lit(1.0)),
                "lambda": F.lit(0.0), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "miss": F.lit(1.0),
            }
        ),
        heap=False,
    )
    rate = _rate(most)
    slope = F.when(rate < most, rate * F.col("size") / F.col("scale")).otherwise(0.0)
    for _ in range(rounds):
        met = groups.join(state.select("source", "lambda", "scale"), groups["source"].eqNullSafe(state["source"])).select(groups["source"], "size", "n", "lambda", "scale")
        sums = met.groupBy("source").agg(F.sum(F.col("n") * F.col("size") * rate).alias("f"), F.sum(F.col("n") * F.col("size") * slope).alias("g")).withColumnRenamed("source", "_source")
        at = state.join(sums, state["source"].eqNullSafe(F.col("_source")), "left").drop("_source")
        miss = F.when(F.col("target") > 0, F.abs(F.col("f") - F.col("target")) / F.col("target")).otherwise(0.0)
        at = at.withColumn("miss", F.coalesce(miss, F.lit(0.0)))
        at = at.withColumns(
            {
                "low": F.when(F.col("f") < F.col("target"), F.col("lambda")).otherwise(F.col("low")),
                "high": F.when(F.col("f") >= F.col("target"), F.col("lambda")).otherwise(F.col("high")),
            }
        )
        # Newton on log f, which is nearly linear; outside the bracket, halve or widen it
        newton = F.col("lambda") + F.log(F.col("target") / F.col("f")) * F.col("f") / F.nullif(F.col("g"), F.lit(0.0))
        wide = F.when(F.col("low").isNull(), F.col("high") - F.greatest(F.lit(1.0), F.abs("high"))).when(
            F.col("high").isNull(), F.col("low") + F.greatest(F.lit(1.0), F.abs("low"))
        )
        middle = F.coalesce((F.col("low") + F.col("high")) / 2, wide)
        inside = (newton > F.coalesce("low", newton - 1)) & (newton < F.coalesce("high", newton + 1)) & (F.abs(newton - F.col("lambda")) < 8)
        step = F.when(inside, newton).otherwise(middle)
        state = stage(at.withColumn("lambda", F.when(F.col("miss") <= tolerance, F.col("lambda")).otherwise(F.coalesce(step, F.col("lambda")))).drop("f", "g"), heap=False)
        worst = state.where("target > 0 and target < source_size * %r * (1 - 1e-9)" % float(most)).agg(F.max("miss")).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        raise RuntimeError(f"the multipliers did not settle in {rounds} rounds: a source misses its target by {worst:.2g} of it")
    # a source that is asked for all it can give has no finite multiplier
    full = F.col("target") >= F.col("source_size") * most * (1 - 1e-9)
    top = F.when(F.col("target") <= 0, -_FAR * F.col("scale")).when(full, _FAR * F.col("scale")).otherwise(F.col("lambda"))
    return state.withColumn("lambda", top).drop("low", "high", "miss")


def _hash(*columns: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def copies(groups: DataFrame, sources: DataFrame, most: int = 3, passes: int = 5) -> DataFrame:
    """Adds ``copies`` to ``groups``: how many a group takes in all."""
    own = sources.select(F.col("source").alias("_source"), "target", "lambda", "scale")
    df = groups.join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    want = F.col("n") * _rate(most)
    df = df.withColumn("rate", _rate(most)).withColumn("copies", F.least(F.floor(want + _hash("source", "size", seed=1)), F.col("n") * most).cast("long"))
    df = df.withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("copies")).cast("long"))
    per = Window.partitionBy("source")
    down = per.orderBy(F.col("size").desc())
    for _ in range(passes):
        df = df.withColumn("_left", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(per))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("_left"))
        room = F.when(fits, F.when(F.col("_left") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))).otherwise(0)
        df = df.withColumn("_room", room.cast("long"))
        df = df.withColumn("_used", F.sum(F.col("_room") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_room") * F.col("size"))
        take = F.least(F.greatest(F.floor((F.abs("_left") - F.col("_used")) / F.greatest("size", F.lit(1))), F.lit(0)), F.col("_room"))
        df = df.withColumn("copies", (F.col("copies") + F.when(F.col("_left") > 0, take).otherwise(-take)).cast("long")).drop("_left", "_room", "_used")
    # last, one copy more or less of the size nearest to what is left, if that helps
    for _ in range(2):
        df = df.withColumn("_left", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(per))
        room = F.when(F.col("_left") > 0, F.col("copies") < F.col("n") * most).otherwise(F.col("copies") > 0)
        miss = F.abs(F.col("size") - F.abs("_left"))
        df = df.withColumn("_best", F.min(F.when(room & (miss < F.abs("_left")), F.struct(miss.alias("miss"), F.col("size").alias("size")))).over(per))
        df = df.withColumn("copies", F.when(F.col("size") == F.col("_best.size"), F.col("copies") + F.signum("_left").cast("long")).otherwise(F.col("copies"))).drop("_left", "_best")
    return df


def mix(docs: DataFrame, most: int = 3, weight: Column | None = None) -> DataFrame:
    """One row for each of ``docs``: doc_id, source, size, source_size, target, rate
    and copies."""
    sized = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), number_of_words(F.col("text")).alias("size"), F.xxhash64("text").alias("body")))
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "body"), F.lit(BUCKETS)).cast("int"))
    by_bucket = stage(dealt.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), heap=False)
    groups = stage(by_bucket.groupBy("source", "size").agg(F.sum("n").alias("n")), heap=False)
    sources = groups.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("n_full"))
    sources = solve(groups, targets(sources, most=float(most), weight=weight), float(most))
    # written aside: in one plan with what follows, it fills the driver's heap
    taken = stage(copies(groups, sources, most).select("source", "size", "n", "rate", "copies"))
    # each bucket's part of its group's copies: parts of a rising line, rounded down
    parts = by_bucket.join(taken.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "rate", "copies", F.col("n").alias("_n")), F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))).drop("_source", "_size")
    up = Window.partitionBy("source", "size").orderBy("bucket")
    extra, total = F.pmod(F.col("copies"), F.col("_n")), F.col("_n")
    upto = F.sum("n").over(up)
    parts = parts.withColumn("_upto", upto).withColumns(
        {
            "base": F.floor(F.col("copies") / total).cast("long"),
            "extra": (F.floor(F.col("_upto") * extra / total) - F.floor((F.col("_upto") - F.col("n")) * extra / total)).cast("long"),
        }
    )
    parts = parts.select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("bucket").alias("_bucket"), "rate", "base", "extra")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("bucket") == F.col("_bucket"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy(F.xxhash64("doc_id", "body", F.lit(2)), "doc_id"))
    rows = dealt.withColumn("_rank", rank).join(parts, same)
    rows = rows.withColumn("copies", (F.col("base") + (F.col("_rank") <= F.col("extra")).cast("long")).cast("long"))
    known = sources.select(F.col("source").alias("_from"), "source_size", "target")
    return rows.join(known, F.col("source").eqNullSafe(F.col("_from"))).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "body")


def take(docs: DataFrame, most: int = 3) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies."""
    chosen = mix(docs, most).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "copies", F.col("source").alias("_from"))
    # rows with one id, text and source are told apart by number
    chosen = stage(chosen.withColumn("_k", F.row_number().over(Window.partitionBy("_id", "_body", "_from").orderBy("copies"))))
    rows = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_hash"), F.col("source").cast("string").alias("_source"))
    # by all their other columns, so that reruns number them alike
    rest = [F.col("_row")[c] for c in docs.columns if c not in ("doc_id", "text", "source")]
    told = F.to_json(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(rest)])) if rest else F.lit(1)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_doc", "_hash", "_source").orderBy(told)))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_body")) & F.col("_source").eqNullSafe(F.col("_from")) & (F.col("_n") == F.col("_k"))
    joined = rows.join(chosen, same)
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select(*columns_of(docs))
