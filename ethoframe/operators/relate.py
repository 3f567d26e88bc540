"""Joins of frames with what belongs to them, and assignments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import distance


def with_tracking(frames: DataFrame, tracking: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ("obs", "frame_idx")) -> DataFrame:
    """Frames with tracked numbers, 0 where a frame has none or they are NaN."""
    wanted = tracking.select(*keys, *columns)
    rows = frames.join(wanted, list(keys), "left")
    return rows.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)) for c in columns})


def joined_vectors(parts: list[DataFrame], vectors: list[str], keys: tuple[str, ...] = ("obs", "frame_idx"), name: str = "x") -> DataFrame:
    """The parts' vectors end to end, by key."""
    named = [p.select(*keys, F.col(v).cast("array<double>").alias(f"_v{i}")) for i, (p, v) in enumerate(zip(parts, vectors))]
    rows = reduce(lambda a, b: a.join(b, list(keys)), named)
    return rows.select(*keys, F.concat(*[F.col(f"_v{i}") for i in range(len(parts))]).alias(name))


def nearest(marks: DataFrame, blobs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each mark's nearest blob of its frame; ties to the smaller blob number."""
    both = marks.join(blobs, list(keys))
    far = distance(F.col("mark_x"), F.col("mark_y"), F.col("x"), F.col("y"))
    return both.groupBy(*keys, "mark").agg(F.min_by("blob", F.struct(far, F.col("blob"))).alias("blob"), F.min(far).alias("gap"))


def cheapest_pair(options: DataFrame, room: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """For two agents: the pair of slots with the least total cost in which no slot
    holds more than its room. ``options``: keys, agent (0 or 1), slot, cost."""
    a = options.where("agent = 0").select(*keys, F.col("slot").alias("s0"), F.col("cost").alias("c0"))
    b = options.where("agent = 1").select(*keys, F.col("slot").alias("s1"), F.col("cost").alias("c1"))
    seats = room.select(*keys, F.col("slot").alias("s0"), "room")
    pairs = a.join(b, list(keys)).join(seats, [*keys, "s0"]).where((F.col("s0") != F.col("s1")) | (F.col("room") >= 2))
    total = F.col("c0") + F.col("c1")
    return pairs.groupBy(*keys).agg(F.min_by(F.struct("s0", "s1", total.alias("cost")), F.struct(total, F.col("s0"), F.col("s1"))).alias("m")).select(*keys, "m.*")


def work_list(observations: DataFrame, animals: DataFrame, done: DataFrame, key: str = "obs") -> DataFrame:
    """Every observation with each of its animals: done or open."""
    items = observations.select(key).join(animals.select(key, "animal").distinct(), key)
    marked = done.select(key, "animal").distinct().withColumn("_done", F.lit(True))
    return items.join(marked, [key, "animal"], "left").select(key, "animal", F.when(F.col("_done"), "done").otherwise("open").alias("status"))


def work_states(experiments: DataFrame, animals: DataFrame | tuple[str, ...], done: DataFrame, failed: DataFrame, key: str = "obs", video: str = "video") -> DataFrame:
    """Every experiment that has a video with every animal: done, failed (tried and not
    done) or open. ``animals``: given ids, or a table whose distinct ids stand for all
    experiments; either way they are few."""
    there = experiments.where(F.col(video).isNotNull() & (F.trim(video) != "")).select(key).distinct()
    if isinstance(animals, DataFrame):
        ids = animals.agg(F.sort_array(F.collect_set(F.col("animal"))).alias("_ids"))
        items = there.crossJoin(F.broadcast(ids)).select(key, F.explode("_ids").alias("animal"))  # one row
    else:
        items = there.select(key, F.explode(F.array(*[F.lit(a) for a in animals])).alias("animal"))
    marks = {name: rows.select(key, "animal").distinct().withColumn(name, F.lit(True)) for name, rows in (("_done", done), ("_failed", failed))}
    for marked in marks.values():
        items = items.join(marked, [key, "animal"], "left")
    return items.select(key, "animal", F.when(F.col("_done"), "done").when(F.col("_failed"), "failed").otherwise("open").alias("status"))


def positions(frames: DataFrame, tracking: DataFrame, animal: str, default: tuple[int, int], key: str = "obs", order: str = "frame_idx") -> DataFrame:
    """Each frame with the place (whole numbers, cut towards 0) of one animal out of long
    tracking (key, order, animal, x, y), or ``default`` where it was not seen, and whether
    it was. Of several places in a frame the smallest (x, y) counts."""
    seen = tracking.where((F.col("animal") == animal) & F.col("x").isNotNull() & F.col("y").isNotNull())
    one = seen.groupBy(key, order).agg(F.min(F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))).alias("_p"))
    rows = frames.join(one, [key, order], "left")
    return rows.select(*frames.columns, F.coalesce("_p.x", F.lit(default[0])).alias("x"), F.coalesce("_p.y", F.lit(default[1])).alias("y"), F.col("_p").isNotNull().alias("found"))


def covariates_from(frames: DataFrame, observations: DataFrame, columns: tuple[str, ...], key: str = "obs") -> DataFrame:
    """W_ columns of each frame's observation, for those columns that it has."""
    there = [c for c in columns if c in observations.columns]
    return frames.join(observations.select(key, *[F.col(c).alias(f"W_{c}") for c in there]), key, "left")


def boolean_of(text: Column) -> Column:
    """true/yes/1 and false/no/0 in any case; null for the rest."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "yes", "1", "on"), True).when(t.isin("false", "no", "0", "off"), False)
