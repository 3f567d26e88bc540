"""Behaviour bouts to frame labels and back.

Frame i of an observation shows source frame trunc(offset + i * ratio); a bout [start,
end) labels it if start <= source < end. For whole bout bounds that is the same as
i in [ceil((start - offset) / ratio), ceil((end - offset) / ratio)), which needs no
join between frames and bouts: both forms are here and agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frames_of(observations: DataFrame, key: str = "obs") -> DataFrame:
    """One row for each frame of (key, n_frames, ...)."""
    there = observations.where("n_frames > 0")
    return there.withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1)))


def source_frame(frame: Column, offset: Column, ratio: Column) -> Column:
    return (offset + frame * ratio).cast("long")


def with_outcomes(bouts: DataFrame, mapping: dict[str, tuple[int, ...]], outcomes: tuple[str, ...], behaviour: str = "behavior") -> DataFrame:
    """Adds a 0/1 column for each outcome by the behaviour's vector; bouts of unknown
    behaviour fall out (``unknown_behaviours`` lists them)."""
    name = F.trim(F.col(behaviour))
    known = bouts.where(name.isin(*mapping))
    value = {o: F.coalesce(*[F.when(name == b, F.lit(int(v[k]))) for b, v in mapping.items()]) for k, o in enumerate(outcomes)}
    return known.withColumns(value)


def unknown_behaviours(bouts: DataFrame, mapping: dict, behaviour: str = "behavior") -> DataFrame:
    name = F.trim(F.col(behaviour))
    return bouts.where(name.isNotNull() & (name != "") & ~name.isin(*mapping)).groupBy(name.alias(behaviour)).agg(F.count(F.lit(1)).alias("n_bouts"))


def label_by_join(observations: DataFrame, bouts: DataFrame, outcomes: tuple[str, ...], key: str = "obs", width: int = 256) -> DataFrame:
    """Labels by a range join within each observation, overlaps by maximum. Both
    sides are dealt into bins of ``width`` source frames, so that a frame meets the
    bouts of its bin only and long observations spread over many tasks. A row of the
    join is a bin with the distinct spans cut to it, of which there are boundedly many;
    its frames are listed after the join, so that no frame is ever shuffled."""
    there = observations.where("n_frames > 0").select(key, F.col("n_frames").cast("long").alias("_n"), "offset", "ratio")
    bin_of = lambda i: F.floor(source_frame(i, F.col("offset"), F.col("ratio")) / width)
    places = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), bin_of))
    bins = there.select("*", F.explode(places).alias("_bin"))
    spans = bouts.where("start_frame < end_frame").select(key, "start_frame", "end_frame", *outcomes)
    spans = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_frame") / width), F.floor((F.col("end_frame") - 1) / width))))
    cut = {"start_frame": F.greatest("start_frame", F.col("_bin") * width), "end_frame": F.least("end_frame", (F.col("_bin") + 1) * width)}
    spans = spans.withColumns(cut).groupBy(key, "_bin").agg(F.collect_set(F.struct("start_frame", "end_frame", *outcomes)).alias("_spans"))
    joined = bins.join(spans, [key, "_bin"], "left")
    # a bin's frames lie between these two; all of them where the ratio is none
    ends = [F.try_divide(F.col("_bin") * width + more - F.col("offset"), F.col("ratio")) for more in (-1, width + 1)]
    first, last = F.floor(F.least(*ends)) - 1, F.ceil(F.greatest(*ends)) + 1
    start = F.greatest(F.coalesce(first, F.lit(0)), F.lit(0)).cast("long")
    stop = F.least(F.coalesce(last, F.col("_n")), F.col("_n") - 1).cast("long")
    own = F.filter(F.sequence(start, stop, F.lit(1).cast("long")), lambda i: bin_of(i).eqNullSafe(F.col("_bin")))
    rows = joined.select(key, "_spans", "offset", "ratio", F.explode(own).alias("frame_idx"))
    source = source_frame(F.col("frame_idx"), F.col("offset"), F.col("ratio"))
    hits = F.filter("_spans", lambda s: (source >= s["start_frame"]) & (source < s["end_frame"]))
    rows = rows.select(key, "frame_idx", hits.alias("_hits"))
    return rows.select(key, "frame_idx", *[F.coalesce(F.array_max(F.col(f"_hits.{o}")), F.lit(0)).cast("int").alias(o) for o in outcomes])


def expand_bouts(observations: DataFrame, bouts: DataFrame, key: str = "obs") -> DataFrame:
    """A row for each frame that a bout covers."""
    both = bouts.join(observations.select(key, "n_frames", "offset", "ratio"), key)
    first = F.greatest(F.ceil((F.col("start_frame") - F.col("offset")) / F.col("ratio")), F.lit(0)).cast("long")
    last = F.least(F.ceil((F.col("end_frame") - F.col("offset")) / F.col("ratio")), F.col("n_frames")).cast("long")
    spans = both.withColumns({"_first": first, "_last": last}).where("_first < _last")
    return spans.withColumn("frame_idx", F.explode(F.sequence(F.col("_first"), F.col("_last") - 1))).drop("_first", "_last", "n_frames", "offset", "ratio")


def label_by_expansion(observations: DataFrame, bouts: DataFrame, outcomes: tuple[str, ...], key: str = "obs") -> DataFrame:
    """The same labels without a range join; cheaper while bouts are short."""
    hits = expand_bouts(observations, bouts, key).groupBy(key, "frame_idx").agg(*[F.max(o).alias(o) for o in outcomes])
    frames = frames_of(observations, key).select(key, "frame_idx")
    return frames.join(hits, [key, "frame_idx"], "left").select(key, "frame_idx", *[F.coalesce(o, F.lit(0)).cast("int").alias(o) for o in outcomes])


def pair_labels(hits: DataFrame, classes: dict[str, int], mutual: tuple[str, ...], key: str = "obs", behaviour: str = "behavior") -> DataFrame:
    """(key, frame_idx, agent1, agent2, label) of expanded pair bouts. Mutual
    behaviours count both ways; of labels in conflict the first record's stays."""
    label = F.coalesce(*[F.when(F.col(behaviour) == b, F.lit(v)) for b, v in classes.items()])
    known = hits.withColumn("label", label).where("label is not null and agent1 <> agent2")
    one, other = F.struct(F.col("agent1").alias("a"), F.col("agent2").alias("b")), F.struct(F.col("agent2").alias("a"), F.col("agent1").alias("b"))
    both = F.when(F.col(behaviour).isin(*mutual), F.array(one, other)).otherwise(F.array(one))
    rows = known.withColumn("_pair", F.explode(both)).select(key, "frame_idx", F.col("_pair.a").alias("agent1"), F.col("_pair.b").alias("agent2"), "label", "ord")
    return rows.groupBy(key, "frame_idx", "agent1", "agent2").agg(F.min_by("label", "ord").cast("int").alias("label"))


def fill_pairs(frames: DataFrame, labels: DataFrame, agents: int, key: str = "obs") -> DataFrame:
    """All ordered pairs of agents in each frame, label 0 where none is given."""
    numbers = F.sequence(F.lit(0), F.lit(agents - 1))
    pairs = frames.select(key, "frame_idx", F.explode(numbers).alias("agent1")).withColumn("agent2", F.explode(numbers)).where("agent1 <> agent2")
    return pairs.join(labels, [key, "frame_idx", "agent1", "agent2"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def filled_pair_counts(observations: DataFrame, labels: DataFrame, agents: int, key: str = "obs") -> DataFrame:
    """(key, agent1, agent2, label, n, frames) over the rows of ``fill_pairs``: how many
    frames, and the sum of their numbers. Frames without label are counted by
    difference, so no row is made for them; ``labels`` lie in their observation's frames."""
    of_pair = lambda a, b, label, n, frames: F.struct(a.cast("int").alias("agent1"), b.cast("int").alias("agent2"), label.cast("int").alias("label"), n.cast("long").alias("n"), frames.cast("long").alias("frames"))
    n, zero = F.col("n_frames").cast("long"), F.lit(0)
    every = [of_pair(F.lit(a), F.lit(b), zero, n, F.floor(n * (n - 1) / 2)) for a in range(agents) for b in range(agents) if a != b]
    whole = observations.where("n_frames > 0").select(key, F.explode(F.array(*every)).alias("_p"))
    known = labels.where(F.col("agent1").between(0, agents - 1) & F.col("agent2").between(0, agents - 1) & (F.col("agent1") != F.col("agent2")))
    given = known.groupBy(key, "agent1", "agent2", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("frame_idx").alias("frames"))
    a, b, label, m, frames = (F.col(c) for c in ("agent1", "agent2", "label", "n", "frames"))
    # what is labelled, and the same taken off the frames without label
    moved = given.select(key, F.explode(F.array(of_pair(a, b, F.coalesce(label, zero), m, frames), of_pair(a, b, zero, -m, -frames))).alias("_p"))
    rows = whole.unionByName(moved).select(key, "_p.*")
    return rows.groupBy(key, "agent1", "agent2", "label").agg(F.sum("n").alias("n"), F.sum("frames").alias("frames")).where("n > 0")


def run_lengths(df: DataFrame, values: tuple[str, ...], key: str = "obs", order: str = "frame_idx") -> DataFrame:
    """Runs of equal values in consecutive rows: key, values, start, end, n_rows."""
    w = Window.partitionBy(key).orderBy(order)
    same = Window.partitionBy(key, *values).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(same)
    runs = df.withColumn("_island", island).groupBy(key, *values, "_island")
    return runs.agg(F.min(order).alias("start_frame"), F.max(order).alias("end_frame"), F.count(F.lit(1)).alias("n_rows")).drop("_island")


def upsample(df: DataFrame, stride: int, key: str = "obs", order: str = "frame_idx", total: str | None = None) -> DataFrame:
    """Each row covers source frames from its own up to the next row's; the last one
    covers one stride, or up to ``total`` (a column) if that is given and larger."""
    following = F.lead(order).over(Window.partitionBy(key).orderBy(order))
    first = F.col(order) * stride
    last = F.coalesce(following * stride, F.greatest(first + stride, F.col(total)) if total else first + stride)
    spans = df.withColumns({"_first": first.cast("long"), "_last": last.cast("long")}).where("_first < _last")
    return spans.withColumn("source_frame", F.explode(F.sequence(F.col("_first"), F.col("_last") - 1))).drop("_first", "_last", order)


def clip(runs: DataFrame, start: int, end: int) -> DataFrame:
    """Runs (start_frame, end_frame inclusive) cut to [start, end)."""
    cut = runs.where((F.col("end_frame") >= start) & (F.col("start_frame") < end))
    return cut.withColumns({"start_frame": F.greatest("start_frame", F.lit(start)), "end_frame": F.least("end_frame", F.lit(end - 1))})
