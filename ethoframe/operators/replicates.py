"""Sums by arm of many permutations or bootstrap draws, without a row for each replicate.

A unit has two 32-bit numbers from its hash; mixed with a replicate's number they give
its key in that replicate. Tasks work out keys by Arrow batches and add up arrays:

* *Permutation.* In each replicate the units in order of their keys get the arms in
  order, each as often as there are units of it. The keys at which one arm ends and the
  next begins are found byte by byte, from the highest: tasks count units by the next
  byte, sums of counts are merged, and a cut goes to the byte that holds its place, until
  all cuts lie between two units. Then each task deals arms by comparing keys with cuts.
* *Bootstrap.* A unit is drawn a Poisson(1) number of times, read off its key.

What is shuffled are counts of bytes and sums by replicate and arm. All of it is in
proportion to tasks and replicates, none of it to rows times replicates. Units with equal
keys (by chance of 2^-64 a pair) get the same arm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Replicates that a job makes at once; a task's counts are this times cuts times 2 KB.
AT_ONCE = 2000
_CHUNK = 64
#: The Poisson(1) distribution function up to 6, beyond which less than 1e-4 lies.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Murmur3's last step: a permutation of 32 bits."""
    h = h.astype(np.uint64)
    low = np.uint64(0xFFFFFFFF)
    h = ((h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & low
    h = ((h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & low
    return h ^ (h >> np.uint64(16))


def draws(first: np.ndarray, second: np.ndarray, rep: int) -> np.ndarray:
    """A 32-bit number for each unit in this replicate."""
    own = _mixed(np.array([rep], np.uint64))[0]
    return _mixed(_mixed((first + own) & np.uint64(0xFFFFFFFF)) ^ second)


def _halves(unit: Column, seed: int) -> tuple[Column, Column]:
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), unit.cast("string")))
    return tuple(F.conv(F.substring(h, at, 8), 16, 10).cast("long") for at in (1, 9))


def _units(df: DataFrame, value: str, unit: str, arm: str, arms: list, seed: int, blocks: list[tuple] | None, by: tuple[str, ...]) -> DataFrame:
    """(first, second, block, arm, value) with blocks and arms as numbers."""

    def number(c: Column, known: list) -> Column:
        out = F.when(c.eqNullSafe(F.lit(known[0])), 0)
        for i, v in enumerate(known[1:], 1):
            out = out.when(c.eqNullSafe(F.lit(v)), i)
        return out.cast("long")

    first, second = _halves(F.col(unit), seed)
    block = F.lit(0).cast("long")
    if blocks and by:
        block = F.coalesce(*[F.when(reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, key)]), i) for i, key in enumerate(blocks)]).cast("long")
    return df.select(first.alias("first"), second.alias("second"), block.alias("block"), number(F.col(arm), arms).alias("arm"), F.col(value).cast("double").alias("value"))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    first, second, block, arm = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    return first.astype(np.uint64), second.astype(np.uint64), block, arm, batch.column(4).to_numpy(zero_copy_only=False).astype(float)


def _counts(reps: range, prefix: np.ndarray, open_: np.ndarray, level: int):
    """One task's units by the next byte of their keys, for each replicate, block and cut
    still open. ``prefix`` (replicates, blocks, cuts) holds the bytes known so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((*prefix.shape, 256))
        above, at = np.uint64(64 - 8 * level), np.uint64(56 - 8 * level)
        for batch in batches:
            first, second, block, _, _ = _arrays(batch)
            for b in range(prefix.shape[1]):
                own = block == b
                f, s = first[own], second[own]
                for i, rep in enumerate(reps):
                    if not open_[i, b].any():
                        continue
                    key = draws(f, s, rep) << np.uint64(32) | f
                    byte = (key >> at & np.uint64(255)).astype(np.int64)
                    for c in np.flatnonzero(open_[i, b]):
                        here = byte if level == 0 else byte[key >> above == prefix[i, b, c]]
                        total[i, b, c] += np.bincount(here, minlength=256)
        task = TaskContext.get().partitionId()
        blobs = [total[i : i + _CHUNK].tobytes() for i in range(0, len(reps), _CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array([task] * len(blobs), pa.int64()), pa.array(range(len(blobs)), pa.int64()), pa.array(blobs, pa.binary())], ["task", "chunk", "counts"])

    return run


def _merged(table: pa.Table) -> pa.Table:
    blobs = table.column("counts")
    total = np.frombuffer(blobs[0].as_py()).copy()
    for i in range(1, len(blobs)):
        total += np.frombuffer(blobs[i].as_py())
    return pa.table({"task": table.column("task")[:1], "chunk": table.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _chosen(left: np.ndarray):
    """The byte in which each cut's place ``left`` lies, the units of lower bytes, and
    the units of that byte."""

    def run(table: pa.Table) -> pa.Table:
        merged = _merged(table)
        k = merged.column("chunk")[0].as_py()
        own = left[k * _CHUNK : (k + 1) * _CHUNK]
        upto = np.frombuffer(merged.column("counts")[0].as_py()).reshape(*own.shape, 256).cumsum(-1)
        byte = np.minimum((upto < own[..., None]).sum(-1), 255)
        last = np.take_along_axis(upto, byte[..., None], -1)[..., 0]
        before = np.where(byte > 0, np.take_along_axis(upto, np.maximum(byte - 1, 0)[..., None], -1)[..., 0], 0)
        n = byte.size
        return pa.table({"chunk": pa.array([k] * n, pa.int64()), "place": pa.array(range(n), pa.int64()), "byte": byte.ravel().astype(np.int64), "before": before.ravel().astype(np.int64), "n": (last - before).ravel().astype(np.int64)})

    return run


def _cuts(units: DataFrame, reps: range, upto: np.ndarray) -> np.ndarray:
    """Keys (replicates, blocks, cuts): a unit is before a cut if its key is not above
    it. ``upto`` (blocks, cuts) says how many units are before each cut."""
    left = np.broadcast_to(upto, (len(reps), *upto.shape)).astype(np.int64).copy()
    prefix = np.zeros(left.shape, np.uint64)
    level_of = np.zeros(left.shape, np.int64)
    # no unit before the cut: no key is as low as that, but for 0
    open_ = left > 0
    for level in range(8):
        if not open_.any():
            break
        each = units.mapInArrow(_counts(reps, prefix, open_, level), "task long, chunk long, counts binary")
        near = each.groupBy("chunk", F.floor(F.sqrt("task")).alias("_near")).applyInArrow(lambda t: _merged(t), "task long, chunk long, counts binary")
        found = near.groupBy("chunk").applyInArrow(_chosen(left), "chunk long, place long, byte long, before long, n long").toPandas()  # replicates x cuts
        per = int(np.prod(left.shape[1:]))
        at = found["chunk"].to_numpy() * _CHUNK * per + found["place"].to_numpy()
        byte, before, n = (np.empty(left.size, np.int64) for _ in range(3))
        for name, a in (("byte", byte), ("before", before), ("n", n)):
            a[at] = found[name].to_numpy()
        byte, before, n = (a.reshape(left.shape) for a in (byte, before, n))
        prefix = np.where(open_, prefix << np.uint64(8) | byte.astype(np.uint64), prefix)
        left = np.where(open_, left - before, left)
        level_of = np.where(open_, level + 1, level_of)
        # all units of the byte are before the cut: it lies behind them
        open_ &= left < n
    rest = (64 - 8 * level_of).astype(np.uint64)
    full = level_of == 8
    ends = np.where(full, prefix, ((prefix + np.uint64(1)) << np.minimum(rest, np.uint64(63))) - np.uint64(1))
    return np.where(level_of == 0, np.uint64(0), ends)


_SUMS = "rep long, arm long, n double, s double, q double"


def _rows(reps: range, total: np.ndarray) -> pa.RecordBatch:
    r, a = np.nonzero(total[..., 0])
    columns = [pa.array(np.asarray(reps)[r], pa.int64()), pa.array(a, pa.int64()), *[pa.array(total[r, a, i]) for i in range(3)]]
    return pa.RecordBatch.from_arrays(columns, ["rep", "arm", "n", "s", "q"])


def _dealt(reps: range, cuts: np.ndarray, arms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(reps), arms, 3))
        for batch in batches:
            first, second, block, _, value = _arrays(batch)
            for b in range(cuts.shape[1]):
                own = (block == b) & ~np.isnan(value)
                f, s, v = first[own], second[own], value[own]
                for i, rep in enumerate(reps):
                    key = draws(f, s, rep) << np.uint64(32) | f
                    new = np.searchsorted(cuts[i, b], key, "left")
                    for j, w in enumerate((None, v, v * v)):
                        total[i, :, j] += np.bincount(new, w, arms)
        yield _rows(reps, total)

    return run


def _drawn(reps: range, arms: int):
    steps = np.array([int(s * (1 << 32)) for s in POISSON], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(reps), arms, 3))
        for batch in batches:
            first, second, _, arm, value = _arrays(batch)
            own = ~np.isnan(value)
            first, second, arm, value = first[own], second[own], arm[own].astype(np.int64), value[own]
            for i, rep in enumerate(reps):
                times = np.searchsorted(steps, draws(first, second, rep), "right").astype(float)
                for j, w in enumerate((times, times * value, times * value * value)):
                    total[i, :, j] += np.bincount(arm, w, arms)
        yield _rows(reps, total)

    return run


def _named(sums: list[DataFrame], df: DataFrame, arm: str, arms: list) -> DataFrame:
    """All replicates' sums with the arms' own values: _rep, arm, n, s, q."""
    rows = reduce(lambda a, b: a.unionByName(b), sums).groupBy("rep", "arm").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    kind = df.schema[arm].dataType
    named = F.array(*[F.lit(a).cast(kind) for a in arms])
    return rows.select(F.col("rep").alias("_rep"), F.get(named, F.col("arm").cast("int")).alias(arm), F.col("n").cast("long").alias("n"), "s", "q")


def permuted_sums(df: DataFrame, value: str, unit: str, arm: str, n: int, seed: int = 0, blocks: tuple[str, ...] = ()) -> DataFrame:
    """(_rep, arm, n, s, q): count, sum and sum of squares of the values that an arm is
    dealt in each of ``n`` permutations, within blocks. Units without a value are dealt
    arms too but add nothing. Arms and blocks are few: they are collected."""
    found = df.groupBy(*blocks, arm).agg(F.count(F.lit(1)).alias("_n")).collect()
    if not found:
        return df.sparkSession.createDataFrame([], f"_rep long, {arm} {df.schema[arm].dataType.simpleString()}, n long, s double, q double")
    arms = sorted({r[arm] for r in found}, key=lambda a: (a is not None, a))
    keys = sorted({tuple(r[b] for b in blocks) for r in found}, key=lambda k: tuple((v is not None, v) for v in k))
    counts = np.zeros((len(keys), len(arms)), np.int64)
    for r in found:
        counts[keys.index(tuple(r[b] for b in blocks)), arms.index(r[arm])] = r["_n"]
    upto = counts.cumsum(1)[:, :-1]
    units = _units(df, value, unit, arm, arms, seed, keys, blocks)
    out = []
    for at in range(1, n + 1, AT_ONCE):
        reps = range(at, min(at + AT_ONCE, n + 1))
        cuts = _cuts(units, reps, upto)
        out.append(units.mapInArrow(_dealt(reps, cuts, len(arms)), _SUMS))
    return _named(out, df, arm, arms)


def bootstrap_sums(df: DataFrame, value: str, unit: str, arm: str, n: int, seed: int = 0) -> DataFrame:
    """(_rep, arm, n, s, q) of what an arm's units, drawn with repetition, add up to."""
    arms = sorted((r[arm] for r in df.select(arm).distinct().collect()), key=lambda a: (a is not None, a))
    if not arms:
        return df.sparkSession.createDataFrame([], f"_rep long, {arm} {df.schema[arm].dataType.simpleString()}, n long, s double, q double")
    units = _units(df, value, unit, arm, arms, seed, None, ())
    out = [units.mapInArrow(_drawn(range(at, min(at + AT_ONCE, n + 1)), len(arms)), _SUMS) for at in range(1, n + 1, AT_ONCE)]
    return _named(out, df, arm, arms)
