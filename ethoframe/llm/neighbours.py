"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, where the nearest by cosine are the nearest by
distance. Each of ``tables`` tables cuts the space into buckets by floor((a.v + b) /
w) for a few Gaussian directions a; how many follows from the number of vectors, so
that buckets stay near one size. A query visits buckets in the order of the
estimated chance that a neighbour at distance ``radius`` lies there (the product,
over directions, of the normal chance of each bucket's interval around the query's
own projection) until the chance over all tables reaches ``success``. The radius is
fitted on a bounded sample of vectors; on a sample the nearest are farther than in
the whole, so it errs towards more buckets.

Queries and vectors meet by bucket in one exchange; a task goes through its sorted
buckets in blocks and hands on each query's best by exact distance, never pairs.
Vectors that are equal are one: only the smallest ids of each can be among a query's
nearest, so a vector held by very many rows costs what one does.

A query whose buckets held fewer than ``k`` others, though there are more, is then
compared with all vectors, in blocks.

Defined results: null ids and vectors that are null, zero or hold null or non-finite
numbers (or another length than most) take no part; ties go to the smaller id; a
query with few candidates returns them all; rows with an equal id are one candidate,
with the smallest of their vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .words import mix

#: Vectors a bucket should hold.
BUCKET = 800
#: Vectors above which a bucket is dealt out in parts.
SPLIT = 4096
_SEED = 5


def _stack(column: pa.Array) -> np.ndarray:
    """Rows of one length from a list column without nulls."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


class Hashes:
    """The directions of all tables, and the plan of buckets to visit."""

    def __init__(self, dims: int, n: int, radius: float, tables: int, success: float, width: float = 1.0):
        # unit vectors' projections spread like 1 / sqrt(dims); scaled back to 1
        per_side = 3.3 / width
        self.k = max(1, round(math.log(n / BUCKET) / math.log(per_side))) if n > BUCKET else 1
        rng = np.random.default_rng(_SEED)
        self.a = rng.normal(size=(tables, self.k, dims))
        self.b = rng.uniform(0, width, (tables, self.k))
        self.width, self.tables, self.scale = width, tables, 1.0
        self.sigma = max(radius, 1e-6)
        self.each = 1 - (1 - success) ** (1 / tables)

    def places(self, unit: np.ndarray, table: int) -> np.ndarray:
        return (unit @ self.a[table].T + self.b[table]) / self.width

    def codes(self, cells: np.ndarray, table: int) -> np.ndarray:
        """A hash of the table and all its cells."""
        code = np.full(cells.shape[:-1], table + 1, np.uint64)
        for i in range(self.k):
            code = mix(code * np.uint64(0x9E3779B97F4A7C15) + cells[..., i].astype(np.int64).view(np.uint64))
        return code.view(np.int64)

    def probes(self, unit: np.ndarray, table: int, reach: int = 4) -> np.ndarray:
        """Cells to visit for one query, likeliest first. A neighbour v's projection
        lies around the query's times the cosine, with the rest of it at random."""
        cosine = 1 - self.sigma**2 / 2
        at = unit @ self.a[table].T
        middle, spread = at * cosine, math.sqrt(max(1 - cosine**2, 1e-12))
        near = np.floor((middle + self.b[table]) / self.width)
        steps = np.arange(-reach, reach + 1)
        cells = near[:, None] + steps
        low = (cells * self.width - self.b[table][:, None] - middle[:, None]) / spread
        high = low + self.width / spread
        chance = 0.5 * (_erf(high / math.sqrt(2)) - _erf(low / math.sqrt(2)))
        most = 64
        while True:
            # the likeliest choices of all directions begin with the likeliest of the
            # first ones, so keeping that many at each step loses none of them
            total, picks = np.ones(1), np.zeros((1, 0), np.int64)
            for i in range(self.k):
                each = (total[:, None] * chance[i]).ravel()
                order = np.argsort(-each, kind="stable")[:most]
                total, picks = each[order], np.concatenate([picks[order // len(steps)], (order % len(steps))[:, None]], 1)
            reached = np.cumsum(total)
            if reached[-1] >= self.each or len(total) < most:
                break
            most *= 4
        chosen = picks[: int(np.searchsorted(reached, self.each)) + 1]
        return np.stack([cells[i][chosen[:, i]] for i in range(self.k)], 1)


def _erf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf)(x)


_PROBES = pa.schema([("bucket", pa.int64()), ("side", pa.int32()), ("node", pa.int64()), ("vector", pa.list_(pa.float64()))])


def _scatter(hashes: Hashes):
    """Each class of equal vectors goes to its bucket in every table (side 1); one
    that holds a query also to the buckets it visits (side 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if not part.num_rows:
                    continue
                nodes, vectors = part.column(0).to_numpy(), _stack(part.column(1))
                unit = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
                asks = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False))
                for t in range(hashes.tables):
                    own = hashes.codes(np.floor(hashes.places(unit, t)), t)
                    yield _probe_rows(own, 1, nodes, vectors)
                    for i in asks:
                        codes = hashes.codes(hashes.probes(unit[i], t), t)
                        yield _probe_rows(codes, 0, np.full(len(codes), nodes[i]), np.repeat(vectors[i : i + 1], len(codes), 0))

    return run


def _probe_rows(codes: np.ndarray, side: int, nodes: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(np.full(len(codes), side, np.int32)), pa.array(nodes), lists], schema=_PROBES)


def _codes(hashes: Hashes):
    """The bucket of each class in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _stack(batch.column(0))
                unit /= np.sqrt((unit * unit).sum(1))[:, None]
                for t in range(hashes.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.codes(np.floor(hashes.places(unit, t)), t))], names=["bucket"])

    return run


_FOUND = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("score", pa.float64())])


def _meet(k: int):
    """Buckets in order, queries before vectors: each query's best k + 1 classes of
    a block of vectors (one may be the query's own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, part_of, asks, vectors = None, None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            buckets, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            nodes, rows, parts = batch.column(2).to_numpy(), _stack(batch.column(3)), batch.column(4).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (buckets[1:] != buckets[:-1]) | (parts[1:] != parts[:-1]) | (sides[1:] != sides[:-1])]))
            for x, y in zip(cut, [*cut[1:], len(buckets)]):
                if (buckets[x], parts[x]) != (bucket, part_of):
                    bucket, part_of, asks, vectors = buckets[x], parts[x], [], []
                if sides[x] == 0:
                    asks.append(nodes[x:y])
                    vectors.append(rows[x:y])
                    continue
                q = np.concatenate(vectors) if vectors else np.zeros((0, rows.shape[1]))
                names = np.concatenate(asks) if asks else np.zeros(0, np.int64)
                own = rows[x:y] / np.sqrt((rows[x:y] ** 2).sum(1))[:, None]
                for at in range(0, len(q), 1024):
                    part = q[at : at + 1024]
                    close = (part / np.sqrt((part**2).sum(1))[:, None]) @ own.T
                    most = min(k + 1, y - x)
                    best = np.argpartition(-close, most - 1, axis=1)[:, :most]
                    # those that tie with the last are not lost
                    last = np.take_along_axis(close, best, 1).min(1)
                    i, j = np.nonzero(close >= last[:, None] - 1e-12)
                    yield pa.RecordBatch.from_arrays([pa.array(names[at + i]), pa.array(nodes[x + j]), pa.array(close[i, j])], schema=_FOUND)

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = _stack(batch.column(3)) if batch.num_rows else np.zeros((0, 1)), _stack(batch.column(4)) if batch.num_rows else np.zeros((0, 1))
        score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(score)], names=["query_id", "own", "ids", "score"])


def _usable(vectors: DataFrame) -> DataFrame:
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad & F.exists("v", lambda x: x != 0))
    # a length whose square is 0 or infinite in double precision has no cosine
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return rows.where((length > 0) & (length < float("inf")))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, tables: int = 4, success: float = 0.97, sample: int = 2000) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each row
    whose vec_id is divisible by ``every``. ``sample``: vectors on which the radius
    is fitted (the first by a hash of their ids)."""
    rows = stage(_usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dims, total = (sizes[0]["d"], sizes[0]["n"]) if sizes else (1, 0)
    rows = rows.where(F.size("v") == dims)
    # -0.0 and 0.0 make equal vectors
    shown = F.transform("v", lambda x: x + F.lit(0.0))
    keyed = rows.select("vec_id", shown.alias("v")).withColumn("node", F.xxhash64("v"))
    ask = F.pmod("vec_id", F.lit(every)) == 0
    # the smallest ids of each vector: Spark keeps so many in each task before it
    # moves them, so a hot vector doesn't meet in one place
    first = keyed.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    held = first.groupBy("node").agg(F.min_by("v", "vec_id").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked_nodes = keyed.where(ask).select("node").distinct().withColumn("asks", F.lit(True))
    classes = stage(held.join(asked_nodes, "node", "left").select("node", "v", F.coalesce("asks", F.lit(False)).alias("asks"), "ids"))
    n = classes.count()
    probe = classes.orderBy(F.xxhash64("node")).limit(sample).select("v").toArrow().column("v")
    radius = _radius(_stack(probe.combine_chunks()) if n else np.zeros((0, dims)), k)
    hashes = Hashes(dims, n, radius, tables, success)
    met = classes.select("node", "v", "asks").mapInArrow(_scatter(hashes), "bucket long, side int, node long, vector array<double>")
    # a bucket with very many vectors is dealt out in parts, which all its queries visit
    counts = classes.select("v").mapInArrow(_codes(hashes), "bucket long").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where(F.col("n") > SPLIT).select("bucket", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts"))
    met = met.join(hot, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    asked = rows.where(ask).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")).withColumn("query", F.xxhash64(F.transform("qv", lambda x: x + F.lit(0.0))))
    found = stage(_ranked(met, asked, classes, k))
    enough = found.where(F.col("rank") == min(k, total - 1)).select("query_id")
    short = stage(asked.join(enough, "query_id", "left_anti"))
    if total < 2 or short.isEmpty():
        return found
    # few as a rule; each meets every block of vectors once
    nodes = short.select(F.col("query").alias("node")).distinct()
    every_one = F.lit(-1).cast("long").alias("bucket")
    sides = classes.select(every_one, F.lit(1).alias("side"), "node", F.col("v").alias("vector")).unionByName(
        classes.join(nodes, "node", "left_semi").select(every_one, F.lit(0).alias("side"), "node", F.col("v").alias("vector"))
    )
    more = _ranked(sides.withColumn("parts", F.lit(-(-n // SPLIT))), short, classes, k)
    return found.join(short.select("query_id"), "query_id", "left_anti").unionByName(more)


def _ranked(met: DataFrame, asked: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the best that ``asked`` (query_id, qv,
    query) meet in ``met`` (bucket, side, node, vector, parts)."""
    own = F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.withColumn("part", F.explode(F.when(F.col("side") == 1, own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    met = met.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "side", "node").select("bucket", "side", "node", "vector", "part")
    found = met.mapInArrow(_meet(k), "query long, node long, score double")
    # a class is met in several tables; each query keeps its best classes
    best = found.groupBy("query", "node").agg(F.max("score").alias("close"))
    top = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("close", "node")), asc=False).alias("all"))
    # k + 1 classes, and whatever ties with the last up to rounding
    cut = F.element_at(F.col("all.close"), F.least(F.size("all"), F.lit(k + 1))) - F.lit(1e-9)
    top = top.withColumn("cut", cut).select("query", F.explode(F.filter("all", lambda x: x["close"] >= F.col("cut"))).alias("x"))
    pairs = top.select("query", F.col("x.node").alias("node"))
    joined = asked.join(pairs, "query").join(classes.select("node", "ids", "v"), "node")
    scored = joined.select("query_id", F.col("query").alias("own"), "ids", "qv", "v").mapInArrow(_exact, "query_id long, own long, ids array<long>, score double")
    each = scored.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ordered = each.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("all"))
    return ordered.select("query_id", F.posexplode(F.slice("all", 1, k)).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score")
    )


def _radius(sample: np.ndarray, k: int) -> float:
    """The distance of the k-th nearest, at the 90th percentile of the sample."""
    if len(sample) < 2:
        return 1.0
    unit = sample / np.sqrt((sample**2).sum(1))[:, None]
    kth = min(k, len(unit) - 1)
    close = []
    for at in range(0, len(unit), 512):
        part = unit[at : at + 512] @ unit.T
        part[np.arange(len(part)), np.arange(at, at + len(part))] = -2
        close.append(-np.partition(-part, kth - 1, axis=1)[:, kth - 1])
    cosine = np.quantile(np.concatenate(close), 0.1)
    return float(math.sqrt(max(2 - 2 * cosine, 1e-6)))
