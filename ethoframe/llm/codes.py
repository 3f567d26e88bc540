"""Vector code compression: a codebook of integer entries for each part of a vector.

A component x becomes the integer floor(scale * x); a vector is cut into equal
consecutive parts and each part is replaced by the index of its nearest entry.

1. *Start.* The parts of the ``entries`` kept vectors of smallest id, in that order.
2. *Rounds.* The codebooks are broadcast (entries x dimensions integers, whatever the
   number of vectors). A task expands |x - c|^2 to |x|^2 - 2xc + |c|^2 with exact int64
   matrix products and takes the first smallest. It adds up its parts by entry over all
   its batches; these sums, one row for an entry's component, are merged by a grouped
   shuffle, so no entry's members ever meet. An entry becomes floor(sum / count).
3. *Codes.* One more assignment gives each vector's code and error.

Each pass reads the vectors anew; nothing but sums is shuffled.

Defined results: vectors that are null or hold null or non-finite components are left
out; empty vectors and those of another length than the kept vector of smallest id
(ties: smallest vector; null ids last) stay with null code and error. With fewer than
``entries`` vectors, each is an entry. A length that the parts don't divide, and a
component of 2^24 or more after scaling (distances might leave 64 bits), raise
ValueError. Repeated ids are vectors like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, LongType, StringType

from .common import stage

#: Components that a task works on at once.
_AT_ONCE = 1 << 21
_MOST = 1 << 24
#: Up to so many labels are broadcast; beyond, only those with more rows than HOT.
_LABELS, _HOT = 1 << 16, 1_000_000


def _kept(vectors: DataFrame) -> DataFrame:
    """(_id, _label, _v) of the vectors without null or non-finite components."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select(F.col("vec_id").alias("_id"), label.alias("_label"), F.col("embedding").cast("array<double>").alias("_v"))
    # x - x is 0 for finite numbers only
    return rows.where(F.col("_v").isNotNull() & F.forall("_v", lambda x: F.coalesce(x - x == 0, F.lit(False))))


def _whole(batch: pa.RecordBatch, column: int, dims: int, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, rows with this length, their integers) of slices of a batch."""
    step = max(1, _AT_ONCE // dims)
    for at in range(0, batch.num_rows, step):
        part = batch.column(column).slice(at, step)
        fits = np.flatnonzero(part.value_lengths().to_numpy(zero_copy_only=False) == dims)
        values = part.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
        x = np.floor(values * scale)
        if np.abs(x).max(initial=0) >= _MOST:
            raise ValueError(f"components reach {_MOST} after scaling")
        yield at, fits, x.astype(np.int64).reshape(len(fits), dims)


def _nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest entry and squared distance, for each row and part.
    ``books`` is (parts, entries, width)."""
    parts, _, width = books.shape
    codes, errors = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for p in range(parts):
        own, book = x[:, p * width : (p + 1) * width], books[p]
        far = (own * own).sum(1)[:, None] - 2 * (own @ book.T) + (book * book).sum(1)
        codes[:, p] = far.argmin(1)
        errors[:, p] = far[np.arange(len(x)), codes[:, p]]
    return codes, errors


def _sums(books, scale: int):
    """One task's counts and sums by part, entry and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        parts, entries, width = book.shape
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, _, x in _whole(batch, 0, parts * width, scale):
                codes, _ = _nearest(x, book)
                for p in range(parts):
                    count[p] += np.bincount(codes[:, p], minlength=entries)
                    np.add.at(total[p], codes[:, p], x[:, p * width : (p + 1) * width])
        p, e = np.nonzero(count)
        arrays = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)), np.repeat(count[p, e], width), total[p, e].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], ["part", "entry", "place", "n", "total"])

    return run


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> np.ndarray:
    """Integer codebooks as an array (parts, entries, width); (parts, 0, 0) without
    vectors."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hexadecimal digits")
    kept = _kept(vectors).where(F.size("_v") > 0)
    first = kept.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).select("_v").collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    dims = len(first[0]["_v"])
    if dims % parts:
        raise ValueError(f"{dims} components don't make {parts} equal parts")
    if any(len(r["_v"]) != dims for r in first):
        first = kept.where(F.size("_v") == dims).orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).select("_v").collect()
    start = np.floor(np.array([r["_v"] for r in first], np.float64) * scale)
    if np.abs(start).max() >= _MOST:
        raise ValueError(f"components reach {_MOST} after scaling")
    books = start.astype(np.int64).reshape(len(first), parts, -1).swapaxes(0, 1).copy()
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(books)
        each = kept.select("_v").mapInArrow(_sums(shared, scale), "part long, entry long, place long, n long, total long")
        merged = each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        rows = merged.toPandas().to_numpy(np.int64).reshape(-1, 5)  # at most the codebooks' own size
        books = books.copy()
        books[rows[:, 0], rows[:, 1], rows[:, 2]] = rows[:, 4] // rows[:, 3]
        shared.destroy()
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _codes(books, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        dims = book.shape[0] * book.shape[2]
        for batch in batches:
            code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            for at, fits, x in _whole(batch, 2, dims, scale) if dims else ():
                codes, errors = _nearest(x, book)
                code[at + fits] = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                error[at + fits] = errors.sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def encode(vectors: DataFrame, books: np.ndarray, scale: int = 256) -> DataFrame:
    """One row for each kept vector: vec_id, label, code, error."""
    kept = _kept(vectors)
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    types = kept.schema
    schema = StructType([StructField("vec_id", types["_id"].dataType), StructField("label", types["_label"].dataType), StructField("code", StringType()), StructField("error", LongType())])
    return kept.mapInArrow(_codes(shared, scale), schema)


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` of ``encode`` and label_error, the error summed over equal labels.
    A label's rows never meet: sums are taken in tasks first, and what is joined by
    shuffle has labels of at most ``_HOT`` rows."""
    sums = stage(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    of = sums.select(F.col("label").alias("_of"), "label_error", "_n")

    def joined(rows: DataFrame, of: DataFrame, how: str = "inner") -> DataFrame:
        return rows.join(of, F.col("label").eqNullSafe(F.col("_of")), how).drop("_of", "_n")

    if sums.count() <= _LABELS:
        return joined(rows, F.broadcast(of))
    # a label with more than _HOT rows: there are fewer than rows / _HOT of them
    hot = F.broadcast(of.where(F.col("_n") > _HOT))
    return joined(rows, hot).unionByName(joined(joined(rows, hot, "left_anti"), of.where(F.col("_n") <= _HOT)))


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """One row for each kept vector: vec_id, label, code (two hexadecimal digits a
    part), error, label_error and codebooks_sha256."""
    books = fit(vectors, parts, entries, rounds, scale)
    rows = stage(encode(vectors, books, scale))
    return with_label_error(rows).withColumn("codebooks_sha256", F.lit(digest(books)))
