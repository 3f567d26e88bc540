"""What the corpus operators share: reading tables, staging and checked sizes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than the six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is set, a local master gets one of
    its own; a cluster is refused, since its machines would each see a part only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return "file://" + tempfile.gettempdir() + "/checkpoints"


def release(heap: bool = True) -> None:
    """Gives back what the driver no longer uses. Python's handles of Spark's plans are
    cycles: until they are collected, the plans stay on the JVM's heap. Arrow and malloc
    keep freed memory for themselves, which a long application never needs again. Old
    plans, broadcasts and results go when the JVM collects its heap; left to itself it
    asks the system for more instead, and only a whole collection gives any back. Many
    of them in a row do the opposite: from some 7 % of its time spent in collections on,
    the JVM makes its heap larger. Loops of short steps leave them out (``heap``)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every libc has it
        ctypes.CDLL(None).malloc_trim(0)
    if heap and (spark := SparkSession.getActiveSession()):
        spark.sparkContext._jvm.System.gc()


def stage(df: DataFrame, heap: bool = True) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage (a lost executor costs a re-read, not a recomputation)
    and, unlike ``checkpoint()``, computes the rows once. The shuffle files of
    the write are removed when it ends, so disk use is that of the largest step.
    The table goes when the application ends, or before by ``unstage``. ``heap``:
    see ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    with contextlib.suppress(Exception):  # not every Spark has the setting
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        with contextlib.suppress(Exception):
            spark.conf.set(_CLEANUP, before)
    at, files = _files(spark, path)
    files.deleteOnExit(at)
    release(heap)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _files(spark: SparkSession, path: str) -> tuple:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(context._jsc.hadoopConfiguration())


def unstage(*tables: DataFrame) -> None:
    """Removes staged tables that no later plan reads."""
    for df in tables:
        at, files = _files(df.sparkSession, df._staged_at)
        files.delete(at, True)


def shards_for(df: DataFrame, column: str, bytes_each: int) -> int:
    """How many groups keep ``column``'s bytes in a group near ``bytes_each``, or,
    from 4096 groups on, near eight times that: what a task sends to each group
    would otherwise shrink to nothing."""
    total = int(df.agg(F.sum(F.octet_length(F.col(column))).alias("n")).first()["n"] or 0)
    each = max(bytes_each, min(8 * bytes_each, total // 4096))
    return max(12, -(-total // each))


def row_of(docs: DataFrame) -> Column:
    """All columns as one struct ``_row``, so that none can clash with what an
    operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def columns_of(docs: DataFrame, replaced: dict[str, Column] | None = None, without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``docs`` out of ``_row``, some replaced, some left out."""
    replaced = replaced or {}
    return [(replaced[c] if c in replaced else F.col("_row")[c]).alias(c) for c in docs.columns if c not in without]


def number_of_words(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
