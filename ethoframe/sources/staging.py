"""Tables written aside in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without one a local master gets a folder of its own and a
    cluster is refused, as its machines would each see a part only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return root or "file://" + tempfile.gettempdir() + "/checkpoints"


def files(spark: SparkSession, path: str) -> tuple:
    """(path, file system) as Hadoop knows them."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(context._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = files(spark, path)
    return bool(system.exists(at))


def remove(spark: SparkSession, path: str) -> None:
    at, system = files(spark, path)
    system.delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder, in order; none if it is not there."""
    at, system = files(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def replace(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder that was written aside; false if the target came to be meanwhile."""
    (a, system), (b, _) = files(spark, source), files(spark, target)
    system.mkdirs(b.getParent())
    return not system.exists(b) and bool(system.rename(a, b))


def staged(df: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """``df`` written and read back, one folder for each value of ``by``, and its path.
    The table goes when the application ends, or before by ``remove``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    at, system = files(spark, path)
    system.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), path
