"""Sources: experiment tables, bout files, per-observation files, metadata, vectors.

Schemas are given or read as strings and cast: inference would take an id such as
3_10_1 for a number.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import stem
from . import staging
from .npy import files, header, matrices


def is_valid(df: DataFrame) -> Column:
    """``valid`` is anything but 0, missing counting as valid."""
    if "valid" not in df.columns:
        return F.lit(True)
    return F.coalesce(F.expr("try_cast(valid as double)"), F.lit(1.0)) != 0


#: Fields of a bout file's line that are read.
MOST_FIELDS = 64


def experiment(spark: SparkSession, path: str, only_valid: bool = True) -> DataFrame:
    """An experiment CSV; header names are trimmed and their spaces made ``_``."""
    df = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    df = df.toDF(*[c.strip().replace(" ", "_") for c in df.columns])
    for c in ("start_frame", "end_frame"):
        if c in df.columns:
            df = df.withColumn(c, F.expr(f"try_cast({c} as long)"))
    return df.where(is_valid(df)) if only_valid else df


def bouts(spark: SparkSession, path: str, skip_head: int = 3, skip_foot: int = 1) -> DataFrame:
    """Bout CSVs of a folder, one for each observation (its stem), with lines before
    the header and after the last bout. A file is one task's: they are small."""
    lines = spark.read.text(path).select(stem(F.col("_metadata.file_name")).alias("obs"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value")
    up, down = Window.partitionBy("obs").orderBy("b", "i"), Window.partitionBy("obs").orderBy(F.desc("b"), F.desc("i"))
    numbered = lines.withColumns({"k": F.row_number().over(up), "z": F.row_number().over(down)})
    kept = numbered.where((F.col("k") > skip_head) & (F.col("z") > skip_foot))
    # each file has its own header: its columns may come in another order
    fields = F.from_csv("value", ", ".join(f"c{i} string" for i in range(MOST_FIELDS)), {"mode": "PERMISSIVE"})
    cells = kept.withColumn("_c", F.transform(F.array(*[fields[f"c{i}"] for i in range(MOST_FIELDS)]), lambda c: F.trim(c)))
    head = F.max(F.when(F.col("k") == skip_head + 1, F.col("_c"))).over(Window.partitionBy("obs"))
    rows = cells.withColumn("_head", F.transform(head, _form)).where(F.col("k") > skip_head + 1)

    def cell(*names: str) -> Column:
        at = F.coalesce(*[F.nullif(F.array_position("_head", _form(F.lit(n))), F.lit(0)) for n in names])
        missing = F.raise_error(F.concat(F.lit(f"none of {names} in the header of "), F.col("obs")))
        return F.when(at.isNull(), missing).otherwise(F.get("_c", (at - 1).cast("int")))

    return rows.select(
        "obs", (F.col("k") - skip_head - 2).cast("long").alias("ord"), cell("Beginning-frame", "start_frame", "Image index start").try_cast("long").alias("start_frame"),
        cell("End-frame", "end_frame", "Image index stop").try_cast("long").alias("end_frame"), cell("Behavior").alias("behavior"),
    )


def _form(name: Column) -> Column:
    """A header name without case and separators."""
    return F.regexp_replace(F.lower(name), r"[-_\s]", "")


def per_observation(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All CSVs of a folder, ``obs`` from the file's stem."""
    return spark.read.schema(schema).csv(path, header=True).withColumn("obs", stem(F.col("_metadata.file_name")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Frame numbers of frame_%06d.jpg files, by names alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", r"frame_(\d+)", 1).cast("long").alias("frame_idx"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Per-version JSON: one row for each of source, full and the povs."""
    entry = "struct<extension:string,n:long,fps:double,duration_min_total:double,size_MB_total:double>"
    df = spark.read.schema(f"source {entry}, full {entry}, povs map<string,{entry}>").json(path, multiLine=True)
    own = F.map_from_arrays(F.array(F.lit("source"), F.lit("full")), F.array("source", "full"))
    return df.select(F.explode(F.map_concat(own, F.coalesce("povs", F.create_map().cast(f"map<string,{entry}>")))).alias("part", "m")).where("m is not null").select("part", "m.*")


def vectors(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of several tables of vectors that can be read: Parquet by key, or
    ``.npy`` files (see ``npy``). One that is not there is passed over; one that is
    there but broken is passed over with a warning. Refuses if none is left."""
    for path in paths:
        try:
            if path.endswith(".npy"):
                df = matrices(spark, path)
                df.limit(1).collect()
                return df
            return spark.read.parquet(path)
        except FileNotFoundError:
            continue
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "FileNotFoundError" not in str(e):
                warnings.warn(f"{path} can't be read, passed over: {str(e)[:200]}", stacklevel=2)
    raise FileNotFoundError(f"none of {paths}")


def availability(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(version, path, format, available) of each version's vectors. A Parquet table is
    available when its write was whole, ``.npy`` files when their headers are right."""
    rows = []
    for version, path in paths.items():
        kind = "npy" if path.endswith(".npy") else "parquet"
        there = staging.exists(spark, path)
        if there and kind == "npy":
            try:
                there = bool([header(f) for f in files(path)])
            except (ValueError, OSError):
                there = False
        elif there:
            there = staging.exists(spark, f"{path}/_SUCCESS") or path.endswith(".parquet")
        rows.append((version, path, kind, there))
    return spark.createDataFrame(rows, "version string, path string, format string, available boolean")


def distinct_lists(df: DataFrame, *columns: str) -> DataFrame:
    """One row with each column's distinct values, nulls left out, in order; empty for
    columns that the table lacks. For settings of few values, such as gene or sex."""
    none = F.array().cast("array<string>")
    return df.agg(*[(F.sort_array(F.collect_set(F.col(c).cast("string"))) if c in df.columns else F.first(none)).alias(c) for c in columns]).select(*[F.coalesce(c, none).alias(c) for c in columns])


def lettered(df: DataFrame) -> DataFrame:
    """Settings of the letter-and-number ids: batch from the letter, position from
    the number."""
    df = df.withColumnsRenamed({"Experiment": "obs", "Valid": "valid", "FPS": "fps", "Video": "video"})
    return df.withColumns(
        {
            "batch": F.ascii(F.substring("obs", 1, 1)) - F.ascii(F.lit("a")), "position": F.substring("obs", 2, 1).cast("int") - 1,
            "annotation_file": F.concat("obs", F.lit(".csv")), "valid": F.expr("try_cast(valid as double) <> 0"),
        }
    )


def named(df: DataFrame) -> DataFrame:
    df = df.withColumnsRenamed({"observation": "obs", "annotation": "annotation_file"})
    return df.withColumn("valid", is_valid(df) if "valid" in df.columns else F.lit(True))


#: Loaders by domain; ``register`` adds to them.
DOMAINS: dict[str, Callable[[DataFrame], DataFrame]] = {"lettered": lettered, "named": named}


def register(name: str, load: Callable[[DataFrame], DataFrame]) -> None:
    DOMAINS[name] = load


def settings(spark: SparkSession, domain: str, path: str) -> DataFrame:
    if domain not in DOMAINS:
        raise KeyError(f"unknown domain {domain!r}; known: {sorted(DOMAINS)}")
    return DOMAINS[domain](experiment(spark, path, only_valid=False))


def with_annotation_policy(experiments: DataFrame, there: DataFrame, policy: str) -> DataFrame:
    """Marks observations that have annotations. ``yes`` and ``partial`` take those
    whose file is named and in ``there`` (annotation_file); with ``yes`` a named but
    missing file fails the query; ``no`` marks none."""
    if policy == "no":
        return experiments.withColumn("has_file", F.lit(False))
    if policy not in ("yes", "partial"):
        raise ValueError(f"unknown policy {policy!r}")
    found = there.select("annotation_file").distinct().withColumn("_there", F.lit(True))
    rows = experiments.join(found, "annotation_file", "left")
    named = F.col("annotation_file").isNotNull() & (F.trim("annotation_file") != "")
    has = F.coalesce("_there", F.lit(False))
    if policy == "yes":
        has = F.when(named & ~has, F.raise_error(F.concat(F.lit("missing annotation file: "), F.col("annotation_file"))).cast("boolean")).otherwise(has)
    return rows.withColumn("has_file", named & has).drop("_there")
