"""Scalar expressions of the domain: ids, clocks, distances, bounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    s = F.floor(seconds)
    return F.concat_ws(":", *[F.lpad(x.cast("string"), 2, "0") for x in (F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)])


def minute_of(frame: Column, fps: Column | float) -> Column:
    return F.floor(frame / (F.lit(60.0) * fps)).cast("long")


def frame_file(frame: Column) -> Column:
    return F.concat(F.lit("frame_"), F.lpad(frame.cast("string"), 6, "0"), F.lit(".jpg"))


def frame_of_file(path: Column) -> Column:
    return F.regexp_extract(path, r"frame_(\d+)", 1).cast("long")


def stem(path: Column) -> Column:
    """A path's file name without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def pool_of(observation: Column) -> Column:
    """line_sex_seed of genotype_line_sex_seed_odor_phase."""
    return F.array_join(F.slice(F.split(observation, "_"), 2, 3), "_")


def fraction(text: Column) -> Column:
    """30000/1001 as a number; null where the denominator is 0."""
    parts = F.split(text, "/")
    return F.element_at(parts, 1).cast("double") / F.nullif(F.coalesce(F.get(parts, F.lit(1)).cast("double"), F.lit(1.0)), F.lit(0.0))


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclid(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x))


def sigmoid(logit: Column, temperature: float | Column = 1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit / temperature))


def null_if_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def any_of(*p: Column) -> Column:
    """The chance of at least one of independent events."""
    return F.lit(1.0) - reduce(lambda a, x: a * (F.lit(1.0) - x), p, F.lit(1.0))


def noise_bound(p: Column) -> Column:
    """The best accuracy under label noise that makes two raters differ by p."""
    return F.when(p < 0.5, F.lit(1.0) - (F.lit(1.0) - F.sqrt(F.lit(1.0) - 2 * p)) / 2)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def mean_of(*c: Column) -> Column:
    """The mean of those that aren't null."""
    total = reduce(lambda a, x: a + F.coalesce(x, F.lit(0.0)), c, F.lit(0.0))
    n = reduce(lambda a, x: a + x.isNotNull().cast("int"), c, F.lit(0))
    return total / F.nullif(n, F.lit(0))


def from_one(number: Column, most: int) -> Column:
    """A number from 1 to ``most`` as one from 0; null for the rest."""
    return F.when(number.between(1, most), number - 1)


def widened(value: Column, margin: float, low: float, high: float) -> Column:
    """A whole-number bound moved by ``margin`` (downwards if negative), kept in range."""
    return F.least(F.greatest(value.cast("int") + F.lit(margin), F.lit(low)), F.lit(high)).cast("int")
