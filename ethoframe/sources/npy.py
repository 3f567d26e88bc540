"""Matrices in ``.npy`` files as tables: ``spark.read.format("npy").load(folder)``.

The driver reads headers only and plans ranges of ``rows_each`` rows; a task seeks to its
range and reads no more. Rows are (file, row, vector). Numbers of 2, 4 or 8 bytes are
read, in row order; other types (objects above all, which would be run, not read),
Fortran order and more than two dimensions are refused. Where the session pushes filters
to Python sources (``spark.sql.python.filterPushdown.enabled``), conditions on ``row``
leave out ranges.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

_NUMBERS = {"f2", "f4", "f8", "i2", "i4", "i8", "u2", "u4"}
_HEADER = 1 << 16


@dataclass
class Part(InputPartition):
    """Rows ``start`` to ``end`` of a file whose rows have ``width`` numbers."""

    path: str
    start: int
    end: int
    width: int
    dtype: str
    offset: int

    def __post_init__(self) -> None:
        super().__init__(self.path)


def _opened(path: str):
    system, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inside


def header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, where the numbers begin) of a file."""
    system, inside = _opened(path)
    with system.open_input_file(inside) as f:
        start, size = io.BytesIO(f.read(_HEADER)), f.size()
    try:
        version = np.lib.format.read_magic(start)
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version]
        shape, fortran, dtype = read(start)
    except (ValueError, KeyError) as e:
        raise ValueError(f"{path} is no .npy file: {e}") from None
    if dtype.str[1:] not in _NUMBERS:
        raise ValueError(f"{path} holds {dtype}, not numbers of 2, 4 or 8 bytes")
    if not 1 <= len(shape) <= 2 or fortran and len(shape) > 1:
        raise ValueError(f"{path} is no matrix in row order")
    if size < start.tell() + dtype.itemsize * int(np.prod(shape)):
        raise ValueError(f"{path} is shorter than its header says")
    return shape, dtype, start.tell()


def files(path: str) -> list[str]:
    """The file itself, or the ``.npy`` files under a folder, in order."""
    system, inside = _opened(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = sorted(i.path for i in system.get_file_info(fs.FileSelector(inside, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(".npy"))
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return [scheme + f for f in found]


class NpyReader(DataSourceReader):
    def __init__(self, path: str, rows_each: int):
        self.path, self.rows_each, self.least, self.most = path, rows_each, 0, None

    def partitions(self) -> list[Part]:
        out, width = [], None
        for path in files(self.path):
            shape, dtype, offset = header(path)
            own = shape[1] if len(shape) == 2 else 1
            if width not in (None, own):
                raise ValueError(f"{path} has rows of {own} numbers, files before it of {width}")
            width = own
            to = shape[0] if self.most is None else min(shape[0], self.most)
            out += [Part(path, at, min(at + self.rows_each, to), own, dtype.str, offset) for at in range(self.least, to, self.rows_each)]
        return out or [Part("", 0, 0, 1, "<f4", 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.end <= part.start:
            return
        dtype = np.dtype(part.dtype)
        bytes_each = dtype.itemsize * part.width
        system, inside = _opened(part.path)
        with system.open_input_file(inside) as f:
            for at in range(part.start, part.end, 4096):
                n = min(4096, part.end - at)
                f.seek(part.offset + at * bytes_each)
                values = np.frombuffer(f.read(n * bytes_each), dtype).astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * part.width, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(np.arange(at, at + n)), lists], ["file", "row", "vector"])


class NarrowedReader(NpyReader):
    """For sessions that push filters to Python sources; others refuse a reader that
    takes them."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows the rows to read; Spark checks all conditions again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("row",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.most = end if self.most is None else min(self.most, end)
            yield f


class NpyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, row long, vector array<double>"

    def reader(self, schema) -> NpyReader:
        each = int(self.options.get("rows_each", 65536))
        if each < 1:
            raise ValueError("rows_each is at least 1")
        kind = NarrowedReader if self.options.get("narrow", "false") == "true" else NpyReader
        return kind(self.options["path"], each)


def matrices(spark: SparkSession, path: str, rows_each: int = 65536):
    """(file, row, vector) of a file or a folder of files."""
    spark.dataSource.register(NpyDataSource)
    narrow = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("npy").options(rows_each=rows_each, narrow=narrow).load(path)
