"""Folds over an observation's rows in order, in one pass with little state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def fold(df: DataFrame, key: str, order: str, columns: tuple[str, ...], made: dict[str, str], begin: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """(key, order, *made) rows that a step emits for each row of ``df``.

    ``begin`` gives the step of a fresh key, which is called with order and
    ``columns`` of its rows, in order, and answers tuples of ``made``. Rows are sorted
    by Spark and stream through, so a key's time is linear in its rows and memory is
    the step's state; nothing is collected by key.
    """
    types = dict(df.dtypes)
    names = {key: types[key], order: types[order], **made}
    schema = pa.schema([(n, _ARROW[t]) for n, t in names.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = batches  # no key is this
        step = None
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if k != at:
                    at, step = k, begin()
                for values in step(*row):
                    for into, v in zip(out, (k, row[0], *values)):
                        into.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    slim = df.select(key, order, *columns).repartition(key).sortWithinPartitions(key, order)
    return slim.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in names.items()))


def fold_stretches(df: DataFrame, key: str, order: str, columns: tuple[str, ...], made: dict[str, str], begin: Callable[[], Callable[..., tuple[np.ndarray, tuple[np.ndarray, ...]]]]) -> DataFrame:
    """As ``fold``, for steps that work on arrays: a step is called with order and
    ``columns`` of consecutive rows of its key (null numbers are NaN), and answers the
    places of the rows that it emits and an array for each of ``made`` (NaN is null). A
    key that goes on in the next batch goes on with the same step."""
    types = dict(df.dtypes)
    names = {key: types[key], order: types[order], **made}
    schema = pa.schema([(n, _ARROW[t]) for n, t in names.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = batches  # no key is this
        step = None
        for batch in batches:
            if not batch.num_rows:
                continue
            same = pc.fill_null(pc.equal(batch.column(0)[1:], batch.column(0)[:-1]), False).to_numpy(zero_copy_only=False)
            both_null = (pc.is_null(batch.column(0)[1:]).to_numpy(zero_copy_only=False)) & (pc.is_null(batch.column(0)[:-1]).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(~(same | both_null)) + 1).tolist(), batch.num_rows]
            arrays = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            places, values = [], [[] for _ in made]
            for x, y in zip(cuts, cuts[1:]):
                k = batch.column(0)[x].as_py()
                if k != at:
                    at, step = k, begin()
                own, out = step(*(a[x:y] for a in arrays))
                places.append(np.asarray(own, np.int64) + x)
                for into, v in zip(values, out):
                    into.append(v)
            chosen = pa.array(np.concatenate(places))
            columns_out = [pa.array(np.concatenate(v), f.type, from_pandas=True) for v, f in zip(values, list(schema)[2:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen), *columns_out], schema=schema)

    slim = df.select(key, order, *columns).repartition(key).sortWithinPartitions(key, order)
    return slim.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in names.items()))
