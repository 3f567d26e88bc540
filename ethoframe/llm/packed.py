"""Arrays packed into one row for each batch and shard, for exchanges of many small
values: Spark moves and groups the rows, numpy works on what is in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOW = np.uint64(0xFFFFFFFF)


def by_shard(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(stable order by shard, bounds of each shard in it); the shard comes from
    the high bits, so the low ones stay a full hash within it."""
    shard = ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.uint32)
    order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def pack(places: np.ndarray) -> bytes:
    """Ascending places as gaps, lowest bytes first, so that codecs squeeze them."""
    gaps = np.diff(places.astype(np.uint32), prepend=np.uint32(0))
    return gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(gaps, dtype=np.uint32)


def batch_of(schema: pa.Schema, rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


#: Bytes of text that a task works on at once.
SLICE = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut, between rows, into parts of about ``size`` bytes of text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lengths, dtype=np.int64), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, to - at)
            at = to
