"""Substring dedup by fixed-block anchors.

Any passage of ``length`` words holds a whole block of ``length // 2`` words that
starts at a multiple of ``length // 2`` in its document. So:

1. *Index and probe.* Each document's non-overlapping blocks are the index and the
   hash of every rolling window of a block's length is a probe. Both go, packed as
   arrays, to the shard that owns their hash range; a shard keeps the positions of
   probes that meet an indexed block which at least two probes meet.
2. *Extend.* Around these anchors the passages of ``length`` words are hashed in
   full and sent, again packed, to the shard of that hash. A passage which starts
   in a document with a smaller id is a repeat; overlapping repeats join into
   maximal ones.
3. *Remove.* Words covered by a repeat go.

Rows between tasks are packed arrays, one row for each batch and shard, so volume
is a few bytes a word and a passage shared by very many documents is only as many
entries of an array. Shard counts follow the bytes of the input, so a task's share
does not grow with it. No pairs of documents are ever formed.

Defined results: a null text has no words; null ids are neither smaller nor larger
than any, so such rows lose nothing; rows with equal ids never remove from one
another; documents below ``length`` words lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import shards_for, stage, unstage
from .packed import LOW, batch_of, by_shard, pack, slices, unpack

#: Bytes of text whose probes make one shard.
SHARD_BYTES = 8 << 20
_PROBES = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("hashes", pa.binary()), ("places", pa.binary())])
_HITS = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("ids", pa.binary()), ("places", pa.binary())])


def _probes(shards: int, block: int, length: int):
    """Packed probes (kind 1) and index blocks (kind 0) by shard, and each batch's
    documents (kind 2: ids and the place of their first word), which any shard
    hands on. The rows of a partition must come in the same order when a lost
    task is run again, as those of a table scan do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, 1):
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            hashes, places, anchors, first, base = [], [], [], [], 0
            for texts in W.chunks(batch.column(1)):
                h = W.window_hashes(texts.word_hashes(), block)
                ok = W.inside(texts.first, len(h), block)
                # a document shorter than a passage can't hold one
                rows = texts.word_rows()[: len(h)]
                ok &= texts.n_words[rows] >= length
                at = np.flatnonzero(ok)
                hashes.append(h[at])
                places.append(at + base)
                anchors.append((at - texts.first[rows[at]]) % block == 0)
                first.append(texts.first[:-1] + base)
                base += len(texts.starts)
            h, p, a = np.concatenate(hashes), np.concatenate(places).astype(np.uint32), np.concatenate(anchors)
            out: dict[str, list] = {f.name: [] for f in _PROBES}

            def put(shard, kind, x, y, out=out):
                for k, v in zip(out, (shard, kind, number, x, y)):
                    out[k].append(v)

            put(number % shards, 2, ids.astype(np.int64).tobytes(), np.concatenate(first).astype(np.uint32).tobytes())
            for kind, hh, pp in ((0, h[a], None), (1, h, p)):
                order, bounds = by_shard(hh, shards)
                low = (hh[order] & LOW).astype(np.uint32)
                places_in = pp[order] if pp is not None else None
                for s in np.flatnonzero(np.diff(bounds)):
                    x, y = bounds[s], bounds[s + 1]
                    put(int(s), kind, low[x:y].tobytes(), pack(places_in[x:y]) if pp is not None else b"")
            yield batch_of(_PROBES, out)
            number += 1

    return run


def _match(table: pa.Table) -> pa.Table:
    """One shard: places of probes of blocks that two or more probes meet."""
    kinds = table.column("kind").to_numpy()
    blobs, places, batches = table.column("hashes"), table.column("places"), table.column("batch").to_numpy()
    own = [np.frombuffer(blobs[int(i)].as_py(), np.uint32) for i in np.flatnonzero(kinds == 0)]
    index = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint32)
    met = np.zeros(len(index), np.int64)
    found = []
    for i in np.flatnonzero(kinds == 1) if len(index) else ():
        h = np.frombuffer(blobs[int(i)].as_py(), np.uint32)
        at = np.minimum(np.searchsorted(index, h), len(index) - 1)
        hit = np.flatnonzero(index[at] == h)
        met += np.bincount(at[hit], minlength=len(index))
        found.append((int(batches[i]), at[hit], unpack(places[int(i)].as_py())[hit]))
    rows: dict[str, list] = {f.name: [] for f in _HITS}
    for number, at, p in found:
        if len(p := p[met[at] > 1]):
            for k, v in zip(rows, (number, 1, None, pack(p))):
                rows[k].append(v)
    for i in np.flatnonzero(kinds == 2):
        for k, v in zip(rows, (int(batches[i]), 2, blobs[int(i)].as_py(), places[int(i)].as_py())):
            rows[k].append(v)
    return pa.Table.from_batches([batch_of(_HITS, rows)])


_ANCHORS = pa.schema([("doc_id", pa.int64()), ("anchors", pa.binary())])


def _locate(table: pa.Table) -> pa.Table:
    """One batch: its hits by document, places counted from the text's start."""
    rows: dict[str, list] = {"doc_id": [], "anchors": []}
    kinds = table.column("kind").to_pylist()
    hits = [unpack(table.column("places")[i].as_py()) for i, k in enumerate(kinds) if k == 1]
    docs = [i for i, k in enumerate(kinds) if k == 2]
    if hits and docs:
        ids = np.frombuffer(table.column("ids")[docs[0]].as_py(), np.int64)
        first = np.frombuffer(table.column("places")[docs[0]].as_py(), np.uint32)
        p = np.unique(np.concatenate(hits))
        # rows without words share their first word with the next row, which owns it
        doc = np.searchsorted(first, p, "right") - 1
        cut = np.flatnonzero(np.diff(doc, prepend=-1))
        for x, y in zip(cut, [*cut[1:], len(p)]):
            rows["doc_id"].append(int(ids[doc[x]]))
            rows["anchors"].append((p[x:y] - first[doc[x]]).tobytes())
    return pa.Table.from_batches([batch_of(_ANCHORS, rows)])


_PASSAGES = pa.schema([("shard", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary()), ("places", pa.binary())])


def _near(anchors: list[bytes], n: int, block: int, length: int) -> np.ndarray:
    """Starts of the passages that hold an anchor's whole block."""
    p = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in anchors]).astype(np.int64))
    p = p[p <= n - block]
    mark = np.zeros(n + 2, np.int32)
    np.add.at(mark, np.maximum(p - (length - block), 0), 1)
    np.add.at(mark, np.minimum(p, n - length) + 1, -1)
    return np.flatnonzero(np.cumsum(mark[: n - length + 1]) > 0)


def _passages(shards: int, block: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids, anchors = batch.column(0).to_numpy(), batch.column(2)
            hs, ds, ps = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for texts in W.chunks(batch.column(1)):
                h = W.window_hashes(texts.word_hashes(), length)
                for i in range(texts.n_rows):
                    n = int(texts.n_words[i])
                    if n < length:
                        continue
                    at = _near(anchors[texts.row + i].as_py(), n, block, length)
                    hs.append(h[texts.first[i] + at])
                    ds.append(np.full(len(at), ids[texts.row + i]))
                    ps.append(at.astype(np.int32))
            h, d, p = np.concatenate(hs), np.concatenate(ds), np.concatenate(ps)
            order, bounds = by_shard(h, shards)
            h, d, p = h[order], d[order], p[order]
            rows: dict[str, list] = {f.name: [] for f in _PASSAGES}
            for s in np.flatnonzero(np.diff(bounds)):
                x, y = bounds[s], bounds[s + 1]
                for k, v in zip(rows, (int(s), h[x:y].tobytes(), d[x:y].tobytes(), p[x:y].tobytes())):
                    rows[k].append(v)
            yield batch_of(_PASSAGES, rows)

    return run


_BY_BUCKET = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("places", pa.binary())])
_REPEATS = pa.schema([("doc_id", pa.int64()), ("repeats", pa.binary())])


def _repeats(buckets: int):
    """One shard: starts of passages that a smaller document also has, packed by
    bucket of documents."""

    def run(table: pa.Table) -> pa.Table:
        h, d, p = (
            np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(c)])
            for c, t in (("hashes", np.uint64), ("ids", np.int64), ("places", np.int32))
        )
        order = np.lexsort((d, h))
        h, d, p = h[order], d[order], p[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = d > least
        d, p = d[later], p[later]
        bucket = (W.mix(d.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, d, p = bucket[order], d[order], p[order]
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        spans = list(zip(cut, [*cut[1:], len(d)]))
        rows = {"bucket": bucket[cut].tolist(), "ids": [d[x:y].tobytes() for x, y in spans], "places": [p[x:y].tobytes() for x, y in spans]}
        return pa.Table.from_batches([batch_of(_BY_BUCKET, rows)])

    return run


def _by_document(table: pa.Table) -> pa.Table:
    """One bucket: each document's starts."""
    d = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("ids")])
    p = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table.column("places")])
    order = np.argsort(d, kind="stable")
    d, p = d[order], p[order]
    cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    rows = {"doc_id": d[cut].tolist(), "repeats": [p[x:y].tobytes() for x, y in zip(cut, [*cut[1:], len(d)])]}
    return pa.Table.from_batches([batch_of(_REPEATS, rows)])


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _cut(length: int, digest: bool):
    schema = pa.schema([*list(_RESULT)[:3], ("kept_sha256", pa.string())]) if digest else _RESULT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids, repeats, at = batch.column(0), batch.column(2), 0
            for texts in W.chunks(batch.column(1)):
                keep = np.ones(len(texts.starts), bool)
                for i in range(texts.n_rows):
                    if (found := repeats[texts.row + i].as_py()) and ids[texts.row + i].is_valid:
                        n = int(texts.n_words[i])
                        p = np.frombuffer(found, np.int32)
                        p = np.unique(p[p <= n - length])
                        mark = np.zeros(n + 1, np.int32)
                        mark[p] += 1
                        np.add.at(mark, p + length, -1)
                        keep[texts.first[i] : texts.first[i + 1]] = np.cumsum(mark[:n]) == 0
                kept = np.concatenate([[0], np.cumsum(keep)])
                left = np.diff(kept[texts.first])
                data, offsets = W.joined(texts, keep)
                parts = [data[x:y].tobytes() for x, y in zip(offsets, offsets[1:])]
                last = [hashlib.sha256(x).hexdigest() for x in parts] if digest else [x.decode() for x in parts]
                arrays = [ids.slice(at, texts.n_rows), pa.array(texts.n_words, pa.int64()), pa.array(texts.n_words - left, pa.int64()), pa.array(last, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
                at += texts.n_rows

    return run


def repeated_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, repeats): for each document the packed int32 word positions where
    a passage of ``length`` words starts that also starts in a smaller doc_id."""
    if length < 2:
        raise ValueError("a passage has two words at least")
    block = length // 2
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    shards = shards_for(slim, "text", SHARD_BYTES)
    packed = "shard int, kind int, batch long, hashes binary, places binary"
    probes = slim.mapInArrow(_probes(shards, block, length), packed)
    hits = probes.repartition(shards, "shard").groupBy("shard").applyInArrow(_match, "batch long, kind int, ids binary, places binary")
    anchors = hits.groupBy("batch").applyInArrow(_locate, "doc_id long, anchors binary")
    anchors = stage(anchors.groupBy("doc_id").agg(F.collect_list("anchors").alias("anchors")))
    # a number of partitions of its own, so that a task's share stays near a shard's
    near = slim.repartition(shards, "doc_id").join(anchors, "doc_id").select("doc_id", "text", "anchors")
    passages = near.mapInArrow(_passages_of(shards, block, length), "shard int, hashes binary, ids binary, places binary")
    found = passages.repartition(shards, "shard").groupBy("shard").applyInArrow(_repeats(shards), "bucket int, ids binary, places binary")
    repeats = stage(found.repartition(shards, "bucket").groupBy("bucket").applyInArrow(_by_document, "doc_id long, repeats binary"))
    unstage(anchors)
    return repeats


def _passages_of(shards: int, block: int, length: int):
    one = _passages(shards, block, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # several blobs of one document, from repeated rows, become one
            joined = pa.array([b"".join(x.as_py()) for x in batch.column(2)], pa.binary())
            lists = pa.array([[x.as_py()] for x in joined], pa.list_(pa.binary()))
            yield from one(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "text", "anchors"])]))

    return run


def remove_repeats(docs: DataFrame, length: int = 50, digest: bool = False) -> DataFrame:
    """One row for each of ``docs``: doc_id, n_words, n_removed and kept_text (its
    kept words joined by one space), or with ``digest`` that text's kept_sha256."""
    repeats = repeated_passages(docs, length)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slim = slim.repartition(shards_for(slim, "text", SHARD_BYTES), "doc_id")
    rows = slim.join(repeats, "doc_id", "left").select("doc_id", "text", "repeats")
    last = "kept_sha256" if digest else "kept_text"
    return rows.mapInArrow(_cut(length, digest), f"doc_id long, n_words long, n_removed long, {last} string")
