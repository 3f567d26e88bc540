"""Scores of documents by a byte model (prediction by partial matching), with the
word-count scores beside them.

What is scored is a text's words, joined by single spaces, and its end: white space
carries no tokens, so both scores are of the same content.

One pass hashes the words of every text and counts the byte grams of the training
texts. Each batch's distinct words go, packed, to the shard that owns their hash,
and its distinct grams to the shard of the ``DEPTH`` bytes before their last, which
so holds whole contexts of that length and longer: a frequent word or gram is one
entry of a batch, however often it comes. A shard adds up counts over the whole
corpus. All shards together find how likely new symbols are; then each answers the
words and grams it was sent, and a batch's texts meet the answers. Every gram is kept.
Broadcast are only the orders below ``DEPTH``: grams of at most three bytes, whose
number is bounded by the alphabet.

Defined results: a null text is empty, its one token is the end; repeated rows
count and score as often as they come; a null id is taken as the empty string when
rows are dealt out. The input's rows must come in the same order each time, as
those of a table scan do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import shards_for, stage
from .packed import batch_of, by_shard, pack, slices, unpack
from .ppm import BUCKETS, Model, grams, left_out, nodes_of

SHARD_BYTES = 8 << 20
#: Bytes of context by which grams are dealt out.
DEPTH = 3
#: Groups in which the shards' sums are added up.
SUM_GROUPS = 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Stands for the end of a text among word hashes.
_END_HASH = np.uint64(0x5851F42D4C957F2D)

_ROWS = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_PARTS = pa.schema(list(_ROWS)[1:])
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, word_sum double, score double"
TOKENS, DOCS, TOTALS, GRAMS, SUMS, MODEL = 1, 2, 3, 4, 5, 6
#: Sums are of short grams, or, with this bit, of left out symbols.
_POOLED = np.uint64(1 << 63)
_ORDER = "the two passes read their rows in different orders: stage the input first"


def held_out(ids: list, folds: int, fold: int) -> np.ndarray:
    return np.array([zlib.crc32(str("" if x is None else x).encode()) % folds == fold for x in ids], bool)


def _texts(batch: pa.RecordBatch) -> Iterator[W.Texts]:
    """Chunks with A-Z in lower case."""
    for texts in W.chunks(batch.column(1)):
        texts.data = _LOWER[texts.data]
        yield texts


def _ids(batch: pa.RecordBatch) -> tuple[bytes, bytes]:
    column = batch.column(0)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), np.packbits(column.is_valid().to_numpy(zero_copy_only=False)).tobytes()


def _deal(hashes: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard and the places of its keys, ascending."""
    at, bounds = by_shard(hashes, shards)
    for s in np.flatnonzero(np.diff(bounds)):
        yield int(s), np.sort(at[bounds[s] : bounds[s + 1]])


def _contexts(keys: np.ndarray, order: int) -> np.ndarray:
    """A hash of the bytes by which a gram is dealt."""
    return W.mix(keys >> np.uint64(8) & np.uint64((1 << 8 * min(DEPTH, order)) - 1))


def _tokens(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and ends, and the row of each (ends last)."""
    hashes = np.concatenate([texts.word_hashes(), np.full(texts.n_rows, _END_HASH)])
    return hashes, np.concatenate([texts.word_rows(), np.arange(texts.n_rows)])


def _added_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(back, np.concatenate(counts), len(k)).astype(np.uint32)


def _gather(shards: int, order: int, folds: int, fold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, 1):
            held = held_out(batch.column(0).to_pylist(), folds, fold)
            words, keys = ([], []), ([], [])

            def count(into: tuple, of: np.ndarray, learn: np.ndarray) -> None:
                # those that aren't learned from are asked for only
                k, n = np.unique(of[learn], return_counts=True)
                rest = np.unique(of[~learn])
                into[0].extend([k, rest])
                into[1].extend([n, np.zeros(len(rest), np.int64)])

            for texts in _texts(batch):
                learn = ~held[texts.row : texts.row + texts.n_rows]
                hashes, docs = _tokens(texts)
                count(words, hashes, learn[docs])
                data, offsets = W.joined(texts, np.ones(len(texts.starts), bool))
                count(keys, grams(data, offsets, order), np.repeat(learn, np.diff(offsets) + 1))
            rows: dict[str, list] = {f.name: [] for f in _ROWS}

            def put(*row, rows=rows):
                for k, v in zip(rows, row):
                    rows[k].append(v)

            put(number % shards, DOCS, number, _ids(batch)[0], np.packbits(held).tobytes(), _ids(batch)[1])
            for kind, found, by in ((TOKENS, words, lambda k: k), (GRAMS, keys, lambda k: _contexts(k, order))):
                k, n = _added_up(*found)
                for s, own in _deal(by(k), shards):
                    put(s, kind, number, k[own].tobytes(), n[own].tobytes(), b"")
            yield batch_of(_ROWS, rows)
            number += 1

    return run


def _sums(keys: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """What a shard's grams add to all others: counts of the short grams, and, for each
    order that the shard holds whole contexts of, the left out symbols by bucket."""
    depth = min(DEPTH, order)
    node, count, *_ = nodes_of(keys, n, depth - 1)
    names, values = [node], [count]
    for j in range(depth, order + 1):
        _, _, _, _, total, kind, once = nodes_of(keys, n, j)
        for side, found in enumerate(left_out(total, kind, once)):
            at = np.flatnonzero(found)
            names.append(_POOLED | np.uint64(2 * j + side << 32) | at.astype(np.uint64))
            values.append(found[at])
    return np.concatenate(names), np.concatenate(values).astype(np.int64)


def _add_up(order: int):
    """One shard: log10(count + 1) over the corpus of the words that each batch asks
    for; and the shard's grams, with the places among them of those asked for."""

    def run(table: pa.Table) -> pa.Table:
        return _added(table, order)

    return run


def _asked(given: list[dict], kind: int) -> tuple[list[dict], np.ndarray, np.ndarray, list[np.ndarray]]:
    """A kind's requests, its distinct keys, their counts, and each request's places."""
    found = [r for r in given if r["kind"] == kind]
    if not found:
        return [], np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    each = [np.frombuffer(r["a"], np.uint64) for r in found]
    keys, back = np.unique(np.concatenate(each), return_inverse=True)
    n = np.bincount(back, np.concatenate([np.frombuffer(r["b"], np.uint32) for r in found]), len(keys)).astype(np.int64)
    return found, keys, n, np.split(back, np.cumsum([len(k) for k in each])[:-1])


def _added(table: pa.Table, order: int) -> pa.Table:
    rows: dict[str, list] = {f.name: [] for f in _PARTS}

    def put(*row):
        for k, v in zip(rows, row):
            rows[k].append(v)

    shard = table["shard"][0].as_py()
    given = table.select(["kind", "batch", "a", "b", "c"]).to_pylist()
    found, words, counts, places = _asked(given, TOKENS)
    if found:
        put(TOTALS, -1, np.array([(counts > 0).sum(), counts.sum()], np.int64).tobytes(), b"", b"")
        logs = np.log10(counts + 1.0)
        for r, at in zip(found, places):
            put(TOKENS, r["batch"], logs[at].tobytes(), np.int64(shard).tobytes(), b"")
    found, keys, n, places = _asked(given, GRAMS)
    if found:
        asked = np.array([[r["batch"] for r in found], [len(x) for x in places]], np.int64)
        put(GRAMS, shard, keys.tobytes(), n.tobytes(), np.int64(len(found)).tobytes() + asked.tobytes() + b"".join(pack(x) for x in places))
        names, values = _sums(keys[n > 0], n[n > 0], order)
        groups = W.mix(names) % np.uint64(SUM_GROUPS)
        for g in np.unique(groups):
            put(SUMS, int(g), names[groups == g].tobytes(), values[groups == g].tobytes(), b"")
    for r in given:
        if r["kind"] == DOCS:
            put(DOCS, r["batch"], r["a"], r["b"], r["c"])
    return pa.Table.from_batches([batch_of(_PARTS, rows)])


def _sum_up(table: pa.Table) -> pa.Table:
    names, back = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["a"]]), return_inverse=True)
    n = np.bincount(back, np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["b"]]), len(names)).astype(np.int64)
    return pa.table({"a": pa.array([names.tobytes()], pa.binary()), "b": pa.array([n.tobytes()], pa.binary())})


def _shared(parts: DataFrame, order: int) -> tuple[Model, list[np.ndarray]]:
    """The model of the orders below the shards', and what is pooled over the others."""
    rows = parts.where(F.col("kind") == SUMS).select("batch", "a", "b").groupBy("batch").applyInArrow(_sum_up, "a binary, b binary").collect()
    names = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["a"], np.uint64) for r in rows)])
    n = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["b"], np.int64) for r in rows)])
    short = names < _POOLED
    at = np.argsort(names[short])
    low = Model(names[short][at], n[short][at], min(DEPTH, order) - 1)
    pooled = np.zeros((order + 1, 2, BUCKETS))
    which = (names[~short] & ~_POOLED).astype(np.int64)
    pooled[which >> 33, which >> 32 & 1, which & 0xFFFFFFFF] = n[~short]
    return low, list(pooled)


def _answer(shared, order: int):
    """Each shard's grams: log10 of their chances, for the batches that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, pooled = shared.value
        for batch in batches:
            for shard, a, b, c in zip(*(batch.column(k) for k in range(4))):
                keys, n, blob = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.int64), c.as_py()
                p = Model(keys[n > 0], n[n > 0], order, low, pooled).log10(keys)
                asking = int(np.frombuffer(blob, np.int64, 1)[0])
                numbers, sizes = np.frombuffer(blob, np.int64, 2 * asking, 8).reshape(2, -1)
                at = 8 + 16 * asking
                for number, size in zip(numbers, sizes):
                    places = unpack(blob[at : at + 4 * size])
                    at += 4 * int(size)
                    rows = {"kind": [MODEL], "batch": [int(number)], "a": [p[places].tobytes()], "b": [np.int64(shard.as_py()).tobytes()], "c": [b""]}
                    yield batch_of(_PARTS, rows)

    return run


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their batch, and their place in it."""
    number = TaskContext.get().partitionId() << 32
    for batch in slices(batches, 1):
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.arange(n)), batch.column(0), batch.column(1)], names=["batch", "at", "doc_id", "text"])
        number += 1


def _answered(keys: np.ndarray, hashes: np.ndarray, answers: list[dict], shards: int) -> np.ndarray:
    """The shards' answers in the order of sorted ``keys``."""
    of = {int(np.frombuffer(r["b"], np.int64)[0]): np.frombuffer(r["a"], np.float64) for r in answers}
    out = np.empty(len(keys))
    for s, own in _deal(hashes, shards):
        if len(of.get(s, ())) != len(own):
            raise RuntimeError(_ORDER)
        out[own] = of[s]
    return out


def _looked_up(found: list[tuple], by, answers: list[dict], shards: int) -> Iterator[np.ndarray]:
    """What the shards say of each (distinct keys, places among them)."""
    keys = np.unique(np.concatenate([k for k, *_ in found]))
    p = _answered(keys, by(keys), answers, shards)
    for k, back, *_ in found:
        yield p[np.searchsorted(keys, k)][back]


def _assemble(order: int, shards: int):
    def run(texts: pa.Table, parts: pa.Table) -> pa.Table:
        return _assembled(texts.sort_by("at").select(["doc_id", "text"]), parts, order, shards)

    return run


def _assembled(texts: pa.Table, parts: pa.Table, order: int, shards: int) -> pa.Table:
    """One batch: its documents' rows."""
    given = parts.to_pylist()
    docs = next((r for r in given if r["kind"] == DOCS), None)
    if docs is None or _ids(texts.combine_chunks().to_batches()[0])[0] != docs["a"]:
        raise RuntimeError(_ORDER)
    ids = np.frombuffer(docs["a"], np.int64)
    n = len(ids)
    words, keys = [], []
    for part in _texts(texts):
        hashes, rows = _tokens(part)
        words.append((*np.unique(hashes, return_inverse=True), rows + part.row))
        data, offsets = W.joined(part, np.ones(len(part.starts), bool))
        keys.append((*np.unique(grams(data, offsets, order), return_inverse=True), offsets))
    sums, known, tokens = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for logs, (_, _, rows) in zip(_looked_up(words, lambda k: k, [r for r in given if r["kind"] == TOKENS], shards), words):
        sums += np.bincount(rows, logs, n)
        known += np.bincount(rows, logs > 0, n).astype(np.int64)
        tokens += np.bincount(rows, minlength=n)
    chances = _looked_up(keys, lambda k: _contexts(k, order), [r for r in given if r["kind"] == MODEL], shards)
    scores = np.concatenate([np.add.reduceat(p, o[:-1] + np.arange(len(o) - 1)) for p, (_, _, o) in zip(chances, keys)])
    valid = np.unpackbits(np.frombuffer(docs["c"], np.uint8), count=n).astype(bool)
    held = np.unpackbits(np.frombuffer(docs["b"], np.uint8), count=n).astype(bool)
    return pa.table(
        {"doc_id": pa.array(ids, mask=~valid), "held_out": held, "n_tokens": tokens, "n_known": known, "word_sum": sums, "score": scores}
    )


def score(docs: DataFrame, order: int = 5, folds: int = 7, fold: int = 2) -> DataFrame:
    """One row for each of ``docs``: doc_id, held_out (not learned from), n_tokens
    and n_known (words and the end), train_tokens, base_score (log10 by word counts
    with one added) and score (log10 by the byte model)."""
    if not 1 <= order <= 7:
        raise ValueError("a gram is one to eight bytes")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = shards_for(slim, "text", SHARD_BYTES)
    rows = slim.mapInArrow(_gather(shards, order, folds, fold), "shard int, kind int, batch long, a binary, b binary, c binary")
    parts = "kind int, batch long, a binary, b binary, c binary"
    # a number of partitions of its own, so that a task's share stays near a shard's
    added = stage(rows.repartition(shards, "shard").groupBy("shard").applyInArrow(_add_up(order), parts))
    totals = np.zeros(2, np.int64)
    for row in added.where(F.col("kind") == TOTALS).select("a").toLocalIterator():
        totals += np.frombuffer(row["a"], np.int64)
    distinct, tokens = int(totals[0]), int(totals[1])
    shared = docs.sparkSession.sparkContext.broadcast(_shared(added, order))
    answers = added.where(F.col("kind") == GRAMS).select("batch", "a", "b", "c").mapInArrow(_answer(shared, order), parts)
    both = added.where(F.col("kind").isin(TOKENS, DOCS)).unionByName(answers)
    # on a side of its own: in a union the partitions, and so the batches, had other numbers
    texts = slim.mapInArrow(_texts_of, "batch long, at long, doc_id long, text string")
    texts, both = texts.repartition(shards, "batch"), both.repartition(shards, "batch")
    found = texts.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(_assemble(order, shards), _SCORES)
    less = F.log10(F.lit(float(tokens + distinct + 1)))
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("word_sum") - F.col("n_tokens") * less).alias("base_score"), "score",
    )
