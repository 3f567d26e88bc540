"""Packing token sequences by the sum-of-squares rule.

1. Each partition encodes its documents and cuts whole windows off the long ones.
2. The remainders of ``STREAMS`` partitions meet in one task, in order: the rule works
   well on long streams only. Each goes to the fill level that makes the sum of the
   squared counts of partially filled windows least. Counts by level are one array
   of the window's length, so a placement costs one pass over it whatever has been
   packed.
3. The windows that are open at the end of a stream are laid end to end and cut into
   full ones; the last rest becomes windows of 2^k tokens, which need no padding, and
   one short one.

Memory is the open windows': at most a few for each level.

Defined results: null and empty texts are the end mark alone; the string of a special
token in a text is that token; repeated rows are packed as often as they come; null
ids stay null; an empty table gives no rows. The order of the rows in a partition
decides the packing, so a table scan gives the same one each time.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Rests of a stream below this are padded rather than cut into powers of two.
LEAST_REST = 128
#: Partitions whose remainders meet in one task.
STREAMS = 16
#: Special tokens of the default vocabulary.
SPECIAL = {"<|endoftext|>": 50256}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The byte-level BPE of 50,257 ids, from its ranks: the ids are those of the
    ``tokenizers`` file of the same name, found about four times as fast."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


Piece = tuple  # (doc_id, start, ids, doc_tokens)


class Levels:
    """Partially filled windows by fill level."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]

    def place(self, piece: Piece) -> list[Piece] | None:
        """Puts the piece into a window; returns the window if that filled it."""
        n, count, size = len(piece[2]), self.count, self.size
        best, level = 2 * int(count[n]) + 1 if n < size else 1, 0
        if n < size:
            # from level h to h + n: the change of the sum of squares
            change = 2 * (count[1 + n : size + 1] - count[1 : size + 1 - n]) + 2
            change[-1] = 1 - 2 * count[size - n]
            change[count[1 : size + 1 - n] == 0] = np.iinfo(np.int64).max
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= best:
                level = at + 1
        window = self.open[level].pop() if level else []
        if level:
            count[level] -= 1
        window.append(piece)
        if level + n == size:
            return window
        count[level + n] += 1
        self.open[level + n].append(window)
        return None

    def rest(self) -> Iterator[list[Piece]]:
        """The open windows, laid end to end and cut anew."""
        pieces = [p for level in reversed(self.open) for window in level for p in window]
        left = sum(len(p[2]) for p in pieces)
        at, used = 0, 0
        while left:
            goal = min(self.size, left)
            if goal < self.size and goal >= LEAST_REST:
                goal = 1 << (goal.bit_length() - 1)
            window, need = [], goal
            while need:
                doc, start, ids, n = pieces[at]
                take = min(need, len(ids) - used)
                window.append((doc, start + used, ids[used : used + take], n))
                need, used = need - take, used + take
                if used == len(ids):
                    at, used = at + 1, 0
            left -= goal
            yield window


class _Rows:
    """Finished windows, and remainders passed on, as rows of one schema."""

    def __init__(self, digest: bool, sequence: int, raw: type = np.uint32):
        last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int32()))
        names = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), last, ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
        self.schema = pa.schema([*names, ("stream", pa.int64()), ("raw", pa.binary()), ("how", pa.string())])
        self.digest, self.sequence, self.raw = digest, sequence, raw
        self.rows: dict[str, list] = {f.name: [] for f in self.schema}

    def put(self, window: list[Piece], how: str, stream: int | None = None) -> None:
        offset = 0
        for doc, start, ids, n in window:
            shown = None if stream is not None else zlib.crc32(ids.tobytes()) if self.digest else ids.astype(np.int32)
            raw = ids.astype(self.raw).tobytes() if stream is not None else None
            for k, v in zip(self.rows, (doc, start, len(ids), shown, n, self.sequence, offset, stream, raw, how)):
                self.rows[k].append(v)
            offset += len(ids)
        self.sequence += 1

    def full(self) -> bool:
        return len(self.rows["doc_id"]) >= 8192

    def flush(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(self.rows[f.name], f.type) for f in self.schema], schema=self.schema)
        for v in self.rows.values():
            v.clear()
        return made


def _raw(code) -> type:
    """The least type for ids on their way."""
    return np.uint16 if code.n_vocab <= 1 << 16 else np.uint32


def _packer(size: int, vocabulary: str, digest: bool, end: int):
    """One partition: its whole windows, and its remainders with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, partition = encoding(vocabulary), TaskContext.get().partitionId()
        rows = _Rows(digest, partition << 33, _raw(code))
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.array([*code.encode(text.as_py() or "", allowed_special="all"), end], np.uint32)
                doc, n = doc.as_py(), len(ids)
                whole = n - n % size
                for start in range(0, whole, size):
                    rows.put([(doc, start, ids[start : start + size], n)], "whole")
                if whole < n:
                    rows.put([(doc, whole, ids[whole:], n)], "open", partition // STREAMS)
                if rows.full():
                    yield rows.flush()
        yield rows.flush()

    return run


def _merger(size: int, vocabulary: str, digest: bool):
    """The remainders of several partitions, by the rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, rows, at, raw = Levels(size), _Rows(digest, 0), None, _raw(encoding(vocabulary))

        def close() -> None:
            for window in levels.rest():
                rows.put(window, "rest")

        for batch in batches:
            for doc, start, n, stream, ids in zip(*(batch.column(k) for k in ("doc_id", "start", "doc_tokens", "stream", "raw"))):
                if stream.as_py() != at:
                    close()
                    at = stream.as_py()
                    levels, rows.sequence = Levels(size), 1 << 62 | at << 33
                piece = (doc.as_py(), start.as_py(), np.frombuffer(ids.as_py(), raw).astype(np.uint32), n.as_py())
                if done := levels.place(piece):
                    rows.put(done, "rule")
                if rows.full():
                    yield rows.flush()
        close()
        yield rows.flush()

    return run


def pack(docs: DataFrame, size: int = 1024, vocabulary: str | None = None, digest: bool = False, end: int = 0) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (or with ``digest`` their
    ids_crc32), doc_tokens, sequence_id, offset, and how (whole: a window of one
    document, rule, or rest: its window was laid end to end).

    ``vocabulary`` is the path of the ranks, which executors must have.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("the window's length is a power of two")
    last = "ids_crc32 long" if digest else "ids array<int>"
    schema = f"doc_id long, start long, length long, {last}, doc_tokens long, sequence_id long, offset long, stream long, raw binary, how string"
    slim = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    packed = stage(slim.mapInArrow(_packer(size, vocabulary or default_vocabulary(), digest, end), schema))
    open_ = packed.where("how = 'open'").repartition("stream").sortWithinPartitions("stream", "sequence_id", "offset")
    merged = open_.mapInArrow(_merger(size, vocabulary or default_vocabulary(), digest), schema)
    return packed.where("how <> 'open'").unionByName(merged).drop("stream", "raw")
