"""Periodic runs of words: stretches that repeat with a small period.

A run is a maximal stretch of consecutive words with smallest period q (words q apart
are identical) and at least ``max(shortest, 3 * q)`` words.

1. *Where a run can be.* In a run each word but the last q comes again within q words.
   For periods from b to 2b - 1 only stretches of max(2b, shortest - 2b + 1) words that
   all come again within 2b - 1 words are searched, with the 2b - 1 words behind them.
2. *Block matching.* For each power of two b the stretch is cut into aligned blocks of
   b words; an Aho-Corasick automaton over integer sequences (the words' numbers) finds
   all their occurrences. A run of period q, b <= q < 2b, holds a whole aligned block
   and its copy q words on, for it has 3q words.
3. *Exact extension.* An occurrence at a distance d from b to 2b - 1 of its aligned block
   is extended both ways as far as words d apart are equal. Seeds inside a stretch
   already found with this d, or with a period that divides d, give nothing new and are
   left out; of several periods of one stretch the smallest stays.

A document is one row and is worked on whole in one task; there is no shuffle. Time is
n log n in the stretches searched, memory some hundred bytes for each of their words.
Words are compared by 64-bit hashes.

Defined results: a null text has no words; every row is judged alone, so null and
repeated ids do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import WORD, columns_of, row_of
from .packed import slices

_FAR = np.int64(1 << 40)


def _next(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, distance to its next place in the row or _FAR)."""
    order = np.argsort(hashes, kind="stable")
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new)
    gap = np.full(len(h), _FAR)
    again = np.flatnonzero(~new[1:] & (r[1:] == r[:-1]))
    gap[order[again]] = order[again + 1] - order[again]
    return number, gap


def _stretches(gap: np.ndarray, b: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Where periods from b to 2b - 1 can be: starts and ends. A row's last word never
    comes again, so no stretch passes a row's end."""
    near = np.concatenate([[False], gap < 2 * b, [False]])
    edges = np.flatnonzero(near[1:] != near[:-1])
    s, e = edges[::2], edges[1::2]
    long = e - s >= max(2 * b, shortest - 2 * b + 1)
    return s[long], e[long]


def _seeds(x: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of aligned blocks and their copies b to 2b - 1 words on."""
    text = tuple(x.tolist())
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    block = np.empty(len(text) // b, np.int64)
    for k in range(len(block)):
        key = text[k * b : (k + 1) * b]
        block[k] = found.get(key, k)
        if block[k] == k:
            found.add_word(key, k)
    found.make_automaton()
    hits = np.array(list(found.iter(text)), np.int64).reshape(-1, 2)
    copy = hits[:, 0] - b + 1
    # the one aligned place from 2b - 1 to b words before
    at = (copy - b) // b
    ok = at >= 0
    ok[ok] = block[at[ok]] == hits[ok, 1]
    return at[ok] * b, copy[ok] - at[ok] * b


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """How many first words of x and y are equal."""
    at, step = 0, 64
    n = min(len(x), len(y))
    while at < n:
        differs = np.flatnonzero(x[at : min(at + step, n)] != y[at : min(at + step, n)])
        if len(differs):
            return at + int(differs[0])
        at, step = at + step, 2 * step
    return n


def _extend(x: np.ndarray, at: np.ndarray, distance: np.ndarray, b: int, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, d) of the stretches of three periods and more around the seeds."""
    order = np.lexsort((distance, at))
    at, distance = at[order], distance[order]
    fresh = np.ones(len(at), bool)
    for s, e, q in known:
        if e - s >= 2 * b:
            i, j = np.searchsorted(at, (s, e))
            fresh[i:j] &= (distance[i:j] % q != 0) | (at[i:j] + distance[i:j] + b > e)
    at, distance = at[fresh], distance[fresh]
    out = []
    order = np.lexsort((at, distance))
    at, distance = at[order], distance[order]
    cuts = np.flatnonzero(np.diff(distance, prepend=-1))
    for i, j in zip(cuts, [*cuts[1:], len(at)]):
        d, own, k = int(distance[i]), at[i:j], 0
        while k < len(own):
            p = int(own[k])
            end = p + d + b + _same(x[p + b :], x[p + d + b :])
            start = p - _same(x[:p][::-1], x[: p + d][::-1])
            if end - start >= 3 * d:
                out.append((start, end, d))
            k = int(np.searchsorted(own, end - d - b, "right"))
            k = max(k, int(np.searchsorted(own, p, "right")))
    return out


def _left(x: int, y: int, b: int, known: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What of the stretch x to y can still hold a new run of a period d >= b. A run
    that shares d + q words with a run of period q <= d is the same run, so a new one
    has more than d words outside, and lies within 2d words of that run's ends."""
    runs = np.array(known, np.int64).reshape(-1, 3)
    s, e, q = runs.T
    if ((q <= b) & (s <= x) & (e >= y)).any():
        return []
    pieces = [(x, y)]
    for s, e, _ in runs[(q <= b) & (e - s >= 4 * b) & (s < y) & (e > x)].tolist():
        after = []
        for x, y in pieces:
            if s >= y or e <= x:
                after.append((x, y))
            elif e - s <= 8 * b and (s - x > b or y - e > b):
                after.append((x, y))
            else:
                after += [(x, min(y, s + 4 * b))] * (s - x > b) + [(max(x, e - 4 * b), y)] * (y - e > b)
        pieces = after
    return pieces


def runs_in(texts: W.Texts, shortest: int = 24) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each row's runs, by start and then period."""
    number, gap = _next(texts.word_hashes(), texts.word_rows())
    found: dict[int, list[tuple[int, int, int]]] = {}
    b = 1
    while 3 * b <= texts.n_words.max(initial=0):
        for s, e in zip(*_stretches(gap, b, shortest)):
            row = int(np.searchsorted(texts.first, s, "right")) - 1
            first, last = int(texts.first[row]), int(texts.first[row + 1])
            known = found.setdefault(row, [])
            for x, y in _left(int(s) - first, min(int(e) + 2 * b - 1, last) - first, b, known):
                at, distance = _seeds(number[first + x : first + y], b)
                known += _extend(number[first:last], at + x, distance, b, known)
        b *= 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(texts.n_rows)]
    for row, stretches in found.items():
        least: dict[tuple[int, int], int] = {}
        for s, e, d in stretches:
            least[s, e] = min(d, least.get((s, e), d))
        out[row] = sorted((s, e - s, d) for (s, e), d in least.items() if e - s >= max(shortest, 3 * d))
    return out


_FIXED = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64())]
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _find(shortest: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            for texts in W.chunks(batch.column(0)):
                runs = runs_in(texts, shortest)
                keep = np.ones(len(texts.starts), bool)
                best: list[tuple] = []
                for row, own in enumerate(runs):
                    mark = np.zeros(int(texts.n_words[row]) + 1, np.int32)
                    for s, n, q in own:
                        mark[s + q] += 1
                        mark[s + n] -= 1
                    keep[texts.first[row] : texts.first[row + 1]] = np.cumsum(mark[:-1]) == 0
                    top = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                    best.append((len(own), *top, 1000 * top[1] // top[2]) if top else (0, None, None, None, None))
                data, offsets = W.joined(texts, keep)
                kept = [data[x:y].tobytes() for x, y in zip(offsets, offsets[1:])]
                arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*best), _FIXED)]
                if digest:
                    lines = ["".join(f"{s},{n},{q}\n" for s, n, q in own) for own in runs]
                    arrays += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lines]), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                    names = ["runs_sha256", "collapsed_sha256"]
                else:
                    arrays += [pa.array([[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs], _RUNS), pa.array([x.decode() for x in kept], pa.string())]
                    names = ["runs", "collapsed"]
                rows = batch.column(1).slice(texts.row, texts.n_rows)
                yield pa.RecordBatch.from_arrays([rows, *arrays], ["_row", *[n for n, _ in _FIXED], *names])

    return run


def collapse_runs(docs: DataFrame, shortest: int = 24, digest: bool = False) -> DataFrame:
    """One row for each of ``docs``: doc_id; n_runs; start, length, period and
    exponent_milli of the run of most periods (ties: smallest start, then period; null
    without runs); all ``runs``; and ``collapsed``, the words that no run holds after its
    first period, joined by one space. With ``digest`` runs_sha256 (of the lines
    ``start,length,period``) and collapsed_sha256 take the place of the last two."""
    if shortest < 3:
        raise ValueError("a run has three words at least")
    slim = docs.select("text", row_of(docs.select("doc_id")))
    kind = slim.schema["_row"].dataType.simpleString()
    last = "runs_sha256 string, collapsed_sha256 string" if digest else "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    found = slim.mapInArrow(_find(shortest, digest), f"_row {kind}, n_runs long, start long, length long, period long, exponent_milli long, {last}")
    return found.select(*columns_of(docs.select("doc_id")), *found.columns[1:])


def repeat_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where a tenth of the documents, by the checksum of doc_id, go on
    from word a repeating a unit of p words to their old length; other texts, and those
    of null ids, stay as they are."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"))
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    hit = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_w"), g.alias("_g"))
    n = F.size("_w")
    a = F.pmod(F.col("_g"), F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).cast("int")
    unit = F.slice("_w", a + 1, p)
    times = F.ceil((n - a) / p).cast("int")
    new = F.slice(F.concat(F.slice("_w", F.lit(1), a), F.flatten(F.array_repeat(unit, times))), F.lit(1), n)
    return hit.select("doc_id", F.when(n > 0, F.array_join(new, " ")).otherwise(F.col("text")).alias("text"))

