"""Toxicity by a convolutional text classifier in numpy.

Words (runs of letters, digits and non-ASCII bytes, A-Z lowered) are hashed to two
rows of embedding tables, whose sum is the word's vector, so that a word is only
taken for another where both hashes meet. Filters of several widths run over the
whole text, each keeps its largest answer, and a logistic layer weighs them.

Training is on a bounded sample of labelled rows (``per_class`` of each class,
chosen by a hash of the id): tables start from the words' class odds, then Adam
steps follow the gradient through the largest answers. A fifth of the sample is
kept out of that: it fixes the bias and a threshold for each language. Scoring is
one scan, without a shuffle; the broadcast model's size is fixed by its parameters.

Defined results: null and empty texts score as texts without words; with no labels
of one class, every text scores the rate of the other; labels that are null, or of
unknown documents, are not learned from; languages seen too rarely (null among
them) take the common threshold; the score never depends on lang, source or doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import release, stage, unstage

BUCKETS = 1 << 18
DIMS = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
#: The score from which a text counts as toxic where no threshold is calibrated.
THRESHOLD = 0.3

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
for _b in range(0x80):
    if not chr(_b).isalnum():
        _FOLD[_b] = 0x20


def _tokens(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(bucket pairs of all words, first word of each row)."""
    plain = W.Texts(_FOLD[texts.data], texts.offsets, texts.row)
    h = plain.word_hashes()
    pairs = np.stack([h % np.uint64(BUCKETS), (h >> np.uint64(40)) % np.uint64(BUCKETS)], 1).astype(np.int32)
    return pairs, plain.first


@dataclass
class Network:
    tables: np.ndarray  # (2, BUCKETS, DIMS)
    kernels: np.ndarray  # (columns, DIMS): for each width, place and filter
    bias: np.ndarray  # (widths * filters)
    out: np.ndarray  # (widths * filters)
    offset: float = 0.0
    thresholds: dict = field(default_factory=dict)
    threshold: float = THRESHOLD

    def columns(self, width: int, place: int) -> slice:
        at = sum(w for w in WIDTHS if w < width) * FILTERS + place * FILTERS
        return slice(at, at + FILTERS)


def _answers(net: Network, projected: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Each width's filter answers at every word; words past a text's end add 0."""
    out = []
    for k, width in enumerate(WIDTHS):
        a = projected[:, net.columns(width, 0)] + net.bias[k * FILTERS : (k + 1) * FILTERS]
        for place in range(1, width):
            same = (doc[place:] == doc[:-place])[:, None]
            a[:-place] += projected[place:, net.columns(width, place)] * same
        out.append(a)
    return out


def _pooled(net: Network, projected: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = np.diff(first)
    doc, full = np.repeat(np.arange(len(n)), n), np.flatnonzero(n)
    pooled = np.zeros((len(n), len(WIDTHS) * FILTERS), np.float32)
    if len(full):
        for k, a in enumerate(_answers(net, projected, doc)):
            pooled[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(a, first[full], axis=0)
    return np.maximum(pooled, 0)


def logits(net: Network, pairs: np.ndarray, first: np.ndarray, projections: np.ndarray | None = None) -> np.ndarray:
    if projections is not None:
        projected = projections[0][pairs[:, 0]] + projections[1][pairs[:, 1]]
    else:
        projected = (net.tables[0][pairs[:, 0]] + net.tables[1][pairs[:, 1]]) @ net.kernels.T
    return _pooled(net, projected, first) @ net.out + net.offset


def _start(texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> Network:
    columns = sum(WIDTHS) * FILTERS
    tables = rng.standard_normal((2, BUCKETS, DIMS), dtype=np.float32) * np.float32(0.02)
    for t in range(2):
        seen = np.zeros((2, BUCKETS))
        for pairs, y in zip(texts, labels):
            seen[int(y), np.unique(pairs[:, t])] += 1
        n = np.array([max((labels == y).sum(), 1) for y in (0, 1)])[:, None]
        rate = (seen + 0.5) / (n + 1)
        odds = np.log(rate[1] / rate[0]) * (seen.sum(0) >= 3)
        tables[t][:, 0] = np.clip(odds, -3, 3) / 3
        tables[t][seen.sum(0) == 0] = 0
    kernels = rng.normal(0, 0.2, (columns, DIMS)).astype(np.float32)
    kernels[:, 0] = np.abs(kernels[:, 0]) + 0.3
    return Network(tables, kernels, np.full(len(WIDTHS) * FILTERS, -0.3, np.float32), np.full(len(WIDTHS) * FILTERS, 0.5, np.float32), -2.0)


class _Adam:
    def __init__(self, shape, rate: float):
        self.m, self.v, self.rate, self.n = np.zeros(shape, np.float32), np.zeros(shape, np.float32), rate, 0

    def step(self, value: np.ndarray, grad: np.ndarray) -> None:
        self.n += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad * grad - self.v)
        value -= self.rate * (self.m / (1 - 0.9**self.n)) / (np.sqrt(self.v / (1 - 0.999**self.n)) + 1e-8)


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 6, batch: int = 64, seed: int = 3) -> Network:
    """``texts``: each one's bucket pairs; ``labels``: 0 or 1."""
    rng = np.random.default_rng(seed)
    net = _start(texts, labels, rng)
    kernels, bias, out = _Adam(net.kernels.shape, 0.01), _Adam(net.bias.shape, 0.01), _Adam(net.out.shape, 0.02)
    offset, shift = _Adam((), 0.02), np.zeros((), np.float32)
    squares = np.zeros((2, BUCKETS), np.float32)  # AdaGrad by row: only rows that are met move
    weight = np.where(labels == 1, (labels == 0).sum() / max((labels == 1).sum(), 1), 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])])
            pairs = np.concatenate([texts[i] for i in own])
            doc = np.repeat(np.arange(len(own)), np.diff(first))
            vectors = net.tables[0][pairs[:, 0]] + net.tables[1][pairs[:, 1]]
            answers = _answers(net, vectors @ net.kernels.T, doc)
            full = np.flatnonzero(np.diff(first))
            top = np.zeros((len(own), len(WIDTHS) * FILTERS), np.int64)
            pooled = np.zeros(top.shape, np.float32)
            for i in full:
                for k, a in enumerate(answers):
                    part = a[first[i] : first[i + 1]]
                    best = part.argmax(0)
                    top[i, k * FILTERS : (k + 1) * FILTERS] = first[i] + best
                    pooled[i, k * FILTERS : (k + 1) * FILTERS] = part[best, np.arange(FILTERS)]
            active = pooled > 0
            pooled = np.maximum(pooled, 0)
            z = pooled @ net.out + net.offset
            y = labels[own]
            slope = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight[own] / len(own)).astype(np.float32)
            g_out = pooled.T @ slope + 1e-4 * net.out
            g_pool = slope[:, None] * net.out * active
            g_kernel = np.zeros_like(net.kernels)
            rows, steps = [], []
            for k, width in enumerate(WIDTHS):
                for place in range(width):
                    columns = net.columns(width, place)
                    for f in range(FILTERS):
                        p = top[full, k * FILTERS + f] + place
                        ok = p < first[full + 1]
                        g = g_pool[full[ok], k * FILTERS + f]
                        p = p[ok]
                        g_kernel[columns.start + f] += g @ vectors[p]
                        rows.append(p)
                        steps.append(g[:, None] * net.kernels[columns.start + f])
            rows, steps = np.concatenate(rows), np.concatenate(steps)
            kernels.step(net.kernels, g_kernel)
            bias.step(net.bias, g_pool.sum(0))
            out.step(net.out, g_out)
            shift[()] = net.offset
            offset.step(shift, np.float32(slope.sum()))
            net.offset = float(shift)
            for t in range(2):
                which, back = np.unique(pairs[rows, t], return_inverse=True)
                g = np.zeros((len(which), DIMS), np.float32)
                np.add.at(g, back, steps)
                squares[t][which] += (g * g).sum(1)
                net.tables[t][which] -= 0.1 * g / (np.sqrt(squares[t][which]) + 1e-6)[:, None]
    return net


def _best(low: np.ndarray, high: np.ndarray, hits: np.ndarray, rows: np.ndarray, usual: float) -> float:
    """The threshold with the best F1, from buckets of scores, highest first: lowest and
    highest score, toxic rows and all rows of each. In the gap of scores where it may
    lie, the place nearest to the usual one, but for a quarter of the gap."""
    f1 = 2 * np.cumsum(hits) / (np.cumsum(rows) + hits.sum())
    at = int(np.argmax(f1))
    below = float(high[at + 1]) if at + 1 < len(high) else 0.0
    margin = (float(low[at]) - below) / 4
    return min(max(usual, below + margin), float(low[at]) - margin)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


#: Labelled ids up to which calibration broadcasts them.
FEW_IDS = 2_000_000
#: Buckets of scores for one step of log odds.
STEPS = 64


def calibrate(net: Network, docs: DataFrame, known: DataFrame, given: float, rates: dict[int, int], least: int = 30) -> None:
    """Fits slope-free bias to the prior, moves the best common threshold to
    ``THRESHOLD`` and finds one for each language with ``least`` of each class, from
    all rows of ``known`` (doc_id, label): one scan scores the texts, and counts by
    language, bucket of scores and label come back. ``given``: the share of label 1
    that the network was fitted to; ``rates``: rows of each label, for which those
    in ``known`` stand."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    p = F.least(F.greatest("score", F.lit(1e-15)), F.lit(1 - 1e-15))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "label")
    # only rows with such a label are scored; few ids are broadcast, so that no text moves
    ids = known.select("doc_id")
    some = rows.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "doc_id", "left_semi").select("doc_id", "text", "lang")
    scored = some.mapInArrow(_scorer(shared), "doc_id long, lang string, score double").select("doc_id", "lang", F.log(p / (1 - p)).alias("z"))
    scored = scored.join(known, "doc_id")
    counts = scored.groupBy("lang", "label", F.floor(F.col("z") * STEPS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))
    table = counts.toPandas()
    shared.destroy()
    if table.empty:
        return
    prior = rates[1] / sum(rates.values())
    shift = float(np.log(prior / (1 - prior)) - np.log(given / (1 - given)))
    # rows that the fit used are missing: those left stand for all of their label
    left = table.groupby("label")["n"].sum()
    table["rows"] = table["n"] * table["label"].map({k: rates[k] / left[k] for k in left.index})
    table["hits"] = table["rows"].where(table["label"] == 1, 0.0)

    def best(part, shift: float) -> float:
        by = part.groupby("bucket").agg({"low": "min", "high": "max", "hits": "sum", "rows": "sum"}).sort_index(ascending=False)
        return _best(_logistic(by["low"].to_numpy() + shift), _logistic(by["high"].to_numpy() + shift), by["hits"].to_numpy(), by["rows"].to_numpy(), THRESHOLD)

    cut = float(np.clip(best(table, shift), 1e-6, 1 - 1e-6))
    shift += float(np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(cut / (1 - cut)))
    net.offset += shift
    for lang, part in table.groupby("lang"):
        if min(part.loc[part["label"] == k, "n"].sum() for k in (0, 1)) >= least:
            net.thresholds[lang] = best(part, shift)


_SAMPLE = pa.schema([("label", pa.int32()), ("lang", pa.string()), ("pairs", pa.binary()), ("key", pa.int64())])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in W.chunks(batch.column(0)):
            pairs, first = _tokens(texts)
            blobs = [pairs[x:y].tobytes() for x, y in zip(first, first[1:])]
            own = batch.slice(texts.row, texts.n_rows)
            yield pa.RecordBatch.from_arrays([own.column(1), own.column(2), pa.array(blobs, pa.binary()), own.column(3)], schema=_SAMPLE)


def held_out(folds: int, fold: int) -> "F.Column":
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def _constant(rate: float) -> Network:
    """A network that answers this to every text."""
    none = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    return Network(np.zeros((2, 1, DIMS), np.float32), np.zeros((sum(WIDTHS) * FILTERS, DIMS), np.float32), none, none, float(np.log(rate / (1 - rate))))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, folds: int = 4, fold: int = 2, label: str = "toxic", epochs: int = 6, most_bytes: int = 96 << 20) -> Network:
    """Learns from labelled ``docs`` outside the fold; at most ``per_class`` ids of
    label 1 and twice as many of label 0, one row of each, and of those as many whole
    texts as make ``most_bytes`` of word buckets (eight bytes a word). Thresholds come
    from all that aren't learned from."""
    net = _learned(docs, labels, per_class, folds, fold, label, epochs, most_bytes)
    release()  # the sample, which has just gone out of use
    return net


def _learned(docs: DataFrame, labels: DataFrame, per_class: int, folds: int, fold: int, label: str, epochs: int, most_bytes: int) -> Network:
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(folds, fold)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.withColumn("key", F.xxhash64("doc_id", F.lit(11)))
    rates = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(rates) < 2:
        return _constant(0.99 if rates.get(1) else 0.01)
    some = known.where("label = 1").orderBy("key").limit(per_class).unionByName(known.where("label = 0").orderBy("key").limit(2 * per_class))
    # the sample is bounded by two parameters; docs may be of any size
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    slim = docs.select("doc_id", "text", lang.alias("lang"))
    rows = slim.join(F.broadcast(some), "doc_id").select("text", "label", "lang", "key")
    sampled = stage(rows.mapInArrow(_sampled, "label int, lang string, pairs binary, key long"))
    # one row of each id, and of those, by their keys, whole texts up to the bound
    sizes = sampled.groupBy("key").agg(F.min(F.struct(F.octet_length("pairs").alias("size"), F.xxhash64("pairs").alias("body"))).alias("row"))
    sizes = sizes.withColumn("upto", F.sum("row.size").over(Window.partitionBy().orderBy("key")))
    fits = sizes.where(F.col("upto") <= most_bytes).select(F.col("key").alias("_key"), F.col("row.body").alias("_body"))
    table = sampled.join(fits, (F.col("key") == F.col("_key")) & (F.xxhash64("pairs") == F.col("_body"))).select("label", "lang", "pairs", "key").dropDuplicates(["key"]).toArrow()
    table = table.sort_by("key").combine_chunks()
    unstage(sampled)
    release()
    if not len(table):
        return _constant(0.5)
    texts = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 2) for x in table.column("pairs")]
    y, langs = table.column("label").to_numpy().astype(np.float64), table.column("lang").to_pylist()
    tuning = np.arange(len(y)) % 5 == 0
    if len({*y[~tuning]}) < 2 or len({*y[tuning]}) < 2:
        tuning[:] = False
    if len({*y}) < 2:
        return _constant(0.99 if y[0] else 0.01)
    net = fit([t for t, u in zip(texts, tuning) if not u], y[~tuning], epochs)
    if tuning.any():
        # as many as the sample at most; all other labels are left for thresholds
        used = docs.sparkSession.createDataFrame([(int(k),) for k in table.column("key").to_numpy()[~tuning]], "key long")
        known = known.join(F.broadcast(used), "key", "left_anti")
    calibrate(net, docs, known, float(y[~tuning].mean()), rates)
    return net


def _projections(shared) -> tuple[Network, np.ndarray]:
    """The broadcast network and what each bucket adds to each column; made anew in
    every task, which takes less than a second and leaves nothing behind."""
    net = shared.value
    return net, np.stack([t @ net.kernels.T for t in net.tables])


def _scorer(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, projections = _projections(shared)
        for batch in batches:
            for texts in W.chunks(batch.column(1), 1 << 18):
                pairs, first = _tokens(texts)
                if net.tables.shape[1] < BUCKETS:
                    pairs = pairs[:0]
                    first = np.zeros_like(first)
                p = 1 / (1 + np.exp(-logits(net, pairs, first, projections).astype(np.float64)))
                own = batch.slice(texts.row, texts.n_rows)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array(p, pa.float64())], schema=schema)

    return run


def _filter(shared, text: int, lang: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, projections = _projections(shared)
        for batch in batches:
            for texts in W.chunks(batch.column(text), 1 << 18):
                pairs, first = _tokens(texts)
                if net.tables.shape[1] < BUCKETS:
                    pairs, first = pairs[:0], np.zeros_like(first)
                p = 1 / (1 + np.exp(-logits(net, pairs, first, projections).astype(np.float64)))
                own = batch.slice(texts.row, texts.n_rows)
                names = own.column(lang).to_pylist() if lang is not None else [None] * texts.n_rows
                cut = np.array([net.thresholds.get(x, net.threshold) for x in names])
                yield own.filter(pa.array(p < cut))

    return run


def keep_clean(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` that score below the threshold of their language; one scan, and no
    join to bring scores and rows together."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    lang = docs.columns.index("lang") if "lang" in docs.columns else None
    return docs.mapInArrow(_filter(shared, docs.columns.index("text"), lang), docs.schema)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score, threshold (of the row's language) and toxic (at it)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang"))
    rows = rows.mapInArrow(_scorer(shared), "doc_id long, lang string, score double")
    cut = F.lit(net.threshold)
    for name, value in sorted(net.thresholds.items()):
        cut = F.when(F.col("lang") == name, F.lit(value)).otherwise(cut)
    return rows.withColumn("threshold", cut).withColumn("toxic", F.col("score") >= F.col("threshold")).drop("lang")
