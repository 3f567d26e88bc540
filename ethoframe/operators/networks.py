"""Small networks in numpy: forward, backward, and scoring of columns by Arrow batches.

A network's parameters are a dict of arrays. A batch is a dict of arrays with a row for
each sample: ``x``, either (rows, numbers) or, for windows, (rows, frames, numbers) with
``pad`` (rows, frames) true where a window has ended. ``backward`` takes the slope of a
loss in the logits and gives the slope in each parameter, so that sums over partitions
are sums of what it returns (see ``training``).
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Arrays = dict[str, np.ndarray]


def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of numbers, all of one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of frames (arrays of numbers), filled up with zeros to the longest, and
    where they were filled up. No Python object is made for a frame."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
    frames = matrix(column.flatten())
    pad = np.arange(lengths.max(initial=0)) >= lengths[:, None]
    x = np.zeros((*pad.shape, frames.shape[1]))
    x[~pad] = frames
    return x, pad


def inputs(network: Network, columns: dict[str, pa.Array]) -> Arrays:
    """The batch that a network reads from columns of its names."""
    out: Arrays = {}
    for name in network.reads:
        c = columns[name]
        if name != "x":
            out[name] = c.to_numpy(zero_copy_only=False).astype(int)
        elif pa.types.is_nested(c.type.value_type):
            out["x"], out["pad"] = windows(c)
        else:
            out["x"] = matrix(c)
    return out


class Network:
    reads: tuple[str, ...] = ("x",)

    def shapes(self) -> dict[str, tuple[int, ...]]:
        raise NotImplementedError

    def forward(self, w: Arrays, batch: Arrays) -> tuple[np.ndarray, object]:
        """(logits, what backward needs)."""
        raise NotImplementedError

    def backward(self, w: Arrays, keep: object, slope: np.ndarray) -> Arrays:
        raise NotImplementedError

    def initial(self, seed: int = 0) -> Arrays:
        """Xavier's uniform weights, zero biases, unit scales, normal embeddings."""
        rng, out = np.random.default_rng(seed), {}
        for name, shape in self.shapes().items():
            if name.endswith(".w"):
                reach = np.sqrt(6 / sum(shape))
                out[name] = rng.uniform(-reach, reach, shape)
            elif name.endswith(".e"):
                out[name] = rng.normal(size=shape)
            else:
                out[name] = np.ones(shape) if name.endswith(".g") else np.zeros(shape)
        return out

    def flat(self, w: Arrays) -> np.ndarray:
        return np.concatenate([np.asarray(w[n], float).ravel() for n in self.shapes()])

    def shaped(self, values: np.ndarray) -> Arrays:
        out, at = {}, 0
        for name, shape in self.shapes().items():
            size = int(np.prod(shape))
            out[name] = values[at : at + size].reshape(shape)
            at += size
        return out


def _linear(w: Arrays, name: str, x: np.ndarray) -> np.ndarray:
    return x @ w[f"{name}.w"] + w[f"{name}.b"]


def _linear_back(w: Arrays, name: str, x: np.ndarray, slope: np.ndarray, out: Arrays) -> np.ndarray:
    """Adds the slopes of a linear layer to ``out``; returns that of its input."""
    flat, over = x.reshape(-1, x.shape[-1]), slope.reshape(-1, slope.shape[-1])
    out[f"{name}.w"] = out.get(f"{name}.w", 0) + flat.T @ over
    out[f"{name}.b"] = out.get(f"{name}.b", 0) + over.sum(0)
    return slope @ w[f"{name}.w"].T


def _layer(name: str, n: int, m: int) -> dict[str, tuple[int, ...]]:
    return {f"{name}.w": (n, m), f"{name}.b": (m,)}


class _Trunk:
    """ReLU layers of one width; none at all leave the input as it is."""

    def __init__(self, n: int, hidden: int, layers: int):
        self.n, self.hidden, self.layers = n, hidden, layers
        self.out = hidden if layers else n

    def shapes(self) -> dict[str, tuple[int, ...]]:
        return {k: s for i in range(self.layers) for k, s in _layer(f"trunk{i}", self.n if i == 0 else self.hidden, self.hidden).items()}

    def forward(self, w: Arrays, x: np.ndarray) -> list[np.ndarray]:
        keep = [x]
        for i in range(self.layers):
            keep.append(np.maximum(_linear(w, f"trunk{i}", keep[-1]), 0))
        return keep

    def backward(self, w: Arrays, keep: list[np.ndarray], slope: np.ndarray, out: Arrays) -> np.ndarray:
        for i in reversed(range(self.layers)):
            slope = _linear_back(w, f"trunk{i}", keep[i], slope * (keep[i + 1] > 0), out)
        return slope


class _Middle:
    """The middle frame of a window asks all of its frames; their mix by the answer and
    the middle frame itself are added and normalised. Windows have an odd length."""

    def __init__(self, dims: int, width: int):
        self.dims, self.width = dims, width

    def shapes(self) -> dict[str, tuple[int, ...]]:
        return {"ask.w": (self.dims, self.width), "key.w": (self.dims, self.width), "norm.g": (self.dims,), "norm.b": (self.dims,)}

    def forward(self, w: Arrays, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        middle = x[:, x.shape[1] // 2]
        q, k = middle @ w["ask.w"], x @ w["key.w"]
        p = _softmax(np.einsum("nw,ntw->nt", q, k) / np.sqrt(self.width))
        h = np.einsum("nt,ntd->nd", p, x) + middle
        spread = np.sqrt(h.var(1, keepdims=True) + 1e-5)
        unit = (h - h.mean(1, keepdims=True)) / spread
        return unit * w["norm.g"] + w["norm.b"], (x, middle, q, k, p, unit, spread)

    def backward(self, w: Arrays, keep: tuple, slope: np.ndarray, out: Arrays) -> None:
        x, middle, q, k, p, unit, spread = keep
        out["norm.g"], out["norm.b"] = (slope * unit).sum(0), slope.sum(0)
        s = slope * w["norm.g"]
        s = (s - s.mean(1, keepdims=True) - unit * (s * unit).mean(1, keepdims=True)) / spread
        of_p = np.einsum("nd,ntd->nt", s, x)
        of_logits = p * (of_p - (p * of_p).sum(1, keepdims=True)) / np.sqrt(self.width)
        out["ask.w"] = middle.T @ np.einsum("nt,ntw->nw", of_logits, k)
        out["key.w"] = np.einsum("ntd,nt,nw->dw", x, of_logits, q, optimize=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    """Over the last axis; rows of minus infinity alone give zeros."""
    top = z.max(-1, keepdims=True, initial=-np.inf)
    p = np.exp(z - np.where(np.isfinite(top), top, 0))
    return p / np.maximum(p.sum(-1, keepdims=True), 1e-300)


class Fused(Network):
    """Vectors, or windows of them, to one logit for each outcome. The last
    ``distances`` numbers pass by the trunk and enter the head (late fusion)."""

    def __init__(self, dims: int, hidden: int = 512, layers: int = 1, outcomes: int = 1, distances: int = 0, context: int = 1, width: int = 64):
        self.distances, self.outcomes = distances, outcomes
        self.middle = _Middle(dims, width) if context > 1 else None
        self.trunk = _Trunk(dims - distances, hidden, layers)

    def shapes(self) -> dict[str, tuple[int, ...]]:
        return {**(self.middle.shapes() if self.middle else {}), **self.trunk.shapes(), **_layer("head", self.trunk.out + self.distances, self.outcomes)}

    def forward(self, w: Arrays, batch: Arrays) -> tuple[np.ndarray, object]:
        x, before = self.middle.forward(w, batch["x"]) if self.middle else (batch["x"], None)
        cut = x.shape[1] - self.distances
        keep = self.trunk.forward(w, x[:, :cut])
        joined = np.concatenate([keep[-1], x[:, cut:]], 1)
        return _linear(w, "head", joined), (before, keep, joined)

    def backward(self, w: Arrays, keep: tuple, slope: np.ndarray) -> Arrays:
        before, trunk, joined = keep
        out: Arrays = {}
        s = _linear_back(w, "head", joined, slope, out)
        of_x = self.trunk.backward(w, trunk, s[:, : self.trunk.out], out)
        if self.middle:
            self.middle.backward(w, before, np.concatenate([of_x, s[:, self.trunk.out :]], 1), out)
        return out


class Twin(Network):
    """Two halves, each numbers and then ``distances``, to two logits. ``apart``: one
    trunk reads each half's numbers, and each half has a head of its own that also sees
    its distances. Otherwise the trunk reads both halves' numbers at once, and one head
    with both outputs sees all distances."""

    def __init__(self, dims: int, hidden: int = 512, layers: int = 1, distances: int = 2, apart: bool = True, context: int = 1, width: int = 64):
        if dims % 2:
            raise ValueError(f"{dims} numbers don't make two halves")
        self.half, self.distances, self.apart, self.outcomes = dims // 2, distances, apart, 2
        self.own = self.half - distances
        self.middle = _Middle(dims, width) if context > 1 else None
        self.trunk = _Trunk(self.own if apart else 2 * self.own, hidden, layers)

    def shapes(self) -> dict[str, tuple[int, ...]]:
        n = self.trunk.out + self.distances
        heads = {**_layer("first", n, 1), **_layer("second", n, 1)} if self.apart else _layer("head", n + self.distances, 2)
        return {**(self.middle.shapes() if self.middle else {}), **self.trunk.shapes(), **heads}

    def forward(self, w: Arrays, batch: Arrays) -> tuple[np.ndarray, object]:
        x, before = self.middle.forward(w, batch["x"]) if self.middle else (batch["x"], None)
        halves = [x[:, : self.half], x[:, self.half :]]
        own, far = [h[:, : self.own] for h in halves], [h[:, self.own :] for h in halves]
        if self.apart:
            keep = [self.trunk.forward(w, o) for o in own]
            joined = [np.concatenate([k[-1], f], 1) for k, f in zip(keep, far)]
            logits = np.concatenate([_linear(w, name, j) for name, j in zip(("first", "second"), joined)], 1)
        else:
            keep = [self.trunk.forward(w, np.concatenate(own, 1))]
            joined = [np.concatenate([keep[0][-1], *far], 1)]
            logits = _linear(w, "head", joined[0])
        return logits, (before, keep, joined)

    def backward(self, w: Arrays, keep: tuple, slope: np.ndarray) -> Arrays:
        before, trunks, joined = keep
        out: Arrays = {}
        n = self.trunk.out
        if self.apart:
            parts = []
            for i, name in enumerate(("first", "second")):
                s = _linear_back(w, name, joined[i], slope[:, i : i + 1], out)
                parts += [self.trunk.backward(w, trunks[i], s[:, :n], out), s[:, n:]]
            of_x = np.concatenate(parts, 1)
        else:
            s = _linear_back(w, "head", joined[0], slope, out)
            own = self.trunk.backward(w, trunks[0], s[:, :n], out)
            far = s[:, n:]
            of_x = np.concatenate([own[:, : self.own], far[:, : self.distances], own[:, self.own :], far[:, self.distances :]], 1)
        if self.middle:
            self.middle.backward(w, before, of_x, out)
        return out


class Pairs(Network):
    """Windows and two agents to a logit for each class. Every agent has a learned query;
    all of them ask the window's frames by attention of several heads, and what the two
    agents were answered goes through a head of one ReLU layer. Frames beyond a window's
    end are not seen; a window without frames answers nothing but the biases."""

    reads = ("x", "a1", "a2")

    def __init__(self, dims: int = 768, heads: int = 8, hidden: int = 256, classes: int = 3, agents: int = 4):
        if dims % heads:
            raise ValueError(f"{heads} heads don't divide {dims} numbers")
        self.dims, self.heads, self.hidden, self.outcomes, self.agents = dims, heads, hidden, classes, agents

    def shapes(self) -> dict[str, tuple[int, ...]]:
        d = self.dims
        same = {k: s for name in ("ask", "key", "value", "out") for k, s in _layer(name, d, d).items()}
        return {"agents.e": (self.agents, d), **same, **_layer("hidden", 2 * d, self.hidden), **_layer("head", self.hidden, self.outcomes)}

    def _split(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(*x.shape[:-1], self.heads, self.dims // self.heads)

    def answers(self, w: Arrays, batch: Arrays) -> tuple[np.ndarray, tuple]:
        """What each agent is answered, (rows, agents, numbers)."""
        x = batch["x"] if batch["x"].size else np.zeros((*batch["pad"].shape, self.dims))
        q = self._split(_linear(w, "ask", w["agents.e"]))
        k, v = self._split(_linear(w, "key", x)), self._split(_linear(w, "value", x))
        z = np.einsum("ahd,nthd->naht", q, k) / np.sqrt(q.shape[-1])
        p = _softmax(np.where(batch["pad"][:, None, None, :], -np.inf, z))
        mixed = np.einsum("naht,nthd->nahd", p, v).reshape(len(x), self.agents, self.dims)
        return _linear(w, "out", mixed), (x, q, k, v, p, mixed)

    def _head(self, w: Arrays, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(_linear(w, "hidden", both), 0)
        return _linear(w, "head", h), h

    def forward(self, w: Arrays, batch: Arrays) -> tuple[np.ndarray, object]:
        got, keep = self.answers(w, batch)
        rows = np.arange(len(got))
        both = np.concatenate([got[rows, batch["a1"]], got[rows, batch["a2"]]], 1)
        logits, h = self._head(w, both)
        return logits, (keep, both, h, batch["a1"], batch["a2"])

    def every_pair(self, w: Arrays, batch: Arrays) -> np.ndarray:
        """Logits of all ordered pairs of two agents: (rows, pairs, classes). The window
        is attended to once."""
        got, _ = self.answers(w, batch)
        return np.stack([self._head(w, np.concatenate([got[:, a], got[:, b]], 1))[0] for a, b in self.pairs()], 1)

    def pairs(self) -> list[tuple[int, int]]:
        return list(permutations(range(self.agents), 2))

    def backward(self, w: Arrays, keep: tuple, slope: np.ndarray) -> Arrays:
        (x, q, k, v, p, mixed), both, h, a1, a2 = keep
        out: Arrays = {}
        s = _linear_back(w, "head", h, slope, out)
        s = _linear_back(w, "hidden", both, s * (h > 0), out)
        of_got, rows = np.zeros(mixed.shape), np.arange(len(x))
        np.add.at(of_got, (rows, a1), s[:, : self.dims])
        np.add.at(of_got, (rows, a2), s[:, self.dims :])
        of_mixed = self._split(_linear_back(w, "out", mixed, of_got, out))
        of_v = np.einsum("naht,nahd->nthd", p, of_mixed)
        of_p = np.einsum("nahd,nthd->naht", of_mixed, v)
        of_z = p * (of_p - (p * of_p).sum(-1, keepdims=True)) / np.sqrt(q.shape[-1])
        of_q = np.einsum("naht,nthd->ahd", of_z, k).reshape(self.agents, self.dims)
        of_k = np.einsum("naht,ahd->nthd", of_z, q)
        _linear_back(w, "key", x, of_k.reshape(x.shape), out)
        _linear_back(w, "value", x, of_v.reshape(x.shape), out)
        out["agents.e"] = _linear_back(w, "ask", w["agents.e"], of_q, out)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def chances(logits: np.ndarray, classes: bool, temperature: float = 1.0) -> np.ndarray:
    return _softmax(logits) if classes else sigmoid(logits / temperature)


def _lists(values: np.ndarray) -> pa.Array:
    out = pa.array(np.ascontiguousarray(values).ravel(), pa.float64())
    for size in reversed(values.shape[1:]):
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, size), pa.int32()), out)
    return out


def scorer(network: Network, w: Arrays, temperature: float = 1.0):
    """A UDF of the network's columns, in order of ``reads``: the chance of each outcome
    (of each class for ``Pairs``)."""

    @F.arrow_udf("array<double>")
    def score(*columns: pa.Array) -> pa.Array:
        if not len(columns[0]):
            return pa.array([], pa.list_(pa.float64()))
        logits, _ = network.forward(w, inputs(network, dict(zip(network.reads, columns))))
        return _lists(chances(logits, isinstance(network, Pairs), temperature))

    return score


def scores(df: DataFrame, network: Network, w: Arrays, *columns: str | Column, names: tuple[str, ...], temperature: float = 1.0) -> DataFrame:
    """``df`` with a column for each outcome's chance."""
    scored = df.withColumn("_scores", scorer(network, w, temperature)(*columns))
    return scored.withColumns({n: F.col("_scores")[i] for i, n in enumerate(names)}).drop("_scores")


def pair_scores(df: DataFrame, network: Pairs, w: Arrays, window: str, names: tuple[str, ...] = ("none", "nt", "nn")) -> DataFrame:
    """A row for each ordered pair of agents (a1, a2) of each row of ``df``, with the
    chance of each class, without the window itself. Its frames are attended to once for
    all pairs."""
    pairs = network.pairs()

    @F.arrow_udf("array<array<double>>")
    def score(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.list_(pa.list_(pa.float64())))
        padded, pad = windows(x)
        return _lists(_softmax(network.every_pair(w, {"x": padded, "pad": pad})))

    rows = df.withColumn("_s", score(window)).drop(window).select("*", F.posexplode("_s").alias("_k", "_p")).drop("_s")
    of = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    found = rows.withColumns({"a1": of[F.col("_k")]["a"], "a2": of[F.col("_k")]["b"], **{n: F.col("_p")[i] for i, n in enumerate(names)}})
    return found.drop("_k", "_p")
