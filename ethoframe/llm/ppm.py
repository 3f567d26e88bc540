"""Prediction by partial matching over bytes.

A trie of byte contexts up to ``order`` is held as sorted arrays, one pair for each
order: nodes (context and symbol) with counts, and contexts with their escapes.
All of it follows from the counts of the longest grams. A context's chance of a new
symbol is that of all contexts of its order with about as many symbols, distinct and
in all, found by leaving out each symbol once. Symbols that a longer context knows
are excluded in the shorter ones, so that each context gives a proper distribution
over all 256 bytes.

A model can be of some contexts alone: all that end with the same few bytes lead,
shortened, to one another and then to the orders below, which are given as another
model; what is pooled over an order is given too. Such parts answer as the whole.
"""

from __future__ import annotations

import numpy as np

END = 0x0A
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


#: Buckets of contexts, enough for 2 ** 62 symbols.
BUCKETS = (4 + 3 * 60 + 1) * 32


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte of each text, then for its end: the ``order`` bytes before and
    the byte itself, as one number. Before a text stand end marks."""
    n = len(offsets) - 1
    # room for the end mark and the context before each text
    at = np.arange(len(data)) + np.repeat(np.arange(n) * (order + 1) + order, np.diff(offsets))
    padded = np.full(len(data) + n * (order + 1) + order, END, np.uint8)
    padded[at] = _LOWER[data]
    g = np.zeros(len(padded) - order, np.uint64)
    for k in range(order + 1):
        g |= padded[k : len(padded) - order + k].astype(np.uint64) << np.uint64(8 * (order - k))
    # positions: a text's bytes and its end; those of the padding between fall out
    keep = np.ones(len(g), bool)
    ends = offsets[1:] + np.arange(n) * (order + 1)
    for k in range(1, order + 1):
        x = ends + k
        keep[x[x < len(g)]] = False
    return g[keep]


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``; -1 where missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _bucket(total: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """One number for about so many symbols, so many of them distinct."""
    def steps(x: np.ndarray) -> np.ndarray:
        return np.where(x <= 4, x, 4 + np.ceil(3 * np.log2(np.maximum(x, 4) / 4))).astype(np.int64)

    return steps(total) * 32 + np.minimum(steps(kind), 31)


def left_out(total: np.ndarray, kind: np.ndarray, once: np.ndarray) -> np.ndarray:
    """Of contexts with ``total`` symbols, ``kind`` of them distinct and ``once`` seen
    once: how many symbols, left out, were new to and known in the rest, by bucket."""
    # without one of its symbols a context has one less, and, if that was seen once,
    # one kind less: then the symbol was new to what is left
    more = total > 1
    fresh, known = _bucket(total - 1, np.maximum(kind - 1, 0))[more], _bucket(total - 1, kind)[more]
    return np.stack([np.bincount(fresh, once[more], BUCKETS), np.bincount(known, (total - once)[more], BUCKETS)])


def new_symbol(total: np.ndarray, kind: np.ndarray, pooled: np.ndarray) -> np.ndarray:
    """The chance of a new symbol, from what ``left_out`` found in all contexts."""
    if not len(total):
        return np.zeros(0)
    own = _bucket(total, kind)
    new, old = pooled
    # a little of the plain estimate stands in for buckets that are seldom met
    plain = kind / (2 * total)
    return np.where(kind >= 256, 0.0, (new[own] + plain) / (new[own] + old[own] + 1))


def nodes_of(keys: np.ndarray, counts: np.ndarray, j: int) -> tuple[np.ndarray, ...]:
    """Order ``j`` of these grams: nodes, their counts, contexts, each node's context,
    and of each context the symbols, the distinct ones and those seen once."""
    node, back = np.unique(keys & np.uint64((1 << (8 * (j + 1))) - 1), return_inverse=True)
    n = np.bincount(back, counts, len(node))
    ctx, own = np.unique(node >> np.uint64(8), return_inverse=True)
    return node, n, ctx, own, *(np.bincount(own, x, len(ctx)) for x in (n, np.ones(len(n)), n == 1))


class Model:
    """A pretrained model from sorted distinct grams and their counts; or the part of
    one for these grams' contexts, with ``low``, the model of the orders that all
    share, and ``pooled``, what ``left_out`` found in each further order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, low: Model | None = None, pooled: list[np.ndarray] | None = None):
        self.order = order
        self.nodes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.first_escape: list[np.ndarray] = []  # log10, entered without exclusion
        self.first_scale: list[np.ndarray] = []  # chance of each count
        self.next_escape: list[np.ndarray] = []  # log10, one order below, after it
        self.next_scale: list[np.ndarray] = []
        before = None
        if low:
            for name in ("nodes", "counts", "contexts", "first_escape", "first_scale", "next_escape", "next_scale"):
                setattr(self, name, list(getattr(low, name)))
            before = low.last
        for j in range(len(self.nodes), order + 1):
            node, n, ctx, own, total, kind, once = nodes_of(keys, counts, j)
            new = new_symbol(total, kind, pooled[j] if pooled else left_out(total, kind, once))
            self.nodes.append(node)
            self.counts.append(n.astype(np.float32) if n.max(initial=0) < 1 << 24 else n)
            self.contexts.append(ctx)
            self.first_scale.append((1 - new) / total)
            self.first_escape.append(np.log10(np.maximum(new, 1e-300)))
            if before:
                nodes, n_below, contexts, new_below, total_below = before
                below = np.uint64((1 << (8 * j)) - 1)
                known = np.bincount(own, n_below[_find(nodes, node & below)], len(ctx))
                up = _find(contexts, ctx & (below >> np.uint64(8)))
                # what isn't excluded: the rest of the counts, and the new symbol
                rest = (1 - new_below[up]) * (total_below[up] - known) / total_below[up] + new_below[up]
                rest = np.maximum(rest, 1e-300)
                self.next_scale.append((1 - new_below[up]) / total_below[up] / rest)
                self.next_escape.append(np.log10(np.maximum(new_below[up] / rest, 1e-300)))
            else:
                self.next_scale.append(1 / np.maximum(256 - kind, 1))
                self.next_escape.append(np.zeros(len(ctx)))
            before = node, n, ctx, new, total
        self.last = before
        top = _find(self.contexts[order], self.nodes[order] >> np.uint64(8))
        self.seen = np.log10(self.counts[order] * self.first_scale[order][top]) if len(top) else np.zeros(1)

    def log10(self, g: np.ndarray) -> np.ndarray:
        """log10 of each gram's last byte's chance after the bytes before it."""
        if not len(self.nodes[0]):  # nothing learned: all bytes alike
            return np.full(len(g), -np.log10(256.0))
        at = _find(self.nodes[self.order], g)
        out = np.where(at >= 0, self.seen[np.maximum(at, 0)], 0.0)
        todo = np.flatnonzero(at < 0)
        g, p = g[todo], np.zeros(len(todo))
        entered = np.full(len(todo), -1)  # the context just escaped from, one order up
        open_ = np.ones(len(todo), bool)
        for j in range(self.order, -1, -1):
            if not len(self.contexts[j]):  # a part that learned nothing of this order
                continue
            key = g & np.uint64((1 << (8 * (j + 1))) - 1)
            ctx, node = _find(self.contexts[j], key >> np.uint64(8)), _find(self.nodes[j], key)
            has = open_ & (ctx >= 0)
            scale, escape = self.first_scale[j][np.maximum(ctx, 0)], self.first_escape[j][np.maximum(ctx, 0)]
            if j < self.order:
                from_, after = np.maximum(entered, 0), entered >= 0
                scale = np.where(after, self.next_scale[j + 1][from_], scale)
                escape = np.where(after, self.next_escape[j + 1][from_], escape)
            hit = has & (node >= 0)
            p[hit] += np.log10(self.counts[j][node[hit]] * scale[hit])
            open_ &= ~hit
            p[has & ~hit] += escape[has & ~hit]
            entered = np.where(has, ctx, -1)
        last = open_
        if last.any():
            p[last] += np.log10(self.next_scale[0][0])
        out[todo] = p
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 chance of each text with its end."""
        g = grams(data, offsets, self.order)
        order = np.argsort(g)
        ranked = g[order]
        new = np.ones(len(g), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        p = np.empty(len(g))
        p[order] = self.log10(ranked[new])[np.cumsum(new) - 1]
        return np.add.reduceat(p, offsets[:-1] + np.arange(len(offsets) - 1)) if len(offsets) > 1 else np.zeros(0)
