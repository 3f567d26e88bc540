"""N-gram Jaccard join by chosen paths.

Every text is a set of word shingles, sketched by minhash into ``SLOTS`` tokens
that two sets share with the chance of their Jaccard similarity. Texts with equal
sets form one class and only classes are joined.

*Chosen paths.* A run splits all classes on sampled tokens: a path's class goes on
to each child token t for which hash(path, t) < 1 / (similarity * SLOTS), so that
classes at the wanted similarity share 1 child on average and dissimilar ones part.
Buckets of up to ``limit`` classes are compared outright, larger ones are split
again, down to ``depth``. Runs are repeated until a pair at the threshold is met
with the wanted recall, by the branching process's chance of survival.

*Comparing.* Buckets compare sketches with a margin of four standard deviations
and tell only which classes hang together (at most one link a member), so a group
of n near copies costs n rows, not n^2. Then all pairs inside such a candidate
group are counted exactly, on whole shingle sets, in tasks of bounded size: groups
too large for one are cut in blocks and each pair of blocks is a task.

Defined results: a text with fewer words than a shingle is one shingle, one with
no words (null, empty) has none and no links; repeated rows and equal texts count
as links of each other; rows with a null id get a null class and no links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import columns_of, row_of, stage
from .components import components

SLOTS = 64
#: Shingles of one block of a candidate group; a task holds two.
BLOCK = 2_000_000
_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 62, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEAT = (np.arange(SLOTS, dtype=np.uint64) + np.uint64(1)) << np.uint64(40)


def shingle_sets(texts: W.Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order by row, and each row's bounds in them."""
    words = texts.word_hashes()
    h = W.window_hashes(words, width)
    at = np.flatnonzero(W.inside(texts.first, len(h), width))
    rows, h = texts.word_rows()[at], h[at]
    short = np.flatnonzero((texts.n_words > 0) & (texts.n_words < width))
    if len(short):
        rows = np.concatenate([rows, short])
        h = np.concatenate([h, W.sequence_hashes(words, texts.first)[short]])
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    rows, h = rows[new], h[new]
    return h, np.searchsorted(rows, np.arange(texts.n_rows + 1))


def set_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set (0 for an empty one)."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(h ^ _XOR[0]))])
    n = np.diff(bounds)
    return np.where(n > 0, W.mix(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64) * _ODD[0]), np.uint64(0)).view(np.int64)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("marks", pa.binary())])


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.chunks(batch.column(1)):
                h, bounds = shingle_sets(texts, width)
                full = np.flatnonzero(np.diff(bounds))
                mins = np.zeros((SLOTS, texts.n_rows), np.uint32)
                for k in range(SLOTS if len(full) else 0):
                    mins[k, full] = W.mix(np.minimum.reduceat((h ^ _XOR[k]) * _ODD[k], bounds[full])) & np.uint64(0xFFFFFFFF)
                sketch = np.ascontiguousarray(mins.T)
                # its lowest bytes are enough to compare two sketches
                marks = (sketch & np.uint32(0xFF)).astype(np.uint8)
                blobs, small = ([x[i].tobytes() for i in range(texts.n_rows)] for x in (sketch, marks))
                ids = batch.column(0).slice(texts.row, texts.n_rows)
                yield pa.RecordBatch.from_arrays([ids, pa.array(set_keys(h, bounds)), pa.array(np.diff(bounds), pa.int64()), pa.array(blobs, pa.binary()), pa.array(small, pa.binary())], schema=_SKETCH)

    return run


_PATHS = pa.schema([("path", pa.int64()), ("node", pa.int64())])


def _expand(similarity: float, runs: int):
    """Children of (node, sketch, path); without paths, of the roots of all runs."""
    most = np.uint64(min(1.0, 1 / (similarity * SLOTS)) * float(1 << 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                if not part.num_rows:
                    continue
                nodes = part.column(0).to_numpy()
                sketch = np.frombuffer(b"".join(x.as_py() for x in part.column(1)), np.uint32).reshape(-1, SLOTS)
                tokens = W.mix(sketch.astype(np.uint64) + _SEAT)
                given = part.num_columns > 2
                roots = [part.column(2).to_numpy().view(np.uint64)] if given else [W.mix(np.full(1, r + 1, np.uint64)) for r in range(runs)]
                for path in roots:
                    children = W.mix(path[:, None] ^ tokens)
                    i, j = np.nonzero(children < most)
                    yield pa.RecordBatch.from_arrays([pa.array(W.mix(children[i, j] ^ _ODD[1]).view(np.int64)), pa.array(nodes[i])], schema=_PATHS)

    return run


def _forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """The root of each of n members under the given pairs of them."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        np.minimum.at(root, root[pairs[:, 0]], low)
        np.minimum.at(root, root[pairs[:, 1]], low)
        while (root != root[root]).any():
            root = root[root]
        pairs = pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]
    return root


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(similarity: float, limit: int):
    """Links within buckets; the input is sorted by path and node.

    Members of a bucket up to ``limit`` are compared all with all. In a larger one
    members that are almost equal (``cover``) to an earlier one in front stand behind it.
    Each is compared with those in front, and with those behind one in front from which it
    is so far that they may be near it all the same; what is joined is kept as a forest,
    so that the same hang together as by comparing all with all. Either way a member is
    told one link, to the smallest of its tree.
    """
    spread = 4 * math.sqrt(similarity * (1 - similarity) / SLOTS)
    near, cover = (similarity - spread) * SLOTS, (1 - (1 - similarity) / 2) * SLOTS

    def close(nodes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        same = (marks[:, None, :] == marks[None, :, :]).sum(2)
        return _forest(len(nodes), np.argwhere(np.triu(same >= near, 1)))

    class Bucket:
        def __init__(self):
            self.nodes, self.marks = np.zeros(0, np.int64), np.zeros((0, SLOTS), np.uint8)
            self.front: np.ndarray | None = None  # members in front, by number
            self.behind: dict[int, list[tuple]] = {}  # by place in front: members, marks, tokens that differ
            self.root = np.zeros(0, np.int64)

        def add(self, nodes: np.ndarray, marks: np.ndarray) -> None:
            self.nodes = np.concatenate([self.nodes, nodes])
            if self.front is None:
                self.marks = np.concatenate([self.marks, marks])
                if len(self.nodes) <= limit:
                    return
                marks, self.marks, self.front = self.marks, self.marks[:0], np.zeros(0, np.int64)
            base = len(self.root)
            self.root = np.concatenate([self.root, np.arange(base, base + len(marks))])
            for x in range(0, len(marks), 128):
                self.meet(np.arange(base + x, base + min(x + 128, len(marks))), marks[x : x + 128])

        def meet(self, own: np.ndarray, marks: np.ndarray) -> None:
            pairs, middling = [], []
            # the place in front behind which each stands, and how many tokens differ there
            lead, apart = np.full(len(own), -1), np.zeros(len(own), np.int64)
            for y in range(0, len(self.front), 1024):
                same = (marks[:, None, :] == self.marks[None, y : y + 1024, :]).sum(2)
                best = same.argmax(1)
                most = same[np.arange(len(own)), best]
                new = (lead < 0) & (most >= cover)
                lead[new], apart[new] = y + best[new], SLOTS - most[new]
                i, j = np.nonzero(same >= near)
                pairs.append(np.stack([own[i], self.front[y + j]], 1))
                i, j = np.nonzero((same >= near + cover - SLOTS) & (same < near))
                middling.append(np.stack([i, y + j, same[i, j]], 1))
            same = (marks[:, None, :] == marks[None, :, :]).sum(2)
            pairs.append(own[np.argwhere(np.triu(same >= near, 1))])
            self.join(np.concatenate(pairs))
            if middling:
                self.meet_behind(own, marks, np.concatenate(middling))
            first = []
            for i in range(len(own)):
                if lead[i] < 0:
                    new = np.flatnonzero((lead < 0) & (same[i] >= cover))
                    new = new[new > i]
                    lead[new], apart[new] = len(self.front) + len(first), SLOTS - same[i, new]
                    first.append(i)
            behind = np.setdiff1d(np.arange(len(own)), first)
            for y in np.unique(lead[behind]):
                at = behind[lead[behind] == y]
                self.behind.setdefault(int(y), []).append((own[at], marks[at], apart[at]))
            self.front = np.concatenate([self.front, own[first]])
            self.marks = np.concatenate([self.marks, marks[first]])

        def meet_behind(self, own: np.ndarray, marks: np.ndarray, middling: np.ndarray) -> None:
            """Members (i, place in front, equal tokens) that are too far from one in front,
            but may be near to some behind it, unless they hang together already."""
            for y in np.unique(middling[:, 1]):
                for nodes, theirs, apart in self.behind.get(int(y), ()):
                    top = self.find(self.front[y])
                    rows = [(i, n) for i, _, n in middling[middling[:, 1] == y] if self.find(own[i]) != top]
                    if not rows:
                        break
                    i, n = np.array(rows).T
                    far = np.flatnonzero(apart >= near - n.max())
                    same = (marks[i][:, None, :] == theirs[far][None, :, :]).sum(2)
                    x, k = np.nonzero(same >= near)
                    self.join(np.stack([own[i[x]], nodes[far[k]]], 1))

        def join(self, pairs: np.ndarray) -> None:
            pairs = np.unique(self.root[pairs], axis=0)
            for a, b in pairs[pairs[:, 0] != pairs[:, 1]]:
                a, b = self.find(a), self.find(b)
                self.root[max(a, b)] = min(a, b)

        def find(self, a: int) -> int:
            while self.root[a] != a:
                a = self.root[a]
            return a

        def links(self) -> np.ndarray:
            n = len(self.nodes)
            if n < 2:
                return np.zeros((0, 2), np.int64)
            root = close(self.nodes, self.marks) if self.front is None else self.root
            while (root != root[root]).any():
                root = root[root]
            own = np.flatnonzero(root != np.arange(n))
            return np.stack([self.nodes[own], self.nodes[root[own]]], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, bucket = None, Bucket()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            paths, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            marks = np.frombuffer(b"".join(x.as_py() for x in batch.column(2)), np.uint8).reshape(-1, SLOTS)
            cut = np.flatnonzero(np.concatenate([[True], paths[1:] != paths[:-1]]))
            for x, y in zip(cut, [*cut[1:], len(paths)]):
                if paths[x] != path:
                    out.append(bucket.links())
                    path, bucket = paths[x], Bucket()
                bucket.add(nodes[x:y], marks[x:y])
            yield _links(out)
        yield _links([bucket.links()])

    return run


def _links(out: list) -> pa.RecordBatch:
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *out])
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_LINKS)


def runs_for(similarity: float, recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold is met with this chance: each split
    keeps a Poisson number of shared children, 1 on average."""
    met = 1.0
    for _ in range(depth):
        met = 1 - math.exp(-met)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def candidate_links(classes: DataFrame, similarity: float, recall: float, depth: int, limit: int) -> DataFrame:
    """Links (a, b) that connect all nodes of ``classes`` (node, sketch) at the
    similarity, with the recall."""
    runs = runs_for(similarity, recall, depth)
    expand = _expand(similarity, runs)
    paths = classes.select("node", "sketch").mapInArrow(expand, "path long, node long")
    met = []
    for level in range(1, depth + 1):
        paths = stage(paths.distinct())
        sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        shared = paths.join(sizes, "path")
        if level == depth:
            met.append(shared.select("path", "node"))
            break
        met.append(shared.where(F.col("size") <= limit).select("path", "node"))
        larger = shared.where(F.col("size") > limit).select("path", "node")
        paths = larger.join(classes.select("node", "sketch"), "node").select("node", "sketch", "path").mapInArrow(expand, "path long, node long")
    buckets = met[0]
    for more in met[1:]:
        buckets = buckets.unionByName(more)
    rows = buckets.join(classes.select("node", "marks"), "node").select("path", "node", "marks")
    rows = rows.repartition("path").sortWithinPartitions("path", "node")
    return rows.mapInArrow(_compare(similarity, limit), "a long, b long").distinct()


_SETS = pa.schema([("component", pa.int64()), ("node", pa.int64()), ("blocks", pa.int32()), ("size", pa.int64()), ("shingles", pa.binary())])


def _sets(width: int):
    """Shingle sets of (text, node, component, blocks, size); a row whose text is
    not its class's (two texts under one id) falls out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.chunks(batch.column(0)):
                h, bounds = shingle_sets(texts, width)
                own = batch.slice(texts.row, texts.n_rows)
                keep = np.flatnonzero(set_keys(h, bounds) == own.column(1).to_numpy())
                blobs = [h[bounds[i] : bounds[i + 1]].tobytes() for i in keep]
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([own.column(2).take(at), own.column(1).take(at), own.column(3).take(at), own.column(4).take(at), pa.array(blobs, pa.binary())], schema=_SETS)

    return run


_COUNTS = pa.schema([("node", pa.int64()), ("linked", pa.int64()), ("texts", pa.int64()), ("to", pa.int64())])


def _count(similarity: float):
    """One pair of blocks of a candidate group: for each node, how many rows and
    texts of the other block (or of its own, if they are one) it is linked to, and
    the root of its links as seen here."""

    def run(table: pa.Table) -> pa.Table:
        left, right = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        nodes, own = table.column("node").to_numpy(), table.column("block").to_numpy()
        nodes, at = np.unique(nodes, return_index=True)
        own, size = own[at], table.column("size").to_numpy()[at]
        sets = [np.frombuffer(table.column("shingles")[int(k)].as_py(), np.uint64) for k in at]
        lengths = np.array([len(x) for x in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        doc = np.repeat(np.arange(len(sets)), lengths)
        order = np.argsort(ids, kind="stable")
        posting, first = doc[order], np.searchsorted(ids[order], np.arange(ids.max() + 2))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        linked, texts, pairs = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64), []
        for x in range(len(sets)):
            if left != right and own[x] != left:
                continue
            mine = ids[bounds[x] : bounds[x + 1]]
            n = first[mine + 1] - first[mine]
            mine, n = mine[n > 1], n[n > 1]
            if not len(mine):
                continue
            spans = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(posting[spans], minlength=len(sets))
            hit = common >= similarity * (lengths[x] + lengths - common) - 1e-9
            hit[x] = False
            if left != right:
                hit &= own == right
            else:
                hit[:x] = False
            y = np.flatnonzero(hit)
            linked[x] += size[y].sum()
            linked[y] += size[x]
            texts[x] += len(y)
            texts[y] += 1
            pairs += [(x, k) for k in y]
        root = _forest(len(sets), np.array(pairs, np.int64).reshape(-1, 2))
        some = texts > 0
        return pa.Table.from_arrays([pa.array(nodes[some]), pa.array(linked[some]), pa.array(texts[some]), pa.array(nodes[root][some])], schema=_COUNTS)

    return run


def near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.9999, depth: int = 3, limit: int = 64) -> DataFrame:
    """One row for each of ``docs``: doc_id, copy_of (the smallest doc_id with the
    same shingles), class_id (the smallest doc_id that links lead to), n_links (rows
    at the similarity or above, equal ones included) and n_texts (how many different
    texts among them)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stage(slim.mapInArrow(_sketches(width), "doc_id long, node long, n long, sketch binary, marks binary"))
    full = sketches.where("n > 0 and doc_id is not null")
    classes = stage(full.groupBy("node").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("size"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("marks").alias("marks")))
    near = stage(candidate_links(classes, similarity, recall, depth, limit))
    groups = components(near)
    members = stage(groups.join(classes.drop("sketch", "marks"), "node"))
    blocks = members.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    wanted = members.join(blocks, "component").select("node", "component", "blocks", "size", F.col("copy_of").alias("doc_id"))
    sets = slim.join(wanted.hint("merge"), "doc_id").select("text", "node", "component", "blocks", "size")
    sets = sets.mapInArrow(_sets(width), "component long, node long, blocks int, size long, shingles binary")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sets = sets.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
    found = stage(sets.groupBy("component", "i", "j").applyInArrow(_count(similarity), "node long, linked long, texts long, to long"))
    counts = found.groupBy("node").agg(F.sum("linked").alias("linked"), F.sum("texts").alias("texts"))
    groups = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    known = classes.select("node", "copy_of", "size").join(counts, "node", "left").join(groups, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    tops = known.groupBy("component").agg(F.min("copy_of").alias("class_id"))
    known = known.join(tops, "component").select("node", "copy_of", "class_id", "size", "linked", "texts")
    rows = full.select("doc_id", "node").join(known, "node").select(
        "doc_id", "copy_of", "class_id",
        (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"),
    )
    alone = sketches.where("n = 0 or doc_id is null").select(
        "doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_texts")
    )
    return rows.unionByName(alone)


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """``docs`` without those whose class has a smaller doc_id. Rows with equal ids
    stay or go together; null ids stay."""
    rest = near_duplicates(docs, similarity, width).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("_doc"))
    return rows.join(rest, F.col("_doc") == F.col("_gone"), "left_anti").select(*columns_of(docs))
