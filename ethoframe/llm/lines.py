"""Line dedup by pairwise alignment.

1. Exact copies of a whole text are aligned from end to end: the smallest doc_id
   keeps its lines, the others lose theirs. Only the first of each group goes on.
2. Line hashes propose pairs. A line held by up to ``rare`` documents pairs each
   with all that come before it; a more frequent one pairs each holder with its
   first holder only. So do, from each line on and up to each line, the shortest runs
   of lines with ``least_chars`` characters: they cover any block long enough to go.
   Pairs grow with the lines, never with their squares.
3. Each pair's two lists of line hashes are aligned by patience diff, by such runs
   where no line is unique, and aligned blocks of at least ``least_chars`` characters
   are deleted from the later one.
4. What is left is proposed again: of a run or a line that is long enough by itself and
   that an alignment with its first holder left in a later document (there it was out of
   order, or there once and here twice) all other earlier holders are tried, in rounds
   that take ``STEP`` times as many each, until it went or none is left. Any aligned
   block long enough to go consists of such runs and lines, so what goes is what all
   pairs of documents would find (but for blank lines at a block's ends). What no holder removes has met all of them: that part
   grows with holders times the documents in which it stays.

Only hashes of lines travel between tasks; texts move once, to meet the deletions.
Lines are compared by a 64-bit hash of their exact characters.

Defined results: a null text has no lines and stays null; null ids pair with none;
rows with equal ids are never each other's earlier copy; empty texts stay.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import columns_of, row_of, stage, unstage

#: Lines held by so many documents at most propose all pairs of them.
RARE = 6
#: Each round tries so many times the holders that the one before it did.
STEP = 8
#: Parts in which the rows of one text, or the partners of one document, are dealt out.
PARTS = 16
#: Partners of a document above which they are dealt out.
BUSY = 1000
#: Aligned blocks with fewer characters stay.
LEAST_CHARS = 40


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs (sorted by the first) rising in the second too."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _runs(side: list, chars: dict, x: int, to: int, least_chars: int) -> dict[tuple, list[int]]:
    """The shortest runs of at least ``least_chars`` in side[x:to], and their starts;
    lines without known characters are in none."""
    out: dict[tuple, list[int]] = {}
    e = n = 0
    for k in range(x, to):
        if e <= k:
            e, n = k, 0
        while e < to and n < least_chars and side[e] in chars:
            n += chars[side[e]]
            e += 1
        if n >= least_chars and chars.get(side[k], 0):
            out.setdefault(tuple(side[k:e]), []).append(k)
        n -= chars.get(side[k], 0)
    return out


def _repeated(in_a: dict[tuple, list[int]], in_b: dict[tuple, list[int]]) -> list[tuple[int, int]]:
    """Rising pairs of starts of equal runs: the n-th of one side with the n-th of the
    other, or each with the next that is left, whichever are more."""
    ranked = _rising(sorted(pair for run, at in in_a.items() for pair in zip(at, in_b.get(run, []))))
    follows, j = [], -1
    for k, run in sorted((k, run) for run, at in in_a.items() if run in in_b for k in at):
        at = bisect_left(in_b[run], j + 1)
        if at < len(in_b[run]):
            j = in_b[run][at]
            follows.append((k, j))
    return max(ranked, follows, key=len)


def patience(a: list, b: list, chars: list[int] | None = None, least_chars: int = LEAST_CHARS) -> list[tuple[int, int]]:
    """Aligned index pairs of a and b: common ends, then lines unique to both sides
    in rising order, or, where there are none and ``chars`` of a are given, starts of
    runs of lines with ``least_chars``; then the same between them."""
    known = dict(zip(a, chars or []))
    matches: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, to_i, j, to_j = todo.pop()
        while i < to_i and j < to_j and a[i] == b[j]:
            matches.append((i, j))
            i, j = i + 1, j + 1
        while i < to_i and j < to_j and a[to_i - 1] == b[to_j - 1]:
            to_i, to_j = to_i - 1, to_j - 1
            matches.append((to_i, to_j))
        if i == to_i or j == to_j:
            continue
        at_a: dict = {}
        at_b: dict = {}
        for seen, side, x, y in ((at_a, a, i, to_i), (at_b, b, j, to_j)):
            for k in range(x, y):
                seen[side[k]] = -1 if side[k] in seen else k
        shared = [(k, at_b[h]) for h, k in at_a.items() if k >= 0 and at_b.get(h, -1) >= 0]
        anchors = _rising(sorted(shared))
        if not anchors and known:
            anchors = _repeated(_runs(a, known, i, to_i, least_chars), _runs(b, known, j, to_j, least_chars))
        if not anchors:
            continue
        for x, y in anchors:
            todo.append((i, x, j, y))
            matches.append((x, y))
            i, j = x + 1, y + 1
        todo.append((i, to_i, j, to_j))
    return sorted(matches)


def aligned_blocks(later: list, chars: list[int], earlier: list, least_chars: int) -> list[int]:
    """Lines of ``later`` in aligned blocks of at least ``least_chars`` characters."""
    out: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for i, j in [*patience(later, earlier, chars, least_chars), (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if sum(chars[k] for k in block) >= least_chars:
                out += block
            block = []
        block.append(i)
        before = (i, j)
    return out


def _align(least_chars: int):
    schema = pa.schema([("doc_id", pa.int64()), ("body", pa.int64()), ("gone", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies, gone = [], [], []
            for doc, body, later, chars, earlier in zip(*(batch.column(k) for k in range(5))):
                if found := aligned_blocks(later.as_py(), chars.as_py(), earlier.as_py(), least_chars):
                    ids.append(doc.as_py())
                    bodies.append(body.as_py())
                    gone.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], schema=schema)

    return run


def _lines(docs: DataFrame) -> DataFrame:
    split = F.split("text", "\n")
    return docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("body"),
        F.transform(split, lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform(split, lambda x: F.length(F.trim(x))).alias("chars"),
        F.length("text").alias("size"),
    )


def _long_runs(least_chars: int):
    """For each line that isn't long enough by itself, the hashes of the shortest runs
    from it on and up to it that are."""
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int64()), ("at", pa.int32()), ("past", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, chars = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2))
            n = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            to, place = np.repeat(np.cumsum(n), n), np.arange(len(chars))
            sums = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
            ends = np.searchsorted(sums, sums[:-1] + least_chars)
            on = np.flatnonzero((chars > 0) & (ends <= to) & (ends > place + 1))
            begins = np.searchsorted(sums, sums[1:] - least_chars, "right") - 1
            up = (chars > 0) & (begins >= to - np.repeat(n, n)) & (begins < place)
            # a run that is the shortest from its first line on is there already
            up &= (ends[begins] != place + 1) | (ends[begins] <= begins + 1)
            up = np.flatnonzero(up)
            at, past = np.concatenate([on, begins[up]]), np.concatenate([ends[on], up + 1])
            runs = W.spans(hashes.astype(np.int64).view(np.uint64), at, past).view(np.int64)
            docs = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n)[at]
            first = (to - np.repeat(n, n))[at]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(runs, pa.int64()), pa.array(at - first, pa.int32()), pa.array(past - first, pa.int32())], schema=schema)

    return run


def _aligned(heads: DataFrame, pairs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, body, gone) of each pair (doc_id, earlier) that loses lines."""
    # a first holder of a very common line is met in parts
    later = pairs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    busy = pairs.groupBy("earlier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUSY).select("earlier", F.lit(True).alias("busy"))
    a = heads.select("doc_id", "body", F.col("hashes").alias("later"), "chars")
    firsts = heads.select(F.col("doc_id").alias("earlier"), F.col("hashes").alias("before")).join(busy, "earlier", "left")
    later = later.join(busy, "earlier", "left").withColumn("part", F.when(F.col("busy"), F.col("part")).otherwise(0)).drop("busy")
    all_parts = F.sequence(F.lit(0), F.when(F.col("busy"), PARTS - 1).otherwise(0))
    b = firsts.select("earlier", "before", F.explode(all_parts).alias("part"))
    aligned = later.join(a, "doc_id").join(b, ["earlier", "part"]).select("doc_id", "body", "later", "chars", "before")
    return aligned.mapInArrow(_align(least_chars), "doc_id long, body long, gone array<int>")


def _by_document(gone: DataFrame) -> DataFrame:
    """However many partners a document has, a set of its lines is all that is held."""
    each = gone.select("doc_id", "body", F.explode("gone").alias("at"))
    return each.groupBy("doc_id", "body").agg(F.collect_set("at").alias("gone"))


_ITEMS = pa.schema([("doc_id", pa.int64()), ("line", pa.int64()), ("at", pa.int32()), ("past", pa.int32())])


def _left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document the items with a line that stays."""
    for batch in batches:
        for doc, items, gone in zip(batch.column(0), batch.column(1), batch.column(2)):
            rows = pa.RecordBatch.from_struct_array(items.values)
            at, past = (rows.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            went = np.zeros(int(past.max()) + 1, np.int64)
            if gone.is_valid:
                lost = gone.values.to_numpy(zero_copy_only=False)
                went[lost[lost < len(went) - 1] + 1] = 1
            sums = np.cumsum(went)
            left = rows.filter(pa.array(sums[past] - sums[at] < past - at))
            yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * left.num_rows, pa.int64()), *left.columns], schema=_ITEMS)


def _unaligned(items: DataFrame, gone: DataFrame, several: DataFrame) -> DataFrame:
    """Those (doc_id, line, at, past) of which not all lines go; a document's
    meet in one row. Where an id has ``several`` texts, lines that one of them loses
    say nothing of the others, and all its items are left."""
    own = gone.join(several, "doc_id", "left_anti").groupBy("doc_id").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    each = items.groupBy("doc_id").agg(F.collect_list(F.struct("line", "at", "past")).alias("items"))
    return each.join(own, "doc_id", "left").select("doc_id", "items", "gone").mapInArrow(_left_over, "doc_id long, line long, at int, past int")


def deletions(docs: DataFrame, rare: int = RARE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, body, copy, gone): the numbers of the lines to delete, or copy =
    true where the whole text goes; body is the text's hash."""
    lines = stage(_lines(docs))
    texts = lines.select("doc_id", "body", "size")
    shared = texts.groupBy("body", "size").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # the rows of one text are dealt out, each part with its own copy of the first id
    parts = shared.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    copies = texts.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")).join(parts, ["body", "size", "part"])
    copies = stage(copies.where("doc_id > first_id").select("doc_id", "body").distinct())
    heads = lines.join(copies, ["doc_id", "body"], "left_anti").dropDuplicates(["doc_id", "body"])
    heads = stage(heads.select("doc_id", "body", "hashes", "chars"))
    unstage(lines)
    several = stage(heads.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    held = heads.select("doc_id", F.explode(F.array_distinct(F.transform(F.arrays_zip("hashes", "chars"), lambda x: F.when(x["chars"] > 0, x["hashes"])))).alias("line")).where("line is not null")
    runs = heads.select("doc_id", "hashes", "chars").mapInArrow(_long_runs(least_chars), "doc_id long, line long, at int, past int")
    held = held.withColumn("run", F.lit(False)).unionByName(runs.select("doc_id", "line", F.lit(True).alias("run"))).distinct()
    counted = held.groupBy("line", "run").agg(F.count(F.lit(1)).alias("holders"), F.min("doc_id").alias("first_id")).where("holders > 1")
    to_first = held.join(counted, ["line", "run"]).where("doc_id > first_id").select("doc_id", F.col("first_id").alias("earlier"))
    few = counted.where(f"not run and holders between 3 and {int(rare)}").select("line")
    groups = held.where("not run").join(few, "line").groupBy("line").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    each = groups.select("ids", F.posexplode("ids").alias("k", "doc_id"))
    among = each.select("doc_id", F.explode(F.slice("ids", F.lit(1), F.col("k"))).alias("earlier"))
    pairs = stage(to_first.unionByName(among).distinct())
    gone = stage(_by_document(_aligned(heads, pairs, least_chars)))
    # lines and runs that may go by themselves, where an earlier document has them too
    long = heads.select("doc_id", F.posexplode(F.arrays_zip("hashes", "chars")).alias("at", "x")).where(F.col("x.chars") >= least_chars)
    strong = runs.unionByName(long.select("doc_id", F.col("x.hashes").alias("line"), "at", (F.col("at") + 1).alias("past")))
    often = counted.groupBy("line").agg(F.min("first_id").alias("first_id"))
    later = stage(_unaligned(strong.join(often, "line").where("doc_id > first_id").drop("first_id"), gone, several))
    # all holders of what is left, each with its turn: 0 up to their number, by a hash
    all_left = strong.join(later.select("line").distinct(), "line").select("line", F.col("doc_id").alias("earlier")).distinct()
    n = all_left.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod(F.xxhash64("earlier", "line"), F.lit(1 << 52)) / float(1 << 52)
    holders = stage(all_left.join(n, "line").select("line", "earlier", "n", (share * F.col("n")).alias("turn")))
    most = int(holders.agg(F.max("n").alias("n")).first()["n"] or 0)
    low = reach = 0
    while reach < most and later.limit(1).count():
        low, reach = reach, reach * STEP or STEP
        turn = holders.where((F.col("turn") >= low) & (F.col("turn") < reach)).select("line", "earlier")
        met = later.select("doc_id", "line").distinct().join(turn, "line").where("earlier < doc_id").select("doc_id", "earlier").distinct()
        fresh = stage(met.join(pairs, ["doc_id", "earlier"], "left_anti"))
        more = stage(_by_document(gone.unionByName(_aligned(heads, fresh, least_chars))))
        all_pairs = stage(pairs.unionByName(fresh))
        left = stage(_unaligned(later.join(holders.where(F.col("n") > reach).select("line").distinct(), "line", "left_semi"), more, several))
        unstage(later, fresh, pairs, gone)
        later, pairs, gone = left, all_pairs, more
    unstage(later, holders, several)
    whole = copies.select("doc_id", "body", F.array().cast("array<int>").alias("gone"), F.lit(True).alias("copy"))
    found = stage(gone.withColumn("copy", F.lit(False)).unionByName(whole))
    unstage(copies, heads, pairs, gone)
    return found


def dedup_lines(docs: DataFrame, rare: int = RARE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with their text cut, and n_lines and n_removed added (columns of
    these names are replaced). Whole copies of a text shorter than ``least_chars``
    stay, as any other block that is as short."""
    found = deletions(docs, rare, least_chars).select(
        F.col("doc_id").alias("_id"), F.col("body").alias("_body"), F.col("gone").alias("_gone"), F.col("copy").alias("_copy")
    )
    rows = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("_doc"), F.col("text").alias("_text"))
    rows = rows.join(found, (F.col("_doc") == F.col("_id")) & (F.xxhash64("_text") == F.col("_body")), "left")
    rows = rows.withColumn("_lines", F.split("_text", "\n"))
    left = F.when(F.col("_copy") & (F.length("_text") >= least_chars), F.array().cast("array<int>")).when(
        F.size("_gone") > 0, F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    )
    rows = rows.withColumn("_left", left)
    text = F.when(F.col("_left").isNull(), F.col("_text")).otherwise(F.array_join(F.transform("_left", lambda i: F.get(F.col("_lines"), i)), "\n"))
    n = F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    removed = F.when(F.col("_left").isNull(), 0).otherwise(F.size("_lines") - F.size("_left")).cast("long")
    return rows.select(*columns_of(docs, {"text": text}, ("n_lines", "n_removed")), n.alias("n_lines"), removed.alias("n_removed"))
