"""Periodic runs and vector codes against plain Python, and their edges."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from ethoframe.llm import codes, periods, queries
from ethoframe.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_of(ws, shortest=24):
    """(start, length, period) of all runs, by trying each period at each place."""
    found = {}
    for q in range(1, len(ws) // 3 + 1):
        i = 0
        while i + q < len(ws):
            if ws[i] == ws[i + q]:
                j = i
                while j + q < len(ws) and ws[j] == ws[j + q]:
                    j += 1
                if j + q - i >= max(shortest, 3 * q):
                    found.setdefault((i, j + q), q)  # the smallest period of a stretch comes first
                i = j
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def document(rng):
    k, ws = rng.randint(1, 4), []
    for _ in range(rng.randint(0, 6)):
        if rng.random() < 0.5:
            unit = [rng.choice("abcd"[:k]) for _ in range(rng.randint(1, 12))]
            ws += unit * rng.randint(1, 7) + unit[: rng.randint(0, len(unit))]
        else:
            ws += [rng.choice("abcdefgh"[: 2 * k]) for _ in range(rng.randint(0, 30))]
    return ws * rng.randint(1, 3)


@pytest.mark.parametrize("shortest", [3, 8, 24])
def test_runs_of_random_documents(shortest):
    rng = random.Random(shortest)
    docs = [document(rng) for _ in range(400)]
    got = [r for t in W.chunks(pa.array([" ".join(d) for d in docs]), 300) for r in periods.runs_in(t, shortest)]
    assert got == [runs_of(d, shortest) for d in docs]


def test_long_documents_of_one_unit():
    for unit, n in ((["a"], 60_000), (["a", "b"], 30_000), ([f"w{i}" for i in range(997)], 40)):
        ws = unit * n
        assert periods.runs_in(next(W.chunks(pa.array([" ".join(ws)])))) == [[(0, len(ws), len(unit))]]


def test_runs_of_the_smallest_tables(spark, duck):
    rows = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(DATA)).collect()}
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    assert set(rows) == set(texts) and sum(r.n_runs > 0 for r in rows.values()) > 10
    for i, text in texts.items():
        ws, h = WORD.findall(text or ""), zlib.crc32(str(i).encode())
        n, g = len(ws), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[k] if k < a else ws[a + (k - a) % p] for k in range(n)]
        if n > 4000:
            continue
        own, r, gone = runs_of(ws), rows[i], set()
        for s, m, q in own:
            gone |= set(range(s + q, s + m))
        best = min(own, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(own), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if own else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in own).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(ws) if k not in gone).encode()).hexdigest()


def test_runs_and_their_texts(spark):
    """Real outputs, null and empty texts, repeated and null ids, clashing columns, no rows."""
    tail = " ".join(["x y z"] * 9)
    rows = [(1, f"one two {tail} end", 7, "r"), (1, f"one two {tail} end", 7, "r"), (2, None, 7, "r"), (3, "", 7, "r"), (None, tail, 7, "r"), (4, " \t\n", 7, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, _row string")
    out = periods.collapse_runs(df)
    got = sorted((r.doc_id or 0, r.n_runs, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect())
    assert got == [(0, 1, [(0, 27, 3)], "x y z"), (1, 1, [(2, 27, 3)], "one two x y z end"), (1, 1, [(2, 27, 3)], "one two x y z end"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], "")]
    assert periods.collapse_runs(df.limit(0)).count() == 0
    assert [r.text for r in periods.repeat_tails(df.where("doc_id is null")).collect()] == [tail]
    with pytest.raises(ValueError):
        periods.collapse_runs(df, shortest=2)


def plain_codes(vectors, parts=16, entries=64, rounds=2, scale=256):
    """Codebooks and (code, error) of each vector, one number at a time."""
    ints = {i: [int(np.floor(np.float64(x) * scale)) for x in v] for i, v in vectors.items()}
    d = len(next(iter(ints.values()))) // parts
    cut = {i: [v[p * d : (p + 1) * d] for p in range(parts)] for i, v in ints.items()}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]

    def nearest(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for v in cut.values():
                members[nearest(v[p], books[p])[0]].append(v[p])
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(members, books[p])]
    found = {i: [nearest(v[p], books[p]) for p in range(parts)] for i, v in cut.items()}
    return books, {i: ("".join(f"{k:02x}" for k, _ in f), sum(e for _, e in f)) for i, f in found.items()}


def test_codes_by_plain_python(spark):
    rng = np.random.default_rng(2)
    vectors = {int(i): np.round(rng.normal(0, 0.3, 32), 3).tolist() for i in rng.permutation(300)[:150]}
    rows = [(i, v, i % 3 if i % 7 else None) for i, v in vectors.items()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    books, each = plain_codes({i: np.float32(v) for i, v in vectors.items()}, parts=8, entries=20, rounds=3)
    out = codes.compress(df, parts=8, entries=20, rounds=3).collect()
    assert {r.vec_id: (r.code, r.error) for r in out} == each
    assert {r.codebooks_sha256 for r in out} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}
    sums = {}
    for i, _, label in rows:
        sums[label] = sums.get(label, 0) + each[i][1]
    assert all(r.label_error == sums[r.label] for r in out)


def test_label_errors_beyond_the_broadcast(spark, monkeypatch):
    """Labels with many rows are joined apart from the others: the same sums."""
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise((F.col("id") % 40).cast("int")).alias("label"), F.lit("00").alias("code"), (F.col("id") % 11).alias("error"))
    whole = sorted((r.vec_id, r.label_error) for r in codes.with_label_error(df).collect())
    monkeypatch.setattr(codes, "_LABELS", 5)
    monkeypatch.setattr(codes, "_HOT", 50)
    assert sorted((r.vec_id, r.label_error) for r in codes.with_label_error(df).collect()) == whole


def test_vectors_at_the_edges(spark):
    """Null, broken, empty and odd vectors, null and repeated ids, clashing columns, no rows, no label."""
    one, two = [0.5, -0.5, 0.25, 1.0], [-0.001, 0.0, 0.3, 0.2]
    rows = [(3, one, "a"), (None, two, "a"), (1, None, "a"), (2, [0.1, None, 0.2, 0.3], "a"), (4, [float("nan"), 0.0, 0.0, 0.0], None), (5, [float("inf"), 0.0, 0.0, 0.0], None), (6, [], None), (7, [0.1, 0.2], None), (3, two, None), (8, one, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label string, _v string, code int")
    out = codes.compress(df, parts=2, entries=64).collect()
    assert sorted((r.vec_id or 0, r.code is None) for r in out) == [(0, False), (3, False), (3, False), (6, True), (7, True), (8, False)]
    assert len({r.label_error for r in out if r.label == "a"}) == 1
    by = {(r.vec_id, r.label): r for r in out}
    assert by[3, "a"].code == by[8, None].code and by[3, None].code == by[None, "a"].code and by[3, "a"].error == 0
    assert codes.compress(df.limit(0)).count() == 0 and codes.compress(df.where("vec_id in (1, 6)"), parts=2).count() == 1
    assert codes.compress(df.drop("label"), parts=2).count() == 6
    for bad, options in ((one, {"parts": 3}), ([1e6, 0.0, 0.0, 0.0], {"parts": 2}), (one, {"parts": 2, "entries": 300})):
        with pytest.raises(ValueError):
            codes.compress(spark.createDataFrame([(1, bad)], "vec_id long, embedding array<double>"), **options)
