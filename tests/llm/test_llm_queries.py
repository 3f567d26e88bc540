"""The corpus queries on the smallest tables: against SQL, or against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from compare import assert_same
from conftest import DATA
from ethoframe.llm import queries

import brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("select doc_id, text from documents").fetchall())


def words(text):
    return WORD.findall(text or "")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, name):
    assert_same(queries.QUERIES[name](spark, str(DATA)), duck.sql(queries.SQL[name]))


def test_mixing(spark, duck, texts):
    rows = queries.op1_mixing(spark, str(DATA)).collect()
    again = queries.op1_mixing(spark, str(DATA)).collect()
    assert sorted(rows) == sorted(again) and len(rows) == len(texts)
    source_of = dict(duck.sql("select doc_id, source from documents").fetchall())
    sizes = Counter()
    for i, t in texts.items():
        sizes[source_of[i]] += len(words(t))
    # targets by the words of the contract: share, stop, share the excess
    order = sorted(sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while left > 1e-6 and open_:
        unit = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in sorted(open_):
            target[s] += unit * weight[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    taken = Counter()
    for r in rows:
        assert r.size == len(words(texts[r.doc_id])) and r.source_size == sizes[r.source]
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.03 * target[s]


def test_scoring(spark, texts):
    rows = {r.doc_id: r for r in queries.op3_lm_scoring(spark, str(DATA)).collect()}
    lower = {i: [*words(re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), "\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, ws in lower.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert set(rows) == set(texts)
    for i, ws in lower.items():
        r, base = rows[i], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    learned = [r for r in rows.values() if not r.held_out]
    assert sum(r.score for r in learned) > sum(r.base_score for r in learned)
    plain = {i: " ".join(ws[:-1]).encode() for i, ws in lower.items()}
    model = brute.Ppm([t for i, t in plain.items() if not held[i]], 5)
    assert all(math.isclose(rows[i].score, model.score(t), rel_tol=1e-9) for i, t in plain.items())


def test_pseudonyms(spark, texts):
    rows = queries.op2_pii(spark, str(DATA)).collect()
    assert len(rows) == len(texts) and sum(r.n_found for r in rows) > 0
    for r in rows:
        text, kinds = brute.pseudonyms(texts[r.doc_id], "op2")
        assert (r.text, r.kinds, r.n_found) == (text, ",".join(kinds), len(kinds))


def test_substrings_of_brute_force(spark, texts):
    first: dict = {}
    split = {i: words(t) for i, t in texts.items()}
    for i in sorted(split):
        for k in range(len(split[i]) - 49):
            first.setdefault(tuple(split[i][k : k + 50]), i)
    for r in queries.op5_substring_dedup(spark, str(DATA)).collect():
        ws, keep = split[r.doc_id], [True] * len(split[r.doc_id])
        for k in range(len(ws) - 49):
            if first[tuple(ws[k : k + 50])] < r.doc_id:
                keep[k : k + 50] = [False] * 50
        kept = " ".join(w for w, x in zip(ws, keep) if x)
        assert (r.n_words, r.n_removed) == (len(ws), keep.count(False)) and r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_toxicity(spark, duck):
    rows = {r.doc_id: r for r in queries.op7_toxicity(spark, str(DATA)).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    labels = dict(duck.sql("select doc_id, toxic from labels").fetchall())
    by = [[rows[i].score for i, y in labels.items() if y == k and not rows[i].held_out] for k in (0, 1)]
    assert np.mean(by[1]) > np.mean(by[0]) + 0.2


def test_toxicity_on_held_out_labels(spark):
    """On rows that nothing was learned from: rank, and hits and false alarms at 0.3.
    Bounds somewhat below what was measured (0.958, 98 of 120, 5 of 870)."""
    import duckdb

    folder = DATA.parent / "sf0.1"
    if not folder.exists():
        pytest.skip("no larger tables here")
    rows = {r.doc_id: r for r in queries.op7_toxicity(spark, str(folder)).where("held_out").collect()}
    labels = duckdb.sql(f"select doc_id, max(toxic) from '{folder}/labels.parquet' group by 1").fetchall()
    toxic, clean = (np.array([rows[i].score for i, y in labels if y == k and i in rows]) for k in (1, 0))
    area = np.mean([(s > clean).mean() + (s == clean).mean() / 2 for s in toxic])
    assert area > 0.94 and (toxic >= 0.3).mean() > 0.75 and (clean >= 0.3).mean() < 0.01


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*code.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    pieces, fill = {}, {}
    for r in queries.op8_packing(spark, str(DATA)).collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in pieces.items():
        at = 0
        for start, length in sorted(own):
            assert start == at and length > 0
            at += length
        assert at == len(ids[i])
    total = padded = 0
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    assert set(pieces) == set(ids) and padded <= max(1024, 0.01 * total)


def test_packing_mostly_by_the_rule(spark):
    """Remainders of several partitions meet in one long stream."""
    from ethoframe.llm import packing

    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, " a" * int(n)) for i, n in enumerate(rng.integers(1, 63, 40000))], "doc_id long, text string").repartition(8)
    rows = packing.pack(docs, size=64, digest=True).collect()
    by = Counter()
    for r in rows:
        by[r.how] += r.length
    assert by["rest"] < 0.1 * by["rule"], by
    assert sum(by.values()) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_neighbours(spark, duck):
    rows = duck.sql("select vec_id, embedding from embeddings order by vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found: dict = {}
    for r in queries.op9_nearest_neighbours(spark, str(DATA)).collect():
        found.setdefault(r.query_id, []).append(r)
    hits = n = 0
    norms = np.sqrt((x * x).sum(1))
    for q in np.flatnonzero(ids % 50 == 0):
        close = (x @ x[q]) / (norms * norms[q])
        close[q] = -9
        best = set(ids[np.lexsort((ids, -close))[:5]])
        own = sorted(found[ids[q]], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and ids[q] not in {r.vec_id for r in own}
        assert all(math.isclose(r.score, close[np.flatnonzero(ids == r.vec_id)[0]], rel_tol=1e-12) for r in own)
        hits, n = hits + len(best & {r.vec_id for r in own}), n + 5
    assert hits / n >= 0.9


def test_line_dedup(spark, texts):
    """All pairs of documents, aligned by another aligner."""
    wanted = brute.line_dedup(texts, 40)
    hits = n = 0
    for r in queries.op10_line_dedup(spark, str(DATA)).collect():
        own = texts[r.doc_id].split("\n")
        assert r.n_lines == len(own)
        hits, n = hits + min(r.n_removed, len(wanted[r.doc_id])), n + len(wanted[r.doc_id])
        assert r.n_removed <= len(wanted[r.doc_id])
        if r.n_removed == len(wanted[r.doc_id]):
            kept = "\n".join(x for k, x in enumerate(own) if k not in wanted[r.doc_id])
            assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert hits >= 0.97 * n > 0, (hits, n)


def test_pipeline(spark, duck, texts):
    """What run() packs is what the stages keep, and these what brute force keeps."""
    import corpus_pipeline
    from ethoframe.llm.common import stage, table

    docs, kept = table(spark, str(DATA), "documents"), []
    for name, make in corpus_pipeline.STAGES[:-1]:
        docs = stage(make(spark, docs, str(DATA)))
        kept.append([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    toxic, deduped, alone, mixed = kept
    assert len(toxic) < len(texts) and all(texts[i] == t for i, t in toxic)
    gone = brute.line_dedup(dict(toxic), 40)
    left = dict(deduped)
    hits = 0
    for i, t in toxic:
        lines = (t or "").split("\n")
        lost = len(lines) - (len(left[i].split("\n")) if left.get(i) else 0 if t else len(lines))
        assert lost <= len(gone[i])
        hits += lost
    assert hits >= 0.97 * sum(map(len, gone.values())) > 0
    linked = brute.near_links(dict(deduped), 0.8)
    assert {i for i, _ in alone} == {i for i, _ in deduped} - {i for i, least in linked.items() if least < i}
    assert {i for i, _ in mixed} <= {i for i, _ in alone} and max(Counter(i for i, _ in mixed).values()) <= 3
    packed = Counter()
    for r in corpus_pipeline.run(spark, str(DATA)).collect():
        packed[r.doc_id] += r.start == 0
    assert packed == Counter(i for i, _ in mixed)
