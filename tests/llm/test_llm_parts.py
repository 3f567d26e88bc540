"""Parts of the corpus operators on their own."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ethoframe.llm import common, components, jaccard, lines, mixing, neighbours, packing, pii, ppm, quality, scoring, toxicity, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b", max_size=30)), max_size=8), st.integers(1, 40))
def test_word_spans(texts, size):
    column = pa.array(texts, pa.string())
    got = []
    for part in words.chunks(column, size):
        data, offsets = words.joined(part, np.ones(len(part.starts), bool))
        got += [bytes(data[a:b]).decode() for a, b in zip(offsets, offsets[1:])]
        h = part.word_hashes()
        seen = [bytes(part.data[a:b]) for a, b in zip(part.starts, part.ends)]
        assert len(set(seen)) == len(set(h.tolist()))
    assert got == [" ".join((t or "").replace("\x0b", " ").split()) for t in texts]


def test_window_hashes_know_equal_windows():
    h = np.random.default_rng(0).integers(0, 5, 400).astype(np.uint64)
    w = words.window_hashes(words.mix(h), 3)
    assert len({tuple(h[i : i + 3]) for i in range(398)}) == len(set(w.tolist()))


def test_distributions_are_proper():
    texts = [b"the cat sat on the mat", b"a cat", b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    g = ppm.grams(data, offsets, 3)
    assert len(g) == len(data) + len(texts)
    keys, n = np.unique(g, return_counts=True)
    model = ppm.Model(keys, n.astype(float), 3)
    for context in (b"the", b"cat", b"zzz", b"xth", b"\n\n\n"):
        base = np.uint64(int.from_bytes(context, "big") << 8)
        p = 10 ** model.log10(base + np.arange(256, dtype=np.uint64))
        assert abs(p.sum() - 1) < 1e-6 and (p > 0).all()
    empty = ppm.Model(np.zeros(0, np.uint64), np.zeros(0), 3)
    assert abs((10 ** empty.log10(np.arange(256, dtype=np.uint64))).sum() - 1) < 1e-9


def test_scores_from_all_grams(spark):
    """Over six million distinct grams, most of them seen once: as one model of all."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8), 120_000)).decode().strip() for _ in range(64)]
    texts = [" ".join(t.split()) for t in texts] + ["of the old kind, as the old ones", "", "the old kind"]
    held = scoring.held_out(list(range(len(texts))), 7, 2)
    learned = np.concatenate([ppm.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 5) for t, h in zip(texts, held) if not h])
    keys, n = np.unique(learned, return_counts=True)
    assert len(keys) > 6_000_000
    model = ppm.Model(keys, n.astype(float), 5)
    rows = scoring.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4, "doc_id")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id].encode()
        assert r.held_out == held[r.doc_id] and math.isclose(r.score, model.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0], rel_tol=1e-9)


def test_thresholds_of_rare_languages(spark):
    """A language with few rows in the sample but enough labels has its own threshold."""
    rows = [(k, f"text {k % 7} is {'vile' if k % 2 else 'fine'} here", "b" if k % 10 in (3, 6) else "a", k % 2) for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    net = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), per_class=100)
    assert set(net.thresholds) == {"a", "b"}
    assert all(r.toxic == (r.doc_id % 2 == 1) for r in toxicity.score(docs.drop("toxic"), net).collect())


def test_frequent_passages_go(spark):
    """A passage of short lines, each first held by another document, and one that its
    first holder, or a later one, has twice."""
    parts = [f"short line no {k} of a block" for k in range(4)]
    block, long = "\n".join(parts), "a passage of two lines, the first one\nand the second one, which ends it"
    docs = [(k, f"{p}\nonly in {k}") for k, p in enumerate(parts)]
    docs += [(10 + k, f"own {k}\n{block}\nrest {k}") for k in range(20)]
    docs += [(50, f"{long}\nbetween\n{long}\nlast"), *((51 + k, f"mine {k}\n{long}\nend {k}") for k in range(10)), (70, f"x\n{long}\ny\n{long}\nz")]
    rows = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [rows[k] for k in (*range(4), 10, 50)] == [dict(docs)[k] for k in (*range(4), 10, 50)]
    assert [rows[10 + k] for k in range(1, 20)] == [f"own {k}\nrest {k}" for k in range(1, 20)]
    assert [rows[51 + k] for k in range(10)] == [f"mine {k}\nend {k}" for k in range(10)]
    assert rows[70] == "x\ny\nz"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.integers(0, 6), max_size=25))
def test_patience_aligns(a, b):
    found = lines.patience(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
    if a == b:
        assert len(found) == len(a)


def test_sum_of_squares_fills_windows():
    rng = np.random.default_rng(1)
    levels, out = packing.Levels(64), []
    total = 0
    for i in range(6000):
        ids = np.zeros(int(rng.integers(1, 64)), np.uint32)
        total += len(ids)
        if w := levels.place((i, 0, ids, len(ids))):
            out.append(w)
    assert all(sum(len(p[2]) for p in w) == 64 for w in out)
    held = sum(int(levels.count[h]) * h for h in range(65))
    assert held + 64 * len(out) == total and held < 0.1 * total, held / total
    assert sum(len(p[2]) for w in levels.rest() for p in w) == held


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 2), (7, 7), (2, 11)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 11: 2, 8: 8, 9: 8}


def test_runs_reach_the_recall():
    assert jaccard.runs_for(0.8, 0.9999, 3) == 20 and jaccard.runs_for(0.8, 0.9, 1) < 5


def test_many_near_copies_in_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(90)] + [(900, "quite another text with some words of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = jaccard.near_duplicates(docs, limit=16).orderBy("doc_id").collect()
    monkeypatch.setattr(jaccard, "BLOCK", 4000)  # many blocks
    cut = jaccard.near_duplicates(docs, limit=16).orderBy("doc_id").collect()
    assert whole == cut
    assert {r.class_id for r in whole[:90]} == {0} and whole[90].n_links == 0
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for _, t in rows[:90]]
    for r in whole[:90]:
        assert r.n_links == sum(len(sets[r.doc_id] & s) / len(sets[r.doc_id] | s) >= 0.8 for s in sets) - 1


def _number(key, kind, r, other):
    return int(hashlib.sha256(f"{key}|{kind}|{r}|{other}".encode()).hexdigest()[:15], 16)


def test_feistel_against_python(spark):
    def python(a, b, m, n):
        for r in range(pii.ROUNDS):
            if r % 2 == 0:
                a = (a + _number("k", "x", r, b)) % m
            else:
                b = (b + _number("k", "x", r, a)) % n
        return a, b

    df = spark.createDataFrame([(a, b) for a in range(12) for b in range(9)], "a long, b long")
    s = pii.feistel("k", "x", F.col("a"), F.col("b"), 12, 9)
    rows = df.select("a", "b", s.alias("s")).collect()
    assert all(tuple(r.s) == python(r.a, r.b, 12, 9) for r in rows) and len({tuple(r.s) for r in rows}) == 108


def test_string_feistel_permutes(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    new = [r[0] for r in df.select(pii.feistel_string("k", "x", F.col("v"))).collect()]
    assert len(set(new)) == 1000 and all(len(x) == 3 and x.isdigit() for x in new)


def _luhn(s):
    d = [int(c) for c in s[::-1]]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms_are_valid_and_linked(spark):
    rows = ["4660658120418122", "x 4660 6581 2041 8122 y", "4660658120418123", "+1 (708) 555-4315", "14.207.121.153.", "300.1.1.1", "2024-02-29", "29/02/2024", "2024-02-30", "DE89 3704 0044 0532 0130 00", "a.b@c.org", "123-45-6789", "000-45-6789"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = [r for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]
    text = [r.text for r in out]
    assert [r.n_found for r in out] == [1, 1, 0, 1, 1, 0, 1, 1, 0, 1, 1, 1, 0]
    assert all((a == b) == (r.n_found == 0) for a, b, r in zip(rows, text, out))
    assert _luhn(text[0]) and text[1][2:-2].replace(" ", "") == text[0]
    assert "/".join(reversed(text[6].split("-"))) == text[7]
    iban = text[9].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert [r.text for r in pii.pseudonymise(df, "other").orderBy("doc_id").collect()] != text
    with pytest.raises(ValueError):
        pii.pseudonymise(df, "")


def test_each_kind_alone(spark):
    """A value gets its pseudonym whatever else its text holds, and no other value gets it."""
    same = {
        "8.8.8.8": "ip", "31/12/1999": "date", "12/31/1999": "date", "2024-02-29": "date", "29.02.2024": "date", "4111 1111 1111 1111": "card", "3782 822463 10005": "card",
        "BE68 5390 0754 7034": "iban", "123-45-6789": "ssn", "(708) 555-4315": "nanp", "+49 30 1234 5678": "phone", "0049 30 1234 5678": "phone", "030 1234567": "phone", "a.b@c.org": "email",
    }
    around = ("{}", "see {} there", "item 2 {}", "{} PAID NOW", "{} and {}", "x {} 10", "at 10 {}.")
    rows = [(i, j, a.replace("{}", v)) for i, v in enumerate(same) for j, a in enumerate(around)]
    df = spark.createDataFrame([(len(around) * i + j, t) for i, j, t in rows], "doc_id long, text string")
    out = [r for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]
    for i, (v, kind) in enumerate(same.items()):
        own = out[i * len(around) : (i + 1) * len(around)]
        new = own[0].text
        assert new != v and own[0].kinds == [kind], (v, own[0])
        # a phone number has no fixed length: a number right after it belongs to it
        seen = [(r.text, a.replace("{}", new)) for r, a in zip(own, around) if kind != "phone" or a != "x {} 10"]
        assert all(a == b for a, b in seen), (v, seen)
    assert out[10 * len(around)].text[1:] == out[11 * len(around)].text[2:]


@pytest.mark.parametrize(
    "spellings",
    [
        ("+1 708-555-4315", "+17085554315", "1-708-555-4315", "708-555-4315", "(708) 555-4315", "+1 (708) 555 4315", "001 708 555 4315"),
        ("+49 30 12345678", "+493012345678", "0049 30 12345678", "+49-30-1234-5678", "+49 (30) 1234 5678"),
        ("+353 1 234 5678", "+35312345678", "00353 1 234 5678"),
        ("4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"),
        ("BE68 5390 0754 7034", "BE68539007547034"),
    ],
)
def test_a_value_has_one_pseudonym_in_all_spellings(spark, spellings):
    """Also after, before and between other numbers that are nobody's."""
    around = ("{}", "no {} there", "item 2 {}", "at 10 {}.", "7 {}", "{} and 12")
    df = spark.createDataFrame([(len(around) * i + j, a.replace("{}", v)) for i, v in enumerate(spellings) for j, a in enumerate(around)], "doc_id long, text string")
    out = [r.text for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]
    ends = set()
    for i, v in enumerate(spellings):
        new = out[len(around) * i]
        assert new != v and len(new) == len(v)
        assert out[len(around) * i : len(around) * (i + 1)] == [a.replace("{}", new) for a in around], v
        ends.add("".join(c for c in new if c.isalnum())[-8:])
    assert len(ends) == 1


def test_numbers_in_a_row(spark):
    """Each of several values in one candidate gets the pseudonym it has alone; numbers grouped like cards that are none stay."""
    alone = {"0049 30 1234 5678": "phone", "4111 1111 1111 1111": "card", "708-555-4315": "nanp", "2024-02-29": "date", "123-45-6789": "ssn", "+49 30 1234 5678": "phone"}
    rows = [*alone, "+49 30 1234 5678 4111 1111 1111 1111", "4111 1111 1111 1111 0049 30 1234 5678", "12 2024-02-29 123 4567", "2 708-555-4315 12 14", "1 123-45-6789 1234 5", "4660 0581 2041 8123", "4660-0049-2041-8123"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = [r.text for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]
    new = dict(zip(alone, out))
    for text, got in zip(rows, out):
        for v in sorted(alone, key=len, reverse=True):
            text = text.replace(v, new[v])
        assert got == text


def test_dates_are_permuted_within_their_form(spark):
    days = spark.range(40_000, 40_800).select(F.date_add(F.lit("1850-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    for form, keep in (("yyyy-MM-dd", "true"), ("dd/MM/yyyy", "true"), ("MM/dd/yyyy", "day(d) > 12")):
        rows = days.where(keep).select(F.date_format("d", form).alias("text"), F.unix_date("d").alias("doc_id"))
        new = [r.text for r in pii.pseudonymise(rows, "k").where("n_found = 1").collect()]
        assert len(set(new)) == rows.count()
        if form == "MM/dd/yyyy":
            assert all(int(t[3:5]) > 12 and int(t[:2]) <= 12 for t in new)


def test_parts_against_brute_force(spark):
    import brute

    rng = np.random.default_rng(8)
    bits = ["+49 30 1234 5678", "+1 708-555-4315", "1-708-555-4315", "(708) 555-4315", "2024-02-29", "708-555-4315", "4111", "1111", "BE68 5390 0754 7034", "DE89", "3704 0044 0532 0130 00", "A1B2", "12", "31/12/1999", "12/31/1999", "-", "8.8.8.8", "0049 30 12345", "030/1234567", "4111-1111-1111-1111", "x@y.de", "ÉÉ", "PAID", "3782 822463 10005", "123-45-6789"]
    texts = [" ".join(rng.choice(bits, int(rng.integers(1, 12)))) for _ in range(300)] + [None, "", " ".join(["1234"] * 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.pseudonymise(df, "k").collect():
        assert (r.text, list(r.kinds)) == tuple(brute.pseudonyms(texts[r.doc_id], "k")), texts[r.doc_id]


def test_ids_are_those_of_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoding(packing.default_vocabulary())
    rng = np.random.default_rng(0)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endo"] + ["".join(rng.choice(["a", " ", "\n", "<|endoftext|>", "é", "日", "1", "'s"], 40)) for _ in range(300)]
    assert all(plain.encode(t, add_special_tokens=False).ids == fast.encode(t, allowed_special="all") for t in texts)


def test_calibration_scores_labelled_rows_only(spark, monkeypatch):
    """Counted as they are scored; by broadcast or by join the thresholds are the same."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["bad", "good", "so", "it"], 12)), "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(rows[i][1].count("bad") > 3)) for i in range(0, 400, 4)], "doc_id long, toxic int")
    scored, scorer = spark.sparkContext.accumulator(0), toxicity._scorer

    def counting(shared):
        inner = scorer(shared)

        def run(batches):
            def seen():
                for b in batches:
                    scored.add(b.num_rows)
                    yield b

            return inner(seen())

        return run

    monkeypatch.setattr(toxicity, "_scorer", counting)
    nets = []
    for few in (2_000_000, 0):
        monkeypatch.setattr(toxicity, "FEW_IDS", few)
        scored.value = 0
        nets.append(toxicity.train(docs, labels, per_class=10, folds=1, fold=2))
        assert 0 < scored.value <= 100
    assert nets[0].offset == nets[1].offset and nets[0].thresholds == nets[1].thresholds


def test_filters_learn_what_words_alone_do_not_show():
    """Every word comes as often in both classes: only their order tells. Without any
    training no document is told from another."""
    rng = np.random.default_rng(5)
    texts, y = [], []
    for k in range(1200):
        own = [f"w{i}" for i in rng.integers(0, 300, 20)]
        at = int(rng.integers(0, 18))
        own[at : at + 2] = ["bad", "thing"] if k % 2 else ["thing", "bad"]
        texts.append(" ".join(own))
        y.append(float(k % 2))
    part = words.Texts(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]), 0)
    pairs, first = toxicity._tokens(part)
    each, y = [pairs[a:b] for a, b in zip(first, first[1:])], np.array(y)

    def right(epochs):
        net = toxicity.fit(each[:900], y[:900], epochs)
        z = toxicity.logits(net, np.concatenate(each[900:]), np.concatenate([[0], np.cumsum([len(x) for x in each[900:]])]))
        return ((z > np.median(z)) == (y[900:] == 1)).mean()

    assert right(0) < 0.65 and right(12) > 0.9


def test_the_sample_is_bounded(spark, monkeypatch):
    """Repeated rows of an id and long texts don't grow what the driver learns from."""
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, epochs: seen.append(sum(t.nbytes for t in texts)) or fit(texts, labels, epochs))
    rows = [(k, f"text {k % 7} is {'vile' if k % 2 else 'fine'} here " + "so " * (900 * (k % 3))) for k in range(200)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    toxicity.train(docs, labels, most_bytes=200_000)
    assert 0 < seen[0] <= 200_000


def test_many_directions_against_brute_force(spark):
    """50,000 vectors, in clusters and outside them: several directions a table."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(400, 24))
    x = centres[rng.integers(0, 400, 50_000)] + 0.4 * rng.normal(size=(50_000, 24))
    x[::500] = rng.normal(size=(100, 24)) * 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(df, every=500).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 50_000, 500):
        close = unit @ unit[q]
        close[q] = -9
        assert len(found[q]) == 5
        hits += len(set(found[q]) & set(np.argsort(-close)[:5].tolist()))
    assert hits >= 0.9 * 500, hits


def test_lonely_queries_find_all_they_can(spark):
    """One dense cluster, and queries far from it and from each other."""
    rng = np.random.default_rng(1)
    x = np.concatenate([np.eye(16)[:6] * -1.0, np.ones((6000, 16)) + 0.001 * rng.normal(size=(6000, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = neighbours.nearest(df, every=1000).where("query_id = 0").collect()
    assert [r.rank for r in sorted(rows, key=lambda r: r.rank)] == [1, 2, 3, 4, 5] and {r.vec_id for r in rows} == {1, 2, 3, 4, 5}
    few = neighbours.nearest(df.where("vec_id < 4 or vec_id = 1000"), every=1000).collect()
    assert sum(r.query_id == 0 for r in few) == 4 and sum(r.query_id == 1000 for r in few) == 4


def test_an_id_with_several_vectors_is_the_smallest(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [-1.0, 5.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    for part in (df, df.orderBy(F.desc("embedding"))):
        assert {r.vec_id: round(r.score, 6) for r in neighbours.nearest(part).collect()} == {2: round(math.sqrt(0.5), 6), 1: round(-1 / math.sqrt(26), 6)}


def test_equal_rows_with_other_columns_are_taken_alike(spark):
    from ethoframe.llm import mixing

    rows = [(1, "a b c", "s", k) for k in range(40)] + [(2, "d e", "t", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    taken = [sorted(r.extra for r in mixing.take(df.repartition(n, "extra")).collect()) for n in (1, 3)]
    assert taken[0] == taken[1]


def test_multipliers_that_do_not_settle_are_told(spark):
    from ethoframe.llm import mixing

    groups = spark.createDataFrame([("a", 3, 5), ("a", 7, 9)], "source string, size long, n long")
    sources = spark.createDataFrame([("a", 78, 14, 40.0)], "source string, source_size long, n_full long, target double")
    with pytest.raises(RuntimeError, match="settle"):
        mixing.solve(groups, sources, rounds=1)


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    from ethoframe.llm import common

    class Context:
        master = "spark://one:7077"

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session())


def test_frequent_short_lines_in_ten_documents(spark):
    """A block of two lines, each line also alone in an older document."""
    block = ["thirty characters in line one..", "thirty characters in line two.."]
    docs = [(1, block[0]), (2, block[1])] + [(10 + k, f"own {k}\n" + "\n".join(block) + f"\nend {k}") for k in range(10)]
    rows = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [rows[10 + k] for k in range(1, 10)] == [f"own {k}\nend {k}" for k in range(1, 10)]


def test_a_first_holder_out_of_order(spark):
    """Two frequent passages that their first holder has the other way round, and one that
    it has once where others have it twice: later holders have them in order."""
    a, b = "the first of two passages that many documents hold", "the second of two passages that many documents hold"
    docs = [(1, f"top\n{b}\nmiddle\n{a}\nend")] + [(10 + k, f"own {k}\n{a}\nmid {k}\n{b}\nend {k}") for k in range(12)]
    docs += [(40 + k, f"new {k}\n{a}\nmore {k}\n{b}\nthen {k}\n{a}\nlast {k}") for k in range(12)]
    rows = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[1] == docs[0][1] and all(rows[10 + k] == f"own {k}\nmid {k}\nend {k}" for k in range(1, 12))
    assert all(rows[40 + k] == f"new {k}\nmore {k}\nthen {k}\nlast {k}" for k in range(1, 12))


def test_many_first_holders_out_of_order(spark):
    """Two frequent passages that thirty holders have the other way round, whichever lines
    follow, and only the last ones in order."""
    a, b = "the first of two passages that many documents hold", "the second of two passages that many documents hold"
    docs = [(k, f"top {k}\n{b}\nmiddle {k}\n{a}\nend {k}") for k in range(30)] + [(40 + k, f"own {k}\n{a}\nmid {k}\n{b}\nend {k}") for k in range(4)]
    rows = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[0] == docs[0][1] and all(rows[k] == f"top {k}\nmiddle {k}\nend {k}" for k in range(1, 30))
    assert all(rows[40 + k] == f"own {k}\nmid {k}\nend {k}" for k in range(1, 4))


def test_rules_compile_to_one_projection(spark):
    df = quality.quality(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("n", [500, 50_000, 3_000_000, 10**9])
def test_probes_come_likeliest_first(n):
    hashes = neighbours.Hashes(64, n, 1.1, 4, 0.97)
    q = np.random.default_rng(2).normal(size=64)
    q /= np.linalg.norm(q)
    cells = hashes.probes(q, 1)
    assert len({tuple(c) for c in cells}) == len(cells) and cells.shape[1] == hashes.k
    codes = hashes.codes(cells, 1)
    assert len(set(codes.tolist())) == len(cells) and not set(codes) & set(hashes.codes(cells, 2))
    if hashes.k <= 3:
        # against all cells within reach
        cosine = 1 - hashes.sigma**2 / 2
        spread, middle = np.sqrt(1 - cosine**2), (q @ hashes.a[1].T) * cosine
        low = (cells * hashes.width - hashes.b[1] - middle) / spread
        p = np.prod(0.5 * (neighbours._erf((low + hashes.width / spread) / np.sqrt(2)) - neighbours._erf(low / np.sqrt(2))), axis=1)
        assert (np.diff(p) <= 1e-12).all() and p.sum() >= hashes.each


@given(st.lists(st.lists(st.sampled_from([0, 3, 9, 14, 22, 45]), max_size=9), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_runs_cover_every_long_block(docs):
    """The runs that propose pairs, and that they hold each line of any block long enough
    to go (a line long enough by itself proposes on its own)."""
    from ethoframe.llm import lines

    hashes = [[k * 100 + i for i in range(len(d))] for k, d in enumerate(docs)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(docs, pa.list_(pa.int32()))], names=["doc_id", "hashes", "chars"])
    found = {(r["doc_id"], r["line"]) for out in lines._long_runs(40)(iter([batch])) for r in out.to_pylist()}
    wanted = set()
    for k, d in enumerate(docs):
        long = {(a, b) for a in range(len(d)) for b in range(a + 1, len(d) + 1) if sum(d[a:b]) >= 40}
        on = {(a, min(b for x, b in long if x == a)) for a, _ in long}
        up = {(max(a for a, y in long if y == b), b) for _, b in long}
        spans = {(a, b) for a, b in on if d[a]} | {(a, b) for a, b in up if d[b - 1]}
        spans = {(a, b) for a, b in spans if b - a > 1}
        own = words.spans(np.array(hashes[k], np.uint64), np.array([a for a, _ in spans], int), np.array([b for _, b in spans], int)) if spans else np.zeros(0, np.uint64)
        wanted |= {(k, int(h)) for h in own.view(np.int64)}
        for a, b in long:
            inside = [s for s in spans if a <= s[0] and s[1] <= b]
            assert all(d[x] >= 40 or not d[x] or any(s[0] <= x < s[1] for s in inside) for x in range(a, b))
    assert found == wanted


def test_a_short_line_after_a_long_one(spark):
    """The long line is first held by one document, the short one by another: the block
    of both is found by the run up to the short one."""
    from ethoframe.llm.lines import dedup_lines

    long, short = "a long line that many documents have, once in each", "and a short one"
    rows = [(1, f"first\n{long}\nof all"), (2, f"x\n{short}\ny")] + [(i, f"own {i}\n{long}\n{short}\nend {i}") for i in range(3, 13)]
    found = {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 0, 2: 0, 3: 1} | dict.fromkeys(range(4, 13), 2)


def test_links_behind_the_front_of_a_large_bucket():
    """A member that is near to one behind the front, but not to the one before it; and
    what hangs together is the same as by comparing all with all."""
    def trees(marks, limit):
        blobs = pa.array([m.tobytes() for m in marks], pa.binary())
        batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(marks), np.int64)), pa.array(np.arange(len(marks))), blobs], names=["path", "node", "marks"])
        root = np.arange(len(marks))
        for out in jaccard._compare(0.8, limit)(iter([batch.slice(0, 150), batch.slice(150)])):
            for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                root[a] = b
        return root

    front = np.zeros(64, np.uint8)
    cover, far = front.copy(), front.copy()
    cover[:6] = 1
    far[:31] = 1  # 33 tokens of the front, 39 of the member behind it
    rng = np.random.default_rng(5)
    others = rng.integers(2, 250, (140, 64)).astype(np.uint8)
    marks = np.stack([front, cover, *others, far])
    assert list(trees(marks, 1000)[[0, 1, 142]]) == [0, 0, 0]
    assert list(trees(marks, 16)[[0, 1, 142]]) == [0, 0, 0]
    for _ in range(20):
        rows = [rng.integers(0, 3, 64).astype(np.uint8)]
        while len(rows) < 300:
            x = rows[rng.integers(len(rows))].copy()
            at = rng.choice(64, rng.integers(1, 30), replace=False)
            x[at] = rng.integers(0, 60, len(at))
            rows.append(x)
        assert (trees(np.stack(rows), 1000) == trees(np.stack(rows), 16)).all()


def test_an_id_with_two_texts_that_lose_other_lines(spark):
    """What one text loses is no sign that the other text of the id, out of order in its
    first holder, has lost the lines at these places."""
    a, b, c, d = (f"the {x} of four passages that many documents hold" for x in ("first", "second", "third", "last"))
    docs = [(1, f"top\n{b}\nmiddle\n{a}\nend"), (2, f"two\n{c}\nmore"), (3, f"three\n{d}\nmore")]
    docs += [(10 + k, f"own {k}\n{a}\nmid {k}\n{b}\nend {k}") for k in range(12)] + [(21, f"other\n{c}\nmid\n{d}\nlast")]
    rows = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id = 21").collect()
    assert sorted(r.text for r in rows) == ["other\nmid\nlast", "own 11\nmid 11\nend 11"]


def test_training_gives_its_memory_back(spark, monkeypatch):
    """The sample that a fit has used doesn't stay with the driver."""
    calls = []
    monkeypatch.setattr(toxicity, "release", lambda: calls.append(1))
    docs = spark.createDataFrame([(k, "vile" if k % 2 else "fine", k % 2) for k in range(100)], "doc_id long, text string, toxic int")
    toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    assert len(calls) == 2


def test_staging_lets_go_of_old_plans(spark):
    """Handles of plans are cycles; a long chain of steps must not gather them."""
    import gc
    import weakref

    gc.collect()
    gc.disable()
    try:
        old = spark.range(10)
        old.count()
        handle = weakref.ref(old._jdf)
        del old
        common.stage(spark.range(3))
        assert handle() is None
    finally:
        gc.enable()


def test_staging_collects_the_heap_of_the_driver(spark):
    """What the JVM no longer uses doesn't wait until its heap is full."""
    jvm = spark.sparkContext._jvm
    before = _collections(jvm)
    common.stage(spark.range(3))
    assert _collections(jvm) > before


def _collections(jvm) -> int:
    """Whole collections of the driver's heap so far."""
    beans = jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(x.getCollectionCount() for x in beans if "Old" in x.getName() or "MarkSweep" in x.getName())


def _of_many_sizes(spark):
    return spark.createDataFrame([(k, "w " * (k * k % 97), "abc"[k % 3]) for k in range(300)], "doc_id long, text string, source string")


def test_mixing_rarely_collects_the_heap_of_the_driver(spark):
    """A whole collection after each of many short steps makes the heap larger."""
    jvm = spark.sparkContext._jvm
    before = _collections(jvm)
    mixing.take(_of_many_sizes(spark))
    assert 0 < _collections(jvm) - before <= 4


def test_mixing_ends_with_a_short_plan(spark):
    """The copies by group, and those by document, are tables of their own."""
    plan = mixing.take(_of_many_sizes(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") <= 1
