"""Null, empty, very long, repeated and clashing input, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ethoframe.llm import jaccard, lines, mixing, neighbours, packing, pii, quality, scoring, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _words string, size long, node string, copies string, path long, _id long, score double, label string, batch string, key string, lambda string, n_words string, text2 string"
EXTRA = ("u", 7, "n", "c", 3, 9, 0.5, "l", "b", "k", "m", "w", "t")
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
BODY = "the first line of a text that others share too\nanother line with a few more words in it\nand the last line of that text"
ROWS = [
    (None, BODY, "en", "a"), (1, None, "en", "a"), (2, "", None, "b"), (3, " \n\t ", "en", None), (4, LONG, "en", "a"), (5, BODY, "en", "a"),
    (5, BODY, "en", "a"), (6, BODY, None, None), (7, BODY + "\nbut one more", "fr", "b"), (8, "x", "en", "a"), (9, "é 日本   😀 <|endoftext|>", "ja", "c"), (9, "same id, other text", "en", "c"),
]


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark, tmp_path_factory):
    rows = [(*r, len(r[1] or ""), *EXTRA) for r in ROWS] if request.param == "rows" else []
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return df.collect()


def test_mixing(docs):
    rows = rows_of(mixing.mix(docs))
    assert len(rows) == docs.count()
    assert all(r.copies == 0 for r in rows if r.size == 0) and all(r.target is not None for r in rows)
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in rows)


def test_pii(docs):
    out = pii.pseudonymise(docs, "k")
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    assert out.where("n_found <> 0").count() == 0


def test_scoring(docs):
    rows = rows_of(scoring.score(docs))
    assert len(rows) == docs.count() and all(r.score < 0 for r in rows)
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (1, 2, 3))


def test_quality(docs):
    out = quality.quality(docs)
    rows = rows_of(out)
    assert len(rows) == docs.count() and set(docs.columns) <= set(out.columns) and all(isinstance(r.kept, bool) for r in rows)
    assert all(r._words == "u" for r in rows)


def test_substrings(docs, spark):
    rows = rows_of(substrings.remove_repeats(docs, length=10))
    assert len(rows) == docs.count()
    gone = sorted((r.doc_id or -1, r.n_removed) for r in rows)
    if rows:
        # null ids lose nothing; 5 comes first of those with ids; its rows don't judge each other
        assert [n for i, n in gone if i in (-1, 5)] == [0, 0, 0] and dict(gone)[6] == 26
        assert next(r.kept_text for r in rows if r.doc_id == 7) == "but one more"
        assert dict(gone)[4] == 0


def test_jaccard(docs):
    rows = rows_of(jaccard.near_duplicates(docs))
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    if rows:
        assert by[None][0].n_links == 0 and by[None][0].class_id is None
        assert all(r.class_id == 5 and r.n_links == 3 for i in (5, 6, 7) for r in by[i])
        assert by[1][0].n_links == by[2][0].n_links == by[3][0].n_links == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == max(0, docs.count() - 2)


def test_toxicity(docs, spark):
    labels = spark.createDataFrame([(5, 1), (8, 0), (None, 1), (77, 0), (4, None)], "doc_id long, toxic int")
    for given in (labels, labels.where("toxic = 1"), labels.limit(0)):
        net = toxicity.train(docs, given)
        rows = rows_of(toxicity.score(docs, net))
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.keep_clean(docs, net).columns == docs.columns


def test_packing(docs):
    rows = rows_of(packing.pack(docs, digest=True))
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert sum(r.start == 0 for r in rows) == docs.count()
    with pytest.raises(ValueError):
        packing.pack(docs, size=1000)


def test_line_dedup(docs):
    out = lines.dedup_lines(docs)
    rows = rows_of(out)
    assert len(rows) == docs.count() and set(docs.columns) <= set(out.columns)
    by = {(r.doc_id, r.source): r for r in rows}
    if rows:
        assert by[None, "a"].n_removed == 0 and by[5, "a"].n_removed == 0 and by[1, "a"].text is None
        assert by[6, None].text == "" and by[7, "b"].text == "but one more" and by[2, "b"].n_lines == 1


def test_stages(docs, spark, tmp_path):
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(5, 1), (8, 0)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = docs
    for name, make in corpus_pipeline.STAGES:
        before = rows
        rows = make(spark, rows, folder)
        if name != "packing":
            assert rows.columns == before.columns, name
        rows.count()
    assert corpus_pipeline.run(spark, folder).columns == rows.columns


VECTORS = [
    (0, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [2.0, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [float("inf"), 1.0]), (10, [1.0]), (None, [1.0, 1.0]), (11, []), (12, [-0.0, 1.0]), (12, [-0.0, 1.0]), (13, [0.0, 1.0]),
]


def test_neighbours(spark):
    df = spark.createDataFrame([(*v, "x", 1) for v in VECTORS], "vec_id long, embedding array<double>, node string, v int")
    rows = [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(df).orderBy("query_id", "rank").collect()]
    assert [r for r in rows if r[0] == 0][:3] == [(0, 1, 7), (0, 2, 50), (0, 3, 3)]
    assert [r for r in rows if r[0] == 50][:3] == [(50, 1, 0), (50, 2, 7), (50, 3, 3)]
    assert {r[2] for r in rows} <= {0, 50, 7, 3, 12, 13}
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_a_hot_vector_costs_little(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.rand(1), F.rand(2))).alias("embedding"))
    rows = neighbours.nearest(df).where("query_id = 300").orderBy("rank").collect()
    assert [r.vec_id for r in rows] == [0, 3, 6, 9, 12]
