"""Matrices in files, tables kept by fingerprint, and networks kept by setting."""

import time
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethoframe.operators import networks as N
from ethoframe.operators import training as T
from ethoframe.operators import relate, versions
from ethoframe.sources import npy, readers, resolver, staging


def test_matrices_are_read_in_ranges(spark, tmp_path):
    a, b = np.arange(70, dtype=np.float32).reshape(10, 7), np.arange(700, 742, dtype=np.float32).reshape(6, 7)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", b)
    df = npy.matrices(spark, str(tmp_path), rows_each=4)
    assert df.rdd.getNumPartitions() == 5
    rows = sorted((r.file[-5:], r.row, r.vector) for r in df.collect())
    assert rows == [("a.npy", i, v.tolist()) for i, v in enumerate(a)] + [("b.npy", i, v.tolist()) for i, v in enumerate(b)]
    for push in ("false", "true"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", push)
        few = npy.matrices(spark, str(tmp_path), rows_each=4).where("row between 5 and 6")
        assert few.rdd.getNumPartitions() == (5 if push == "false" else 2) and few.count() == 3
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_task_reads_its_slice_only(tmp_path):
    np.save(tmp_path / "a.npy", np.arange(40.0).reshape(20, 2))
    reader = npy.NarrowedReader(str(tmp_path / "a.npy"), 6)
    parts = reader.partitions()
    assert [(p.start, p.end) for p in parts] == [(0, 6), (6, 12), (12, 18), (18, 20)]
    assert [b.column(1).to_pylist() for b in reader.read(parts[3])] == [[18, 19]] and next(reader.read(parts[3])).column(2).to_pylist() == [[36, 37], [38, 39]]
    list(reader.pushFilters([npy.GreaterThan(("row",), 10), npy.LessThanOrEqual(("row",), 13), npy.EqualTo(("file",), 1)]))
    assert [(p.start, p.end) for p in reader.partitions()] == [(11, 14)]


@pytest.mark.parametrize("dtype", ["f2", "f8", "i2", "i8", ">f4"])
def test_types_of_numbers(spark, tmp_path, dtype):
    np.save(tmp_path / "a.npy", np.arange(6).reshape(3, 2).astype(dtype))
    assert [r.vector for r in npy.matrices(spark, str(tmp_path)).orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]


@pytest.mark.parametrize(
    "made, message",
    [
        (np.array([{"a": 1}], dtype=object), "not numbers"), (np.array(["x"]), "not numbers"), (np.zeros((2, 2), dtype=complex), "not numbers"),
        (np.asfortranarray(np.ones((2, 3))), "row order"), (np.zeros((2, 2, 2)), "no matrix"),
    ],
)
def test_what_is_no_matrix_is_refused(tmp_path, made, message):
    np.save(tmp_path / "a.npy", made, allow_pickle=True)
    with pytest.raises(ValueError, match=message):
        npy.header(str(tmp_path / "a.npy"))


def test_broken_and_missing_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.ones((50, 4)))
    whole = (tmp_path / "a.npy").read_bytes()
    (tmp_path / "short.npy").write_bytes(whole[:-8])
    (tmp_path / "text.npy").write_text("nothing of the kind")
    for name, message in (("short.npy", "shorter"), ("text.npy", "no .npy")):
        with pytest.raises(ValueError, match=message):
            npy.header(str(tmp_path / name))
    spark.createDataFrame([(1, [1.0])], "frame_idx long, x array<double>").write.parquet(str(tmp_path / "p"))
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        df = readers.vectors(spark, str(tmp_path / "none.npy"), str(tmp_path / "text.npy"), str(tmp_path / "p"))
    assert df.columns == ["frame_idx", "x"] and any("passed over" in str(w.message) for w in told)
    assert readers.vectors(spark, str(tmp_path / "none"), str(tmp_path / "a.npy"), str(tmp_path / "p")).count() == 50
    with pytest.raises(FileNotFoundError):
        readers.vectors(spark, str(tmp_path / "none.npy"), str(tmp_path / "none"))
    other = tmp_path / "two"
    other.mkdir()
    np.save(other / "a.npy", np.ones((2, 3)))
    np.save(other / "b.npy", np.ones((2, 4)))
    with pytest.raises(ValueError, match="rows of 4"):
        npy.NpyReader(str(other), 10).partitions()
    (tmp_path / "empty").mkdir()
    assert npy.matrices(spark, str(tmp_path / "empty")).count() == 0


def test_availability_by_version(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.ones((3, 2)))
    (tmp_path / "b.npy").write_text("broken")
    spark.range(2).write.parquet(str(tmp_path / "whole"))
    spark.range(2).write.parquet(str(tmp_path / "part"))
    staging.remove(spark, str(tmp_path / "part" / "_SUCCESS"))
    paths = {v: str(tmp_path / p) for v, p in {"v1": "a.npy", "v2": "b.npy", "v3": "whole", "v4": "part", "v5": "none", "v6": "none.npy"}.items()}
    got = {r.version: r.available for r in readers.availability(spark, paths).collect()}
    assert got == {"v1": True, "v2": False, "v3": True, "v4": False, "v5": False, "v6": False}


def test_distinct_lists(spark):
    df = spark.createDataFrame([("b", 1), ("a", None), (None, 1)], "gene string, sex int")
    assert readers.distinct_lists(df, "gene", "sex", "line").first().asDict() == {"gene": ["a", "b"], "sex": ["1"], "line": []}
    assert readers.distinct_lists(df.limit(0), "gene", "line").first().asDict() == {"gene": [], "line": []}


def test_work_states_and_positions(spark):
    exps = spark.createDataFrame([("e1", "a.mp4"), ("e2", " "), ("e3", None)], "obs string, video string")
    done, failed = spark.createDataFrame([("e1", "blue")], "obs string, animal string"), spark.createDataFrame([("e1", "blue"), ("e1", "yellow")], "obs string, animal string")
    got = sorted(map(tuple, relate.work_states(exps, ("blue", "yellow", "red"), done, failed).collect()))
    assert got == [("e1", "blue", "done"), ("e1", "red", "open"), ("e1", "yellow", "failed")]
    frames = spark.createDataFrame([("o", 0), ("o", 1), ("o", 2)], "obs string, frame_idx int")
    seen = spark.createDataFrame([("o", 0, "blue", 3.9, -2.9), ("o", 0, "blue", 1.5, 7.0), ("o", 1, "red", 1.0, 1.0), ("o", 2, "blue", None, 1.0)], "obs string, frame_idx int, animal string, x double, y double")
    got = [tuple(r)[1:] for r in relate.positions(frames, seen, "blue", (9, 8)).orderBy("frame_idx").collect()]
    assert got == [(0, 1, 7, True), (1, 9, 8, False), (2, 9, 8, False)]


def test_a_table_is_made_once_and_anew_when_its_inputs_change(spark, tmp_path):
    source, folder = tmp_path / "in", f"file://{tmp_path}/kept"
    source.mkdir()
    (source / "a.csv").write_text("1\n2\n")
    made = []

    def make():
        made.append(1)
        return spark.read.csv(str(source), schema="v int")

    def get(**settings):
        return sorted(r.v for r in resolver.resolved(spark, folder, "t", (str(source),), make, settings).collect())

    assert get() == get() == [1, 2] and len(made) == 1
    (source / "b.csv").write_text("3\n")
    assert get() == [1, 2, 3] and len(made) == 2
    time.sleep(0.01)
    (source / "a.csv").write_text("7\n8\n")
    assert get() == [3, 7, 8] and len(made) == 3
    assert get(x=1) == [3, 7, 8] and len(made) == 4 and get(x=1) and len(made) == 4
    assert len([f for f in staging.folders(spark, f"{folder}/t") if f.startswith("v-")]) == 1


def test_a_broken_write_is_never_read(spark, tmp_path):
    folder = f"file://{tmp_path}/kept"

    def broken():
        return spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("v"))

    with pytest.raises(Exception, match="no"):
        resolver.resolved(spark, folder, "t", (), broken)
    assert staging.folders(spark, f"{folder}/t") == []
    # a folder without a success mark, as a lost driver may leave, is made anew
    target = f"{folder}/t/v-{resolver.fingerprint(spark, ())}"
    spark.range(1).write.parquet(target)
    staging.remove(spark, f"{target}/_SUCCESS")
    assert resolver.resolved(spark, folder, "t", (), lambda: spark.range(5)).count() == 5
    missing, there = resolver.fingerprint(spark, (str(tmp_path / "x"),)), tmp_path / "x"
    there.mkdir()
    assert resolver.fingerprint(spark, (str(there),)) != missing


def test_the_first_of_two_writers_wins(spark, tmp_path):
    folder = f"file://{tmp_path}/kept"

    def make():
        # meanwhile another one finishes
        spark.range(7).write.parquet(f"{folder}/t/v-{resolver.fingerprint(spark, ())}")
        return spark.range(5)

    assert resolver.resolved(spark, folder, "t", (), make).count() == 7
    assert [f[:2] for f in staging.folders(spark, f"{folder}/t")] == ["v-"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    data = [(i, v.tolist(), [float(b)], i % 3 == 0) for i, (v, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "unit long, x array<double>, y array<double>, is_val boolean").cache()


STAGES = [("hidden", (2, 6)), ("rate", (0.01, 0.1))]


def build(setting):
    return N.Fused(3, setting["hidden"], 1), T.Settings(epochs=2, batches=1, rate=setting["rate"])


def test_a_stopped_search_gives_the_same_best(spark, rows, tmp_path):
    start = {"hidden": 2, "rate": 0.01}
    whole = versions.resumed_search(spark, f"file://{tmp_path}/a", STAGES, start, build, rows)
    folder = f"file://{tmp_path}/b"
    with pytest.raises(RuntimeError, match="after 2"):
        versions.resumed_search(spark, folder, STAGES, start, build, rows, most=2)
    assert versions.runs(spark, folder).count() == 2
    again = versions.resumed_search(spark, folder, STAGES, start, build, rows, most=1)  # of three settings two are there
    assert again == whole and versions.runs(spark, folder).count() == 3
    assert versions.resumed_search(spark, folder, STAGES, start, build, rows, most=0) == whole
    with pytest.raises(RuntimeError):
        versions.resumed_search(spark, folder, STAGES, start, build, rows, data="others", most=0)


def test_warm_starts_begin_where_the_kept_network_is(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/w"
    net = N.Fused(3, 2, 1)
    w = net.initial(9)
    versions.save(spark, folder, "before", net, w, {"score": 0.5})
    versions.save(spark, folder, "before", net, net.initial(1), {"score": 0.9})  # the first one stays
    found, note = versions.load(spark, folder, "before", net)
    assert note == {"score": 0.5} and all((found[k] == w[k]).all() for k in w)
    assert versions.load(spark, folder, "none", net) is None
    begun = []
    versions.resumed_search(spark, folder, STAGES[1:], {"hidden": 2, "rate": 0.01}, build, rows, first=lambda s: begun.append(s) or found)
    assert [s["rate"] for s in begun] == [0.01, 0.1]
    still = T.fit(rows, net, T.Settings(epochs=1, batches=1, rate=0.0), found)
    assert all(np.allclose(still.last[k], w[k]) for k in w)


def test_a_chain_goes_on_from_version_to_version(spark, rows, tmp_path):
    folder, net, how = f"file://{tmp_path}/c", N.Fused(3, 4, 1), T.Settings(epochs=3, batches=1, rate=0.05)
    later = rows.withColumn("x", F.transform("x", lambda v: v * 2))
    one = versions.chain(spark, folder, [("v1", rows)], net, how)
    both = versions.chain(spark, folder, [("v1", rows), ("v2", later)], net, how)
    assert [r["resumed"] for r in one + both] == [False, True, False] and both[1]["parent"] == both[0]["key"] == one[0]["key"]
    assert versions.lineage(spark, folder, both[1]["key"], net) == ["v1", "v2"]
    # the second version by hand, from the first one's parameters
    first, _ = versions.load(spark, folder, both[0]["key"], net)
    epochs = T.fit(later, net, how, first).best_epoch
    hand = T.fit(later.withColumn("is_val", F.lit(False)), net, T.Settings(epochs=epochs, batches=1, rate=0.05), first)
    got, note = versions.load(spark, folder, both[1]["key"], net)
    assert note["epochs"] == epochs and all(np.allclose(got[k], hand.last[k]) for k in got)
    assert versions.chain(spark, folder, [("v2", later)], net, how)[0]["key"] != both[1]["key"]  # another parent
