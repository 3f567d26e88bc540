import json

import pytest

from ethoframe.operators import quality
from ethoframe.sources import readers, sinks
from ethoframe.streaming import twins


def test_experiment_trims_headers_and_filters(spark, tmp_path):
    (tmp_path / "e.csv").write_text(" observation_id ,start frame,valid\n3_10_1,5,1\n3_10_2,6,0\n3_10_3,7,\n")
    rows = readers.experiment(spark, str(tmp_path / "e.csv")).collect()
    assert [r.observation_id for r in rows] == ["3_10_1", "3_10_3"] and rows[0].start_frame == 5


def test_bouts_skip_head_and_foot(spark, tmp_path):
    for name in ("a1", "a2"):
        (tmp_path / f"{name}.csv").write_text("x\ny\nz\nBeginning-frame, End-frame,Behavior\n1,5, groom\n7,9,rest\ntotal,2,\n")
    rows = readers.bouts(spark, str(tmp_path)).orderBy("obs", "ord").collect()
    assert [(r.obs, r.ord, r.start_frame, r.end_frame, r.behavior) for r in rows] == [(o, *b) for o in ("a1", "a2") for b in ((0, 1, 5, "groom"), (1, 7, 9, "rest"))]


def test_bouts_go_by_each_files_own_header(spark, tmp_path):
    (tmp_path / "a1.csv").write_text("x\ny\nz\nBeginning-frame, End-frame,Behavior\n1,5,groom\nend,,\n")
    (tmp_path / "a2.csv").write_text('x\ny\nz\nnote,behavior,end frame,Start_frame\n"a, b",rest,9,7\nend,,,\n')
    rows = readers.bouts(spark, str(tmp_path)).orderBy("obs").collect()
    assert [(r.obs, r.start_frame, r.end_frame, r.behavior) for r in rows] == [("a1", 1, 5, "groom"), ("a2", 7, 9, "rest")]
    (tmp_path / "a3.csv").write_text("x\ny\nz\nnote,what\n1,2\nend,\n")
    with pytest.raises(Exception, match="header of a3"):
        readers.bouts(spark, str(tmp_path)).collect()


def test_vectors_that_are_not_finite_are_not_saved(spark, tmp_path):
    for bad in ([1.0, float("nan")], [1.0, None], [0.0, 0.0], [float("inf"), 1.0], None):
        with pytest.raises(ValueError):
            sinks.save_vectors(spark.createDataFrame([([1.0, 2.0],), (bad,)], "x array<double>"), str(tmp_path / "v"))
    sinks.save_vectors(spark.createDataFrame([([1.0, 2.0],)], "x array<double>"), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1


def test_per_observation_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("o1", 1, 0.5), ("o1", 0, 0.25), ("o2", 0, 1.0)], "obs string, frame_idx long, p double")
    sinks.save_per_observation(df, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").glob("obs=*")} == {"obs=o1", "obs=o2"}
    assert spark.read.csv(str(tmp_path / "out"), header=True).where("obs = 'o1'").count() == 2
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "o9.csv").write_text("frame_idx,x\n0,1.5\n")
    assert readers.per_observation(spark, str(tmp_path / "t"), "frame_idx long, x double").first().obs == "o9"


def test_save_ignores_what_is_there(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.save(spark.range(3), path)
    sinks.save(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3
    sinks.save(spark.range(5), path, overwrite=True)
    assert spark.read.parquet(path).count() == 5
    assert readers.vectors(spark, str(tmp_path / "none"), path).count() == 5
    with pytest.raises(FileNotFoundError):
        readers.vectors(spark, str(tmp_path / "none"))


def test_vectors_are_checked(spark, tmp_path):
    df = spark.createDataFrame([([0.0, 0.0],)], "x array<double>")
    with pytest.raises(ValueError):
        sinks.save_vectors(df, str(tmp_path / "v"))


def test_metadata(spark, tmp_path):
    entry = {"extension": "mp4", "n": 2, "fps": 30.0, "duration_min_total": 1.0, "size_MB_total": 2.0}
    (tmp_path / "m.json").write_text(json.dumps({"source": entry, "full": entry | {"n": 3}, "povs": {"blue": entry | {"n": 4}}}))
    assert {r.part: r.n for r in readers.metadata(spark, str(tmp_path / "m.json")).collect()} == {"source": 2, "full": 3, "blue": 4}


def test_domains(spark, tmp_path):
    (tmp_path / "e.csv").write_text("Experiment,Valid,FPS,Video\nb3,1,30,v.mp4\n")
    r = readers.settings(spark, "lettered", str(tmp_path / "e.csv")).first()
    assert (r.batch, r.position, r.annotation_file, r.valid) == (1, 2, "b3.csv", True)
    with pytest.raises(KeyError):
        readers.settings(spark, "birds", "x")


def test_annotation_policy(spark):
    e = spark.createDataFrame([("a", "a.csv"), ("b", "b.csv"), ("c", None)], "obs string, annotation_file string")
    there = spark.createDataFrame([("a.csv",)], "annotation_file string")
    assert {r.obs: r.has_file for r in readers.with_annotation_policy(e, there, "partial").collect()} == {"a": True, "b": False, "c": False}
    assert not any(r.has_file for r in readers.with_annotation_policy(e, there, "no").collect())
    with pytest.raises(Exception, match="missing annotation file"):
        readers.with_annotation_policy(e, there, "yes").collect()


def test_missing_keys(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r.k, r.side) for r in quality.missing_keys(a, b, ("k",)).collect()} == {(1, "left"), (3, "right")}


def test_streamed_marks_carry_state(spark, tmp_path):
    df = spark.createDataFrame([("o", i, float(10 * i), 0.0) for i in range(5)], "obs string, frame_idx long, x double, y double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = twins.run_to_end(spark, str(tmp_path / "in"), df.schema, lambda s: twins.marks(s, 15.0), str(tmp_path / "state"), str(tmp_path / "out"))
    assert [r.mark_x for r in out.orderBy("frame_idx").collect()] == [0, 10, 20, 30, 40]


def test_streamed_raw_marks_are_held(spark, tmp_path):
    rows = [("o", 0, 0.0, 0.0, 5.0, 0.0), ("o", 1, None, None, 60.0, 80.0), ("o", 2, None, None, 61.0, 80.0), ("o", 3, 70.0, 90.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "obs string, frame_idx long, raw_x double, raw_y double, x double, y double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = twins.run_to_end(spark, str(tmp_path / "in"), df.schema, lambda s: twins.marks(s, 100.0), str(tmp_path / "state"), str(tmp_path / "out"))
    assert [(r.mark_x, r.mark_y) for r in out.orderBy("frame_idx").collect()] == [(0, 0), (0, 0), (61, 80), (70, 90)]
