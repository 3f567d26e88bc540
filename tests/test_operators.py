"""Operators on small inputs with results worked out by hand."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ethoframe.functions import columns as C
from ethoframe.functions import roles, stats
from ethoframe.operators import aggregate, effects, labels, learn, metrics, multiplicity, quality, replicates, resample, tracking, windows

MAPPING = {"y": (1, 0), "b": (0, 1), "both": (1, 1)}


def frames(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.collect()[0]


@pytest.fixture
def small(spark):
    observations = frames(spark, [("o", 6, 12, 6.0)], "obs string, n_frames long, offset long, ratio double")
    bouts = frames(spark, [("o", 0, "y", 18, 30), ("o", 1, "b", 24, 37), ("o", 2, "both", 42, 42), ("o", 3, "?", 0, 99)], "obs string, ord long, behavior string, start_frame long, end_frame long")
    return observations, bouts


@pytest.mark.parametrize("name, step", [("interval_labels_join", "Exchange"), ("ordered_pairs_fill0", "Join")])
def test_frames_are_not_dealt_out(spark, name, step):
    """No frame is shuffled to be labelled, and none joined to be filled."""
    from conftest import DATA
    from ethoframe.plans import catalog

    plan = catalog.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    found = [x for x in plan.splitlines() if step in x]
    assert found and not any("frame_idx" in x for x in found)


def test_counts_of_filled_pairs(spark):
    observations = spark.createDataFrame([(1, 5), (2, 3), (3, 0)], "obs long, n_frames long")
    given = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 4, 0, 1, 2), (1, 2, 1, 0, 0), (1, 3, 2, 0, 1), (2, 0, 1, 2, 1), (2, 1, 1, 2, 1), (2, 2, 1, 2, 1), (2, 2, 5, 2, 1)], "obs long, frame_idx long, agent1 int, agent2 int, label int")
    rows = labels.fill_pairs(labels.frames_of(observations), given, 3).groupBy("obs", "agent1", "agent2", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("frame_idx").alias("frames"))
    found = labels.filled_pair_counts(observations, given, 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.select(found.columns).collect()))


@pytest.mark.parametrize("ratio", [0.4, 1.0, 6.0, 700.0, -3.0, 0.0])
def test_labels_by_bins(spark, ratio):
    """Against plain loops, for frames denser and rarer than bins and spans over several."""
    spans = [(1, 0, 30, 1, 0), (1, 250, 530, 0, 2), (1, 255, 257, 3, 0), (1, 600, 600, 1, 1), (1, 12, 13, None, 5), (2, 5, 6, 1, 1)]
    df = spark.createDataFrame(spans, "obs long, start_frame long, end_frame long, a int, b int")
    observations = spark.createDataFrame([(1, 150, 12.0, ratio), (3, 2, 0.0, ratio)], "obs long, n_frames long, offset double, ratio double")
    wanted = set()
    for obs, n, offset in ((1, 150, 12.0), (3, 2, 0.0)):
        for i in range(n):
            own = [s for s in spans if s[0] == obs and s[1] <= int(offset + i * ratio) < s[2]]
            wanted.add((obs, i, *(max((s[k] for s in own if s[k] is not None), default=0) for k in (3, 4))))
    found = labels.label_by_join(observations, df, ("a", "b")).collect()
    assert {tuple(r) for r in found} == wanted and len(found) == 152


@pytest.mark.parametrize("make", [labels.label_by_join, labels.label_by_expansion])
def test_interval_labels(small, make):
    observations, bouts = small
    known = labels.with_outcomes(bouts, MAPPING, ("Y2F", "B2F"))
    rows = make(observations, known, ("Y2F", "B2F")).orderBy("frame_idx").collect()
    assert [r.Y2F for r in rows] == [0, 1, 1, 0, 0, 0]
    assert [r.B2F for r in rows] == [0, 0, 1, 1, 1, 0]


def test_unknown_behaviours(small):
    assert one(labels.unknown_behaviours(small[1], MAPPING)).behavior == "?"


@settings(max_examples=15, deadline=None)
@given(st.sampled_from([5.9, 6.0, 1.0, 2.5]), st.integers(0, 20), st.lists(st.tuples(st.integers(-5, 80), st.integers(0, 40)), max_size=6))
def test_both_label_forms_agree(spark, ratio, offset, spans):
    observations = frames(spark, [("o", 15, offset, ratio)], "obs string, n_frames long, offset long, ratio double")
    bouts = frames(spark, [("o", i, "y", s, s + n) for i, (s, n) in enumerate(spans)], "obs string, ord long, behavior string, start_frame long, end_frame long")
    known = labels.with_outcomes(bouts, MAPPING, ("Y2F",))
    a, b = (sorted(map(tuple, f(observations, known, ("Y2F",)).collect())) for f in (labels.label_by_join, labels.label_by_expansion))
    assert a == b


def test_pair_labels(spark):
    observations = frames(spark, [("o", 6, 0, 6.0)], "obs string, n_frames long, offset long, ratio double")
    rows = [("o", 0, "nn", 1, 2, 0, 12), ("o", 1, "nt", 2, 1, 6, 18), ("o", 2, "np?", 3, 4, 7, 13), ("o", 3, "nt", 5, 1, 0, 6), ("o", 4, "xx", 1, 2, 0, 6)]
    bouts = frames(spark, rows, "obs string, ord long, behavior string, agent1 int, agent2 int, start_frame long, end_frame long")
    bouts = bouts.where("agent1 between 1 and 4 and agent2 between 1 and 4").withColumns({"agent1": F.col("agent1") - 1, "agent2": F.col("agent2") - 1})
    found = labels.pair_labels(labels.expand_bouts(observations, bouts), {"nn": 2, "np": 2, "np?": 2, "nt": 1}, ("nn",))
    got = sorted((r.frame_idx, r.agent1, r.agent2, r.label) for r in found.collect())
    assert got == [(0, 0, 1, 2), (0, 1, 0, 2), (1, 0, 1, 2), (1, 1, 0, 2), (2, 1, 0, 1), (2, 2, 3, 2)]
    full = labels.fill_pairs(labels.frames_of(observations), found, 4)
    assert full.count() == 6 * 12 and full.where("label > 0").count() == 6


def test_run_lengths(spark):
    rows = [("o", i, *v) for i, v in enumerate([(0, 0), (1, 0), (1, 0), (1, 1), (0, 1), (0, 1), (0, 0)])]
    runs = labels.run_lengths(frames(spark, rows, "obs string, frame_idx long, Y2F int, B2F int"), ("Y2F", "B2F"))
    got = sorted((r.start_frame, r.end_frame, r.Y2F, r.B2F) for r in runs.collect())
    assert got == [(0, 0, 0, 0), (1, 2, 1, 0), (3, 3, 1, 1), (4, 5, 0, 1), (6, 6, 0, 0)]


def test_upsample(spark):
    df = frames(spark, [("o", 0, 0.1, 26), ("o", 1, 0.6, 26), ("o", 3, 0.9, 26)], "obs string, frame_idx long, p double, total int")
    short = {r.source_frame: r.p for r in labels.upsample(df.drop("total"), 6).collect()}
    assert short == {**dict.fromkeys(range(6), 0.1), **dict.fromkeys(range(6, 18), 0.6), **dict.fromkeys(range(18, 24), 0.9)}
    assert max(r.source_frame for r in labels.upsample(df, 6, total="total").collect()) == 25


def test_context(spark):
    df = frames(spark, [("o", i, float(v)) for i, v in enumerate((1, 2, 6))], "obs string, frame_idx long, x double")
    mean = [r.context for r in windows.context_mean(df, "x", 1).orderBy("frame_idx").collect()]
    assert np.allclose(mean, [4 / 3, 3, 14 / 3])
    assert [r.context for r in windows.context_rows(df, "x", 1).orderBy("frame_idx").collect()] == [[1, 1, 2], [1, 2, 6], [2, 6, 6]]
    cut = windows.context_truncated(df, "x", 1).orderBy("frame_idx").collect()
    assert [r.context for r in cut] == [[1, 2], [1, 2, 6], [2, 6]]
    assert [r.context_padding for r in cut] == [[False, False, True], [False] * 3, [False, False, True]]


def test_vector_context(spark):
    df = frames(spark, [("o", i, [float(i), 1.0]) for i in range(4)], "obs string, frame_idx long, x array<double>")
    rows = windows.vector_context_mean(df, "x", 1).orderBy("frame_idx").collect()
    assert np.allclose([r.context[0] for r in rows], [1 / 3, 1, 2, 8 / 3]) and all(math.isclose(r.context[1], 1) for r in rows)
    assert windows.context_concat(df, "x", 1).orderBy("frame_idx").first().context == [0, 1, 0, 1, 1, 1]


@pytest.fixture
def observed(spark):
    rows = [("a", 1, 1, 0.9), ("a", 1, 0, 0.2), ("a", 1, 1, 0.7), ("b", 0, 0, 0.1), ("b", 0, 0, 0.3), ("c", 1, 1, 0.6), ("c", 1, None, 0.4)]
    return aggregate.observation_level(frames(spark, rows, "obs string, T int, Y_y int, Yhat_y double"))


def test_observation_level(observed):
    got = {r.obs: (round(r.Y_y, 6), round(r.Yhat_y, 6), r.has_annotations) for r in observed.collect()}
    assert got == {"a": (0.666667, 0.6, 1), "b": (0.0, 0.2, 1), "c": (1.0, 0.5, 0)}


def test_bias_of_predictions(observed):
    r = one(effects.bias_of_predictions(observed, {"Y_y": "Yhat_y"}))
    assert np.allclose((r.ate_true, r.ate_pred, r.bias), (2 / 3, 0.35, 0.35 - 2 / 3)) and r.ate_true_std is None and r.ate_pred_std is None


def test_difference_in_means(spark):
    df = frames(spark, [("1", v) for v in (0.2, 0.4, 0.6)] + [("0", v) for v in (0.1, 0.3)], "T string, y double")
    r = one(effects.with_p(effects.difference_in_means(df, "y")))
    assert np.allclose((r.ate, r.se, r.t, r.df), (0.2, 0.152753, 2.828427, 4), atol=1e-6) and abs(r.p - 0.02371) < 1e-5


def test_multiplicity(spark):
    df = frames(spark, [(i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.20))], "id int, p double")
    assert np.allclose([r.p_holm for r in multiplicity.holm(df).orderBy("id").collect()], [0.04, 0.09, 0.09, 0.20])
    assert np.allclose([r.q for r in multiplicity.benjamini_hochberg(df).orderBy("id").collect()], [0.04, 0.16 / 3, 0.16 / 3, 0.20])


def test_rater_agreement(spark):
    rows = [("v", i, r, y) for r, ys in (("a", (1, 1, 0, 0, 1)), ("b", (1, 0, 0, 0, 1))) for i, y in enumerate(ys)]
    r = one(metrics.rater_agreement(frames(spark, rows, "video string, frame_idx int, rater string, y int")))
    assert np.allclose((r.ba_12, r.ba_21, r.ia_ba), 5 / 6) and abs(r.kappa - 0.615385) < 1e-6 and abs(r.disagree_pos - 1 / 3) < 1e-9


def test_bounds(spark):
    df = frames(spark, [(1 / 3,), (0.5,)], "p double").select(C.noise_bound(F.col("p")).alias("b"))
    assert [None if r.b is None else round(r.b, 6) for r in df.collect()] == [0.788675, None]
    shares = frames(spark, [("a", 0.75), ("b", 0.25)], "rater string, share double")
    agreement = frames(spark, [("a", "b", 0.9)], "a string, b string, ia_ba double")
    assert abs(one(metrics.mixed_bound(shares, agreement)).bound - 0.9625) < 1e-9


def test_derm_weights(spark):
    df = frames(spark, list(zip((0, 0, 0, 1, 1), (0, 1, 1, 0, 0), range(5))), "E int, Y int, i int")
    got = [r.weight for r in learn.derm_weights(df, "Y", "E").orderBy("i").collect()]
    assert np.allclose(got, [2.5, 1.25, 1.25, 0, 0])


def test_env_ids_are_in_string_order(spark):
    df = frames(spark, [("10", 0), ("2", 1), ("10", 2)], "W string, i int")
    assert [r.E for r in learn.encode(df, ("W",), "E").orderBy("i").collect()] == [0, 1, 0]


def test_min_gap(spark):
    df = frames(spark, [("o", i) for i in (1, 3, 6, 10, 11)], "obs string, frame_idx long")
    assert sorted(r.frame_idx for r in resample.min_gap(df, 5).collect()) == [1, 6, 11]


def test_leash(spark):
    df = frames(spark, [("o", 0, 0.0, 0.0, 0.0, 0.0), ("o", 1, 60.0, 80.0, None, None), ("o", 2, 61.0, 80.0, None, None), ("o", 3, 0.0, 0.0, 70.0, 90.0)], "obs string, frame_idx long, x double, y double, raw_x double, raw_y double")
    got = [(r.mark_x, r.mark_y) for r in tracking.leash(df, 100.0).orderBy("frame_idx").collect()]
    assert got == [(0, 0), (0, 0), (61, 80), (70, 90)]


def test_proximity(spark):
    rows = [(1, 0.0, 500.0), (0, 0.0, 0.0), (2, 79.0, 80.0)]
    df = frames(spark, rows, "n_blobs int, blue_x double, yellow_x double").withColumns({c: F.lit(0.0) for c in ("focal_x", "focal_y", "blue_y", "yellow_y")})
    assert [(r.B2F, r.Y2F) for r in tracking.with_proximity(df, 80.0).collect()] == [(1, 1), (0, 0), (1, 0)]


def test_tracking_keeps_identities(spark):
    rows = [("o", t, [0.0 + t, 100.0, 200.0][:: 1 if t % 2 else -1], [0.0, 0.0 + t, 0.0][:: 1 if t % 2 else -1]) for t in range(6)]
    df = frames(spark, rows, "obs string, frame_idx long, xs array<double>, ys array<double>")
    got = tracking.track(df).orderBy("animal", "frame_idx").collect()
    for animal in ("blue", "yellow", "focal"):
        xs = [r.x for r in got if r.animal == animal]
        assert len(xs) == 6 and max(xs) - min(xs) <= 5


def test_t_distribution():
    assert abs(stats.t_cdf_array(np.array([2.0]), np.array([13.0]))[0] - 0.96658) < 1e-5
    assert abs(stats.t_quantile(0.975, 13) - 2.16037) < 1e-5
    t = np.linspace(-6, 6, 41)
    assert np.allclose(stats.t_cdf_array(t, np.full(41, 1.0)), 0.5 + np.arctan(t) / np.pi)


@pytest.mark.parametrize("by", [(), ("g",)])
def test_average_ranks(spark, by):
    values = [3.0, 1.0, 2.0, 2.0, None, 5.0, 2.0]
    df = frames(spark, [(1, i, v) for i, v in enumerate(values)], "g int, i int, v double")
    got = {r.i: r.r for r in stats.with_average_rank(df, "v", "r", by).collect()}
    assert got == {0: 5.0, 1: 1.0, 2: 3.0, 3: 3.0, 4: None, 5: 6.0, 6: 3.0}


def test_permutation_finds_an_effect(spark):
    df = frames(spark, [(i, "ab"[i % 2], float(i % 2) + (i * 7 % 11) / 20) for i in range(60)], "obs int, T string, y double")
    assert one(resample.permutation_anova(df, "y", "obs", "T", 99, 1)).p <= 0.02
    same = df.withColumn("y", (F.col("obs") * 7 % 11) / 20.0)
    assert one(resample.permutation_anova(same, "y", "obs", "T", 99, 1)).p > 0.05


def test_blocked_permutation_stays_in_blocks(spark):
    df = frames(spark, [(i, "ab"[i % 2], i // 10) for i in range(40)], "obs int, T string, block int")
    out = resample.permuted(df, "obs", "T", 3, 5, ("block",))
    counts = out.groupBy("_rep", "block", "T").count().collect()
    assert len(counts) == 3 * 4 * 2 and all(r["count"] == 5 for r in counts)
    assert out.join(df.withColumnRenamed("T", "T0"), ["obs", "block"]).where("T <> T0").count() > 0


def one_by_one(rows, n, seed, by):
    """Deals and draws of each replicate, sorted one by one."""
    import hashlib

    from ethoframe.operators.replicates import POISSON

    def mix(h):
        for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ (h >> shift)) * times % (1 << 32)
        return h

    dealt, drawn = {}, {}
    for rep in range(1, n + 1):
        keyed = []
        for unit, arm, block, y in rows:
            d = hashlib.md5(f"{seed}|{unit}".encode()).hexdigest()
            a, b = int(d[:8], 16), int(d[8:16], 16)
            h = mix(mix((a + mix(rep)) % (1 << 32)) ^ b)
            keyed.append((block if by else 0, h, a, arm, y))
            k = sum(h >= int(p * (1 << 32)) for p in POISSON)
            if y is not None:
                drawn.setdefault((rep, arm), []).extend([y] * k)
        for block in {k[0] for k in keyed}:
            own = sorted(k for k in keyed if k[0] == block)
            for arm, k in zip(sorted(k[3] for k in own), own):
                if k[4] is not None:
                    dealt.setdefault((rep, arm), []).append(k[4])
    return dealt, drawn


@pytest.mark.parametrize("by", [(), ("block",)])
def test_packed_replicates_are_those_dealt_one_by_one(spark, monkeypatch, by):
    monkeypatch.setattr(replicates, "AT_ONCE", 70)  # two jobs, the second with one chunk and a part
    rows = [(i, "abc"[i * i % 3], i % 4, None if i % 9 == 5 else float(i % 7)) for i in range(200)]
    df = frames(spark, rows, "obs int, T string, block int, y double").repartition(3)
    dealt, drawn = one_by_one(rows, 100, 5, by)
    got = {(r._rep, r["T"]): (r.n, r.s, r.q) for r in replicates.permuted_sums(df, "y", "obs", "T", 100, 5, by).where("n > 0").collect()}
    assert got == {k: (len(v), sum(v), sum(x * x for x in v)) for k, v in dealt.items()}
    if not by:
        got = {(r._rep, r["T"]): (r.n, r.s) for r in replicates.bootstrap_sums(df, "y", "obs", "T", 100, 5).collect()}
        assert got == {k: (len(v), sum(v)) for k, v in drawn.items() if v}
    assert replicates.permuted_sums(df.limit(0), "y", "obs", "T", 10).count() == 0 == replicates.bootstrap_sums(df.limit(0), "y", "obs", "T", 10).count()


def test_hash_rank_is_a_permutation(spark):
    ranks = sorted(r._k for r in resample.with_hash_rank(frames(spark, [(i,) for i in range(500)], "u int"), "u", 3).collect())
    assert ranks == list(range(1, 501))


def test_concat_numbers_environments_on(spark):
    a = frames(spark, [("x", 0, "t", 1.0, 2.0, 0.5)], "obs string, E int, T string, W_a double, Y_y double, Yhat_y double")
    b = frames(spark, [("x", 1, "t", 9.0, 3.0, 0.5)], "obs string, E int, T string, W_z double, Y_y double, Yhat_y double")
    got = {r.obs: (r.E, r.W_a) for r in learn.concat([a, b]).collect()}
    assert got == {"ds0_x": (0, 1.0), "ds1_x": (2, 0.0)}
    with pytest.raises(ValueError):
        learn.concat([a, b.drop("Y_y")])


def test_roles(spark):
    df = frames(spark, [(1, 2, 3, 4, 5)], "Y_b int, obs int, W_z int, Yhat_a int, W_a int")
    assert roles.in_order(df, ("obs",)).columns == ["obs", "W_a", "W_z", "Y_b", "Yhat_a"]
    assert roles.find_column(["Beginning-frame", "x"], "beginning_frame") == "Beginning-frame"
    with pytest.raises(KeyError):
        roles.find_column(["x"], "y")


def test_scalars(spark):
    df = frames(spark, [("30000/1001", "d/frame_000012.jpg", "wt_l1_m_7_soc_p1", 3725.9)], "f string, p string, o string, s double")
    r = one(df.select(C.fraction(F.col("f")).alias("f"), C.frame_of_file(F.col("p")).alias("i"), C.pool_of(F.col("o")).alias("o"), C.clock(F.col("s")).alias("s"), C.stem(F.col("p")).alias("t")))
    assert abs(r.f - 29.97003) < 1e-5 and (r.i, r.o, r.s, r.t) == (12, "l1_m_7", "01:02:05", "frame_000012")


def test_staged_search_reuses_known_runs():
    from ethoframe.operators import search

    ran = []

    def run(setting):
        ran.append(setting)
        return -abs(setting["a"] - 2) - abs(setting["b"] - 5)

    best, runs = search.staged([("a", (1, 2, 3)), ("b", (4, 5))], {"a": 1, "b": 4}, run, {(("a", 3), ("b", 4)): -2})
    assert best == {"a": 2, "b": 5} and len(runs) == 5 and len(ran) == 3
    assert search.merged({"x": {"a": 1, "b": 2}}, {"x": {"b": 3}}) == {"x": {"a": 1, "b": 3}}


def test_unknown_estimator_and_absent_arm(spark):
    from ethoframe.operators import search

    df = frames(spark, [(1, 0.5), (1, 0.7)], "T int, y double")
    assert search.estimate(df, "ead", "y", "T", 0, 1).count() == 0
    with pytest.raises(ValueError):
        search.estimate(df, "guess", "y", "T", 0, 1)


def test_learned_effects_find_a_known_one(spark):
    from ethoframe.operators import meta

    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, 600)
    t = (rng.uniform(0, 1, 600) < 0.3 + 0.4 * x).astype(int)
    y = 2 * x + 1.5 * t + rng.normal(0, 0.1, 600)
    df = frames(spark, list(zip(map(str, t.tolist()), x.tolist(), y.tolist())), "T string, W_x double, y double")
    for make in (meta.t_learner, meta.dr_learner, meta.aipw_forest):
        assert abs(one(make(df, "y", "T", "0", "1", ("W_x",))).ate - 1.5) < 0.25, make.__name__


def test_weighted_probe_separates(spark):
    from ethoframe.operators import meta

    rows = [([float(i % 2), float(i % 3)], i % 2, 1.0) for i in range(60)]
    df = frames(spark, rows, "x array<double>, y int, w double")
    scored = meta.probe_scores(meta.linear_probe(df, "x", "y", "w"), df, "x").collect()
    assert all((r.yhat > 0.5) == (r.y == 1) for r in scored)


@pytest.mark.parametrize("by", [(), ("family",)])
def test_corrections_of_many_tests(spark, by):
    """Against sorting in one place: ties, a hot value, families, and no p-value."""
    rng = np.random.default_rng(8)
    ps = np.where(rng.random(900) < 0.3, 0.02, np.round(rng.random(900) ** 3, 3)).tolist()
    rows = [(i, None if i % 11 == 0 else 0, None if i % 17 == 0 else p) for i, p in enumerate(ps)]
    rows = [(i, f if i % 3 else 1, p) for i, f, p in rows]
    df = spark.createDataFrame(rows, "id int, family int, p double")
    wanted = {}
    for family in {f for _, f, _ in rows} if by else {0}:
        own = sorted((p, i) for i, f, p in rows if p is not None and (not by or f == family))
        n, top, least = len(own), 0.0, 1.0
        for k, (p, i) in enumerate(own):
            top = max(top, (n - k) * p)
            wanted[i] = [min(1.0, top), 0.0]
        for k in range(n - 1, -1, -1):
            least = min(least, n * own[k][0] / (k + 1))
            wanted[own[k][1]][1] = least
    found = multiplicity.benjamini_hochberg(multiplicity.holm(df, by=by), by=by).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.id in wanted:
            assert np.allclose([r.p_holm, r.q], wanted[r.id], rtol=1e-12)
        else:
            assert r.p is None and r.p_holm is None and r.q is None


def test_columns_by_suffix(spark):
    assert roles.without_suffix(spark.sql("select 1 a, 2 b_OL, 3 c_OL"), "OL").columns == ["a"]


def test_recordings(spark):
    seen = spark.createDataFrame([("a", 0, 300), ("b", 0, 300), ("c", 0, 300), ("d", 30, 300), ("e", None, 3)], "obs string, start_frame long, end_frame long")
    files = spark.createDataFrame([("a", 5.0, 52), ("b", 4.0, 40), ("c", 5.0, 49), ("e", 0.0, 9)], "obs string, fps double, frames long")
    rows = {r.obs: (r.expected, r.actual, r.status) for r in quality.recordings(seen, files, 5, 30).collect()}
    assert rows == {"a": (10, 10, "ok"), "b": (10, 10, "fps"), "c": (10, 9, "duration"), "d": (9, None, "missing"), "e": (None, 0, "fps")}
