"""Learned effects and probes on data whose answer is known."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethoframe.functions import stats
from ethoframe.operators import learn, meta, resample, search


@pytest.fixture(scope="module")
def trial(spark):
    """The treated are more often high in w, which raises y; the effect is 2."""
    rng = np.random.default_rng(0)
    w = rng.uniform(0, 1, 800)
    t = rng.random(800) < 0.2 + 0.6 * w
    y = 2.0 * t + 3.0 * w + rng.normal(0, 0.3, 800)
    return spark.createDataFrame([(int(i), "b" if a else "a", float(c), float(v)) for i, (a, c, v) in enumerate(zip(t, w, y))], "obs long, T string, W_w double, y double").cache()


@pytest.mark.parametrize("method", ["s_learner", "t_learner", "x_learner", "dr_learner", "aipw_forest"])
def test_learners_find_the_effect(trial, method):
    row = search.estimate(trial, method, "y", "T", "a", "b", ("W_w",)).first()
    plain = search.estimate(trial, "ead", "y", "T", "a", "b").first().ate
    assert row.n == 800 and abs(row.ate - 2) < 0.25 < abs(plain - 2)


def test_probe_is_the_logistic_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(0, 1, 300) > 0).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), float(b)) for i, (v, b) in enumerate(zip(x, y))], "frame_idx long, x array<double>, y double")
    got = {r.frame_idx: r.yhat for r in meta.probe_scores(meta.linear_probe(df, "x", "y", rounds=100), df, "x").collect()}
    # the same penalised loss by Newton steps: Spark penalises standardised weights
    sd = x.std(0, ddof=1)
    z, w = np.column_stack([x / sd, np.ones(300)]), np.zeros(4)
    ridge = np.diag([0.01] * 3 + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T * (p * (1 - p)) @ z / 300 + ridge, z.T @ (p - y) / 300 + ridge @ w)
    assert max(abs(got[i] - v) for i, v in enumerate(1 / (1 + np.exp(-z @ w)))) < 1e-3


@pytest.mark.parametrize("kind", ["variance", "irm"])
def test_invariant_probe_follows_the_slope_of_its_loss(spark, kind):
    rng = np.random.default_rng(2)
    z, e = rng.normal(size=400), rng.integers(0, 3, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-z * (0.5 + e)))).astype(float)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(z, e, y)], "z double, e int, y double")

    def total(w):
        f = w[0] * z + w[1]
        p = 1 / (1 + np.exp(-f))
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p))
        each = [loss[e == k].mean() for k in range(3)]
        differ = np.var(each) if kind == "variance" else np.mean([np.mean(((p - y) * f)[e == k]) ** 2 for k in range(3)])
        return np.mean(each) + differ

    w = np.zeros(2)
    for _ in range(8):
        grad = np.array([(total(w + d) - total(w - d)) / 2e-5 for d in np.eye(2) * 1e-5])
        w = w - grad
    assert np.allclose(meta.invariant_probe(df, ("z",), "y", "e", rounds=8, kind=kind), w, atol=1e-4)


def test_noise_has_the_scale_and_repeats(spark):
    df = spark.range(500).select(F.col("id").alias("frame_idx"), F.array_repeat(F.lit(1.0), 20).alias("x"))
    a, b = (np.array([r.x for r in learn.noisy(df, "x", 0.5, "frame_idx", 3).orderBy("frame_idx").collect()]) for _ in range(2))
    assert (a == b).all() and abs(a.mean() - 1) < 0.02 and abs(a.std() - 0.5) < 0.02


def test_two_passes_fit_all_rows_with_the_best_number(spark):
    df = spark.range(10).select("id", (F.col("id") % 2 == 0).alias("is_val"))
    fits = []
    best, model = meta.two_pass(df, lambda rows, n: fits.append((rows.count(), n)) or n, lambda m, rows: abs(m - 7) + 0 * rows.count(), "is_val", (3, 6, 8, 20))
    assert (best, model) == (6, 6) and fits == [(5, 3), (5, 6), (5, 8), (5, 20), (10, 6)]


def test_a_missing_environment_column_is_told_and_left_out(spark):
    df = spark.createDataFrame([("x",), ("y",)], "T string")
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        assert sorted(r.E for r in learn.encode(df, ("T", "W_none"), "E").collect()) == [0, 1]
    assert any("W_none" in str(w.message) for w in told)


def test_tails():
    assert abs(float(stats.incomplete_beta(np.array([5.0]), np.array([1.0]), np.array([10 / (10 + 2 * 4.103)]))[0]) - 0.05) < 1e-3


def test_suite_p_values(spark, trial):
    rows = search.suite(trial, "y").orderBy("test").collect()
    assert [r.test for r in rows] == ["anova", "welch"] and all(0 <= r.p < 1e-6 for r in rows)
    # of two arms with equal variances, F is the square of t
    assert abs(rows[0].statistic - rows[1].statistic ** 2) < 0.05 * rows[0].statistic
    assert search.suite(trial, "y", control="a").count() == 2


def test_bounds_get_finer(spark):
    rng = np.random.default_rng(6)
    v = rng.uniform(0, 100, 2000)
    df = spark.createDataFrame([(float(x), int(23 <= x <= 61)) for x in v], "v double, y int")
    row = search.two_stage_bounds(df, "v", "y", (0.0, 20.0, 40.0), (40.0, 60.0, 80.0)).first()
    assert abs(row.low - 23) <= 3 and abs(row.high - 61) <= 3 and row.f1 > 0.95


def test_mann_whitney_by_pairs(spark):
    a, b = [1.0, 2.0, 2.0, 5.0, 7.0], [2.0, 3.0, 5.0, 5.0, 9.0, 9.0]
    df = spark.createDataFrame([("x", v) for v in a] + [("y", v) for v in b] + [("x", None)], "T string, y double")
    row = resample.mann_whitney(df, "y", "T", "x", "y").first()
    u = sum((p > q) + 0.5 * (p == q) for p in a for q in b)
    n, ties = 11, sum(k**3 - k for k in (3, 3, 2))
    z = -(abs(u - 15) - 0.5) / np.sqrt(30 / 12 * (12 - ties / (n * (n - 1))))
    assert (row.n0, row.n1, row.u) == (5, 6, u) and abs(row.z - z) < 1e-12 and 0.1 < row.p < 0.5


def test_fits_read_rows_written_aside(spark):
    """What made the rows is not run again in every pass of a fit."""
    rows = spark.range(60).selectExpr("id % 3 as g", "id").groupBy("g", "id").count().selectExpr("id * 1.0d as y", "if(id % 2 = 0, 'a', 'b') as arm", "id as w_x")
    plan = meta._prepared(rows, "y", "arm", "a", "b", ("w_x",))._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan and "Exchange" not in plan and "Aggregate" not in plan
