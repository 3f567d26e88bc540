"""Networks against plain loops and differences; training against known answers and its rules."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ethoframe.operators import networks as N
from ethoframe.operators import training as T

PAD = np.arange(5) >= np.array([5, 3, 1, 4, 2, 5])[:, None]
FRAMES = np.random.default_rng(0).normal(size=(6, 5, 8))
PLAIN = FRAMES[:, 0]
CASES = [
    (N.Fused(8, 5, 2, 2, 2), {"x": PLAIN}), (N.Fused(8, 5, 0, 1), {"x": PLAIN}), (N.Fused(8, 5, 1, 1, 2, 5, 3), {"x": FRAMES}),
    (N.Twin(8, 5, 1, 1), {"x": PLAIN}), (N.Twin(8, 5, 2, 1, False), {"x": PLAIN}), (N.Twin(8, 5, 1, 1, True, 5, 3), {"x": FRAMES}), (N.Twin(8, 5, 1, 1, False, 5, 3), {"x": FRAMES}),
    (N.Pairs(8, 2, 5), {"x": np.where(PAD[..., None], 0, FRAMES), "pad": PAD, "a1": np.array([0, 1, 2, 3, 0, 1]), "a2": np.array([1, 0, 3, 2, 2, 3])}),
]


def some(network, seed=1):
    rng = np.random.default_rng(seed)
    return {k: v + rng.normal(0, 0.1, v.shape) for k, v in network.initial(seed).items()}


def slopes(f, at):
    return np.array([(f(at + d) - f(at - d)) / 2e-6 for d in np.eye(len(at)) * 1e-6])


@pytest.mark.parametrize("k", range(len(CASES)))
def test_backward_is_the_slope_of_forward(k):
    net, batch = CASES[k]
    w = some(net)
    z, keep = net.forward(w, batch)
    up = np.random.default_rng(2).normal(size=z.shape)
    got = net.flat(net.backward(w, keep, up))
    assert np.allclose(got, slopes(lambda v: (net.forward(net.shaped(v), batch)[0] * up).sum(), net.flat(w)), atol=1e-7)


def by_loops(net, w, frames, a1, a2):
    """Attention as its words say, one number at a time."""
    size = net.dims // net.heads
    got = []
    for a in (a1, a2):
        q, mixed = w["agents.e"][a] @ w["ask.w"] + w["ask.b"], []
        for h in range(net.heads):
            own = slice(h * size, (h + 1) * size)
            z = [sum(q[own][i] * (f @ w["key.w"] + w["key.b"])[own][i] for i in range(size)) / size**0.5 for f in frames]
            e = [np.exp(v) for v in z]
            for i in range(size):
                mixed.append(sum(p / sum(e) * (f @ w["value.w"] + w["value.b"])[own][i] for p, f in zip(e, frames)))
        got.append(np.array(mixed) @ w["out.w"] + w["out.b"])
    h = np.maximum(np.concatenate(got) @ w["hidden.w"] + w["hidden.b"], 0)
    z = h @ w["head.w"] + w["head.b"]
    return np.exp(z) / np.exp(z).sum()


def test_pairs_of_windows_by_loops(spark):
    """Windows of one to five frames, in one column, against loops; all pairs at once or one by one."""
    net = N.Pairs(8, 2, 5)
    w = some(net)
    rows = [(i, FRAMES[i, : 5 - PAD[i].sum()].tolist(), i % 4, (i + 1) % 4) for i in range(6)]
    df = spark.createDataFrame(rows, "i int, x array<array<double>>, a1 int, a2 int")
    one = {r.i: r.p for r in df.select("i", N.scorer(net, w)("x", "a1", "a2").alias("p")).collect()}
    every = {(r.i, r.a1, r.a2): (r.none, r.nt, r.nn) for r in N.pair_scores(df.select("i", "x"), net, w, "x").collect()}
    assert len(every) == 6 * 12
    for i, frames, a1, a2 in rows:
        expected = by_loops(net, w, [np.array(f) for f in frames], a1, a2)
        assert np.allclose(one[i], expected, atol=1e-9) and np.allclose(every[i, a1, a2], expected, atol=1e-9)


def test_a_window_without_frames_and_no_rows(spark):
    net = N.Pairs(8, 2, 5)
    w = some(net)
    df = spark.createDataFrame([(1, [], 0, 1), (2, None, 0, 1), (3, [[0.5] * 8], 0, 1)], "i int, x array<array<double>>, a1 int, a2 int")
    p = {r.i: r.p for r in df.select("i", N.scorer(net, w)("x", "a1", "a2").alias("p")).collect()}
    assert p[1] == p[2] != p[3] and all(abs(sum(v) - 1) < 1e-12 for v in p.values())
    assert df.limit(0).select(N.scorer(net, w)("x", "a1", "a2")).count() == 0


def test_distances_pass_by_the_trunk():
    """Late fusion: the slope in a distance is its weight in the head, whatever the rest."""
    net = N.Fused(8, 5, 2, 1, distances=2)
    w = some(net)
    for x in PLAIN:
        more = x.copy()
        more[6] += 0.7
        rise = net.forward(w, {"x": more[None]})[0] - net.forward(w, {"x": x[None]})[0]
        assert np.allclose(rise, 0.7 * w["head.w"][5])


def test_halves_are_apart_and_not_alike():
    net = N.Twin(8, 5, 1, 1)
    w = some(net)
    z = net.forward(w, {"x": PLAIN})[0]
    other = np.concatenate([PLAIN[:, :4], PLAIN[::-1, 4:]], 1)
    assert np.allclose(net.forward(w, {"x": other})[0][:, 0], z[:, 0])  # the second half is not seen by the first head
    swapped = net.forward(w, {"x": np.concatenate([PLAIN[:, 4:], PLAIN[:, :4]], 1)})[0]
    assert not np.allclose(swapped[:, ::-1], z)
    joint = N.Twin(8, 5, 1, 1, False)
    v = some(joint)
    assert not np.allclose(joint.forward(v, {"x": other})[0][:, 0], joint.forward(v, {"x": PLAIN})[0][:, 0])
    with pytest.raises(ValueError):
        N.Twin(7)


def test_windows_from_arrow():
    x, pad = N.windows(pa.array([[[1.0, 2.0]], [], [[3.0, 4.0], [5.0, 6.0]]]))
    assert x.tolist() == [[[1, 2], [0, 0]], [[0, 0], [0, 0]], [[3, 4], [5, 6]]] and pad.tolist() == [[False, True], [True, True], [False, False]]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x, e = rng.normal(size=(240, 3)), rng.integers(0, 3, 240)
    y = (rng.random(240) < N.sigmoid(x @ [2.0, -1.0, 0.5] * (0.5 + e))).astype(float)
    data = [(i, v.tolist(), [float(b)], int(k), float(1 + k), i % 4 == 3) for i, (v, b, k) in enumerate(zip(x, y, e))]
    df = spark.createDataFrame(data, "unit long, x array<double>, y array<double>, env long, weight double, is_val boolean").cache()
    return df, x, y, e


@pytest.mark.parametrize("method", ["ERM", "DERM", "vREx", "IRM"])
def test_slopes_of_each_method(rows, method):
    """Sums over partitions against differences of the loss as its words say."""
    df, x, y, e = rows
    net, how = N.Fused(3, 4, 1), T.Settings(method=method, penalty=0.7)
    at = net.flat(some(net))

    def total(values):
        z = net.forward(net.shaped(values), {"x": x})[0][:, 0]
        loss = np.logaddexp(0, z) - y * z
        each = np.array([loss[e == k].mean() for k in range(3)])
        slope = np.array([((N.sigmoid(z) - y) * z)[e == k].mean() for k in range(3)])
        return {"ERM": loss.mean(), "DERM": (loss * (1 + e)).mean(), "vREx": each.mean() + 0.7 * each.var(ddof=1), "IRM": each.sum() + 0.7 * (slope**2).sum()}[method]

    loss, slope = T.gradient(df.repartition(3), net, at, how)
    assert abs(loss - total(at)) < 1e-9 and np.allclose(slope, slopes(total, at), atol=1e-7)


def test_slope_of_weighted_classes(spark):
    net, how = N.Pairs(8, 2, 5), T.Settings(class_weights=(0.5, 2.0, 3.0))
    _, batch = CASES[-1]
    y, w = np.array([0, 1, 2, 0, 0, 1]), np.array([0.5, 2.0, 3.0])
    df = spark.createDataFrame([(FRAMES[i, : 5 - PAD[i].sum()].tolist(), int(batch["a1"][i]), int(batch["a2"][i]), int(y[i])) for i in range(6)], "x array<array<double>>, a1 int, a2 int, y int")
    at = net.flat(some(net))

    def total(values):
        z = net.forward(net.shaped(values), batch)[0]
        own = np.log(np.exp(z).sum(1)) - z[np.arange(6), y]
        return (w[y] * own).sum() / w[y].sum()

    loss, slope = T.gradient(df, net, at, how)
    assert abs(loss - total(at)) < 1e-9 and np.allclose(slope, slopes(total, at), atol=1e-7)


def test_erm_of_a_linear_network_is_the_logistic_fit(rows, spark):
    df, x, y, _ = rows
    net = N.Fused(3, 1, 0)
    found = T.fit(df.withColumn("is_val", F.lit(False)), net, T.Settings(epochs=60, batches=1, rate=0.1))
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(4)
    for _ in range(30):
        p = N.sigmoid(z @ w)
        w -= np.linalg.solve(z.T * (p * (1 - p)) @ z, z.T @ (p - y))
    p = N.sigmoid(z @ w)
    assert found.history[-1]["loss"] - -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) < 1e-3


def test_decay_is_apart_from_the_slope():
    adam = T.AdamW(2, 0.1, 0.5)
    assert np.allclose(adam.step(np.array([1.0, -2.0]), np.zeros(2)), [0.95, -1.9])
    assert np.allclose(T.AdamW(2, 0.1, 0.0).step(np.zeros(2), np.array([3.0, -5.0])), [-0.1, 0.1])


def test_stopped_training_goes_on(rows, tmp_path):
    """Six epochs at once, or two and then four, leave the same parameters."""
    df, *_ = rows
    net, how = N.Fused(3, 4, 1), T.Settings(epochs=6, batches=2, rate=0.05)
    whole = T.fit(df, net, how)
    folder = f"file://{tmp_path}/state"
    part = T.fit(df, net, how, folder=folder, stop_after=2)
    assert len(part.history) == 2
    on = T.fit(df, net, how, folder=folder)
    assert on.history == whole.history and on.best_epoch == whole.best_epoch
    assert all((on.parameters[k] == whole.parameters[k]).all() for k in net.shapes())
    best = max(h["val"] for h in whole.history)
    assert whole.best_epoch == max(i + 1 for i, h in enumerate(whole.history) if h["val"] == best)
    with pytest.raises(ValueError):
        T.fit(df, N.Fused(3, 5, 1), how, folder=folder)


def fake(*answers):
    """A fitter that gives what it is told and notes how it was called."""
    calls, left = [], list(answers)

    def fitter(rows, network, how, start):
        calls.append((how.rate, how.epochs, start))
        losses, val, best = left.pop(0)
        history = [{"loss": x, "train": 0.8, "val": val} for x in losses]
        return T.Fitted(network, {"from": len(calls)}, best, history, T.diagnosed(history, best, how.epochs))

    return fitter, calls


FALLS, RISES, LIES = [1.0, 0.8, 0.7, 0.6, 0.5] * 2, [1.0, 1.2, 1.4, 1.5, 1.6] * 2, [1.0, 1.0, 1.0, 1.0, 0.99] * 2


@pytest.mark.parametrize(
    "answers, rates, done",
    [
        ([(FALLS, 0.7, 3)], [1.0], []),
        ([(RISES, 0.5, 3), (FALLS, 0.7, 3)], [1.0, 1 / 3], ["rate / 3"]),
        ([([float("nan")] * 10, 0.5, 3), (RISES, 0.5, 3), (FALLS, 0.6, 3)], [1.0, 1 / 3, 1 / 9], ["rate / 3", "rate / 3"]),
        ([(LIES, 0.5, 3), (FALLS, 0.7, 3)], [1.0, 3.0], ["rate * 3"]),
        ([(LIES, 0.5, 3)] * 3, [1.0, 3.0, 9.0], ["rate * 3", "rate * 3"]),
        ([(FALLS, 0.7, 10), (FALLS[:5], 0.75, 2)], [1.0, 1.0], ["longer"]),
        ([(FALLS, 0.7, 9), (FALLS[:5], 0.65, 2)], [1.0, 1.0], ["longer, left"]),
    ],
)
def test_each_rule_fires(answers, rates, done):
    fitter, calls = fake(*answers)
    found, what = T.train(None, N.Fused(3, 4, 1), T.Settings(epochs=10, rate=1.0), {"from": 0}, fitter)
    assert np.allclose([c[0] for c in calls], rates) and what == done
    if done == ["longer"]:
        assert calls[1][1:] == (5, {"from": 1}) and found.parameters == {"from": 2}
    if done == ["longer, left"]:
        assert found.parameters == {"from": 1}


def test_negatives_are_drawn_anew(spark):
    """Class weights of what is drawn, and pairs learned from few of many negatives."""
    rng = np.random.default_rng(5)
    data = []
    for i in range(400):
        a1, a2 = rng.choice(4, 2, replace=False)
        y = int(rng.choice(3, p=[0.8, 0.1, 0.1]))
        frames = rng.normal(0, 0.3, (rng.integers(1, 4), 4)) + np.eye(4)[y]
        data.append((i, frames.tolist(), int(a1), int(a2), y, i % 4 == 0))
    df = spark.createDataFrame(data, "unit long, x array<array<double>>, a1 int, a2 int, y int, is_val boolean")
    n = np.bincount([r[4] for r in data], minlength=3)
    drawn = np.array([2.0 * (n[1] + n[2]), n[1], n[2]])
    weights = T.class_weights(df, 3, 2.0)
    assert np.allclose(weights, drawn.sum() / (3 * drawn))
    found = T.fit(df, N.Pairs(4, 2, 8), T.Settings(epochs=8, batches=2, rate=0.02, negatives=2.0, class_weights=weights))
    assert max(h["val"] for h in found.history) > 0.9 and found.history[-1]["loss"] < found.history[0]["loss"]


def test_unknown_methods_and_few_environments(rows):
    df, *_ = rows
    with pytest.raises(ValueError):
        T.fit(df, N.Fused(3, 4, 1), T.Settings(method="SGD"))
    with pytest.warns(UserWarning, match="is ERM"):
        T.fit(df.withColumn("env", F.lit(1)), N.Fused(3, 4, 1), replace(T.Settings(epochs=1, batches=1), method="vREx"))
    assert T.fit(df.withColumn("y", F.lit(None).cast("array<double>")), N.Fused(3, 4, 1), T.Settings(epochs=1, batches=1)).history[0]["loss"] == 0
