"""Queries on networks: late fusion, two halves, pairs of agents, and their training."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ..operators import networks as N
from ..operators import training, windows
from . import views as V
from .analysis import _DOTS, _numbers
from .frames import r6


def _given(network: N.Network, seed: int) -> N.Arrays:
    """Parameters that no training made, so that SQL can have them too: none is zero."""
    rng = np.random.default_rng(seed)
    return {n: np.round(rng.normal(0, 0.3, s), 4) + n.endswith(".g") for n, s in network.shapes().items()}


_FUSED, _WINDOWS = N.Fused(64, 12, 2, 2, distances=4), N.Fused(64, 12, 1, 1, distances=4, context=5, width=6)
_APART, _JOINT = N.Twin(64, 10, 1, 2, True), N.Twin(64, 10, 1, 2, False)
_PAIRS = N.Pairs(64, heads=4, hidden=8)


def late_fusion_scores(spark, d):
    """The last four numbers of a vector as distances that enter the head."""
    rows = N.scores(V.vectors(spark, d), _FUSED, _given(_FUSED, 2), "x", names=("a", "b"), temperature=1.5)
    return rows.select("frame_idx", r6(F.col("a"), "a"), r6(F.col("b"), "b"))


def window_fusion_scores(spark, d):
    rows = windows.context_rows(V.vectors(spark, d), "x", 2).select("frame_idx", "context")
    return N.scores(rows, _WINDOWS, _given(_WINDOWS, 3), "context", names=("score",)).select("frame_idx", r6(F.col("score"), "score"))


def twin_scores(spark, d):
    """Half a vector for each of two views, its last two numbers as distances."""
    rows = N.scores(V.vectors(spark, d), _APART, _given(_APART, 4), "x", names=("b2f", "y2f"))
    rows = N.scores(rows, _JOINT, _given(_JOINT, 5), "x", names=("joint_b2f", "joint_y2f"))
    return rows.select("frame_idx", *[r6(F.col(c), c) for c in ("b2f", "y2f", "joint_b2f", "joint_y2f")])


def pair_class_scores(spark, d):
    """Chances of three classes for the twelve ordered pairs of each frame, from windows
    of three to five frames."""
    rows = windows.context_truncated(V.vectors(spark, d), "x", 2).select("frame_idx", "context")
    found = N.pair_scores(rows, _PAIRS, _given(_PAIRS, 6), "context")
    return found.select("frame_idx", "a1", "a2", *[r6(F.col(c), c) for c in ("none", "nt", "nn")])


def _labelled(spark, d):
    v = V.vectors(spark, d)
    return v.select("x", "frame_idx", F.array((F.col("label") > 4).cast("double")).alias("y"), F.col("frame_idx").alias("unit"), (F.col("obs") % 5 == 4).alias("is_val"), (F.col("obs") % 3).alias("env"), "label")


def network_training(spark, d):
    """Each epoch of a network trained on all labelled vectors, by each method."""
    rows, net = _labelled(spark, d), N.Fused(64, 16, 1)
    how = training.Settings(epochs=3, batches=2, rate=0.01, decay=0.01, penalty=0.5)
    out = []
    for method in ("ERM", "vREx", "IRM"):
        found = training.fit(rows, net, replace(how, method=method))
        out += [(method, i + 1, *[float(round(h[k], 5)) for k in ("loss", "train", "val")], i + 1 == found.best_epoch) for i, h in enumerate(found.history)]
    return spark.createDataFrame(out, "method string, epoch int, loss double, train double, val double, best boolean")


def pair_training(spark, d):
    """Each epoch of the pair classifier: an agent's class is that of its frame's label.
    Every epoch draws as many of class 0 anew as there are others."""
    rows = windows.context_truncated(V.vectors(spark, d), "x", 2).select("context", "label", "frame_idx", (F.col("obs") % 5 == 4).alias("is_val"))
    agents = F.array(*[F.struct(F.lit(a).alias("a1"), F.lit(b).alias("a2")) for a, b in _PAIRS.pairs()])
    rows = rows.select(F.col("context").alias("x"), "label", "is_val", "frame_idx", F.posexplode(agents).alias("k", "p"))
    y = F.when(F.col("label") % 4 != F.col("p.a1"), 0).when(F.col("label") > 4, 1).otherwise(2)
    rows = rows.select("x", "is_val", "p.a1", "p.a2", y.alias("y"), (F.col("frame_idx") * 12 + F.col("k")).alias("unit"))
    net = N.Pairs(64, heads=4, hidden=16)
    how = training.Settings(epochs=4, batches=4, rate=0.005, negatives=1.0)
    how = replace(how, class_weights=training.class_weights(rows.where("not is_val"), 3, 1.0))
    found = training.fit(rows, net, how)
    out = [(i + 1, *[float(round(h[k], 5)) for k in ("loss", "train", "val")], i + 1 == found.best_epoch) for i, h in enumerate(found.history)]
    return spark.createDataFrame(out, "epoch int, loss double, train double, val double, best boolean")


QUERIES = {f.__name__: f for f in (late_fusion_scores, window_fusion_scores, twin_scores, pair_class_scores, network_training, pair_training)}


def _dense(w: N.Arrays, name: str, x: str) -> str:
    """A linear layer of the list ``x``, as a list."""
    b = _numbers(w[f"{name}.b"])
    dots = _DOTS.format(m=_numbers(w[f"{name}.w"].T), x=x)
    return f"list_transform(list_zip({dots}, {b}), lambda z: z[1] + z[2])"


def _relu(x: str) -> str:
    return f"list_transform({x}, lambda z: greatest(z, 0))"


def _sigmoid(x: str) -> str:
    return f"round(1 / (1 + exp(-({x}))), 6)"


def _fusion_sql() -> str:
    w = _given(_FUSED, 2)
    return f"""{V.with_views('vectors')},
a AS (SELECT frame_idx, x[61:64] AS far, {_relu(_dense(w, 'trunk0', 'x[1:60]'))} AS h FROM vectors), b AS (SELECT frame_idx, far, {_relu(_dense(w, 'trunk1', 'h'))} AS h FROM a),
z AS (SELECT frame_idx, {_dense(w, 'head', 'list_concat(h, far)')} AS z FROM b)
SELECT frame_idx, {_sigmoid('z[1] / 1.5')} AS a, {_sigmoid('z[2] / 1.5')} AS b FROM z"""


def _windows_sql() -> str:
    from .frames import _clamped

    w = _given(_WINDOWS, 3)
    return f"""{V.with_views('vectors')}, {_clamped('x', 'vectors', '', 2)},
e AS (SELECT a.frame_idx, a.x AS middle, b.v AS x, list_dot_product({_DOTS.format(m=_numbers(w['ask.w'].T), x='a.x')}, {_DOTS.format(m=_numbers(w['key.w'].T), x='b.v')}) / sqrt(6) AS z
  FROM vectors a JOIN c b ON a.obs = b.obs AND a.frame_idx = b.frame_idx),
s AS (SELECT frame_idx, middle, x, exp(z) / sum(exp(z)) OVER (PARTITION BY frame_idx) AS p FROM e),
u AS (SELECT frame_idx, unnest(range(1, 65)) AS i, unnest(middle) AS m, unnest(x) * p AS v FROM s),
h AS (SELECT frame_idx, i, any_value(m) + sum(v) AS h FROM u GROUP BY frame_idx, i),
n AS (SELECT frame_idx, i, (h - avg(h) OVER w) / sqrt(var_pop(h) OVER w + 1e-5) * {_numbers(w['norm.g'])}[i] + {_numbers(w['norm.b'])}[i] AS h FROM h WINDOW w AS (PARTITION BY frame_idx)),
l AS (SELECT frame_idx, list(h ORDER BY i) AS x FROM n GROUP BY frame_idx),
t AS (SELECT frame_idx, x[61:64] AS far, {_relu(_dense(w, 'trunk0', 'x[1:60]'))} AS h FROM l)
SELECT frame_idx, {_sigmoid(_dense(w, 'head', 'list_concat(h, far)') + '[1]')} AS score FROM t"""


def _twin_sql() -> str:
    a, j = _given(_APART, 4), _given(_JOINT, 5)
    return f"""{V.with_views('vectors')},
h AS (SELECT frame_idx, x[31:32] AS far1, x[63:64] AS far2, {_relu(_dense(a, 'trunk0', 'x[1:30]'))} AS h1, {_relu(_dense(a, 'trunk0', 'x[33:62]'))} AS h2,
  {_relu(_dense(j, 'trunk0', 'list_concat(x[1:30], x[33:62])'))} AS h FROM vectors),
z AS (SELECT frame_idx, {_dense(a, 'first', 'list_concat(h1, far1)')}[1] AS z1, {_dense(a, 'second', 'list_concat(h2, far2)')}[1] AS z2,
  {_dense(j, 'head', 'list_concat(list_concat(h, far1), far2)')} AS z FROM h)
SELECT frame_idx, {_sigmoid('z1')} AS b2f, {_sigmoid('z2')} AS y2f, {_sigmoid('z[1]')} AS joint_b2f, {_sigmoid('z[2]')} AS joint_y2f FROM z"""


def _pairs_sql() -> str:
    w = _given(_PAIRS, 6)
    queries = w["agents.e"] @ w["ask.w"] + w["ask.b"]
    return f"""{V.with_views('vectors')},
f AS (SELECT obs, frame_idx, {_dense(w, 'key', 'x')} AS k, {_dense(w, 'value', 'x')} AS v, row_number() OVER (PARTITION BY obs ORDER BY frame_idx) AS n FROM vectors),
p AS (SELECT a.frame_idx, b.v, b.n, b.k, h.h, q.q, list_dot_product(({_numbers(queries)}[q.q + 1])[h.h * 16 + 1:h.h * 16 + 16], b.k[h.h * 16 + 1:h.h * 16 + 16]) / 4 AS z
  FROM f a JOIN f b ON a.obs = b.obs AND b.n BETWEEN a.n - 2 AND a.n + 2, range(0, 4) AS h(h), range(0, 4) AS q(q)),
s AS (SELECT frame_idx, q, h, v[h * 16 + 1:h * 16 + 16] AS v, exp(z) / sum(exp(z)) OVER (PARTITION BY frame_idx, q, h) AS p FROM p),
u AS (SELECT frame_idx, q, h * 16 + unnest(range(1, 17)) AS i, unnest(v) * p AS v FROM s),
m AS (SELECT frame_idx, q, i, sum(v) AS v FROM u GROUP BY ALL),
o AS (SELECT frame_idx, q, list(v ORDER BY i) AS v FROM m GROUP BY ALL),
g AS (SELECT frame_idx, q, {_dense(w, 'out', 'v')} AS g FROM o),
z AS (SELECT a.frame_idx, a.q AS a1, b.q AS a2, {_relu(_dense(w, 'hidden', 'list_concat(a.g, b.g)'))} AS h FROM g a JOIN g b ON a.frame_idx = b.frame_idx AND a.q <> b.q),
l AS (SELECT frame_idx, a1, a2, list_transform({_dense(w, 'head', 'h')}, lambda y: exp(y)) AS e FROM z)
SELECT frame_idx, a1::INT AS a1, a2::INT AS a2, round(e[1] / list_sum(e), 6) AS "none", round(e[2] / list_sum(e), 6) AS nt, round(e[3] / list_sum(e), 6) AS nn FROM l"""


SQL = {"late_fusion_scores": _fusion_sql(), "window_fusion_scores": _windows_sql(), "twin_scores": _twin_sql(), "pair_class_scores": _pairs_sql()}
