"""Queries on effects, tests, metrics, agreement, weights, samples and folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.stats import with_average_rank
from ..operators import aggregate, effects, learn, metrics, multiplicity, resample, tracking, windows
from ..sources.tables import table
from . import views as V
from .frames import _OBS, _clamped, r6, t_area

PAIRS = {"Y_a": "Yhat_a", "Y_b": "Yhat_b"}


def _obs(spark, d):
    return aggregate.observation_level(V.frames_orders(spark, d).drop("price"))


def rounded(df, *keys, digits=6):
    """``df`` with its doubles rounded, keys first."""
    types = dict(df.dtypes)
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *[F.round(c, digits).alias(c) if types[c] == "double" else F.col(c) for c in rest])


def ead_all_pairs(spark, d):
    return rounded(effects.difference_in_means(_obs(spark, d), "Y_b").select("t0", "t1", "n0", "n1", "ate", "se", "t", "df"), "t0", "t1")


def ead_pvalues(spark, d):
    return rounded(effects.with_p(effects.difference_in_means(_obs(spark, d), "Y_b")).select("t0", "t1", "ate", "t", "df", "p"), "t0", "t1")


def teb_all_pairs(spark, d):
    return rounded(effects.bias_of_predictions(_obs(spark, d), PAIRS), "t0", "t1", "outcome")


def teb_average(spark, d):
    return rounded(effects.average_bias(effects.bias_of_predictions(_obs(spark, d), PAIRS)), "outcome")


def ate_matrix_welch(spark, d):
    return rounded(effects.matrix(_obs(spark, d), "Yhat_b"), "t0", "t1")


def ate_matrix_pvalues(spark, d):
    rows = effects.with_p(effects.matrix(_obs(spark, d), "Yhat_b"), sides=2)
    return rounded(rows.withColumn("mark", C.stars(F.col("p"))), "t0", "t1")


def ate_versus_control(spark, d):
    return rounded(effects.versus_control(_obs(spark, d), "Yhat_a", "BUILDING"), "t0", "t1")


def paired_phase_change(spark, d):
    return rounded(effects.paired_change(V.phases(spark, d), "y", "unit", "phase", 1995, 1996, ("line",)), "line")


def genotype_contrast_grouping_sets(spark, d):
    p = V.phases(spark, d).where("phase = 1995")
    return rounded(effects.contrast(p, "y", "line", "BUILDING", "MACHINERY", "sex"), "stratum")


def interaction_did(spark, d):
    return rounded(effects.interaction(V.phases(spark, d), "y", "unit", "phase", 1995, 1996, "line", "BUILDING", "MACHINERY"), "stratum")


def aipw_cellmean(spark, d):
    return rounded(effects.doubly_robust(_obs(spark, d), "Yhat_b", "T", "BUILDING", "MACHINERY", "W_nation"))


def _tests(spark, d):
    return table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("x")).select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 3).alias("family"), (F.pmod(F.col("doc_id") * 7919, F.lit(9973)) / 9973.0 * F.when(F.col("x") == 1, 0.01).otherwise(1.0)).alias("p")
    )


def holm(spark, d):
    return rounded(multiplicity.holm(_tests(spark, d), by=("family",)), "id", digits=9)


def bh(spark, d):
    return rounded(multiplicity.benjamini_hochberg(_tests(spark, d), by=("family",)), "id", digits=9)


def anova_f(spark, d):
    return rounded(resample.anova(_obs(spark, d), "Yhat_b", "T"))


def permutation_anova(spark, d):
    rows = _obs(spark, d).select("obs", "T", "Yhat_b")
    return rounded(resample.permutation_anova(rows, "Yhat_b", "obs", "T", _REPLICATES, 7))


def permutation_pairwise(spark, d):
    rows = _obs(spark, d).select("obs", "T", "Yhat_b")
    return rounded(resample.permutation_pairwise(rows, "Yhat_b", "obs", "T", _REPLICATES, 7), "t0", "t1")


def bootstrap_ci(spark, d):
    return rounded(resample.bootstrap(_obs(spark, d).select("obs", "T", "Yhat_b"), "Yhat_b", "obs", "T", _REPLICATES, 7), "T")


def mann_whitney_u(spark, d):
    return rounded(resample.mann_whitney(_obs(spark, d), "Yhat_b", "T", "BUILDING", "MACHINERY"))


def mann_whitney_ties(spark, d):
    """Of a value with many ties: an observation's count of large orders."""
    rows = V.frames_orders(spark, d).groupBy("obs", "T").agg(F.sum("Y_b").alias("y"))
    return rounded(resample.mann_whitney(rows, "y", "T", "BUILDING", "MACHINERY"))


def confusion_metrics(spark, d):
    return rounded(metrics.binary_metrics(V.frames_orders(spark, d), PAIRS), "outcome")


def metrics_by_treatment(spark, d):
    return rounded(metrics.binary_metrics(V.frames_orders(spark, d), PAIRS, ("T",), None), "T", "outcome")


def macro_metrics(spark, d):
    m = metrics.binary_metrics(V.frames_orders(spark, d), PAIRS, ("T",), None)
    return rounded(metrics.macro(m, ("accuracy", "balanced", "recall", "precision"), ("T",)), "T")


def micro_macro(spark, d):
    """Recall of large orders pooled over observations, and averaged over them."""
    f = V.frames_orders(spark, d)
    per = f.groupBy("T", "obs").agg(F.count_if((F.col("Y_b") == 1) & (F.col("Yhat_a") >= 0.6)).alias("tp"), F.sum("Y_b").alias("pos"))
    return per.groupBy("T").agg(r6(F.sum("tp") / F.sum("pos"), "micro"), r6(F.avg(metrics.ratio(F.col("tp"), F.col("pos"))), "macro"))


def continuous_metrics(spark, d):
    return rounded(metrics.continuous_metrics(V.frames_orders(spark, d), "Y_b", "Yhat_a", ("T",)), "T")


def multiclass_bacc(spark, d):
    e = table(spark, d, "embeddings").select("label", F.when(F.col("vec_id") % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("guess"))
    return rounded(metrics.multiclass(e, "label", "guess", 12), "class")


def always_zero(spark, d):
    f = V.frames_orders(spark, d)
    return f.groupBy("T").agg(r6(F.avg((F.col("Y_b") == 0).cast("double")), "accuracy"), F.lit(0.5).alias("balanced"))


def rater_agreement(spark, d):
    return rounded(metrics.rater_agreement(V.raters(spark, d)), "video", "a", "b")


def worst_pair(spark, d):
    return rounded(metrics.worst_pair(metrics.rater_agreement(V.raters(spark, d))))


def noise_bound(spark, d):
    a = metrics.rater_agreement(V.raters(spark, d))
    return rounded(a.select("video", "a", "b", "disagree", C.noise_bound(F.col("disagree")).alias("bound")), "video", "a", "b")


def mixed_bound(spark, d):
    r = V.raters(spark, d)
    shares = r.groupBy("rater").agg((F.sum("y") / 1.0).alias("n"))
    total = shares.agg(F.sum("n").alias("all"))
    shares = shares.crossJoin(F.broadcast(total)).select("rater", (F.col("n") / F.col("all")).alias("share"))  # one row
    return rounded(metrics.mixed_bound(shares, metrics.rater_agreement(r)))


def agreement_matrix(spark, d):
    a = metrics.rater_agreement(V.raters(spark, d)).groupBy("a", "b").agg(F.avg("kappa").alias("kappa"))
    return rounded(metrics.both_ways(a, "kappa"), "row", "column")


def disagreement_tags(spark, d):
    r = V.raters(spark, d).where("rater <> 't'").groupBy("video", "frame_idx").pivot("rater", ["q", "n"]).agg(F.max("y"))
    rows = metrics.disagreement_tags(r.select("video", "frame_idx", (1 - F.col("q")).alias("y1"), (1 - F.col("n")).alias("y2")), 3)
    return rows.select("video", "frame_idx", "y1", "y2", F.concat_ws(",", "tags").alias("tags"))


def _spearman(df, by):
    a = with_average_rank(with_average_rank(df, "x", "rx", by), "y", "ry", by)
    return a.groupBy(*by).agg(r6(F.corr("rx", "ry"), "rho"), F.count(F.lit(1)).alias("n"))


def spearman_overall(spark, d):
    o = _obs(spark, d).select(F.col("Yhat_a").alias("x"), F.col("Y_avg").alias("y")).where("y is not null")
    return _spearman(o, ())


def spearman_by_condition(spark, d):
    o = _obs(spark, d).select("T", F.col("Yhat_a").alias("x"), F.col("Y_avg").alias("y")).where("y is not null")
    return _spearman(o, ("T",))


def env_ids(spark, d):
    return learn.encode(V.frames_orders(spark, d), ("T", "W_nation"), "E").select("obs", "frame_idx", "E")


def derm_weights(spark, d):
    f = learn.encode(V.frames_orders(spark, d).where("Y_b is not null"), ("T",), "E")
    return rounded(learn.derm_weights(f, "Y_b", "E").select("obs", "frame_idx", "weight"), "obs", "frame_idx")


def class_weights(spark, d):
    return rounded(learn.class_weights(table(spark, d, "embeddings"), "label"), "label")


def label_encode(spark, d):
    return learn.encode(V.events(spark, d), ("behavior",), "code").groupBy("behavior", "code").agg(F.count(F.lit(1)).alias("n"))


def concat_datasets(spark, d):
    o = learn.encode(_obs(spark, d), ("T",), "E").select("obs", "E", "T", "W_nation", F.lit(1.0).alias("W_b"), "Y_a", "Yhat_a")
    other = o.where("obs % 2 = 0").drop("W_b").withColumn("W_c", F.lit(2.0))
    return rounded(learn.concat([o, other]), "obs")


def topk_leaderboard(spark, d):
    runs = _obs(spark, d).groupBy("W_nation").agg(F.avg("Yhat_a").alias("val"), F.avg("Yhat_b").alias("test"))
    whole = Window.partitionBy()
    ranked = runs.withColumns(
        {
            "place": F.row_number().over(whole.orderBy(F.desc("test"), "W_nation")),
            "best_val": (F.row_number().over(whole.orderBy(F.desc("val"), "W_nation")) == 1).cast("int"),
        }
    )
    return rounded(ranked.where("place <= 10"), "place", "W_nation")


def stratified_topn(spark, d):
    return resample.top_per_group(V.frames_orders(spark, d), ("T",), 5, F.desc("price"), F.col("obs"), F.col("frame_idx")).select("T", "obs", "frame_idx", "price")


def stratified_sample(spark, d):
    return resample.top_per_group(_obs(spark, d), ("T",), 20, resample.hash_order("obs", seed=3), F.col("obs")).select("T", "obs")


def round_robin_sample(spark, d):
    return resample.round_robin(_obs(spark, d).select("T", "obs"), "T", 23, resample.hash_order("obs", seed=5), F.col("obs"))


def best_by_priority(spark, d):
    o = table(spark, d, "orders")
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return o.groupBy(F.col("o_custkey").alias("obs")).agg(F.min_by("o_orderkey", F.struct(rank, F.col("o_orderkey"))).alias("orderkey"))


def val_split_by_obs(spark, d):
    return resample.split_by_unit(V.frames_orders(spark, d).select("obs", "frame_idx"), "obs", 0.2, 11)


def negative_sampling(spark, d):
    rows = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return resample.sample_negatives(rows, "toxic", "doc_id", 1.5, 4)


def grid_configs(spark, d):
    """A search's settings for each label that the vectors have."""
    labels = tuple(r["label"] for r in V.vectors(spark, d).select("label").distinct().orderBy("label").collect())  # classes are few
    axes = {"label": labels, "layers": (0, 1, 2), "hidden": (0, 128, 512), "context": (0, 2, 4), "mode": ("none", "mean", "concat"), "rate": (0.001, 0.0003)}
    return learn.grid(spark, axes, "(layers = 0) = (hidden = 0)", "(context = 0) = (mode = 'none')")


def percentile_background(spark, d):
    e = V.vectors(spark, d).select("label", F.posexplode("x").alias("dim", "v"))
    return e.groupBy("label", "dim").agg(r6(F.percentile("v", F.lit(0.85)), "background"), r6(F.percentile("v", F.lit(0.05)), "low"))


def survival_2d(spark, d):
    """How many lines have at least this quantity and this discount."""
    li = table(spark, d, "lineitem").select(F.floor(F.col("l_quantity") / 5).cast("int").alias("s"), F.round(F.col("l_discount") * 100).cast("int").alias("v"))
    n = li.groupBy("s", "v").agg(F.count(F.lit(1)).alias("n"))
    full = n.select("s").distinct().crossJoin(F.broadcast(n.select("v").distinct()))  # a histogram's axis
    dense = full.join(n, ["s", "v"], "left").na.fill(0)
    down = Window.unboundedPreceding
    one = F.sum("n").over(Window.partitionBy("v").orderBy(F.desc("s")).rowsBetween(down, 0))
    rows = dense.withColumn("_a", one)
    return rows.select("s", "v", F.sum("_a").over(Window.partitionBy("s").orderBy(F.desc("v")).rowsBetween(down, 0)).alias("n_at_least"))


def temperature_search(spark, d):
    f = V.frames_orders(spark, d).where("Y_a is not null").withColumn("logit", F.log(F.col("Yhat_a") / (1 - F.col("Yhat_a"))))
    return rounded(learn.temperature(f, "Y_a", "logit").select("loss"), digits=5)


def temperature_grid(spark, d):
    f = V.frames_orders(spark, d).where("Y_a is not null").withColumn("logit", F.log(F.col("Yhat_a") / (1 - F.col("Yhat_a"))))
    return rounded(learn.temperature_grid(f, "Y_a", "logit", (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)), "temperature")


_W = [((i * 37) % 11 - 5) / 10 for i in range(64)]


def linear_probe_scores(spark, d):
    return rounded(learn.linear_scores(V.vectors(spark, d), "x", _W, 0.1).select("frame_idx", "score"), "frame_idx")


def _mlp_layers():
    rng = np.random.default_rng(0)
    return [(rng.normal(0, 0.3, (64, 16)), np.zeros(16)), (rng.normal(0, 0.3, (16, 1)), np.zeros(1))]


def mlp_scores_udf(spark, d):
    return V.vectors(spark, d).select("frame_idx", r6(learn.mlp_scorer(_mlp_layers())("x"), "score"))


def _attention():
    rng = np.random.default_rng(1)
    return rng.normal(0, 0.2, (64, 8)), rng.normal(0, 0.2, (64, 8)), rng.normal(0, 0.2, (64, 64)), rng.normal(0, 0.3, 64)


def attention_pool_udf(spark, d):
    rows = windows.context_rows(V.vectors(spark, d), "x", 2)
    return rows.select("frame_idx", r6(learn.attention_scorer(*_attention())("context"), "score"))


def min_gap_dedupe(spark, d):
    return resample.min_gap(V.events(spark, d).where("behavior = 'error'"), 2000, order="minute")


def _bodies(spark, d):
    e = V.events(spark, d)
    x, y = (F.col("event_id") * 37 % 400).cast("double"), (F.col("event_id") * 53 % 300).cast("double")
    seen = F.col("event_id") % 3 == 0
    return e.select("obs", "frame_idx", x.alias("x"), y.alias("y"), F.when(seen, x + 5).alias("raw_x"), F.when(seen, y - 5).alias("raw_y"))


def leash_fold(spark, d):
    return tracking.leash(_bodies(spark, d), 150.0)


def proximity_flags(spark, d):
    b = _bodies(spark, d).select(
        "obs", "frame_idx", F.col("x").alias("focal_x"), F.col("y").alias("focal_y"), (F.col("x") + F.col("frame_idx") % 7 * 20).alias("blue_x"), F.col("y").alias("blue_y"),
        F.col("x").alias("yellow_x"), (F.col("y") - F.col("frame_idx") % 5 * 30).alias("yellow_y"), (F.col("frame_idx") % 4).alias("n_blobs"),
    )
    return tracking.with_proximity(b, 80.0).select("obs", "frame_idx", "B2F", "Y2F")


def detections(spark, d):
    e = F.col("obs") * 31 + F.col("frame_idx")
    return _bodies(spark, d).select(
        "obs", "frame_idx", F.array("x", F.col("x") + 40, F.col("x") - 60).alias("xs"), F.array("y", F.col("y") + 10, F.col("y") - 20).alias("ys"),
        F.when(e % 5 == 0, 0).alias("blue_blob"), F.when(e % 5 == 0, F.col("x")).alias("blue_x"), F.when(e % 5 == 0, F.col("y")).alias("blue_y"),
        F.when(e % 3 == 0, 1).alias("yellow_blob"), F.when(e % 3 == 0, F.col("x") + 40).alias("yellow_x"), F.when(e % 3 == 0, F.col("y") + 10).alias("yellow_y"),
    )


def identity_fold(spark, d):
    return tracking.track(detections(spark, d))


def detection_rates(spark, d):
    b = _bodies(spark, d)
    return b.groupBy("obs").agg(
        F.count(F.lit(1)).alias("n"), r6(100.0 * F.count("raw_x") / F.count(F.lit(1)), "percent"), r6(F.avg(F.when(F.col("raw_x").isNotNull(), F.col("x"))), "mean_x")
    )


def embedding_frame_quality(spark, d):
    """Frames without a vector and vectors without a frame, by keys."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("k"))
    vecs = table(spark, d, "embeddings").select((F.col("vec_id") * 3).alias("k"))
    a = docs.join(vecs, "k", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("frame without vector").alias("what"), "n")
    b = vecs.join(docs, "k", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("vector without frame").alias("what"), "n")
    return a.unionByName(b)


def file_stats(spark, d):
    """Per source: a value if all agree, else INCONSISTENT; and ranges."""
    docs = table(spark, d, "documents")
    lang = F.when(F.countDistinct("lang") <= 1, F.min("lang")).otherwise("INCONSISTENT")
    return docs.groupBy("source").agg(lang.alias("lang"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.sum("n_chars").alias("total"), F.count(F.lit(1)).alias("n"))


def evenly_spaced_frames(spark, d):
    return resample.evenly_spaced(V.frames_orders(spark, d), 4).select("obs", "frame_idx")


def offset_limit_slice(spark, d):
    return resample.slice_rows(V.frames_orders(spark, d), 2, 3).select("obs", "frame_idx", "price")


def error_rows(spark, d):
    f = V.frames_orders(spark, d)
    wrong = (F.rint("Yhat_a") != F.col("Y_a")) | (F.rint("Yhat_b") != F.col("Y_b"))
    return f.where(wrong & F.col("Y_a").isNotNull() & F.col("Y_b").isNotNull() & F.col("T").isin("BUILDING", "MACHINERY")).select("obs", "frame_idx", "T")


def training_diagnostics(spark, d):
    """Per run (nation): first, best and last loss, and flags of bad runs."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    per = o.groupBy("c_nationkey", F.year("o_orderdate").alias("epoch")).agg(F.avg("o_totalprice").alias("loss"))
    return rounded(
        per.groupBy("c_nationkey").agg(
            F.min_by("loss", "epoch").alias("first"), F.max_by("loss", "epoch").alias("last"), F.min("loss").alias("best"),
            F.min_by("epoch", F.struct("loss", "epoch")).cast("int").alias("best_epoch"), (F.max_by("loss", "epoch") > 1.05 * F.min_by("loss", "epoch")).cast("int").alias("diverged"),
        ), "c_nationkey",
    )


QUERIES = {f.__name__: f for f in (
    ead_all_pairs, ead_pvalues, teb_all_pairs, teb_average, ate_matrix_welch, ate_matrix_pvalues, ate_versus_control, paired_phase_change,
    genotype_contrast_grouping_sets, interaction_did, aipw_cellmean, holm, bh, anova_f, permutation_anova, permutation_pairwise, bootstrap_ci,
    mann_whitney_u, mann_whitney_ties, confusion_metrics, metrics_by_treatment, macro_metrics, micro_macro, continuous_metrics, multiclass_bacc, always_zero,
    rater_agreement, worst_pair, noise_bound, mixed_bound, agreement_matrix, disagreement_tags, spearman_overall, spearman_by_condition, env_ids,
    derm_weights, class_weights, label_encode, concat_datasets, topk_leaderboard, stratified_topn, stratified_sample, round_robin_sample,
    best_by_priority, val_split_by_obs, negative_sampling, grid_configs, percentile_background, survival_2d, temperature_grid, temperature_search,
    linear_probe_scores, mlp_scores_udf, attention_pool_udf, min_gap_dedupe, leash_fold, proximity_flags, identity_fold, detection_rates,
    embedding_frame_quality, file_stats, evenly_spaced_frames, offset_limit_slice, error_rows, training_diagnostics,
)}

_ARMS = """arms AS (SELECT "T", count({0}) AS n, avg({0}) AS mean, var_samp({0}) AS var FROM o GROUP BY "T"),
p AS (SELECT a."T" AS t0, b."T" AS t1, a.n AS n0, b.n AS n1, a.mean AS mean0, b.mean AS mean1, a.var AS var0, b.var AS var1 FROM arms a JOIN arms b ON a."T" < b."T")"""
_WELCH = """(mean1 - mean0) / nullif(sqrt(var1 / n1 + var0 / n0), 0)"""
_WELCH_DF = """(var0 / n0 + var1 / n1) ** 2 / nullif((var0 / n0) ** 2 / (n0 - 1) + (var1 / n1) ** 2 / (n1 - 1), 0)"""
_TEB = """l AS (SELECT "T", has_annotations AS h, unnest(['Y_a', 'Y_b']) AS outcome, unnest([Y_a, Y_b]) AS y, unnest([Yhat_a, Yhat_b]) AS g FROM o),
a AS (SELECT outcome, "T", count(y) FILTER (WHERE h = 1) AS n, avg(y) FILTER (WHERE h = 1) AS m, var_samp(y) FILTER (WHERE h = 1) AS v,
  count(g) AS k, avg(g) AS u, var_samp(g) AS s FROM l GROUP BY ALL),
e AS (SELECT x."T" AS t0, y."T" AS t1, x.outcome, y.m - x.m AS ate_true, sqrt(y.v / y.n + x.v / x.n) AS ate_true_std, y.u - x.u AS ate_pred,
  sqrt(y.s / y.k + x.s / x.k) AS ate_pred_std, (y.u - x.u) - (y.m - x.m) AS bias, x.n + y.n AS n_true, x.k + y.k AS n_pred
  FROM a x JOIN a y ON x.outcome = y.outcome AND x."T" < y."T")"""
_TESTS = """t AS (SELECT doc_id AS id, doc_id % 3 AS family, (doc_id * 7919) % 9973 / 9973.0::DOUBLE * CASE WHEN max(toxic) = 1 THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END AS p FROM labels GROUP BY doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS k, count(*) OVER (PARTITION BY family) AS n FROM t)"""
_DELTA = """u AS (SELECT unit, line, avg(y) FILTER (WHERE phase = 1996) - avg(y) FILTER (WHERE phase = 1995) AS delta FROM phases GROUP BY ALL),
d AS (SELECT * FROM u WHERE delta IS NOT NULL)"""


def _contrast(source: str, value: str, strata: bool) -> str:
    s = "unnest(['All', sex])" if strata else "'All'"
    return f"""c AS (SELECT {s} AS stratum, line, {value} AS y FROM {source} WHERE line IN ('BUILDING', 'MACHINERY')),
g AS (SELECT stratum, count(y) FILTER (WHERE line = 'BUILDING') AS n0, count(y) FILTER (WHERE line = 'MACHINERY') AS n1,
  avg(y) FILTER (WHERE line = 'BUILDING') AS mean0, avg(y) FILTER (WHERE line = 'MACHINERY') AS mean1,
  var_samp(y) FILTER (WHERE line = 'BUILDING') AS var0, var_samp(y) FILTER (WHERE line = 'MACHINERY') AS var1 FROM c GROUP BY stratum)
SELECT stratum, n0, n1, round(mean1 - mean0, 6) AS ate, round(sqrt(var1 / n1 + var0 / n0), 6) AS se, round({_WELCH}, 6) AS t, round({_WELCH_DF}, 6) AS df,
  round((mean1 - mean0) / sqrt(((n0 - 1) * var0 + (n1 - 1) * var1) / (n0 + n1 - 2)), 6) AS d FROM g WHERE n0 > 0 AND n1 > 0"""


_LONG = """l AS (SELECT obs, frame_idx, "T", unnest(['Y_a', 'Y_b']) AS outcome, unnest([Y_a, Y_b]) AS y, unnest([round_even(Yhat_a, 0), round_even(Yhat_b, 0)]) AS g FROM frames_orders)"""
_COUNTS = "count(*) FILTER (WHERE y = 1 AND g = 1) AS tp, count(*) FILTER (WHERE y = 0 AND g = 1) AS fp, count(*) FILTER (WHERE y = 1 AND g = 0) AS fn, count(*) FILTER (WHERE y = 0 AND g = 0) AS tn"


def _rates(empty: str) -> str:
    def q(a: str, b: str) -> str:
        return f"coalesce(({a})::DOUBLE / nullif({b}, 0), {empty})"

    recall, spec = q("tp", "tp + fn"), q("tn", "tn + fp")
    return f"""tp, fp, fn, tn, round({q('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy, round(({recall} + {spec}) / 2, 6) AS balanced, round({recall}, 6) AS recall,
  round({q('tp', 'tp + fp')}, 6) AS precision, round({spec}, 6) AS specificity, round({q('fp', 'fp + tn')}, 6) AS fpr, round({q('fn', 'fn + tp')}, 6) AS fnr"""


_AGREE = V.with_views("raters").replace("WITH ", "WITH ", 1) + """,
pr AS (SELECT x.video, x.rater AS a, y.rater AS b, count(*) FILTER (WHERE x.y = 1 AND y.y = 1)::DOUBLE AS tp, count(*) FILTER (WHERE x.y = 0 AND y.y = 1)::DOUBLE AS fp,
  count(*) FILTER (WHERE x.y = 1 AND y.y = 0)::DOUBLE AS fn, count(*) FILTER (WHERE x.y = 0 AND y.y = 0)::DOUBLE AS tn
  FROM raters x JOIN raters y ON x.video = y.video AND x.frame_idx = y.frame_idx AND x.rater < y.rater GROUP BY ALL),
ag AS (SELECT video, a, b, tp + fp + fn + tn AS n, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS ba_12,
  (coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tn / nullif(tn + fn, 0), 0)) / 2 AS ba_21, least(ba_12, ba_21) AS ia_ba,
  ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n) AS pe, ((tp + tn) / n - pe) / nullif(1 - pe, 0) AS kappa,
  (fp + fn) / nullif(tp + fp + fn, 0) AS disagree_pos, (fp + fn) / n AS disagree FROM pr)"""
_RANKS = """r AS (SELECT *, rank() OVER (PARTITION BY {0} ORDER BY x) + (count(*) OVER (PARTITION BY {0}, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY {0} ORDER BY y) + (count(*) OVER (PARTITION BY {0}, y) - 1) / 2.0 AS ry FROM s)"""
_AVG = """oa AS (SELECT obs, min("T") AS "T", avg(Yhat_a) AS x, avg((coalesce(Y_a, 0) + coalesce(Y_b, 0)) / nullif((Y_a IS NOT NULL)::INT + (Y_b IS NOT NULL)::INT, 0)::DOUBLE) AS y FROM frames_orders GROUP BY obs),
s AS (SELECT * FROM oa WHERE y IS NOT NULL)"""
_FO = V.with_views("frames_orders")
_EV = V.with_views("ev")
_BODY = _EV + """, b AS (SELECT obs, frame_idx, (event_id * 37 % 400)::DOUBLE AS x, (event_id * 53 % 300)::DOUBLE AS y, event_id % 3 = 0 AS seen FROM ev)"""
_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
_REPLICATES = 2000


def _mixed(name: str, source: str, start: str) -> str:
    """Views that end in ``name``: ``source`` with h, the 32-bit mix of ``start``."""
    steps = (start, "xor(h, h >> 16)", "h * 2246822507 % 4294967296", "xor(h, h >> 13)", "h * 3266489909 % 4294967296", "xor(h, h >> 16)")
    names = [f"{name}_{i}" for i in range(len(steps) - 1)] + [name]
    rest = ["* EXCLUDE (h)" if i else "*" for i in range(len(steps))]
    return ", ".join(f"{n} AS MATERIALIZED (SELECT {r}, {x} AS h FROM {f})" for n, f, r, x in zip(names, [source, *names], rest, steps))


_DRAWS = f"""u AS (SELECT obs, "T", Yhat_b, md5('7|' || obs) AS m FROM o), b AS (SELECT obs, "T", Yhat_b, ('0x' || m[1:8])::UBIGINT AS b1, ('0x' || m[9:16])::UBIGINT AS b2 FROM u),
{_mixed('own', f'range(1, {_REPLICATES + 1}) AS g(rep)', 'rep::UBIGINT')}, {_mixed('once', '(SELECT b.*, rep, h AS c FROM b, own)', '(b1 + c) % 4294967296')},
{_mixed('draws', '(SELECT * RENAME (h AS h0) FROM once)', 'xor(h0, b2)')}"""
_PERMUTED = f"""{_DRAWS}, k AS (SELECT rep, Yhat_b, row_number() OVER (PARTITION BY rep ORDER BY h, b1, obs) AS k FROM draws),
c AS (SELECT "T", sum(count(*)) OVER (ORDER BY "T") AS upto FROM o GROUP BY "T"), e AS (SELECT "T", upto, lag(upto, 1, 0) OVER (ORDER BY "T") AS below FROM c),
dealt AS (SELECT rep, e."T", Yhat_b FROM k JOIN e ON k > below AND k <= upto)"""
_F_OF = """{name}_a AS (SELECT rep, count(*) AS n, avg(Yhat_b) AS m, sum(Yhat_b) AS s, var_pop(Yhat_b) * count(*) AS w FROM {source} GROUP BY rep, "T"),
{name}_g AS (SELECT *, sum(s) OVER (PARTITION BY rep) / sum(n) OVER (PARTITION BY rep) AS g FROM {name}_a),
{name} AS (SELECT rep, (sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS f, (count(*) - 1)::BIGINT AS df1, (sum(n) - count(*))::BIGINT AS df2 FROM {name}_g GROUP BY rep)"""
# the normal tail by its series: (2k + 1)!! from the gamma function
_MANN = """w AS (SELECT "T" = 'BUILDING' AS f, y FROM m WHERE "T" IN ('BUILDING', 'MACHINERY') AND y IS NOT NULL),
k AS (SELECT f, y, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS r FROM w),
t AS (SELECT sum(n::DOUBLE * (n::DOUBLE * n - 1)) AS ties FROM (SELECT count(*) AS n FROM w GROUP BY y)),
s AS (SELECT count(*) FILTER (WHERE f) AS n0, count(*) FILTER (WHERE NOT f) AS n1, count(*)::DOUBLE AS n, sum(r) FILTER (WHERE f) AS ranks FROM k),
z AS (SELECT n0, n1, ranks - n0 * (n0 + 1) / 2 AS u, u - n0 * n1 / 2 AS far, sign(far) * greatest(abs(far) - 0.5::DOUBLE, 0) / sqrt(n0 * n1 / 12.0::DOUBLE * (n + 1 - ties / (n * (n - 1)))) AS z FROM s, t)
SELECT n0, n1, round(u, 6) AS u, round(z, 6) AS z, round(CASE WHEN z = 0 THEN 1 ELSE 1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200),
  lambda i: exp((2 * i + 1) * ln(abs(z)) - (i + 1) * ln(2.0::DOUBLE) - lgamma(i + 1.5::DOUBLE) + 0.5::DOUBLE * ln(pi())))) END, 6) AS p FROM z"""


def _numbers(x: np.ndarray) -> str:
    """An array as a DuckDB list of doubles."""
    return "[" + ", ".join(_numbers(v) if v.ndim else f"{float(v):.17e}" for v in x) + "]"


_PROBE = _mlp_layers()
_QUERY, _KEY, _VALUE, _OUT = _attention()
_DOTS = "list_transform({m}, lambda w: list_dot_product({x}, w))"


SQL = {
    "ead_all_pairs": f"""{_OBS}, {_ARMS.format('Y_b')},
q AS (SELECT *, mean1 - mean0 AS ate, sqrt(((n0 - 1) * var0 + (n1 - 1) * var1) / (n0 + n1 - 1)) / sqrt(n0 + n1) AS e FROM p)
SELECT t0, t1, n0, n1, round(ate, 6) AS ate, round(sqrt(var1 / n1 + var0 / n0), 6) AS se, round(ate / nullif(e, 0), 6) AS t, (n0 + n1 - 1)::DOUBLE AS df FROM q""",
    "teb_all_pairs": f"""{_OBS}, {_TEB} SELECT t0, t1, outcome, round(ate_true, 6) AS ate_true, round(ate_true_std, 6) AS ate_true_std, round(ate_pred, 6) AS ate_pred,
  round(ate_pred_std, 6) AS ate_pred_std, round(bias, 6) AS bias, n_true, n_pred FROM e""",
    "teb_average": f"""{_OBS}, {_TEB} SELECT outcome, round(avg(ate_true), 6) AS ate_true, round(avg(ate_pred), 6) AS ate_pred, round(avg(abs(bias)), 6) AS abs_bias,
  round(1.96 * stddev_samp(abs(bias)) / sqrt(count(bias)), 6) AS abs_bias_ci, count(*) AS n_pairs FROM e GROUP BY outcome""",
    "ate_matrix_welch": f"""{_OBS}, {_ARMS.format('Yhat_b')} SELECT t0, t1, round(mean1 - mean0, 6) AS ate, round(sqrt(var1 / n1 + var0 / n0), 6) AS se,
  round({_WELCH}, 6) AS t, round({_WELCH_DF}, 6) AS df FROM p""",
    "ate_versus_control": f"""{_OBS}, {_ARMS.format('Yhat_a').replace('ON a."T" < b."T"', "ON a.\"T\" = 'BUILDING' AND b.\"T\" <> 'BUILDING'")}
SELECT t0, t1, round(mean1 - mean0, 6) AS ate, round(sqrt(var1 / n1 + var0 / n0), 6) AS se, round({_WELCH}, 6) AS t, round({_WELCH_DF}, 6) AS df FROM p""",
    "paired_phase_change": f"""{V.with_views('phases')}, {_DELTA}, g AS (SELECT line, count(*) AS n, avg(delta) AS m, stddev_samp(delta) AS sd FROM d GROUP BY line)
SELECT line, n, round(m, 6) AS ate, round(sd / sqrt(n), 6) AS se, round(m / nullif(sd / sqrt(n), 0), 6) AS t, (n - 1)::DOUBLE AS df, round(m / nullif(sd, 0), 6) AS d FROM g WHERE n >= 2""",
    "genotype_contrast_grouping_sets": f"{V.with_views('phases')}, w AS (SELECT * FROM phases WHERE phase = 1995), {_contrast('w', 'y', True)}",
    "interaction_did": f"{V.with_views('phases')}, {_DELTA}, {_contrast('d', 'delta', False)}",
    "aipw_cellmean": f"""{_OBS}, w AS (SELECT ("T" = 'MACHINERY')::INT AS t, Yhat_b AS y, W_nation AS c FROM o WHERE "T" IN ('BUILDING', 'MACHINERY')),
k AS (SELECT c, avg(t) AS e, avg(y) FILTER (WHERE t = 1) AS m1, avg(y) FILTER (WHERE t = 0) AS m0 FROM w GROUP BY c),
a AS (SELECT avg(y) FILTER (WHERE t = 1) AS a1, avg(y) FILTER (WHERE t = 0) AS a0 FROM w),
f AS (SELECT t, y, least(greatest(e, 0.05), 0.95) AS e, coalesce(m1, a1) AS m1, coalesce(m0, a0) AS m0 FROM w JOIN k USING (c), a),
i AS (SELECT m1 - m0 + t * (y - m1) / e - (1 - t) * (y - m0) / (1 - e) AS v FROM f)
SELECT count(*) AS n, round(avg(v), 6) AS ate, round(sqrt(var_samp(v) / count(*)), 6) AS se, round(avg(v) / sqrt(var_samp(v) / count(*)), 6) AS t, (count(*) - 1)::DOUBLE AS df FROM i""",
    "holm": f"WITH {_TESTS} SELECT id, family, round(p, 9) AS p, round(least(1, max((n - k + 1) * p) OVER (PARTITION BY family ORDER BY k)), 9) AS p_holm FROM k",
    "bh": f"WITH {_TESTS} SELECT id, family, round(p, 9) AS p, round(least(1, min(n * p / k) OVER (PARTITION BY family ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM k",
    "anova_f": f"""{_OBS}, a AS (SELECT count(*) AS n, avg(Yhat_b) AS m, sum(Yhat_b) AS s, var_pop(Yhat_b) * count(*) AS w FROM o GROUP BY "T"),
g AS (SELECT sum(s) / sum(n) AS m FROM a)
SELECT round((sum(n * (a.m - g.m) ** 2) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) AS f, (count(*) - 1)::BIGINT AS df1, (sum(n) - count(*))::BIGINT AS df2 FROM a, g""",
    "mann_whitney_u": f"""{_OBS}, m AS (SELECT "T", Yhat_b AS y FROM o), {_MANN}""",
    "mann_whitney_ties": f"""{_FO}, m AS (SELECT obs, "T", sum(Y_b) AS y FROM frames_orders GROUP BY ALL), {_MANN}""",
    "ead_pvalues": f"""{_OBS}, {_ARMS.format('Y_b')},
q AS (SELECT *, mean1 - mean0 AS ate, sqrt(((n0 - 1) * var0 + (n1 - 1) * var1) / (n0 + n1 - 1)) / sqrt(n0 + n1) AS e FROM p),
r AS (SELECT t0, t1, ate, ate / nullif(e, 0) AS t, (n0 + n1 - 1)::DOUBLE AS df FROM q)
SELECT t0, t1, round(ate, 6) AS ate, round(t, 6) AS t, df, round(0.5::DOUBLE - {t_area('abs(t)')}, 6) AS p FROM r""",
    "ate_matrix_pvalues": f"""{_OBS}, {_ARMS.format('Yhat_b')},
r AS (SELECT t0, t1, mean1 - mean0 AS ate, sqrt(var1 / n1 + var0 / n0) AS se, {_WELCH} AS t, {_WELCH_DF} AS df FROM p),
s AS (SELECT *, 1 - 2 * {t_area('abs(t)')} AS p FROM r)
SELECT t0, t1, round(ate, 6) AS ate, round(se, 6) AS se, round(t, 6) AS t, round(df, 6) AS df, round(p, 6) AS p,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS mark FROM s""",
    "permutation_anova": f"""{_OBS}, {_PERMUTED}, {_F_OF.format(name='seen', source='(SELECT 0 AS rep, "T", Yhat_b FROM o)')}, {_F_OF.format(name='drawn', source='dealt')}
SELECT round(s.f, 6) AS f, s.df1, s.df2, round((1 + count(*) FILTER (WHERE d.f >= s.f - 1e-12)) / {_REPLICATES + 1}.0::DOUBLE, 6) AS p, count(*) AS n_replicates FROM seen s, drawn d GROUP BY ALL""",
    "permutation_pairwise": f"""{_OBS}, {_PERMUTED},
a AS (SELECT 0 AS rep, "T", avg(Yhat_b) AS m FROM o GROUP BY "T" UNION ALL SELECT rep, "T", avg(Yhat_b) FROM dealt GROUP BY ALL),
g AS (SELECT x.rep, x."T" AS t0, y."T" AS t1, y.m - x.m AS gap FROM a x JOIN a y ON x.rep = y.rep AND x."T" < y."T")
SELECT s.t0, s.t1, round(s.gap, 6) AS gap, round((1 + count(*) FILTER (WHERE abs(d.gap) >= abs(s.gap) - 1e-12)) / {_REPLICATES + 1}.0::DOUBLE, 6) AS p
FROM g s JOIN g d ON s.t0 = d.t0 AND s.t1 = d.t1 AND s.rep = 0 AND d.rep > 0 GROUP BY s.t0, s.t1, s.gap""",
    "bootstrap_ci": f"""{_OBS}, {_DRAWS},
w AS (SELECT rep, "T", Yhat_b, {' + '.join(f"(h >= {int(x * (1 << 32))})::INT" for x in _POISSON)} AS n FROM draws WHERE Yhat_b IS NOT NULL),
m AS (SELECT rep, "T", sum(n * Yhat_b) / nullif(sum(n), 0) AS m FROM w GROUP BY ALL)
SELECT "T", round(quantile_cont(m, 0.025), 6) AS low, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY "T\"""",
    "confusion_metrics": f"{_FO}, {_LONG}, c AS (SELECT outcome, {_COUNTS} FROM l GROUP BY outcome) SELECT outcome, {_rates('0')} FROM c",
    "metrics_by_treatment": f"{_FO}, {_LONG}, c AS (SELECT \"T\", outcome, {_COUNTS} FROM l GROUP BY ALL) SELECT \"T\", outcome, {_rates('NULL')} FROM c",
    "macro_metrics": f"""{_FO}, {_LONG}, c AS (SELECT "T", outcome, {_COUNTS} FROM l GROUP BY ALL),
m AS (SELECT "T", (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS a, tp::DOUBLE / nullif(tp + fn, 0) AS r, tn::DOUBLE / nullif(tn + fp, 0) AS s, tp::DOUBLE / nullif(tp + fp, 0) AS p FROM c)
SELECT "T", round(avg(a), 6) AS accuracy, round(avg((r + s) / 2), 6) AS balanced, round(avg(r), 6) AS recall, round(avg(p), 6) AS precision FROM m GROUP BY "T\"""",
    "micro_macro": f"""{_FO}, p AS (SELECT "T", obs, count(*) FILTER (WHERE Y_b = 1 AND Yhat_a >= 0.6) AS tp, sum(Y_b) AS pos FROM frames_orders GROUP BY ALL)
SELECT "T", round(sum(tp)::DOUBLE / sum(pos), 6) AS micro, round(avg(tp::DOUBLE / nullif(pos, 0)), 6) AS macro FROM p GROUP BY "T\"""",
    "continuous_metrics": f'{_FO} SELECT "T", round(avg((Y_b - Yhat_a) ** 2), 6) AS mse, round(avg(abs(Y_b - Yhat_a)), 6) AS mae, count(Y_b) AS n FROM frames_orders GROUP BY "T"',
    "multiclass_bacc": """WITH e AS (SELECT label, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS g FROM embeddings)
SELECT c::INT AS class, (SELECT count(*) FROM e WHERE label = c) AS n, round((SELECT count(*) FROM e WHERE label = c AND g = c)::DOUBLE / greatest((SELECT count(*) FROM e WHERE label = c), 1), 6) AS recall,
  round((SELECT count(*) FROM e WHERE label = c AND g = c)::DOUBLE / greatest((SELECT count(*) FROM e WHERE g = c), 1), 6) AS precision FROM range(12) AS r(c)""",
    "always_zero": f'{_FO} SELECT "T", round(avg((Y_b = 0)::INT), 6) AS accuracy, 0.5::DOUBLE AS balanced FROM frames_orders GROUP BY "T"',
    "rater_agreement": f"""{_AGREE} SELECT video, a, b, n::BIGINT AS n, round(ba_12, 6) AS ba_12, round(ba_21, 6) AS ba_21, round(ia_ba, 6) AS ia_ba, round(kappa, 6) AS kappa,
  round(disagree_pos, 6) AS disagree_pos, round(disagree, 6) AS disagree FROM ag""",
    "worst_pair": f"{_AGREE}, m AS (SELECT a, b, avg(ia_ba) AS m FROM ag GROUP BY ALL) SELECT round(min(m), 6) AS worst, round(avg(m), 6) AS mean, round(max(m), 6) AS best FROM m",
    "noise_bound": f"{_AGREE} SELECT video, a, b, round(disagree, 6) AS disagree, CASE WHEN disagree < 0.5 THEN round(1 - (1 - sqrt(1 - 2 * disagree)) / 2, 6) END AS bound FROM ag",
    "mixed_bound": f"""{_AGREE}, m AS (SELECT a, b, avg(ia_ba) AS m FROM ag GROUP BY ALL),
s AS (SELECT rater, sum(y)::DOUBLE / sum(sum(y)) OVER () AS f FROM raters GROUP BY rater),
x AS (SELECT a, b, m FROM m UNION ALL SELECT b, a, m FROM m UNION ALL SELECT rater, rater, 1.0 FROM s)
SELECT round(sum(p.f * q.f * m) / sum(p.f * q.f), 6) AS bound FROM x JOIN s p ON x.a = p.rater JOIN s q ON x.b = q.rater""",
    "agreement_matrix": f"""{_AGREE}, m AS (SELECT a, b, avg(kappa) AS k FROM ag GROUP BY ALL)
SELECT a AS "row", b AS "column", round(k, 6) AS kappa FROM m UNION ALL SELECT b, a, round(k, 6) FROM m""",
    "disagreement_tags": f"""{V.with_views('raters')}, p AS (SELECT video, frame_idx, 1 - max(y) FILTER (WHERE rater = 'q') AS y1, 1 - max(y) FILTER (WHERE rater = 'n') AS y2 FROM raters WHERE rater <> 't' GROUP BY ALL),
w AS (SELECT *, max(y1) OVER w AS m1, max(y2) OVER w AS m2, max(least(y1, y2)) OVER (PARTITION BY video ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS aft,
  max(least(y1, y2)) OVER (PARTITION BY video ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS bef
  FROM p WINDOW w AS (PARTITION BY video ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT video, frame_idx, y1, y2, concat_ws(',', CASE WHEN m1 = 0 OR m2 = 0 THEN 'event' END, CASE WHEN m1 = 1 AND m2 = 1 THEN 'boundary' END,
  CASE WHEN aft = 1 AND coalesce(bef, 0) = 0 THEN 'start' END, CASE WHEN bef = 1 AND coalesce(aft, 0) = 0 THEN 'end' END) AS tags FROM w WHERE y1 <> y2""",
    "spearman_overall": f"{_FO}, {_AVG}, {_RANKS.format('1')} SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r",
    "spearman_by_condition": f"{_FO}, {_AVG}, {_RANKS.format(chr(34) + 'T' + chr(34))} SELECT \"T\", round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY \"T\"",
    "env_ids": f"""{_FO} SELECT obs, frame_idx, (dense_rank() OVER (ORDER BY "T" || '_' || W_nation::VARCHAR) - 1)::INT AS "E" FROM frames_orders""",
    "derm_weights": f"""{_FO}, y AS (SELECT obs, frame_idx, "T", Y_b FROM frames_orders WHERE Y_b IS NOT NULL),
r AS (SELECT obs, frame_idx, coalesce(var_samp(Y_b) OVER (PARTITION BY "T"), 0) / greatest(count(*) OVER (PARTITION BY "T", Y_b) / (count(*) OVER ())::DOUBLE, 1e-6) AS w FROM y)
SELECT obs, frame_idx, round(w / avg(w) OVER (), 6) AS weight FROM r""",
    "class_weights": "SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight FROM embeddings GROUP BY label",
    "label_encode": "SELECT event_type AS behavior, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS code, count(*) AS n FROM events GROUP BY event_type",
    "concat_datasets": f"""{_OBS}, e AS (SELECT obs, (dense_rank() OVER (ORDER BY "T") - 1)::INT AS "E", "T", W_nation::DOUBLE AS W_nation, round(Y_a, 6) AS Y_a, round(Yhat_a, 6) AS Yhat_a FROM o)
SELECT 'ds0_' || obs AS obs, "E", W_nation, 1.0::DOUBLE AS W_b, "T", Y_a, Yhat_a FROM e
UNION ALL SELECT 'ds1_' || obs, ("E" + (SELECT max("E") + 1 FROM e))::INT, W_nation, 0.0::DOUBLE, "T", Y_a, Yhat_a FROM e WHERE obs % 2 = 0""",
    "topk_leaderboard": f"""{_OBS}, r AS (SELECT W_nation, avg(Yhat_a) AS val, avg(Yhat_b) AS test FROM o GROUP BY W_nation),
k AS (SELECT row_number() OVER (ORDER BY test DESC, W_nation)::INT AS place, W_nation, round(val, 6) AS val, round(test, 6) AS test, (row_number() OVER (ORDER BY val DESC, W_nation) = 1)::INT AS best_val FROM r)
SELECT * FROM k WHERE place <= 10""",
    "stratified_topn": f"""{_FO} SELECT "T", obs, frame_idx, price FROM frames_orders QUALIFY row_number() OVER (PARTITION BY "T" ORDER BY price DESC, obs, frame_idx) <= 5""",
    "stratified_sample": f"""{_OBS} SELECT "T", obs FROM o QUALIFY row_number() OVER (PARTITION BY "T" ORDER BY md5('3|' || obs), obs) <= 20""",
    "round_robin_sample": f"""{_OBS}, r AS (SELECT "T", obs, row_number() OVER (PARTITION BY "T" ORDER BY md5('5|' || obs), obs)::INT AS turn FROM o)
SELECT * FROM r ORDER BY turn, "T" LIMIT 23""",
    "best_by_priority": """SELECT o_custkey AS obs, o_orderkey AS orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) = 1""",
    "val_split_by_obs": f"""{_FO}, u AS (SELECT DISTINCT obs FROM frames_orders),
k AS (SELECT obs, row_number() OVER (ORDER BY md5('11|' || obs), obs) <= greatest(floor(count(*) OVER () * 0.2), 1) AS is_val FROM u)
SELECT obs, frame_idx, is_val FROM frames_orders JOIN k USING (obs)""",
    "negative_sampling": """WITH t AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
n AS (SELECT doc_id, toxic, row_number() OVER (ORDER BY md5('4|' || doc_id), doc_id) AS k FROM t WHERE toxic = 0)
SELECT doc_id, toxic FROM t WHERE toxic > 0 UNION ALL SELECT doc_id, toxic FROM n WHERE k <= (SELECT trunc(count(*) * 1.5) FROM t WHERE toxic > 0)""",
    "grid_configs": """SELECT label::BIGINT AS label, layers::BIGINT AS layers, hidden::BIGINT AS hidden, context::BIGINT AS context, mode, rate::DOUBLE AS rate
FROM (SELECT DISTINCT label FROM embeddings), (SELECT unnest([0, 1, 2]) AS layers), (SELECT unnest([0, 128, 512]) AS hidden), (SELECT unnest([0, 2, 4]) AS context), (SELECT unnest(['none', 'mean', 'concat']) AS mode), (SELECT unnest([0.001, 0.0003]) AS rate)
WHERE (layers = 0) = (hidden = 0) AND (context = 0) = (mode = 'none')""",
    "percentile_background": f"""{V.with_views('vectors')}, e AS (SELECT label, unnest(range(0, 64))::INT AS dim, unnest(x) AS v FROM vectors)
SELECT label, dim, round(quantile_cont(v, 0.85), 6) AS background, round(quantile_cont(v, 0.05), 6) AS low FROM e GROUP BY ALL""",
    "survival_2d": """WITH l AS (SELECT floor(l_quantity / 5)::INT AS s, round(l_discount * 100)::INT AS v FROM lineitem),
h AS (SELECT s, v, count(*) AS n FROM l GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT s FROM h), (SELECT DISTINCT v FROM h))
SELECT g.s, g.v, coalesce(sum(h.n), 0)::BIGINT AS n_at_least FROM g LEFT JOIN h ON h.s >= g.s AND h.v >= g.v GROUP BY ALL""",
    "temperature_grid": f"""{_FO}, l AS (SELECT Y_a AS y, ln(Yhat_a / (1 - Yhat_a)) AS z FROM frames_orders WHERE Y_a IS NOT NULL),
t AS (SELECT unnest([0.25, 0.5, 1.0, 2.0, 4.0, 8.0])::DOUBLE AS temperature), p AS (SELECT temperature, y, least(greatest(1 / (1 + exp(-z / temperature)), 1e-7), 1 - 1e-7) AS p FROM l, t)
SELECT temperature, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS loss FROM p GROUP BY temperature""",
    # the loss is nearly flat about its least: a grid of 2401 log temperatures finds it
    "temperature_search": f"""{_FO}, l AS (SELECT Y_a AS y, ln(Yhat_a / (1 - Yhat_a)) AS z, count(*) AS n FROM frames_orders WHERE Y_a IS NOT NULL GROUP BY ALL),
t AS (SELECT exp(i / 400.0::DOUBLE) AS temperature FROM range(-1200, 1201) AS g(i)),
p AS (SELECT temperature, y, n, least(greatest(1 / (1 + exp(-z / temperature)), 1e-7), 1 - 1e-7) AS p FROM l, t),
s AS (SELECT temperature, sum(n * -(y * ln(p) + (1 - y) * ln(1 - p))) / sum(n) AS loss FROM p GROUP BY temperature) SELECT round(min(loss), 5) AS loss FROM s""",
    "linear_probe_scores": f"""{V.with_views('vectors')}
SELECT frame_idx, round(1 / (1 + exp(-(0.1 + list_sum(list_transform(range(1, 65), lambda i: x[i] * (((i - 1) * 37) % 11 - 5) / 10.0::DOUBLE))))), 6) AS score FROM vectors""",
    "mlp_scores_udf": f"""{V.with_views('vectors')}, h AS (SELECT frame_idx, list_transform({_DOTS.format(m=_numbers(_PROBE[0][0].T), x='x')}, lambda v: greatest(v, 0)) AS h FROM vectors)
SELECT frame_idx, round(1 / (1 + exp(-list_dot_product(h, {_numbers(_PROBE[1][0][:, 0])}))), 6) AS score FROM h""",
    "attention_pool_udf": f"""{V.with_views('vectors')}, {_clamped('x', 'vectors', '', 2)},
e AS (SELECT a.frame_idx, b.o, a.x AS middle, list_dot_product({_DOTS.format(m=_numbers(_QUERY.T), x='a.x')}, {_DOTS.format(m=_numbers(_KEY.T), x='b.v')}) / sqrt(8) AS logit,
  {_DOTS.format(m=_numbers(_VALUE.T), x='b.v')} AS v FROM vectors a JOIN c b ON a.obs = b.obs AND a.frame_idx = b.frame_idx),
s AS (SELECT frame_idx, middle, v, exp(logit) / sum(exp(logit)) OVER (PARTITION BY frame_idx) AS p FROM e),
u AS (SELECT frame_idx, unnest(range(1, 65)) AS i, unnest(middle) AS m, unnest(v) * p AS v FROM s),
h AS (SELECT frame_idx, i, any_value(m) + sum(v) AS h FROM u GROUP BY frame_idx, i),
n AS (SELECT frame_idx, i, (h - avg(h) OVER w) / sqrt(var_pop(h) OVER w + 1e-5) AS h FROM h WINDOW w AS (PARTITION BY frame_idx))
SELECT frame_idx, round(1 / (1 + exp(-sum(h * {_numbers(_OUT)}[i]))), 6) AS score FROM n GROUP BY frame_idx""",
    "min_gap_dedupe": _EV.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT DISTINCT obs, minute FROM ev WHERE behavior = 'error'),
k AS (SELECT obs, min(minute) AS minute FROM e GROUP BY obs UNION ALL SELECT k.obs, (SELECT min(e.minute) FROM e WHERE e.obs = k.obs AND e.minute >= k.minute + 2000) FROM k WHERE k.minute IS NOT NULL)
SELECT obs, minute FROM k WHERE minute IS NOT NULL""",
    "leash_fold": _BODY.replace("WITH ", "WITH RECURSIVE ", 1) + """,
f AS (SELECT obs, frame_idx, CASE WHEN seen THEN x + 5 ELSE x END AS mark_x, CASE WHEN seen THEN y - 5 ELSE y END AS mark_y FROM b WHERE frame_idx = 0
  UNION ALL SELECT b.obs, b.frame_idx, CASE WHEN seen THEN x + 5 WHEN sqrt((mark_x - x) ** 2 + (mark_y - y) ** 2) <= 150 THEN mark_x ELSE x END,
  CASE WHEN seen THEN y - 5 WHEN sqrt((mark_x - x) ** 2 + (mark_y - y) ** 2) <= 150 THEN mark_y ELSE y END FROM f JOIN b ON b.obs = f.obs AND b.frame_idx = f.frame_idx + 1)
SELECT obs, frame_idx, mark_x, mark_y FROM f""",
    "proximity_flags": _EV + """ SELECT obs, frame_idx, CASE frame_idx % 4 WHEN 1 THEN 1 WHEN 0 THEN 0 ELSE (frame_idx % 7 * 20 < 80)::INT END AS "B2F",
  CASE frame_idx % 4 WHEN 1 THEN 1 WHEN 0 THEN 0 ELSE (frame_idx % 5 * 30 < 80)::INT END AS "Y2F" FROM ev""",
    "detection_rates": _BODY + " SELECT obs, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE seen) / count(*), 6) AS percent, round(avg(x) FILTER (WHERE seen), 6) AS mean_x FROM b GROUP BY obs",
    "embedding_frame_quality": """SELECT 'frame without vector' AS what, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id * 3 FROM embeddings)
UNION ALL SELECT 'vector without frame', count(*) FROM embeddings WHERE vec_id * 3 NOT IN (SELECT doc_id FROM documents)""",
    "file_stats": """SELECT source, CASE WHEN count(DISTINCT lang) <= 1 THEN min(lang) ELSE 'INCONSISTENT' END AS lang, min(n_chars) AS least, max(n_chars) AS most,
  sum(n_chars)::BIGINT AS total, count(*) AS n FROM documents GROUP BY source""",
    "evenly_spaced_frames": f"""{_FO}, n AS (SELECT obs, frame_idx, count(*) OVER (PARTITION BY obs) AS n FROM frames_orders)
SELECT DISTINCT obs, frame_idx FROM n, range(4) AS r(j) WHERE frame_idx = floor(j * (n - 1) / 3.0::DOUBLE)""",
    "offset_limit_slice": f"{_FO} SELECT obs, frame_idx, price FROM frames_orders WHERE frame_idx BETWEEN 2 AND 4",
    "error_rows": f"""{_FO} SELECT obs, frame_idx, "T" FROM frames_orders WHERE Y_a IS NOT NULL AND Y_b IS NOT NULL AND "T" IN ('BUILDING', 'MACHINERY')
  AND (round_even(Yhat_a, 0) <> Y_a OR round_even(Yhat_b, 0) <> Y_b)""",
    "training_diagnostics": """WITH p AS (SELECT c_nationkey, year(o_orderdate) AS epoch, avg(o_totalprice) AS loss FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_nationkey, round(arg_min(loss, epoch), 6) AS first, round(arg_max(loss, epoch), 6) AS last, round(min(loss), 6) AS best, arg_min(epoch, loss)::INT AS best_epoch,
  (arg_max(loss, epoch) > 1.05 * arg_min(loss, epoch))::INT AS diverged FROM p GROUP BY c_nationkey""",
}
