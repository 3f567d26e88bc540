"""Queries on scans, joins, assignments, reshaping and selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.roles import in_order, roles
from ..operators import aggregate, labels, metrics, relate, resample, search
from ..sources import readers
from ..sources.readers import is_valid
from ..sources.tables import table
from . import views as V
from .analysis import _AGREE, _ARMS, _BODY, _COUNTS, _EV, _FO, _LONG, PAIRS, _bodies, rounded
from .frames import _OBS, r6


def _obs(spark, d):
    return aggregate.observation_level(V.frames_orders(spark, d).drop("price"))


def scan_filter_valid(spark, d):
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("obs"), F.when(F.col("c_acctbal") < 0, "0").when(F.col("c_custkey") % 5 == 0, None).otherwise("1").alias("valid"))
    return e.where(is_valid(e)).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


def role_projection(spark, d):
    rows = in_order(V.frames_orders(spark, d).drop("price"), ("obs", "frame_idx", "T"))
    r = roles(rows)
    return rows.select("obs", "frame_idx", *r.covariates, *r.outcomes)


def json_props_extract(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def filename_id_parse(spark, d):
    p = table(spark, d, "pages")
    name = F.concat(F.lit("frames/full/frame_"), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit(".jpg"))
    ids = F.concat_ws("_", F.lit("wt"), F.concat(F.lit("l"), (F.col("page_id") % 3).cast("string")), F.lit("m"), (F.col("page_id") % 7).cast("string"), F.lit("soc"), F.lit("p1"))
    return p.select("page_id", C.frame_of_file(name).alias("frame_idx"), C.stem(name).alias("stem"), C.pool_of(ids).alias("pool"), C.frame_file(F.col("page_id")).alias("file"))


def stride_subsample(spark, d):
    return V.frames_orders(spark, d).where("frame_idx % 3 = 0 and Y_a is not null and Y_b is not null").select("obs", "frame_idx")


def tracking_left_join(spark, d):
    t = _bodies(spark, d).where("frame_idx % 2 = 0")
    frames = V.events(spark, d).select("obs", "frame_idx")
    return relate.with_tracking(frames, t, ("raw_x", "x"))


def vector_hconcat(spark, d):
    v = V.vectors(spark, d)
    a, b = v.select("obs", "frame_idx", F.slice("x", 33, 32).alias("x")), v.select("obs", "frame_idx", F.slice("x", 1, 32).alias("x"))
    rows = relate.joined_vectors([a, b], ["x", "x"])
    return rows.select("frame_idx", F.size("x").alias("n"), r6(F.element_at("x", 1), "first"), r6(F.aggregate("x", F.lit(0.0), lambda s, x: s + x), "total"))


def _blobs(spark, d):
    b = _bodies(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("blob"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for i, (dx, dy) in enumerate(((0, 0), (40, 10), (-60, -20)))]))
    return b.select("obs", "frame_idx", each.alias("b")).select("obs", "frame_idx", "b.*")


def nearest_blob(spark, d):
    m = _bodies(spark, d)
    marks = m.select("obs", "frame_idx", F.explode(F.array(F.struct(F.lit("a").alias("mark"), (F.col("x") + 30).alias("mark_x"), F.col("y").alias("mark_y")), F.struct(F.lit("b").alias("mark"), (F.col("x") - 45).alias("mark_x"), (F.col("y") - 5).alias("mark_y")))).alias("m"))
    return rounded(relate.nearest(marks.select("obs", "frame_idx", "m.*"), _blobs(spark, d), ("obs", "frame_idx")), "obs", "frame_idx", "mark")


def min_cost_pairs(spark, d):
    blobs = _blobs(spark, d)
    agents = F.explode(F.array(F.struct(F.lit(0).alias("agent"), F.abs(F.col("x") - 100).alias("cost")), F.struct(F.lit(1).alias("agent"), F.abs(F.col("x") - 120).alias("cost"))))
    options = blobs.select("obs", "frame_idx", F.col("blob").alias("slot"), agents.alias("a")).select("obs", "frame_idx", "slot", "a.*")
    room = blobs.select("obs", "frame_idx", F.col("blob").alias("slot"), (1 + (F.col("obs") + F.col("blob")) % 2).alias("room"))
    return rounded(relate.cheapest_pair(options, room, ("obs", "frame_idx")), "obs", "frame_idx")


def worklist_status(spark, d):
    e = V.events(spark, d)
    animals = e.select("obs", F.col("behavior").alias("animal"))
    return relate.work_list(e.select("obs").distinct(), animals, e.where("value > 95").select("obs", F.col("behavior").alias("animal")))


def crop_states(spark, d):
    """Users with a signup as experiments with a video, all kinds of event as animals; a
    high value is done, a low one failed."""
    e = V.events(spark, d).withColumn("animal", F.col("behavior"))
    videos = e.groupBy("obs").agg(F.max(F.when(F.col("behavior") == "signup", "v.mp4")).alias("video"))
    return relate.work_states(videos, e, e.where("value > 95"), e.where("value < 3"))


def animal_positions(spark, d):
    """Every frame with the blue animal's place, or the middle where it was not seen."""
    b = _bodies(spark, d)
    long = b.where("raw_x is not null").select("obs", "frame_idx", F.lit("blue").alias("animal"), F.col("raw_x").alias("x"), F.col("raw_y").alias("y"))
    other = b.select("obs", "frame_idx", F.lit("yellow").alias("animal"), "x", "y")
    return relate.positions(b.select("obs", "frame_idx"), long.unionByName(other), "blue", (200, 150))


def distinct_lists(spark, d):
    found = readers.distinct_lists(table(spark, d, "customer"), "c_mktsegment", "c_nationkey", "none")
    return found.select(*[F.array_join(c, ",").alias(c) for c in found.columns])


def derived_covariates(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("obs"), "c_nationkey", "c_acctbal")
    rows = relate.covariates_from(V.frames_orders(spark, d).select("obs", "frame_idx"), c, ("c_nationkey", "c_acctbal", "none"))
    return rows.groupBy("W_c_nationkey").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("W_c_acctbal"), "mean"))


def shared_treatments(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 400000")
    years = [o.where(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("obs")) for y in (1996, 1997)]
    return years[0].intersect(years[1])


def text_coercions(spark, d):
    e = table(spark, d, "events").withColumn("s", F.element_at(F.array(*[F.lit(x) for x in ("Yes", " no", "1", "maybe", "12.5")]), (F.col("event_id") % 5 + 1).cast("int")))
    return e.groupBy("s").agg(F.max(relate.boolean_of(F.col("s")).cast("int")).alias("flag"), F.max(F.expr("try_cast(s as double)")).alias("number"), F.count(F.lit(1)).alias("n"))


def cohort_balance(spark, d):
    c = table(spark, d, "customer").dropDuplicates(["c_custkey"])
    return c.groupBy("c_mktsegment", (F.col("c_nationkey") % 2).alias("sex")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("c_acctbal") > 0).cast("long")).alias("n_positive"))


def any_positive_frames(spark, d):
    f = V.frames_orders(spark, d)
    return f.groupBy("obs").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.greatest("Y_a", "Y_b") > 0, F.col("frame_idx")))), ",").alias("frames"))


def value_fractions(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("all"))
    return n.crossJoin(F.broadcast(total)).select("event_type", r6(F.col("n") / F.col("all"), "share"))  # one row


def dataset_summary(spark, d):
    f = V.frames_orders(spark, d)
    return f.agg(F.count(F.lit(1)).alias("n_frames"), F.countDistinct("obs").alias("n_obs"), F.countDistinct("T").alias("n_arms"), F.countDistinct("T", "W_nation").alias("n_envs"), F.count_if(F.col("Y_a").isNull()).alias("n_missing"))


def rater_summary(spark, d):
    a = metrics.rater_agreement(V.raters(spark, d))
    return rounded(a.groupBy("a", "b").agg(F.avg("ia_ba").alias("mean"), F.min("ia_ba").alias("least"), F.max("ia_ba").alias("most")), "a", "b")


def relative_topk(spark, d):
    return search.near_best(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.99, 25, F.col("o_orderkey"))


def n_largest(spark, d):
    return resample.top_per_group(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ("l_orderkey",), 2, F.desc("l_quantity"), F.col("l_linenumber"))


def pool_split(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("pool"))
    return resample.split_by_unit(n, "pool", 0.25, 9)


def row_split(spark, d):
    h = F.conv(F.substring(resample.hash_order("doc_id", seed=42), 1, 4), 16, 10).cast("long")
    return table(spark, d, "documents").select("doc_id", (h < 13107).alias("is_test"))


def best_across_sources(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    return o.groupBy("o_orderpriority").agg(F.max_by(F.struct("o_custkey", "o_orderkey"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("m")).select("o_orderpriority", "m.*")


def distinct_keep_first(spark, d):
    e = V.events(spark, d)
    return resample.top_per_group(e.select("obs", "behavior", "event_id", "k"), ("obs", "behavior"), 1, F.col("event_id"))


def ordered_union(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    return c.select("conv_id", F.array_join(F.array_distinct(F.concat("r", F.array(F.lit("user"), F.lit("end")))), ",").alias("roles"))


def membership_two(spark, d):
    e = V.events(spark, d)
    per = e.where("behavior in ('signup', 'error')").groupBy("obs").agg(F.array_sort(F.collect_set("behavior")).alias("b"))
    return per.where(F.size("b") >= 2).select("obs", F.array_join("b", ",").alias("behaviors"))


def tidy_metrics(spark, d):
    m = metrics.binary_metrics(V.frames_orders(spark, d), PAIRS, ("T",))
    return rounded(m.select("T", "outcome", "accuracy", "recall", "precision").unpivot(["T", "outcome"], ["accuracy", "recall", "precision"], "metric", "value"), "T", "outcome", "metric")


def bound_grid_search(spark, d):
    f = V.frames_orders(spark, d).where("Y_a is not null").select("price", "Y_a")
    return rounded(search.bound_grid(f, "price", "Y_a", (0.0, 50000.0, 100000.0, 200000.0), (150000.0, 300000.0, 500000.0)), "low", "high")


def estimator_dispatch(spark, d):
    o = _obs(spark, d)
    rows = [search.estimate(o, m, "Yhat_a", "T", "BUILDING", "MACHINERY", ("W_nation",)).select(F.lit(m).alias("method"), r6(F.col("ate"), "ate")) for m in ("ead", "welch")]
    return rows[0].unionByName(rows[1])


def slot_join(spark, d):
    """Annotated and tracked frames that both have, by key, not by position."""
    a = V.events(spark, d).where("frame_idx % 2 = 0").select("obs", "frame_idx", "k")
    b = V.events(spark, d).where("frame_idx % 3 = 0").select("obs", "frame_idx", "value")
    return a.join(b, ["obs", "frame_idx"]).groupBy("obs").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


def long_tracking(spark, d):
    b = _bodies(spark, d).select("obs", "frame_idx", F.col("x").alias("blue"), F.col("y").alias("yellow"))
    return b.unpivot(["obs", "frame_idx"], ["blue", "yellow"], "animal", "x")


def summary_with_total(spark, d):
    """Counts by arm, and in all, by grouping sets."""
    rows = V.frames_orders(spark, d).rollup("T").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("price"))
    return rounded(rows.select(F.coalesce("T", F.lit("All")).alias("T"), "n", "price"), "T")


def frame_gaps(spark, d):
    w = Window.partitionBy("obs").orderBy("minute", "event_id")
    e = V.events(spark, d).withColumn("gap", F.col("minute") - F.lag("minute").over(w))
    return e.groupBy("obs").agg(F.max("gap").alias("longest"), r6(F.avg("gap"), "mean"))


def bout_expansion_counts(spark, d):
    hits = labels.expand_bouts(V.observations(spark, d), V.bouts(spark, d))
    return hits.groupBy("obs", "behavior").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    scan_filter_valid, role_projection, json_props_extract, filename_id_parse, stride_subsample, tracking_left_join, vector_hconcat, nearest_blob,
    min_cost_pairs, worklist_status, crop_states, animal_positions, distinct_lists, derived_covariates, shared_treatments, text_coercions, cohort_balance, any_positive_frames, value_fractions,
    dataset_summary, rater_summary, relative_topk, n_largest, pool_split, row_split, best_across_sources, distinct_keep_first, ordered_union,
    membership_two, tidy_metrics, bound_grid_search, estimator_dispatch, slot_join, long_tracking, summary_with_total, frame_gaps, bout_expansion_counts,
)}

SQL = {
    "scan_filter_valid": "WITH e AS (SELECT CASE WHEN c_acctbal < 0 THEN '0' WHEN c_custkey % 5 = 0 THEN NULL ELSE '1' END AS valid FROM customer) SELECT valid, count(*) AS n FROM e WHERE coalesce(valid, '1') <> '0' GROUP BY valid",
    "role_projection": f"{_FO} SELECT obs, frame_idx, W_nation, Y_a, Y_b FROM frames_orders",
    "json_props_extract": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "filename_id_parse": """SELECT page_id, page_id AS frame_idx, 'frame_' || lpad(page_id::VARCHAR, 6, '0') AS stem, 'l' || page_id % 3 || '_m_' || page_id % 7 AS pool, 'frame_' || lpad(page_id::VARCHAR, 6, '0') || '.jpg' AS file FROM pages""",
    "stride_subsample": f"{_FO} SELECT obs, frame_idx FROM frames_orders WHERE frame_idx % 3 = 0 AND Y_a IS NOT NULL AND Y_b IS NOT NULL",
    "tracking_left_join": f"{_BODY} SELECT obs, frame_idx, CASE WHEN frame_idx % 2 = 0 AND seen THEN x + 5 ELSE 0 END AS raw_x, CASE WHEN frame_idx % 2 = 0 THEN x ELSE 0 END AS x FROM b",
    "vector_hconcat": f"{V.with_views('vectors')} SELECT frame_idx, 64::INT AS n, round(x[33], 6) AS first, round(list_sum(x), 6) AS total FROM vectors",
    "nearest_blob": f"""{_BODY}, m AS (SELECT obs, frame_idx, unnest(['a', 'b']) AS mark, unnest([x + 30, x - 45]) AS mx, unnest([y, y - 5]) AS my FROM b),
l AS (SELECT obs, frame_idx, unnest([0, 1, 2]) AS blob, unnest([x, x + 40, x - 60]) AS x, unnest([y, y + 10, y - 20]) AS y FROM b),
g AS (SELECT m.obs, m.frame_idx, mark, blob, sqrt((mx - x) ** 2 + (my - y) ** 2) AS gap FROM m JOIN l ON m.obs = l.obs AND m.frame_idx = l.frame_idx)
SELECT obs, frame_idx, mark, arg_min(blob, gap)::INT AS blob, round(min(gap), 6) AS gap FROM g GROUP BY ALL""",
    "min_cost_pairs": f"""{_BODY}, l AS (SELECT obs, frame_idx, unnest([0, 1, 2]) AS slot, unnest([x, x + 40, x - 60]) AS x FROM b),
p AS (SELECT a.obs, a.frame_idx, a.slot AS s0, c.slot AS s1, abs(a.x - 100) + abs(c.x - 120) AS cost FROM l a JOIN l c ON a.obs = c.obs AND a.frame_idx = c.frame_idx
  WHERE a.slot <> c.slot OR 1 + (a.obs + a.slot) % 2 >= 2)
SELECT obs, frame_idx, s0, s1, round(cost, 6) AS cost FROM p QUALIFY row_number() OVER (PARTITION BY obs, frame_idx ORDER BY cost, s0, s1) = 1""",
    "worklist_status": "SELECT user_id AS obs, event_type AS animal, CASE WHEN max(value) > 95 THEN 'done' ELSE 'open' END AS status FROM events GROUP BY ALL",
    "crop_states": """WITH v AS (SELECT DISTINCT user_id AS obs FROM events WHERE event_type = 'signup'), a AS (SELECT DISTINCT event_type AS animal FROM events),
m AS (SELECT user_id AS obs, event_type AS animal, max(value) > 95 AS done, min(value) < 3 AS failed FROM events GROUP BY ALL)
SELECT v.obs, a.animal, CASE WHEN done THEN 'done' WHEN failed THEN 'failed' ELSE 'open' END AS status FROM v CROSS JOIN a LEFT JOIN m ON m.obs = v.obs AND m.animal = a.animal""",
    "animal_positions": f"{_BODY} SELECT obs, frame_idx, CASE WHEN seen THEN trunc(x + 5)::INT ELSE 200 END AS x, CASE WHEN seen THEN trunc(y - 5)::INT ELSE 150 END AS y, seen AS found FROM b",
    "distinct_lists": """SELECT string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS c_mktsegment, string_agg(DISTINCT c_nationkey::VARCHAR, ',' ORDER BY c_nationkey::VARCHAR) AS c_nationkey, '' AS "none" FROM customer""",
    "derived_covariates": "SELECT c_nationkey AS W_c_nationkey, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "shared_treatments": """SELECT o_custkey AS obs FROM orders WHERE o_totalprice > 400000 AND year(o_orderdate) = 1996
INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 400000 AND year(o_orderdate) = 1997""",
    "text_coercions": """WITH e AS (SELECT ['Yes', ' no', '1', 'maybe', '12.5'][event_id % 5 + 1] AS s FROM events)
SELECT s, max(CASE WHEN lower(trim(s)) IN ('true', 'yes', '1', 'on') THEN 1 WHEN lower(trim(s)) IN ('false', 'no', '0', 'off') THEN 0 END) AS flag, max(try_cast(s AS DOUBLE)) AS number, count(*) AS n FROM e GROUP BY s""",
    "cohort_balance": "SELECT c_mktsegment, c_nationkey % 2 AS sex, count(*) AS n, sum((c_acctbal > 0)::BIGINT)::BIGINT AS n_positive FROM customer GROUP BY ALL",
    "any_positive_frames": f"{_FO} SELECT obs, coalesce(string_agg(frame_idx::VARCHAR, ',' ORDER BY frame_idx) FILTER (WHERE greatest(Y_a, Y_b) > 0), '') AS frames FROM frames_orders GROUP BY obs",
    "value_fractions": "SELECT event_type, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM events GROUP BY event_type",
    "dataset_summary": f"""{_FO} SELECT count(*) AS n_frames, count(DISTINCT obs) AS n_obs, count(DISTINCT "T") AS n_arms, count(DISTINCT "T" || W_nation) AS n_envs, count(*) FILTER (WHERE Y_a IS NULL) AS n_missing FROM frames_orders""",
    "rater_summary": f"{_AGREE} SELECT a, b, round(avg(ia_ba), 6) AS mean, round(min(ia_ba), 6) AS least, round(max(ia_ba), 6) AS most FROM ag GROUP BY ALL",
    "relative_topk": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 0.99::DOUBLE * (SELECT max(o_totalprice) FROM orders) ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "n_largest": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) <= 2",
    "pool_split": "SELECT n_name AS pool, row_number() OVER (ORDER BY md5('9|' || n_name), n_name) <= greatest(floor(count(*) OVER () * 0.25), 1) AS is_val FROM nation",
    "row_split": "SELECT doc_id, substr(md5('42|' || doc_id), 1, 4) < '3333' AS is_test FROM documents",
    "best_across_sources": "SELECT o_orderpriority, o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "distinct_keep_first": f"{_EV} SELECT obs, behavior, event_id, k FROM ev QUALIFY row_number() OVER (PARTITION BY obs, behavior ORDER BY event_id) = 1",
    "ordered_union": """WITH r AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL UNION ALL SELECT DISTINCT conv_id, unnest(['user', 'end']), unnest([1000000, 1000001]) FROM conversations),
f AS (SELECT conv_id, role, min(t) AS t FROM r GROUP BY ALL) SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM f GROUP BY conv_id""",
    "membership_two": "SELECT user_id AS obs, 'error,signup' AS behaviors FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id HAVING count(DISTINCT event_type) >= 2",
    "tidy_metrics": f"""{_FO}, {_LONG}, c AS (SELECT "T", outcome, {_COUNTS} FROM l GROUP BY ALL)
SELECT "T", outcome, unnest(['accuracy', 'recall', 'precision']) AS metric, unnest([round(coalesce((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0), 6),
  round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6), round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6)]) AS value FROM c""",
    "bound_grid_search": f"""{_FO}, g AS (SELECT * FROM (SELECT unnest([0.0, 50000.0, 100000.0, 200000.0])::DOUBLE AS low), (SELECT unnest([150000.0, 300000.0, 500000.0])::DOUBLE AS high) WHERE low < high),
c AS (SELECT low, high, count(*) FILTER (WHERE price BETWEEN low AND high AND Y_a = 1) AS tp, count(*) FILTER (WHERE price BETWEEN low AND high AND Y_a = 0) AS fp,
  count(*) FILTER (WHERE NOT price BETWEEN low AND high AND Y_a = 1) AS fn FROM frames_orders, g WHERE Y_a IS NOT NULL GROUP BY ALL)
SELECT low, high, tp, fp, fn, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1 FROM c""",
    "estimator_dispatch": f"""{_OBS}, {_ARMS.format('Yhat_a')} SELECT unnest(['ead', 'welch']) AS method, round(mean1 - mean0, 6) AS ate FROM p WHERE t0 = 'BUILDING' AND t1 = 'MACHINERY'""",
    "slot_join": f"{_EV} SELECT obs, count(*) AS n, sum(k)::BIGINT AS k FROM ev WHERE frame_idx % 6 = 0 GROUP BY obs",
    "long_tracking": f"{_BODY} SELECT obs, frame_idx, unnest(['blue', 'yellow']) AS animal, unnest([x, y]) AS x FROM b",
    "summary_with_total": f"""{_FO} SELECT coalesce("T", 'All') AS "T", count(*) AS n, round(avg(price), 6) AS price FROM frames_orders GROUP BY ROLLUP ("T")""",
    "frame_gaps": f"{_EV}, g AS (SELECT obs, minute - lag(minute) OVER (PARTITION BY obs ORDER BY minute, event_id) AS gap FROM ev) SELECT obs, max(gap) AS longest, round(avg(gap), 6) AS mean FROM g GROUP BY obs",
    "bout_expansion_counts": f"""{V.with_views('ev', 'bouts', 'observations')}, f AS (SELECT obs, unnest(range(0, n_frames)) AS i, "offset", ratio FROM observations)
SELECT b.obs, behavior, count(*) AS n FROM bouts b JOIN f ON f.obs = b.obs AND "offset" + i * ratio >= start_frame AND "offset" + i * ratio < end_frame GROUP BY ALL""",
}
