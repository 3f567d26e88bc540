"""The driver's tables seen as experiments, each as Spark plan and as SQL.

``SQL_VIEWS`` has the same views as common table expressions for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table

#: An order counts as large from this price on.
LARGE = 250000.0
BEHAVIOURS = {"view": (1, 0), "click": (0, 1), "purchase": (1, 1), "signup": (0, 0), "error": (0, 0)}
OUTCOMES = ("y2f", "b2f")


def frames_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as observations, their orders as frames, the segment as treatment.
    A quarter of the customers are partly annotated."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    missing = (F.col("o_custkey") % 4 == 3) & (F.col("o_orderstatus") == "P")
    price = F.col("o_totalprice")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return rows.select(
        F.col("o_custkey").alias("obs"), (F.row_number().over(w) - 1).cast("long").alias("frame_idx"),
        F.col("c_mktsegment").alias("T"), F.col("c_nationkey").alias("W_nation"),
        F.when(~missing, (F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("Y_a"),
        F.when(~missing, (price > LARGE).cast("int")).alias("Y_b"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-(price - LARGE) / 100000.0))).alias("Yhat_a"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-(price - LARGE) / 25000.0))).alias("Yhat_b"),
        price.alias("price"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as observations; minutes since the first day as an integer clock."""
    minute = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 60000000).cast("long")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("obs"), "event_id", F.col("event_type").alias("behavior"), "value", k.alias("k"),
        minute.alias("minute"), (F.row_number().over(w) - 1).cast("long").alias("frame_idx"), "ts",
    )


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("obs", F.col("event_id").alias("ord"), "behavior", F.col("minute").alias("start_frame"), (F.col("minute") + 30).alias("end_frame"), "k")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation of 2000 frames of 6 minutes each for every user."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("obs")).distinct()
    return users.select("obs", F.lit(2000).cast("long").alias("n_frames"), F.lit(12).cast("long").alias("offset"), F.lit(6.0).alias("ratio"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty embeddings make an observation."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 50).cast("long").alias("obs"), F.col("vec_id").alias("frame_idx"), F.col("embedding").cast("array<double>").alias("x"), "label")


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as units, years as phases, segments as groups, with mean price."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    unit = F.concat_ws("_", "n_name", "c_mktsegment")
    return rows.groupBy(
        unit.alias("unit"), F.year("o_orderdate").cast("int").alias("phase"), F.col("c_mktsegment").alias("line"), F.col("n_regionkey").cast("string").alias("sex")
    ).agg(F.avg("o_totalprice").alias("y"))


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three raters of documents: high quality, not toxic, long text."""
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    rows = lab.join(docs, "doc_id")
    marks = F.array(
        F.struct(F.lit("q").alias("rater"), F.col("quality").cast("int").alias("y")),
        F.struct(F.lit("t").alias("rater"), (F.lit(1) - F.col("toxic")).cast("int").alias("y")),
        F.struct(F.lit("n").alias("rater"), (F.col("n_chars") > 400).cast("int").alias("y")),
    )
    return rows.select(F.col("source").alias("video"), F.col("doc_id").alias("frame_idx"), F.explode(marks).alias("m")).select("video", "frame_idx", "m.*")


SQL_VIEWS = {
    "frames_orders": f"""frames_orders AS (
  SELECT o_custkey AS obs, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS frame_idx,
    c_mktsegment AS "T", c_nationkey AS W_nation,
    CASE WHEN NOT (o_custkey % 4 = 3 AND o_orderstatus = 'P') THEN (o_orderpriority = '1-URGENT')::INT END AS Y_a,
    CASE WHEN NOT (o_custkey % 4 = 3 AND o_orderstatus = 'P') THEN (o_totalprice > {LARGE})::INT END AS Y_b,
    1.0::DOUBLE / (1.0::DOUBLE + exp(-(o_totalprice - {LARGE}) / 100000.0::DOUBLE)) AS Yhat_a,
    1.0::DOUBLE / (1.0::DOUBLE + exp(-(o_totalprice - {LARGE}) / 25000.0::DOUBLE)) AS Yhat_b, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "ev": """ev AS (
  SELECT user_id AS obs, event_id, event_type AS behavior, value, json_extract_string(props, '$.k')::BIGINT AS k,
    (epoch_us(ts) - 1704067200000000) // 60000000 AS minute,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, ts FROM events)""",
    "bouts": """bouts AS (SELECT obs, event_id AS ord, behavior, minute AS start_frame, minute + 30 AS end_frame, k FROM ev)""",
    "observations": """observations AS (SELECT DISTINCT user_id AS obs, 2000 AS n_frames, 12 AS "offset", 6.0::DOUBLE AS ratio FROM events)""",
    "vectors": """vectors AS (SELECT vec_id // 50 AS obs, vec_id AS frame_idx, embedding::DOUBLE[] AS x, label FROM embeddings)""",
    "phases": """phases AS (
  SELECT n_name || '_' || c_mktsegment AS unit, year(o_orderdate)::INT AS phase, c_mktsegment AS line, n_regionkey::VARCHAR AS sex, avg(o_totalprice) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)""",
    "raters": """lab AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
raters AS (
  SELECT source AS video, doc_id AS frame_idx, unnest(['q', 't', 'n']) AS rater, unnest([quality::INT, (1 - toxic)::INT, (n_chars > 400)::INT]) AS y
  FROM lab JOIN documents USING (doc_id))""",
}


def with_views(*names: str) -> str:
    """WITH and the named views, to be followed by a comma or a SELECT."""
    return "WITH " + ",\n".join(SQL_VIEWS[n] for n in names)
