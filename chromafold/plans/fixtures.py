"""Standard data sets over the star schema tables, each as ``Examples`` and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromafold.sources.readers import Examples, from_columns, from_words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def basket(spark: SparkSession, sf_dir: str, part: str | None = None) -> Examples:
    """Orders as lines, part keys as words, target: the order is finished. Part: train (7 of 10 orders) or valid."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") == "F").cast("double").alias("target"))
    if part:
        chosen = F.col("l_orderkey") % 10 < 7 if part == "train" else F.col("l_orderkey") % 10 >= 7
        items, orders = items.where(chosen), orders.where(chosen)
    lines = orders.join(items, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("ex_id"), "target")
    words = items.join(orders.select("l_orderkey"), "l_orderkey", "left_semi")
    return Examples(lines, from_words(words, "l_orderkey", F.col("l_partkey")))


BASKET = """
basket AS (SELECT l_orderkey AS ex_id, CAST(l_partkey AS VARCHAR) AS key, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS target
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
lines AS (SELECT DISTINCT ex_id, target FROM basket),
vocab AS (SELECT key, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, key) - 1 AS fid FROM basket GROUP BY key),
features AS (SELECT DISTINCT ex_id, fid FROM basket JOIN vocab USING (key)),
edges AS (SELECT a.fid AS l, b.fid AS r, count(*) AS freq FROM features a JOIN features b ON a.ex_id = b.ex_id AND a.fid < b.fid GROUP BY 1, 2)"""

BASKET_SPLIT = """
basket AS (SELECT l_orderkey AS ex_id, CAST(l_partkey AS VARCHAR) AS key FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
vocab AS (SELECT key, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, key) - 1 AS fid FROM basket WHERE ex_id % 10 < 7 GROUP BY key),
features AS (SELECT DISTINCT ex_id, fid FROM basket JOIN vocab USING (key)),
pairs AS (SELECT a.ex_id, a.fid AS l, b.fid AS r FROM features a JOIN features b ON a.ex_id = b.ex_id AND a.fid < b.fid),
train AS (SELECT l, r, count(*) AS freq FROM pairs WHERE ex_id % 10 < 7 GROUP BY 1, 2),
valid AS (SELECT l, r, count(*) AS freq FROM pairs WHERE ex_id % 10 >= 7 GROUP BY 1, 2),
n_valid AS (SELECT count(DISTINCT ex_id) AS n FROM basket WHERE ex_id % 10 >= 7)"""

TABULAR_COLUMNS = ["c_mktsegment", "n_name", "o_orderpriority"]


def tabular(spark: SparkSession, sf_dir: str) -> Examples:
    """Orders with three categorical columns; target: the order is finished."""
    return from_columns(tabular_rows(spark, sf_dir), "o_orderkey", F.col("o_orderstatus") == "F", TABULAR_COLUMNS)


def tabular_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))


TABULAR = """
source AS (SELECT o_orderkey AS ex_id, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS target, c_mktsegment, n_name, o_orderpriority, c_acctbal, o_totalprice
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
lines AS (SELECT ex_id, target FROM source),
tokens AS (SELECT ex_id, 'c_mktsegment' AS col, c_mktsegment AS key FROM source UNION ALL SELECT ex_id, 'n_name', n_name FROM source
           UNION ALL SELECT ex_id, 'o_orderpriority', o_orderpriority FROM source),
vocab AS (SELECT col, key, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, col DESC, key DESC) - 1 AS fid,
          dense_rank() OVER (ORDER BY col) - 1 AS color FROM tokens GROUP BY col, key),
features AS (SELECT DISTINCT ex_id, fid, color FROM tokens JOIN vocab USING (col, key))"""


def user_days(spark: SparkSession, sf_dir: str) -> Examples:
    """Users' days as lines; event types with values and properties as words; target: a purchase that day."""
    events = table(spark, sf_dir, "events").withColumn("ex_id", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    lines = events.groupBy("ex_id").agg(F.max((F.col("event_type") == "purchase").cast("double")).alias("target"))
    pos = F.col("event_id") * 2
    words = from_words(events, "ex_id", F.col("event_type"), pos, F.col("value"))
    props = from_words(events, "ex_id", F.concat(F.lit("k"), F.regexp_extract("props", "([0-9]+)", 1)), pos + 1)
    return Examples(lines, words.unionAll(props))


USER_DAYS = """
ev AS (SELECT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS ex_id, * FROM events),
lines AS (SELECT ex_id, max(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS target FROM ev GROUP BY ex_id),
tokens AS (SELECT ex_id, event_id * 2 AS pos, event_type AS key, value FROM ev
           UNION ALL SELECT ex_id, event_id * 2 + 1, 'k' || regexp_extract(props, '([0-9]+)', 1), 1.0 FROM ev),
counts AS (SELECT key, count(*) AS cnt, count(*) >= (SELECT floor(count(*) * 0.1) FROM lines) AS dense FROM tokens GROUP BY key),
vocab AS (SELECT key, cnt, dense, row_number() OVER (ORDER BY dense, cnt DESC, key) - 1 AS fid FROM counts)"""
