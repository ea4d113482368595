"""Graph, log and text inputs derived from the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables


def _id(letter: str, col: str):
    return F.concat(F.lit(letter), F.col(col).cast("string"))


def trade_edges(t: Tables) -> DataFrame:
    """(src, dst, rel, weight) of the trade graph."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    bought = lines.groupBy(_id("c", "o_custkey").alias("src"), _id("p", "l_partkey").alias("dst")).agg(F.least(F.lit(1.0), F.sum("l_quantity") / 100).alias("weight"))
    supplied = t.lineitem.groupBy(_id("p", "l_partkey").alias("src"), _id("s", "l_suppkey").alias("dst")).agg(F.least(F.lit(1.0), F.sum("l_quantity") / 100).alias("weight"))
    one = F.lit(1.0).alias("weight")
    parts = [
        (bought, "bought"),
        (supplied, "supplied_by"),
        (t.customer.select(_id("c", "c_custkey").alias("src"), _id("n", "c_nationkey").alias("dst"), one), "located_in"),
        (t.supplier.select(_id("s", "s_suppkey").alias("src"), _id("n", "s_nationkey").alias("dst"), one), "located_in"),
        (t.nation.select(_id("n", "n_nationkey").alias("src"), _id("r", "n_regionkey").alias("dst"), one), "part_of"),
    ]
    out = None
    for df, rel in parts:
        df = df.select("src", "dst", F.lit(rel).alias("rel"), "weight")
        out = df if out is None else out.unionByName(df)
    return out


EDGES = """edges AS (
  SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, 'bought' AS rel, least(1.0::DOUBLE, sum(l_quantity) / 100) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
  UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'supplied_by', least(1.0::DOUBLE, sum(l_quantity) / 100) FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'located_in', 1.0 FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in', 1.0 FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of', 1.0 FROM nation
)"""


def trade_nodes(t: Tables) -> DataFrame:
    """(id, kind, label, score, region): all keys; score is the balance or price over the largest of the kind."""

    def side(df, letter, key, kind, label, score):
        return df.select(_id(letter, key).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"), score.cast("double").alias("score"))

    return (
        side(t.customer, "c", "c_custkey", "customer", "c_name", F.col("c_acctbal") / 10000)
        .unionByName(side(t.supplier, "s", "s_suppkey", "supplier", "s_name", F.col("s_acctbal") / 10000))
        .unionByName(side(t.part, "p", "p_partkey", "part", "p_name", F.col("p_retailprice") / 2000))
        .unionByName(side(t.nation, "n", "n_nationkey", "nation", "n_name", F.lit(0.5)))
        .unionByName(side(t.region, "r", "r_regionkey", "region", "r_name", F.lit(0.5)))
    )


NODES = """nodes AS (
  SELECT 'c' || c_custkey AS id, 'customer' AS kind, c_name AS label, c_acctbal / 10000 AS score FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name, s_acctbal / 10000 FROM supplier
  UNION ALL SELECT 'p' || p_partkey, 'part', p_name, p_retailprice / 2000 FROM part
  UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name, 0.5 FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'region', r_name, 0.5 FROM region
)"""


def region_seeds(t: Tables) -> DataFrame:
    """(query_id, id, x): one query per region, its customers alike."""
    homes = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    per = homes.groupBy("r_name").agg(F.count("*").alias("n"))
    return homes.join(per, "r_name").select(F.col("r_name").alias("query_id"), _id("c", "c_custkey").alias("id"), (1.0 / F.col("n")).alias("x"))


SEEDS = """seeds AS (
  SELECT r_name AS query_id, 'c' || c_custkey AS id, 1.0::DOUBLE / count(*) OVER (PARTITION BY r_name) AS x
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def passes(t: Tables) -> DataFrame:
    """(pass_id, at, node_ids): what a user touched in a session that a gap of 30 minutes ends."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp")) > 1_800_000_000
    marked = t.events.withColumn("_new", F.coalesce(gap.cast("int"), F.lit(1)))
    numbered = marked.withColumn("_s", F.sum("_new").over(order))
    node = F.concat_ws(":", "event_type", (F.col("user_id") % 50).cast("string"))
    return numbered.groupBy("user_id", "_s").agg(F.max("ts").alias("at"), F.array_sort(F.collect_set(node)).alias("node_ids")).select(
        F.concat_ws("-", "user_id", "_s").alias("pass_id"), "at", "node_ids"
    )


PASSES = """marked AS (
  SELECT user_id, ts, event_type || ':' || (user_id % 50) AS node, event_id,
         CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 WHEN lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM marked
), passes AS (
  SELECT user_id || '-' || CAST(s AS BIGINT) AS pass_id, max(ts) AS fired_at, list_sort(list_distinct(list(node))) AS node_ids FROM numbered GROUP BY user_id, s
)"""


def event_edges(t: Tables) -> DataFrame:
    """(src, dst, rel, weight): how often a user's event type follows another, per user group of 50."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    node = F.concat_ws(":", "event_type", (F.col("user_id") % 50).cast("string"))
    pairs = t.events.select(F.lag(node).over(order).alias("src"), node.alias("dst"), "value").where("src is not null")
    return pairs.groupBy("src", "dst").agg(F.least(F.lit(1.0), F.count("*") / 10.0).alias("weight")).select("src", "dst", F.lit("then").alias("rel"), "weight")


EVENT_EDGES = """pairs AS (
  SELECT lag(event_type || ':' || (user_id % 50)) OVER w AS src, event_type || ':' || (user_id % 50) AS dst, value
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), event_edges AS (
  SELECT src, dst, 'then' AS rel, least(1.0::DOUBLE, count(*) / 10.0::DOUBLE) AS weight FROM pairs WHERE src IS NOT NULL GROUP BY src, dst
)"""


def deltas(t: Tables) -> DataFrame:
    """(src, dst, rel, delta): each pair of consecutive events of a user, delta = value / 1000."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    node = F.concat_ws(":", "event_type", (F.col("user_id") % 50).cast("string"))
    pairs = t.events.select(F.lag(node).over(order).alias("src"), node.alias("dst"), F.lit("then").alias("rel"), ((F.col("value") - 5) / 1000).alias("delta"))
    return pairs.where("src is not null")


DELTAS = """deltas AS (SELECT src, dst, 'then' AS rel, (value - 5) / 1000 AS delta FROM pairs WHERE src IS NOT NULL)"""


def tokens(t: Tables) -> DataFrame:
    """(doc_id, token, tf)."""
    from arboryx.functions import text

    words = t.documents.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token"))
    return words.groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


TOKENS = """tokens AS (
  SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY 1, 2
)"""
