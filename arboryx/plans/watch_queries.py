"""Queries of links from contents, seeds, reports, clusters and measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arboryx.operators import linking, ranking, watch

from . import fixtures as fx
from .fixtures import EDGES, SEEDS
from .rank_queries import _KNN, _UNIT, _unit
from .registry import query


def _near(t, k):
    unit = _unit(t).select("id", "v")
    return ranking.nearest(unit, unit.where("id % 100 = 0"), k)


_RANKED = f"{_KNN}, near AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= 50)"


@query("WITH m AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS i FROM lineitem), h AS (SELECT a.i AS src, b.i AS dst, count(*) AS groups FROM m a JOIN m b ON a.g = b.g AND a.i <> b.i GROUP BY 1, 2) SELECT * FROM h")
def co_occurrence(t):
    """Suppliers that appear in the same orders."""
    return linking.co_occurring(t.lineitem.select(F.col("l_orderkey").alias("grp"), F.col("l_suppkey").alias("item")))


@query(
    "WITH c AS (SELECT DISTINCT o_custkey AS query_id, l_partkey AS id, l_partkey AS rank FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 10 = 0), m AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS passage FROM lineitem),"
    " h AS (SELECT query_id, passage, count(DISTINCT c.id) AS overlap, min(rank) AS f FROM c JOIN m USING (id) GROUP BY 1, 2), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, f, passage) AS INTEGER) AS rank, passage, overlap FROM h)"
    " SELECT * FROM r WHERE rank <= 10"
)
def passage_bridge(t):
    """Suppliers as passages that mention the parts a customer bought."""
    bought = t.orders.where("o_custkey % 10 = 0").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    chosen = bought.select(F.col("o_custkey").alias("query_id"), F.col("l_partkey").alias("id"), F.col("l_partkey").alias("rank")).distinct()
    mentions = t.lineitem.select(F.col("l_partkey").alias("id"), F.concat(F.lit("book#p"), F.col("l_suppkey").cast("string")).alias("chunk"))
    return linking.bridged(chosen, mentions)


@query("SELECT 'o' || l_orderkey || '/' || l_linenumber AS src, 'o' || o_orderkey AS dst, 'part_of' AS rel, 0.9::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def section_hierarchy(t):
    """Lines as sections of their orders."""
    sections = t.lineitem.select(F.concat_ws("/", F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_orderkey").alias("path"))
    documents = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderkey").alias("path"))
    return linking.part_of(sections, documents)


@query(f"WITH {_RANKED}, c AS (SELECT query_id, count(*) AS n FROM near GROUP BY 1) SELECT query_id AS src, id AS dst, round((1 + cosine) / 2 + 1e-11, 8) AS score FROM near JOIN c USING (query_id) WHERE rank <= greatest(1, floor(n * 0.2)) AND (1 + cosine) / 2 >= 0.5")
def crosslinks(t):
    """A fifth of the fifty nearest vectors of every hundredth one."""
    return linking.crosslinks(_near(t, 50), 0.2).withColumn("score", F.round(F.col("score") + 1e-11, 8))


@query(f"WITH {_RANKED} SELECT query_id AS src, n.id AS dst, round((a.v[1] + b.v[1]) / 2 + 1e-11, 8) AS first, round((a.v[64] + b.v[64]) / 2 + 1e-11, 8) AS last FROM near n JOIN unit a ON a.id = query_id JOIN unit b ON b.id = n.id WHERE rank <= 20")
def implicit_edges(t):
    """Edges to the twenty nearest with the mean of both vectors."""
    made = linking.implicit_edges(_near(t, 20), _unit(t).select("id", "v"))
    return made.select("src", "dst", F.round(F.element_at("v", 1) + 1e-11, 8).alias("first"), F.round(F.element_at("v", -1) + 1e-11, 8).alias("last"))


@query(
    "WITH e AS (SELECT DISTINCT l_orderkey AS passage, 'part ' || (l_partkey % 40) AS label FROM lineitem), r AS (SELECT l_orderkey AS passage, 'part ' || (l_partkey % 40) AS a, 'part ' || (l_suppkey % 50) AS b FROM lineitem)"
    " SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS count FROM r JOIN e x ON x.passage = r.passage AND x.label = a JOIN e y ON y.passage = r.passage AND y.label = b WHERE a <> b GROUP BY 1, 2"
)
def extraction_graph(t):
    """Relations between what one order names; those with an end it does not name are dropped."""
    name = lambda c, n: F.concat(F.lit(" Part  "), (F.col(c) % n).cast("string"))
    entities = t.lineitem.select(F.col("l_orderkey").alias("passage"), name("l_partkey", 40).alias("label"))
    relations = t.lineitem.select(F.col("l_orderkey").alias("passage"), name("l_partkey", 40).alias("src"), name("l_suppkey", 50).alias("dst"))
    return linking.graph_inputs(entities, relations)[1]


@query(f"WITH {SEEDS}, a AS (SELECT r_name AS query_id, 'c' || c_custkey AS id, c_acctbal / 1e5::DOUBLE AS x FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 3 = 0) SELECT query_id, id, round(max(x) + 1e-11, 8) AS x FROM (SELECT * FROM seeds UNION ALL SELECT * FROM a) GROUP BY 1, 2")
def merged_seeds(t):
    """Seeds of a region and anchors among its customers, the larger weight of each."""
    homes = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).where("c_custkey % 3 = 0")
    anchors = homes.select(F.col("r_name").alias("query_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_acctbal") / 1e5).alias("x"))
    return linking.merged_seeds(fx.region_seeds(t), anchors).withColumn("x", F.round(F.col("x") + 1e-11, 8))


@query(f"WITH {_KNN}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, id % 4 = 0 ORDER BY cosine DESC, id) AS n FROM s) SELECT query_id, id, greatest(cosine, 0) AS x FROM r WHERE n <= 5")
def hybrid_seeds(t):
    """The five nearest of both pools of vectors, every fourth one being an entity."""
    unit = _unit(t).select("id", "v")
    asked = unit.where("id % 100 = 0")
    pools = {"entity": "id % 4 = 0", "passage": "id % 4 <> 0"}
    near = [ranking.nearest(unit.where(rule), asked, 5).withColumn("pool", F.lit(name)) for name, rule in pools.items()]
    return linking.seeds_by_pool(near[0].unionByName(near[1]), "hybrid")


@query(
    "WITH s AS (SELECT o_custkey AS q, l_partkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY l_partkey) AS INTEGER) AS rank FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 20 = 0)),"
    " k AS (SELECT * FROM s WHERE rank <= 3), e AS (SELECT DISTINCT o_custkey AS q, l_partkey AS a, 1000000 + l_suppkey AS b, l_suppkey AS rank FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 20 = 0),"
    " o AS (SELECT e.q, e.b AS id, min(e.rank) AS rank FROM e JOIN k ON k.q = e.q AND k.id = e.a GROUP BY 1, 2), u AS (SELECT q, id, 0 AS kind, rank FROM k UNION ALL SELECT q, id, 1, rank FROM o)"
    " SELECT q AS query_id, id, CAST(row_number() OVER (PARTITION BY q ORDER BY kind, rank, id) AS INTEGER) AS place FROM u"
)
def seed_touching(t):
    """Three parts a customer bought, then the suppliers of these."""
    lines = t.orders.where("o_custkey % 20 = 0").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("query_id"), "l_partkey", "l_suppkey").distinct()
    parts = lines.select("query_id", F.col("l_partkey").alias("id")).distinct()
    seeds = ranking.top(parts, ["query_id"], [F.col("id")], 3)
    edges = lines.select("query_id", F.col("l_partkey").alias("a"), (F.lit(1000000) + F.col("l_suppkey")).alias("b"), F.col("l_suppkey").alias("rank"))
    return linking.seed_touching(seeds, edges)


@query(f"WITH {EDGES}, a AS (SELECT DISTINCT o_custkey AS session, 'p' || l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 20 = 0), h AS (SELECT session, dst AS id, max(weight) AS weight FROM a JOIN edges ON src = a.id WHERE NOT EXISTS (SELECT 1 FROM a x WHERE x.session = a.session AND x.id = dst) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY weight DESC, id) AS n FROM h) SELECT session, id, round(weight + 1e-11, 8) AS weight FROM r WHERE n <= 3")
def session_candidates(t):
    """The three strongest nodes one hop from the parts of a customer."""
    lines = t.orders.where("o_custkey % 20 = 0").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    active = lines.select(F.col("o_custkey").alias("session"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id")).distinct()
    return linking.strongest_unseen(fx.trade_edges(t), active).withColumn("weight", F.round(F.col("weight") + 1e-11, 8))


@query("WITH c AS (SELECT p_brand AS query_id, quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS q, count(*) AS n FROM part GROUP BY 1) SELECT p_brand AS query_id, p_partkey AS id, CAST(CASE WHEN n = 1 THEN 0 ELSE len(list_filter(q, lambda x: x <= p_retailprice)) END AS INTEGER) AS weight_class FROM part JOIN c ON p_brand = query_id")
def local_weight_classes(t):
    """Parts by quarter of their brand's prices."""
    c = t.part.select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("id"), "p_retailprice")
    return linking.local_classes(c, "p_retailprice").select("query_id", "id", F.col("weight_class").cast("int").alias("weight_class"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def reports_in_window(t):
    """Events of the last seven days as reports."""
    last = t.events.agg(F.max("ts").alias("now"))
    return watch.in_window(t.events.select("event_id", "ts").crossJoin(F.broadcast(last)), "ts", F.col("now"), 7).select("event_id")  # one row


@query("SELECT event_type, event_id, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 20")
def newest_reports(t):
    """The twenty newest reports of each type."""
    return watch.newest_of_type(t.events.select("event_type", "event_id"), "event_type", "event_id", 20)


@query(
    "WITH s AS (SELECT user_id % 100 AS region, value / 100 AS strength, CASE WHEN user_id % 7 = 0 THEN NULL ELSE event_type END AS c FROM events), h AS (SELECT region, count(*) AS hits, least(1.0, greatest(0.0, avg(strength))) AS strength FROM s GROUP BY 1 HAVING count(*) >= 3),"
    " v AS (SELECT region, c, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, c) AS n FROM s WHERE c IS NOT NULL GROUP BY 1, 2) SELECT h.region, hits, round(strength + 1e-11, 6) AS strength, c AS dominant FROM h LEFT JOIN v ON v.region = h.region AND n = 1"
)
def blind_spots(t):
    """Groups of users whose queries fail, with what they asked for most."""
    stubs = t.events.select((F.col("user_id") % 100).alias("region"), (F.col("value") / 100).alias("strength"), F.when(F.col("user_id") % 7 != 0, F.col("event_type")).alias("cluster"))
    return watch.blind_spots(stubs).withColumn("strength", F.round(F.col("strength") + 1e-11, 6))


@query("WITH c AS (SELECT o_orderpriority AS region, l_suppkey AS id, count(*) AS times FROM orders JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY times DESC, id) AS INTEGER) AS place FROM c) SELECT * FROM r WHERE place <= 10")
def most_cited(t):
    """The ten suppliers that orders of each priority cite most."""
    cited = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("cited"))
    return watch.most_cited(t.orders.join(cited, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("region"), "cited"))


@query("SELECT o_orderkey AS id, o_orderstatus AS type, o_orderpriority AS severity FROM orders ORDER BY o_orderpriority DESC, o_orderstatus, o_orderkey LIMIT 50")
def findings_in_order(t):
    """The fifty gravest orders, by priority, status and key."""
    severities = tuple(r[0] for r in t.orders.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect())  # a fixed few
    return watch.findings_in_order(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("severity")), severities)


@query(
    "WITH r AS (SELECT l_shipmode_ AS by_, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_linenumber % 5 END AS tier FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem))"
    " SELECT by_ AS kind, count(tier) AS resolved, " + ", ".join(f"count(*) FILTER (tier = {i}) AS tier{i}" for i in range(5)) + ", round(count(*) FILTER (tier <= 1) / greatest(count(tier), 1) + 1e-11, 8) AS low_share FROM r GROUP BY 1"
)
def tier_summary(t):
    """How lines of each flag and status were resolved."""
    r = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("kind"), F.when(F.col("l_partkey") % 11 != 0, F.col("l_linenumber") % 5).alias("tier"))
    return watch.tier_summary(r, "kind").withColumn("low_share", F.round(F.col("low_share") + 1e-11, 8))


_ANSWERS = "a AS (SELECT o_orderpriority AS kind, count(*) AS expected, count(*) FILTER (l_quantity > 10) AS present, count(*) FILTER (l_quantity > 10 AND l_discount > 0.02) AS retrieved FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, 1)"


@query(
    f"WITH {_ANSWERS} SELECT coalesce(kind, 'all') AS kind, count(*) AS questions, round(coalesce(sum(present) / nullif(sum(expected), 0), 0) + 1e-11, 8) AS coverage, round(coalesce(sum(retrieved) / nullif(sum(present), 0), 0) + 1e-11, 8) AS recall,"
    " round(coalesce(sum(retrieved) / nullif(sum(expected), 0), 0) + 1e-11, 8) AS end_to_end, count(*) FILTER (present > 0 AND retrieved = present) AS answered FROM a GROUP BY ROLLUP (kind)"
)
def coverage_by_kind(t):
    """Orders as questions, their lines as expected answers."""
    lines = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    has = F.col("l_quantity") > 10
    a = lines.groupBy("o_orderkey", F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("expected"), F.count_if(has).alias("present"), F.count_if(has & (F.col("l_discount") > 0.02)).alias("retrieved"))
    out = watch.coverage(a)
    return out.select("kind", "questions", *[F.round(F.col(c) + 1e-11, 8).alias(c) for c in ("coverage", "recall", "end_to_end")], "answered")


@query(
    "WITH s AS (SELECT o_orderpriority AS kind, o_orderkey, l_quantity > 20 AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey), p AS (SELECT kind, o_orderkey, bool_and(f) AS b, bool_or(f) AS a, count(*) FILTER (f) AS n FROM s GROUP BY 1, 2)"
    ' SELECT kind, count(*) AS questions, round(avg(b::INT) + 1e-11, 8) AS "both", round(avg(a::INT) + 1e-11, 8) AS "any", round(avg(n) + 1e-11, 8) AS mean FROM p GROUP BY 1'
)
def sides_recall(t):
    """Orders whose lines are the sides of a question."""
    sides = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("question"), (F.col("l_quantity") > 20).alias("found"))
    out = watch.sides_recall(sides, "kind")
    return out.select("kind", "questions", *[F.round(F.col(c) + 1e-11, 8).alias(c) for c in ("both", "any", "mean")])


@query(
    "WITH l AS (SELECT DISTINCT l_orderkey AS q, l_suppkey AS i, l_partkey AS p FROM lineitem), g AS (SELECT q, count(DISTINCT i) FILTER (TRUE) AS gold, count(DISTINCT i) FILTER (i % 2 = 0) AS had, count(DISTINCT i) FILTER (i % 2 = 0 AND i % 3 = 0) AS both_, count(DISTINCT i) FILTER (i % 2 <> 0) AS missed, count(DISTINCT i) FILTER (i % 2 <> 0 AND i % 3 = 0) AS won FROM l GROUP BY 1)"
    " SELECT count(*) AS questions, round(sum(both_) / sum(had) + 1e-11, 8) AS retention, round(sum(won) / sum(missed) + 1e-11, 8) AS rescue, CAST(sum(won) AS BIGINT) AS exclusive_after, CAST(sum(had) - sum(both_) AS BIGINT) AS exclusive_before FROM g"
)
def seeding_diagnostics(t):
    """An order's suppliers are its golds; one method finds the even ones, another every third."""
    g = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("gold")).withColumnRenamed("l_orderkey", "question")
    found = g.withColumns({"before": F.filter("gold", lambda i: i % 2 == 0), "after": F.filter("gold", lambda i: i % 3 == 0)})
    out = watch.seeding_diagnostics(found)
    return out.select("questions", F.round(F.col("retention") + 1e-11, 8).alias("retention"), F.round(F.col("rescue") + 1e-11, 8).alias("rescue"), "exclusive_after", "exclusive_before")


@query("SELECT count(*) AS pairs, round(avg((abs(a - b) <= 1)::INT) + 1e-11, 8) AS within_one, round(avg(a) + 1e-11, 8) AS mean_a, round(avg(b) + 1e-11, 8) AS mean_b FROM (SELECT l_linenumber AS a, CAST(l_quantity AS INTEGER) % 7 + 1 AS b FROM lineitem)")
def rater_agreement(t):
    out = watch.rater_agreement(t.lineitem.select(F.col("l_linenumber").alias("a"), (F.col("l_quantity").cast("int") % 7 + 1).alias("b")), "a", "b")
    return out.select("pairs", *[F.round(F.col(c) + 1e-11, 8).alias(c) for c in ("within_one", "mean_a", "mean_b")])


@query(
    "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events),"
    " g AS (SELECT user_id, avg(value) FILTER (a <= 5) AS f, avg(value) FILTER (b <= 5) AS l FROM r GROUP BY 1) SELECT user_id, round(f + 1e-9, 6) AS first, round(l + 1e-9, 6) AS last, round(l - f + 1e-9, 6) AS gain FROM g"
)
def reward_windows(t):
    """Mean of a user's first and last five values."""
    r = t.events.select("user_id", "ts", "event_id", F.col("value").alias("reward"))
    out = watch.first_and_last_window(r, "user_id", ["ts", "event_id"], 5)
    return out.select("user_id", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("first", "last", "gain")])


@query(
    "WITH c AS (SELECT o_orderpriority AS type, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1), r AS (SELECT type AS name, 0 AS p, type, n FROM c UNION ALL SELECT 'urgent or high', 1, type, n FROM c WHERE type IN ('1-URGENT', '2-HIGH')),"
    " g AS (SELECT name, p, array_to_string(list_sort(list(type)), ',') AS types, CAST(sum(n) AS BIGINT) AS questions FROM r GROUP BY 1, 2) SELECT name, CAST(row_number() OVER (ORDER BY p, questions DESC, name) AS INTEGER) AS place, types, questions FROM g"
)
def type_groups(t):
    """Orders by priority, and the two gravest together."""
    out = watch.type_groups(t.orders.select(F.col("o_orderkey").alias("question"), F.col("o_orderpriority").alias("type")), {"urgent or high": ["1-URGENT", "2-HIGH"]})
    return out.withColumn("types", F.array_join("types", ","))


@query(f"WITH {EDGES}, c AS (SELECT 'c' || c_custkey AS id, c_nationkey AS k FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 'p' || p_partkey, p_size % 25 FROM part WHERE p_size % 3 <> 0) SELECT rel, count(*) AS n, count(*) FILTER (a.k <> b.k) AS crossing FROM edges LEFT JOIN c a ON a.id = src LEFT JOIN c b ON b.id = dst GROUP BY 1")
def crossing_edges(t):
    """How many edges of each relation join two clusters, here nations."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string")).alias("id")
    clusters = t.customer.select(key("c", "c_custkey"), F.col("c_nationkey").alias("cluster")).union(t.supplier.select(key("s", "s_suppkey"), "s_nationkey")).union(t.part.where("p_size % 3 <> 0").select(key("p", "p_partkey"), F.col("p_size") % 25))
    return watch.crossing(fx.trade_edges(t), clusters).groupBy("rel").agg(F.count("*").alias("n"), F.count_if("crosses").alias("crossing"))


@query("WITH s AS (SELECT label AS cluster, count(*) AS size FROM embeddings WHERE label IS NOT NULL GROUP BY 1) SELECT cluster, size, round((SELECT avg(size) FROM s) + 1e-9, 6) AS mean FROM s")
def cluster_sizes(t):
    return watch.cluster_sizes(t.embeddings.select(F.col("label").alias("cluster"))).withColumn("mean", F.round(F.col("mean") + 1e-9, 6))


@query(
    "WITH d AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_ FROM events) SELECT event_id, last_ IS NULL OR (epoch_us(ts) - epoch_us(last_)) / 86400000000.0 >= 1 AS due FROM d"
)
def recluster_gate(t):
    """Whether a day has passed since a user's last event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.withColumn("last", F.lag("ts").over(w)).select("event_id", watch.due(F.col("last"), F.col("ts"), 1.0).alias("due"))


@query(
    "WITH h AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'P') SELECT c_custkey AS id, round(CASE WHEN h.c IS NOT NULL THEN greatest(0, c_acctbal / 10000 - 0.1) ELSE c_acctbal / 10000 END + 1e-11, 8) AS confidence FROM customer LEFT JOIN h ON h.c = c_custkey"
)
def demoted_confidence(t):
    """Customers with a grave open order lose a step of confidence."""
    nodes = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10000).alias("confidence"))
    findings = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("severity"))
    return watch.demoted(nodes, findings, ("1-URGENT", "2-HIGH")).withColumn("confidence", F.round(F.col("confidence") + 1e-11, 8))


@query(
    "WITH d AS (SELECT o_custkey AS id, CASE WHEN min(o_orderkey) % 2 = 0 THEN 'X' || min(o_orderkey) END AS e FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)"
    " SELECT c_custkey AS id, coalesce(e, CASE WHEN c_custkey % 5 = 0 THEN 'K' || c_custkey END) AS external_id, CAST(CASE WHEN e IS NOT NULL THEN 1 ELSE 3 END AS INTEGER) AS tier, d.id IS NULL AS pending FROM customer LEFT JOIN d ON d.id = c_custkey"
)
def manual_resolution(t):
    """Customers that wait for a decision, and decisions on some."""
    nodes = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("K"), F.col("c_custkey").cast("string"))).alias("external_id"), F.lit(3).alias("tier"), F.lit(True).alias("pending"))
    first = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("k"))
    return watch.resolved(nodes, first.select("id", F.when(F.col("k") % 2 == 0, F.concat(F.lit("X"), F.col("k").cast("string"))).alias("external_id")))


@query(
    "WITH m AS (SELECT o_custkey AS id, list_sort(list(DISTINCT o_orderpriority)) AS r FROM orders GROUP BY 1) SELECT c_custkey AS id, array_to_string(list_concat([c_mktsegment, '1-URGENT'], list_filter(coalesce(r, []), lambda x: x <> '1-URGENT')), ',') AS marks FROM customer LEFT JOIN m ON m.id = c_custkey"
)
def marks_once(t):
    """Priorities of a customer's orders as marks, each once."""
    nodes = t.customer.select(F.col("c_custkey").alias("id"), F.array("c_mktsegment", F.lit("1-URGENT")).alias("marks"))
    return watch.marked_once(nodes, t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("run")), "marks").withColumn("marks", F.array_join("marks", ","))


@query(
    "WITH m AS (SELECT event_type, count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events) AS s, count(*) FILTER (value < 1) AS i, count(*) FILTER (value > 500) AS c FROM events GROUP BY 1)"
    " SELECT event_type, concat_ws('; ', CASE WHEN s < 0.75 THEN 'fragmented' END, CASE WHEN i > 3 THEN 'isolated nodes' END, CASE WHEN c = 0 THEN 'no cross links' END) AS anomalies FROM m"
)
def connectivity_anomalies(t):
    """Event types as graphs: how many users they reach, small and large values."""
    users = t.events.agg(F.countDistinct("user_id").alias("n"))
    m = t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("u"), F.count_if(F.col("value") < 1).alias("isolated"), F.count_if(F.col("value") > 500).alias("cross_links"))
    return watch.connectivity_anomalies(m.crossJoin(F.broadcast(users)).withColumn("largest_share", F.col("u") / F.col("n"))).select("event_type", "anomalies")  # one row
