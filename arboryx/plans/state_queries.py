"""Queries of ticks, logs, life cycles, identity and clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arboryx.functions import scalar
from arboryx.operators import evolve, identity

from . import fixtures as fx
from .fixtures import DELTAS, EDGES, EVENT_EDGES, NODES, PASSES
from .registry import query

_LOG = f"{EVENT_EDGES}, {DELTAS}, {PASSES}"
_MERGED = """merged AS MATERIALIZED (
  SELECT src, dst, rel, least(1.0, coalesce(max(weight), 0) + coalesce(sum(delta) FILTER (delta > 0), 0)) AS weight
  FROM (SELECT src, dst, rel, weight, NULL AS delta FROM event_edges UNION ALL SELECT src, dst, rel, NULL, delta FROM deltas WHERE delta > 0) GROUP BY 1, 2, 3
)"""
_FIRED = """touched AS (SELECT pass_id, unnest(node_ids) AS id FROM passes),
fired AS (
  SELECT DISTINCT m.src, m.dst FROM merged m JOIN touched a ON a.id = m.src JOIN touched b ON b.id = m.dst AND a.pass_id = b.pass_id WHERE m.src <> m.dst
  UNION SELECT src, dst FROM deltas WHERE delta > 0 AND src <> dst
)"""


@query(f"WITH {PASSES} SELECT pass_id, fired_at, array_to_string(node_ids, ',') AS nodes FROM passes")
def firing_passes(t):
    return fx.passes(t).select("pass_id", F.col("at").alias("fired_at"), F.array_join("node_ids", ",").alias("nodes"))


@query(f"WITH {_LOG}, {_MERGED} SELECT src, dst, rel, round(weight + 1e-11, 8) AS weight FROM merged")
def delta_merge(t):
    out = evolve.merge_deltas(fx.event_edges(t), fx.deltas(t))
    return out.withColumn("weight", F.round(F.col("weight") + 1e-11, 8))


@query(f"WITH {_LOG}, {_MERGED}, {_FIRED} SELECT f.src, f.dst FROM fired f SEMI JOIN merged m ON f.src = m.src AND f.dst = m.dst")
def fired_edges(t):
    return evolve.fired(evolve.merge_deltas(fx.event_edges(t), fx.deltas(t)), fx.passes(t), fx.deltas(t))


_TICK = f"""{_LOG}, {_MERGED}, {_FIRED}, faded AS (
  SELECT m.src, m.dst, rel, CASE WHEN f.src IS NULL THEN greatest(0.0, weight - 0.05 * weight ** 2) ELSE weight END AS weight
  FROM merged m LEFT JOIN fired f ON f.src = m.src AND f.dst = m.dst
)"""


@query(f"WITH {_TICK} SELECT src, dst, rel, round(weight + 1e-11, 8) AS weight FROM faded")
def gated_decay(t):
    merged = evolve.merge_deltas(fx.event_edges(t), fx.deltas(t))
    out = evolve.decayed(merged, evolve.fired(merged, fx.passes(t), fx.deltas(t)))
    return out.withColumn("weight", F.round(F.col("weight") + 1e-11, 8))


@query(
    f"WITH {_TICK} SELECT src, dst, rel, round(least(round(weight, 9), 1.0) + 1e-11, 8) AS weight FROM"
    " (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(weight, 9) DESC, dst, rel) AS r FROM faded) WHERE r <= 20"
)
def substrate_tick(t):
    """Merge, gate, decay and keep the 20 strongest edges of each source."""
    merged = evolve.merge_deltas(fx.event_edges(t), fx.deltas(t))
    faded = evolve.decayed(merged, evolve.fired(merged, fx.passes(t), fx.deltas(t))).withColumn("weight", F.round("weight", 9))
    return evolve.saturated(faded, 20).withColumn("weight", F.round(F.col("weight") + 1e-11, 8))


@query(f"WITH {EVENT_EDGES} SELECT src, dst, rel, round(weight * 100 / (SELECT sum(weight) FROM event_edges) + 1e-11, 8) AS weight FROM event_edges")
def homeostasis(t):
    out = evolve.renormalised(fx.event_edges(t), 100.0)
    return out.withColumn("weight", F.round(F.col("weight") + 1e-11, 8))


@query(
    f"WITH {EVENT_EDGES}, {DELTAS}, {_MERGED} SELECT src, dst, rel, round(weight * then_ / sum(weight) OVER (PARTITION BY src) + 1e-11, 8) AS weight"
    " FROM merged JOIN (SELECT src, sum(weight) AS then_ FROM event_edges GROUP BY 1) USING (src)"
)
def homeostasis_per_source(t):
    before = fx.event_edges(t)
    out = evolve.renormalised_per_source(evolve.merge_deltas(before, fx.deltas(t)), before)
    return out.withColumn("weight", F.round(F.col("weight") + 1e-11, 8))


@query(f"WITH {EDGES} SELECT src, dst, rel, round(weight, 8) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst, rel) AS r FROM edges) WHERE r <= 5")
def saturation(t):
    return evolve.saturated(fx.trade_edges(t), 5).withColumn("weight", F.round("weight", 8))


_STATE = "state AS (SELECT event_type || ':' || (user_id % 50) AS id, count(*) AS fired_total, count(*) % 17 AS fired_recent, min(ts) AS last_fired FROM events GROUP BY 1)"


def _node_state(t):
    node = F.concat_ws(":", "event_type", (F.col("user_id") % 50).cast("string"))
    return t.events.groupBy(node.alias("id")).agg(F.count("*").alias("fired_total"), (F.count("*") % 17).alias("fired_recent"), F.min("ts").alias("last_fired"))


@query(
    f"WITH {PASSES}, {_STATE}, hits AS (SELECT id, count(*) AS n, max(fired_at) AS fired_at FROM (SELECT fired_at, unnest(node_ids) AS id FROM passes) GROUP BY id)"
    " SELECT id, fired_total + n AS fired_total, CAST(floor(fired_recent * 0.9) AS BIGINT) + n AS fired_recent, greatest(last_fired, fired_at) AS last_fired FROM state JOIN hits USING (id)"
)
def firing_fold(t):
    return evolve.firing_fold(_node_state(t), fx.passes(t))


_LIFE = f"""{NODES}, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id),
life AS (
  SELECT id, greatest(0.0, least(1.0, score)) AS confidence, 0.5 AS relevance, coalesce(degree, 0) AS degree, CAST(length(label) AS DOUBLE) AS idle_days
  FROM nodes LEFT JOIN deg USING (id)
)"""


def _life(t):
    edges = fx.trade_edges(t)
    degree = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    nodes = fx.trade_nodes(t).join(degree, "id", "left")
    return nodes.select("id", scalar.clamp(F.col("score")).alias("confidence"), F.lit(0.5).alias("relevance"), F.coalesce("degree", F.lit(0)).alias("degree"), F.length("label").cast("double").alias("idle_days"))


_VITAL = "0.4 * confidence + 0.25 * relevance + 0.2 * least(1.0, degree / 20) + 0.15 * greatest(0.0, 1 - idle_days / 30)"


@query(
    f"WITH {EDGES}, {_LIFE}, v AS (SELECT *, {_VITAL} AS vitality FROM life) SELECT id, degree, round(vitality + 1e-11, 8) AS vitality,"
    " CASE WHEN vitality >= 0.7 THEN 'promote' WHEN vitality <= 0.25 AND idle_days >= 7 THEN 'degrade' ELSE 'keep' END AS verdict FROM v"
)
def life_cycle(t):
    out = evolve.life_cycle(_life(t))
    return out.select("id", "degree", F.round(F.col("vitality") + 1e-11, 8).alias("vitality"), "verdict")


@query(
    f"WITH {EDGES}, {_LIFE}, e AS (SELECT id, 0.6 * CASE WHEN degree <= 0 THEN 0 ELSE least(1.0, ln(1 + degree) / ln(51)) END + 0.4 * ({_VITAL}) AS x, degree % 6 AS band FROM life)"
    " SELECT id, CAST(band + sign((CASE WHEN x >= 0.15 THEN 1 ELSE 0 END + CASE WHEN x >= 0.3 THEN 1 ELSE 0 END + CASE WHEN x >= 0.5 THEN 1 ELSE 0 END"
    " + CASE WHEN x >= 0.7 THEN 1 ELSE 0 END + CASE WHEN x >= 0.85 THEN 1 ELSE 0 END) - band) AS INTEGER) AS band FROM e"
)
def depth_bands(t):
    life = evolve.life_cycle(_life(t))
    return life.select("id", scalar.depth_band(scalar.connectivity_log(F.col("degree")), F.col("vitality"), F.col("degree") % 6).alias("band"))


@query(f"WITH {NODES} SELECT id, label, CASE WHEN kind = 'supplier' THEN round(score * 2, 8) ELSE round(score, 8) END AS score, CASE WHEN kind = 'region' THEN 'zone' ELSE kind END AS kind FROM nodes WHERE kind <> 'nation'")
def node_mutations(t):
    """Known ids updated field by field, rows replaced, a kind deleted with a cascade."""
    nodes = fx.trade_nodes(t).select("id", "kind", "label", F.round("score", 8).alias("score"))
    doubled = nodes.where("kind = 'supplier'").select("id", F.round(F.col("score") * 2, 8).alias("score"))
    zones = nodes.where("kind = 'region'").withColumn("kind", F.lit("zone"))
    out = evolve.upsert(evolve.update_known(nodes, doubled), zones)
    return evolve.delete_nodes(out, fx.trade_edges(t), nodes.where("kind = 'nation'"))[0].select("id", "label", "score", "kind")


@query(f"WITH {EDGES} SELECT src, dst, rel, round(weight, 8) AS weight FROM edges WHERE src NOT LIKE 'n%' AND dst NOT LIKE 'n%'")
def cascading_delete(t):
    gone = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    edges = evolve.delete_nodes(fx.trade_nodes(t), fx.trade_edges(t), gone)[1]
    return edges.withColumn("weight", F.round("weight", 8))


@query("SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(t):
    return evolve.latest(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "ts", "value")


_NAMES = "names AS (SELECT DISTINCT 'p' || p_partkey AS id, unnest(regexp_extract_all(p_name, '[A-Za-z]+')) || ':' || p_brand || ':' || p_size AS name FROM part)"


def _part_names(t):
    words = F.explode(F.regexp_extract_all("p_name", F.lit("[A-Za-z]+"), 0))
    return t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), words.alias("w"), "p_brand", "p_size").select("id", F.concat_ws(":", "w", "p_brand", F.col("p_size").cast("string")).alias("name"))


_MERGES = f"""{_NAMES}, ok AS (SELECT name FROM names GROUP BY name HAVING count(*) BETWEEN 2 AND 25),
r AS (
  SELECT id, name, row_number() OVER w AS r, first(id) OVER w AS anchor
  FROM names JOIN ok USING (name) JOIN part ON id = 'p' || p_partkey WINDOW w AS (PARTITION BY name ORDER BY p_retailprice DESC, id)
), merges AS (SELECT anchor, id AS member, count(*) AS shared FROM r WHERE r > 1 AND id NOT IN (SELECT id FROM r WHERE r = 1) GROUP BY 1, 2)"""


def _merges(t):
    nodes = t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_retailprice").alias("potential"))
    return identity.propose_merges(_part_names(t), nodes)


@query(f"WITH {_MERGES} SELECT * FROM merges")
def merge_proposals(t):
    return _merges(t)


_REMAP = f"{_MERGES}, remap AS (SELECT member, min(anchor) AS anchor FROM merges GROUP BY member HAVING count(DISTINCT anchor) = 1)"


@query(f"WITH {_REMAP} SELECT * FROM remap")
def merge_resolution(t):
    """Every proposal judged the same; members with several anchors are ambiguous."""
    return identity.resolve(_merges(t).withColumn("verdict", F.lit("same")))


@query(
    f"WITH {_REMAP}, {EDGES}, m AS (SELECT coalesce(a.anchor, src) AS f, coalesce(b.anchor, dst) AS g, src, dst, rel, weight FROM edges LEFT JOIN remap a ON a.member = src LEFT JOIN remap b ON b.member = dst)"
    " SELECT f AS src, g AS dst, rel, round(least(1.0, sum(weight)) + 1e-11, 8) AS weight FROM m WHERE f <> g OR src = dst GROUP BY 1, 2, 3"
)
def edge_rewire(t):
    remap = identity.resolve(_merges(t).withColumn("verdict", F.lit("same")))
    return identity.rewire(fx.trade_edges(t), remap).withColumn("weight", F.round(F.col("weight") + 1e-11, 8))


@query(
    f"WITH {_REMAP} SELECT coalesce(anchor, 'p' || p_partkey) AS id, min(p_size) AS born, sum(p_partkey)::BIGINT AS fired_total, max(p_retailprice) AS last_fired,"
    " array_to_string(list_sort(list_distinct(list(p_type))), ',') AS tags FROM part LEFT JOIN remap ON member = 'p' || p_partkey GROUP BY 1"
)
def node_fuse(t):
    remap = identity.resolve(_merges(t).withColumn("verdict", F.lit("same")))
    nodes = t.part.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").alias("born"), F.col("p_partkey").alias("fired_total"), F.col("p_retailprice").alias("last_fired"), F.col("p_type").alias("tag")
    )
    return identity.fuse(nodes, remap).withColumn("tags", F.array_join("tags", ","))


@query(
    "WITH e AS (SELECT DISTINCT l_orderkey AS src, l_returnflag AS rel, l_suppkey AS dst, l_shipdate AS w FROM lineitem),"
    " slots AS (SELECT src, rel FROM e GROUP BY 1, 2 HAVING count(DISTINCT dst) BETWEEN 2 AND 4), g AS (SELECT src, rel, dst, list(w) AS w FROM e GROUP BY 1, 2, 3)"
    " SELECT a.src AS shared, a.rel, a.dst AS a, b.dst AS b FROM g a JOIN g b ON a.src = b.src AND a.rel = b.rel AND a.dst < b.dst JOIN slots s ON s.src = a.src AND s.rel = a.rel WHERE NOT list_has_any(a.w, b.w)"
)
def contradictions(t):
    """Suppliers of an order under one return flag, never shipped on the same day."""
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_returnflag").alias("rel"), F.col("l_suppkey").alias("dst"), F.col("l_shipdate").alias("witness"))
    return identity.contradictions(edges)


@query(
    "WITH m AS (SELECT DISTINCT l_orderkey AS u, l_partkey AS i FROM lineitem), "
    " p AS (SELECT a.u AS l, b.u AS r, count(*) AS shared FROM m a JOIN m b ON a.i = b.i AND a.u < b.u GROUP BY 1, 2),"
    " d AS (SELECT l, r, shared FROM p UNION ALL SELECT r, l, shared FROM p), k12 AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY shared DESC, r) AS n FROM d)"
    " SELECT DISTINCT least(l, r) AS l, greatest(l, r) AS r, shared FROM k12 WHERE n <= 12"
)
def shared_entity_lattice(t):
    """Orders with common parts, the twelve closest partners of each."""
    return identity.shared_pairs(t.lineitem, "l_orderkey", "l_partkey")


@query(
    "WITH n AS (SELECT c_custkey AS id, c_nationkey % 25 AS c FROM customer WHERE c_custkey % 10 <> 3), b AS (SELECT c_custkey AS id, 100 + c_nationkey AS p FROM customer WHERE c_custkey % 10 <> 7),"
    " o AS (SELECT c, p, count(*) AS x FROM n JOIN b USING (id) GROUP BY 1, 2), j AS (SELECT c, p, x / ((SELECT count(*) FROM n m WHERE m.c = o.c) + (SELECT count(*) FROM b m WHERE m.p = o.p) - x) AS j FROM o)"
    " SELECT DISTINCT n.c AS cluster, coalesce(p, -1) AS identity, round(coalesce(j, 0) + 1e-11, 8) AS jaccard FROM n LEFT JOIN (SELECT * FROM j WHERE j >= 0.7) k ON k.c = n.c"
)
def cluster_identity(t):
    """Customers by nation as new clusters against the same of an earlier run with other members missing."""
    now = t.customer.where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 25).alias("cluster"))
    before = t.customer.where("c_custkey % 10 <> 7").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 100).alias("cluster"))
    out = identity.stable_clusters(now, before)
    return out.select("cluster", F.coalesce("identity", F.lit(-1)).alias("identity"), F.round(F.coalesce("jaccard", F.lit(0.0)) + 1e-11, 8).alias("jaccard"))


@query(
    "SELECT user_id, list_aggregate(list(x ORDER BY h), 'max') AS most, count(*) AS windows FROM (SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS x FROM events GROUP BY 1, 2) GROUP BY user_id"
)
def hourly_quota(t):
    """Largest count of events in a clock hour and the number of such hours, per user."""
    hours = t.events.groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("x"))
    return hours.groupBy("user_id").agg(F.max("x").alias("most"), F.count("*").alias("windows"))


@query(
    "WITH w AS (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spent FROM events) SELECT event_id, user_id, round(spent + 1e-9, 4) AS spent FROM w WHERE spent <= 500"
)
def spend_guard(t):
    """Events up to which a user's running value stays within a limit."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.withColumn("spent", F.sum("value").over(order)).where("spent <= 500").select("event_id", "user_id", F.round(F.col("spent") + 1e-9, 4).alias("spent"))
