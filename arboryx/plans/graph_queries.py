"""Queries of graph building and spreading activation."""

from __future__ import annotations

from pyspark.sql import functions as F

from arboryx.operators import graph

from . import fixtures as fx
from .fixtures import EDGES, NODES, SEEDS
from .registry import query


#: Added before rounding, so that values that lie on a tie round alike in every engine.
NUDGE = 1e-11


def _rounded(df, *cols, places=8):
    return df.withColumns({c: F.round(F.col(c) + NUDGE, places) for c in cols})


@query(f"WITH {EDGES} SELECT src, dst, rel, round(weight + 1e-11, 8) AS weight FROM edges")
def trade_graph(t):
    return _rounded(fx.trade_edges(t), "weight")


@query(f"WITH {EDGES} SELECT src, dst, round(weight / greatest(sum(weight) OVER (PARTITION BY src), 1e-12) + 1e-11, 8) AS cond FROM edges WHERE src <> dst")
def row_normalised_graph(t):
    return _rounded(graph.row_normalised(graph.conducting(fx.trade_edges(t))), "cond")


@query(
    f"WITH {EDGES} SELECT src, dst, round(weight / sqrt(greatest(sum(weight) OVER (PARTITION BY src) * sum(weight) OVER (PARTITION BY dst), 1e-24)) + 1e-11, 8) AS cond"
    " FROM edges WHERE src <> dst"
)
def sym_normalised_graph(t):
    return _rounded(graph.sym_normalised(graph.conducting(fx.trade_edges(t))), "cond")


@query(f"WITH {EDGES} SELECT dst AS id, count(*) AS in_degree, round(sum(weight) + 1e-11, 6) AS in_strength FROM edges WHERE src <> dst GROUP BY dst")
def node_strength(t):
    edges = graph.conducting(fx.trade_edges(t))
    return _rounded(graph.in_degree(edges).join(graph.in_strength(edges), "id"), "in_strength", places=6)


@query(f"WITH {EDGES} SELECT id, round(sum(weight) + 1e-11, 6) AS potential FROM (SELECT src AS id, weight FROM edges UNION ALL SELECT dst, weight FROM edges) GROUP BY id")
def node_potentials(t):
    return _rounded(graph.potentials(fx.trade_edges(t)), "potential", places=6)


@query(
    f"WITH {EDGES} SELECT id, count(DISTINCT n) AS degree FROM (SELECT src AS id, dst AS n FROM edges UNION ALL SELECT dst, src FROM edges) WHERE id <> n"
    " GROUP BY id HAVING count(DISTINCT n) >= 20"
)
def degree_selection(t):
    return graph.adjacency(fx.trade_edges(t)).groupBy("id").agg(F.count("*").alias("degree")).where("degree >= 20")


def _frames_sql(step: str, n: int, base: str, out: str = "SELECT query_id, id, round(x + 1e-11, 8) AS x FROM x{n}") -> str:
    """Chained steps: {i} is a step's number, {p} its predecessor's."""
    parts = [base] + [f"x{i} AS MATERIALIZED ({step.format(i=i, p=i - 1)})" for i in range(1, n + 1)]
    return "WITH " + ", ".join(parts) + " " + out.format(n=n)


_RAW = f"{EDGES}, {SEEDS}, e AS MATERIALIZED (SELECT src, dst, weight AS cond FROM edges WHERE src <> dst), x0 AS (SELECT * FROM seeds)"
_NORM = (
    f"{EDGES}, {SEEDS}, e AS MATERIALIZED (SELECT src, dst, weight / greatest(sum(weight) OVER (PARTITION BY src), 1e-12) AS cond FROM edges WHERE src <> dst),"
    " x0 AS (SELECT * FROM seeds)"
)
_MOVE = "SELECT query_id, dst AS id, {k} * sum(x * cond) AS x FROM x{{p}} JOIN e ON id = src GROUP BY 1, 2"
_PPR_STEP = (
    "SELECT query_id, id, sum(x) AS x FROM (SELECT query_id, dst AS id, 0.85 * sum(x * cond) AS x FROM x{p} JOIN e ON id = src GROUP BY 1, 2"
    " UNION ALL SELECT query_id, id, 0.15 * x FROM seeds) GROUP BY 1, 2"
)


@query(_frames_sql(_MOVE.format(k=0.5), 3, _RAW))
def spread_raw(t):
    return _rounded(graph.spread(graph.conducting(fx.trade_edges(t)), fx.region_seeds(t), "raw"), "x")


@query(_frames_sql(_MOVE.format(k=0.5), 3, _NORM))
def spread_degnorm(t):
    return _rounded(graph.spread(graph.conducting(fx.trade_edges(t)), fx.region_seeds(t), "degnorm"), "x")


@query(_frames_sql(_PPR_STEP, 12, _NORM))
def spread_ppr(t):
    return _rounded(graph.spread(graph.conducting(fx.trade_edges(t)), fx.region_seeds(t), "ppr"), "x")


@query(
    _frames_sql(
        "SELECT query_id, id, sum(x) AS x FROM (SELECT query_id, dst AS id, 0.85 * sum(x * cond) / sqrt(any_value(greatest(d.n, 1))) AS x FROM x{p} JOIN e ON id = src"
        " JOIN deg d ON d.did = dst GROUP BY 1, 2 UNION ALL SELECT query_id, id, 0.15 * x FROM seeds) GROUP BY 1, 2",
        12,
        _NORM + ", deg AS (SELECT dst AS did, count(*) AS n FROM e GROUP BY 1)",
    )
)
def spread_ppr_degree_penalty(t):
    return _rounded(graph.spread(graph.conducting(fx.trade_edges(t)), fx.region_seeds(t), "ppr", beta=0.5), "x")


@query(
    _frames_sql(_MOVE.format(k=0.5), 3, _RAW, " UNION ALL ".join(f"SELECT query_id, id, round(x + 1e-11, 8) AS x, {i} AS iteration FROM x{i}" for i in (1, 2, 3)))
)
def spread_trace(t):
    return _rounded(graph.spread(graph.conducting(fx.trade_edges(t)), fx.region_seeds(t), "raw", trace=True), "x")


@query(
    _frames_sql(
        "SELECT query_id, id, sum(x) AS x FROM (SELECT query_id, dst AS id, 0.5 * sum(x * cond) AS x FROM x{p} JOIN e ON id = src GROUP BY 1, 2"
        " UNION ALL SELECT query_id, id, x FROM seeds) GROUP BY 1, 2",
        3,
        _RAW,
    )
)
def spread_accumulating(t):
    return _rounded(graph.spread(graph.conducting(fx.trade_edges(t)), fx.region_seeds(t), "accumulate"), "x")


@query(f"WITH {EDGES}, {SEEDS} SELECT query_id, dst AS id, round(sum(x * weight) + 1e-11, 8) AS x FROM seeds JOIN edges ON id = src WHERE rel = 'bought' GROUP BY 1, 2")
def relation_hop(t):
    bought = graph.conducting(fx.trade_edges(t).where("rel = 'bought'"))
    return _rounded(graph.spread(bought, fx.region_seeds(t), "raw", hops=1, damping=1.0), "x")


_STRENGTH = "CASE rel WHEN 'bought' THEN 2.0 WHEN 'supplied_by' THEN 1.0 ELSE 0.0 END"


@query(
    _frames_sql(
        "SELECT query_id, id, sum(x) AS x FROM (SELECT * FROM (SELECT query_id, dst AS id, 0.85 * sum(x * w) AS x FROM x{p} JOIN e ON id = src GROUP BY 1, 2) WHERE x >= 0.0001"
        " UNION ALL SELECT query_id, id, 0.2 * x FROM x{p}) GROUP BY 1, 2",
        3,
        f"{EDGES}, {SEEDS}, e AS MATERIALIZED (SELECT src, dst, weight * ln(1 + {_STRENGTH}) * 0.5 AS w FROM edges WHERE rel IN ('bought', 'supplied_by')), x0 AS (SELECT * FROM seeds)",
    )
)
def codebook_activation(t):
    strength = F.when(F.col("rel") == "bought", 2.0).when(F.col("rel") == "supplied_by", 1.0).otherwise(0.0)
    edges = fx.trade_edges(t).withColumns({"strength": strength, "match": F.lit(0.5)})
    return _rounded(graph.codebook_spread(edges, fx.region_seeds(t), threshold=0.0001), "x")


_TYPED = f"{EDGES}, {SEEDS}, e AS MATERIALIZED (SELECT src, dst, weight * CASE WHEN rel = 'part_of' OR rel = 'located_in' THEN 3 ELSE 1 END AS cond FROM edges), x0 AS (SELECT * FROM seeds)"


@query(_frames_sql(_MOVE.format(k=0.5), 3, _TYPED))
def typed_edge_boost(t):
    """Edges whose descriptor has a property of the vocabulary conduct three times as much."""
    vocab = fx.trade_edges(t).select("rel").distinct().where(F.col("rel").isin("part_of", "located_in")).withColumn("pid", F.concat(F.lit("P-"), "rel"))
    boosted = fx.trade_edges(t).join(vocab, "rel", "left").select("src", "dst", F.when(F.col("pid").isNotNull(), F.col("weight") * 3).otherwise(F.col("weight")).alias("cond"))
    return _rounded(graph.spread(boosted, fx.region_seeds(t), "raw"), "x")


@query(
    f"WITH {EDGES}, {NODES}, f AS (SELECT id, greatest(0.0, least(1.0, score)) AS c FROM nodes)"
    " SELECT src, dst, round(CASE WHEN least(a.c, b.c) >= 0.1 THEN weight * least(a.c, b.c) ELSE 0 END + 1e-11, 8) AS cond"
    " FROM edges JOIN f a ON a.id = src JOIN f b ON b.id = dst WHERE src <> dst"
)
def consistency_routing(t):
    """Edges scaled by the smaller consistency of their ends, nothing below 0.1."""
    fits = fx.trade_nodes(t).select("id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("c"))
    edges = graph.conducting(fx.trade_edges(t))
    both = edges.join(fits.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(fits.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst")
    low = F.least("a", "b")
    return both.select("src", "dst", F.round(F.when(low >= 0.1, F.col("cond") * low).otherwise(0.0) + NUDGE, 8).alias("cond"))


@query(
    _frames_sql(
        _MOVE.format(k=0.5), 3, _RAW,
        "SELECT query_id, id, round(x + 1e-11, 8) AS x FROM x3 WHERE id NOT IN (SELECT dst FROM e GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 10)",
    )
)
def hub_masking(t):
    edges = graph.conducting(fx.trade_edges(t))
    return _rounded(graph.mask_hubs(graph.spread(edges, fx.region_seeds(t), "raw"), edges, fx.region_seeds(t), 10), "x")


_PATHS = (
    f"WITH RECURSIVE {EDGES}, strong AS (SELECT src, dst, weight FROM edges WHERE weight >= 0.5), walk AS ("
    " SELECT 'c' || c_custkey AS start, ['c' || c_custkey] AS path, 1.0::DOUBLE AS score FROM customer"
    " UNION ALL SELECT start, list_append(path, dst), score * weight FROM walk JOIN strong ON path[-1] = src WHERE len(path) <= 3 AND NOT list_contains(path, dst))"
)


@query(_PATHS + " SELECT start, array_to_string(path, '>') AS path, round(score + 1e-11, 8) AS score FROM walk WHERE len(path) > 1")
def simple_paths(t):
    starts = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    paths = graph.simple_paths(fx.trade_edges(t), starts, 3, 0.5)
    return paths.select("start", F.array_join("path", ">").alias("path"), F.round(F.col("score") + NUDGE, 8).alias("score"))


@query(
    _PATHS + f", {SEEDS}, b AS (SELECT query_id, p.path[-1] AS id, s.x * p.score AS x FROM seeds s JOIN walk p ON s.id = p.start WHERE p.path[-1] NOT LIKE 'c%'),"
    " m AS (SELECT query_id, id, round(max(x), 10) AS x FROM b GROUP BY 1, 2),"
    " r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY x DESC, id) AS INTEGER) AS rank FROM m) SELECT * FROM r WHERE rank <= 20"
)
def multi_hop_search(t):
    """The 20 best nodes per region other than its customers, by the product of weights along a path."""
    seeds = fx.region_seeds(t)
    paths = graph.simple_paths(fx.trade_edges(t), seeds.select("id").distinct(), 3, 0.5)
    from pyspark.sql import Window

    hit = seeds.join(paths, F.col("id") == F.col("start")).select("query_id", F.element_at("path", -1).alias("id"), (F.col("x") * F.col("score")).alias("x"))
    best = hit.groupBy("query_id", "id").agg(F.round(F.max("x"), 10).alias("x"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("x"), "id"))).where("rank <= 20")


@query(
    f"WITH {EDGES}, a AS (SELECT DISTINCT src AS id, dst AS n FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),"
    " d0 AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS id, 0 AS distance FROM supplier),"
    " d1 AS (SELECT DISTINCT start, n AS id, 1 AS distance FROM d0 JOIN a USING (id)),"
    " d2 AS (SELECT DISTINCT start, n AS id, 2 AS distance FROM d1 JOIN a USING (id))"
    " SELECT start, id, min(distance) AS distance FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) GROUP BY 1, 2"
)
def neighbourhood(t):
    starts = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return graph.neighbourhood(fx.trade_edges(t), starts, 2)


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT 'u' || user_id AS a, event_type || ':' || CAST(floor(value) AS BIGINT) AS b FROM events),"
    " s AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),"
    " reach AS (SELECT x AS id, x AS c FROM s UNION SELECT s.y, reach.c FROM reach JOIN s ON s.x = reach.id AND reach.c < s.y)"
    " SELECT id, min(c) AS component FROM reach GROUP BY id"
)
def event_components(t):
    """Users and the (type, whole value) of their events, connected."""
    edges = t.events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"),
        F.concat_ws(":", "event_type", F.floor("value").cast("string")).alias("dst"),
    ).distinct()
    return graph.components(edges)


@query(
    _frames_sql(
        _PPR_STEP, 12, _NORM,
        "SELECT query_id, round(sum(x) * sum(x) / sum(x * x) + 1e-11, 4) AS participation, round(sum(x) FILTER (r <= 10) / sum(x) + 1e-11, 6) AS top10,"
        " round(sum(x) FILTER (r <= 100) / sum(x) + 1e-11, 6) AS top100, round(sum(x) FILTER (r <= 1000) / sum(x) + 1e-11, 6) AS top1000"
        " FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, id) AS r FROM x12 ANTI JOIN seeds USING (query_id, id)) GROUP BY query_id",
    )
)
def energy_concentration(t):
    seeds = fx.region_seeds(t)
    out = graph.concentration(graph.spread(graph.conducting(fx.trade_edges(t)), seeds), seeds)
    return _rounded(_rounded(out, "participation", places=4), "top10", "top100", "top1000", places=6)


@query(
    _frames_sql(
        _MOVE.format(k=0.5), 2, _RAW,
        "SELECT query_id, a.id AS src, b.id AS dst, round(0.01 * a.x * b.x, 12) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 10) DESC, id) AS r FROM x2) a"
        " JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 10) DESC, id) AS r FROM x2) b USING (query_id)"
        " WHERE a.r <= 10 AND b.r <= 10 AND a.id < b.id AND NOT EXISTS (SELECT 1 FROM e WHERE (e.src = a.id AND e.dst = b.id) OR (e.src = b.id AND e.dst = a.id))",
    )
)
def dream_proposals(t):
    """Deltas for pairs among a query's ten most active nodes that no edge joins yet."""
    from pyspark.sql import Window

    edges = graph.conducting(fx.trade_edges(t))
    x = graph.spread(edges, fx.region_seeds(t), "raw", hops=2)
    top = x.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("x", 10)), "id"))).where("r <= 10")
    a, b = top.alias("a"), top.alias("b")
    pairs = a.join(b, "query_id").where("a.id < b.id").select("query_id", F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.round(0.01 * F.col("a.x") * F.col("b.x"), 12).alias("delta"))
    known = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return pairs.join(known, ["src", "dst"], "left_anti").select("query_id", "src", "dst", "delta")
