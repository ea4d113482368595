"""Queries of result assembly, joins with reject counts, reports, anomalies and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arboryx.functions import text, vectors
from arboryx.lineage import cut
from arboryx.operators import assemble, first_answers, graph, ranking

from . import fixtures as fx
from .fixtures import EDGES, NODES
from .graph_queries import _RAW
from .registry import query


def _edges(t):
    """The trade graph, made and stored once a query."""
    if "_edges" not in t.__dict__:
        t.__dict__["_edges"] = cut(fx.trade_edges(t))
    return t.__dict__["_edges"]


def _spread(t):
    x = graph.spread(graph.conducting(_edges(t)), fx.region_seeds(t), "accumulate", hops=2)
    return x.withColumn("x", F.round(F.col("x") + 1e-11, 8))


def _chosen(t):
    nodes = fx.trade_nodes(t).select("id", F.col("kind").isin("nation", "region").alias("is_anchor"))
    return cut(assemble.strongest(_spread(t), nodes, 300, 10, 50))  # a few hundred rows a query, used several times


def _sql(tail: str) -> str:
    step = (
        "SELECT query_id, id, sum(x) AS x FROM (SELECT query_id, dst AS id, 0.5 * sum(x * cond) AS x FROM x{p} JOIN e ON id = src GROUP BY 1, 2 UNION ALL SELECT query_id, id, x FROM seeds) GROUP BY 1, 2"
    )
    rest = (
        ", y AS MATERIALIZED (SELECT query_id, id, round(x + 1e-11, 8) AS x FROM x2), few AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, id) AS r FROM y WHERE x > 0),"
        " told AS (SELECT f.query_id, f.id, x, id[1] IN ('n', 'r') AS is_anchor FROM few f WHERE r <= 350),"
        " kk AS (SELECT *, row_number() OVER (PARTITION BY query_id, is_anchor ORDER BY x DESC, id) AS k FROM told),"
        " chosen AS MATERIALIZED (SELECT query_id, id, x, CAST(row_number() OVER (PARTITION BY query_id ORDER BY x DESC, id) AS INTEGER) AS rank, is_anchor FROM kk WHERE k <= CASE WHEN is_anchor THEN 10 ELSE 300 END),"
        " inside AS (SELECT a.query_id, src, dst, rel, weight, a.x AS xs, b.x AS xt, CASE rel WHEN 'located_in' THEN 2 WHEN 'part_of' THEN 2 ELSE 1 END AS rel_rank"
        " FROM edges JOIN chosen a ON a.id = src JOIN chosen b ON b.id = dst AND a.query_id = b.query_id),"
        " one AS (SELECT query_id, least(src, dst) AS a, greatest(src, dst) AS b, first(rel ORDER BY rel_rank DESC, weight DESC, rel DESC, src DESC) AS rel, first(weight ORDER BY rel_rank DESC, weight DESC, rel DESC, src DESC) AS weight,"
        " max(rel_rank) AS rel_rank, min(least(xs, xt)) AS low FROM inside GROUP BY 1, 2, 3),"
        " sd AS (SELECT o.*, EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = o.query_id AND s.id IN (o.a, o.b)) AS seed FROM one o),"
        " redges AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY seed DESC, low DESC, rel_rank DESC, weight DESC, a, b) AS INTEGER) AS rank FROM sd) "
    )
    parts = [_RAW] + [f"x{i} AS MATERIALIZED ({step.format(p=i - 1)})" for i in (1, 2)]
    return "WITH " + ", ".join(parts) + rest + tail


def _rank_of():
    return F.when(F.col("rel").isin("located_in", "part_of"), 2).otherwise(1)


@query(_sql("SELECT * FROM chosen"))
def result_nodes(t):
    return _chosen(t)


@query(_sql("SELECT query_id, a, b, rel, round(weight, 8) AS weight, seed, rank FROM redges WHERE rank <= 200"))
def result_edges(t):
    out = assemble.result_edges(_edges(t), _chosen(t), fx.region_seeds(t), _rank_of())
    return out.select("query_id", "a", "b", "rel", F.round("weight", 8).alias("weight"), "seed", "rank")


@query(
    _sql(
        "SELECT query_id, src, dst, rel, round(0.01 * xs * xt + 1e-13, 12) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(0.01 * xs * xt, 12) DESC, src, dst, rel) AS n FROM inside) WHERE n <= 64"
    )
)
def hebbian_credit(t):
    out = assemble.hebbian(_edges(t), _chosen(t))
    return out.withColumn("delta", F.round(F.col("delta") + 1e-13, 12))


@query(
    _sql(
        "SELECT query_id, n.nodes, coalesce(e.edges, 0) AS edges, n.anchors, CASE WHEN coalesce(e.edges, 0) = 0 OR n.anchors = 0 THEN 'partial' ELSE 'good' END AS verdict,"
        " concat_ws('; ', CASE WHEN n.anchors = 0 THEN 'no anchors' END, CASE WHEN coalesce(e.edges, 0) = 0 THEN 'no direct edges' END) AS gaps"
        " FROM (SELECT query_id, count(*) AS nodes, count(*) FILTER (is_anchor) AS anchors FROM chosen GROUP BY 1) n LEFT JOIN (SELECT query_id, count(*) AS edges FROM redges WHERE rank <= 200 GROUP BY 1) e USING (query_id)"
    )
)
def result_verdicts(t):
    chosen = _chosen(t)
    edges = assemble.result_edges(_edges(t), chosen, fx.region_seeds(t), _rank_of())
    return assemble.verdicts(chosen, edges, fx.region_seeds(t))


@query(
    _sql(
        f", {NODES} SELECT query_id, string_agg(line, chr(10) ORDER BY part, rank, line) AS text FROM (SELECT query_id, 0 AS part, rank, label || ' (' || id || ')' AS line FROM chosen JOIN nodes USING (id)"
        " UNION ALL SELECT query_id, 1, rank, a || ' -' || rel || '- ' || b FROM redges WHERE rank <= 200) GROUP BY query_id"
    )
)
def result_text(t):
    chosen = _chosen(t)
    edges = assemble.result_edges(_edges(t), chosen, fx.region_seeds(t), _rank_of())
    return assemble.rendered(chosen, edges, fx.trade_nodes(t))


@query(
    "WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_partkey END AS a, CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE l_suppkey END AS b FROM lineitem),"
    " x AS (SELECT CASE WHEN a IS NULL THEN 'no subject' WHEN b IS NULL THEN 'no object' WHEN a = b THEN 'loop' ELSE 'kept' END AS reason FROM r) SELECT reason, count(*) AS n FROM x GROUP BY 1"
)
def lookup_join_reasons(t):
    """Relations whose ends resolve to parts and suppliers, others counted by the first reason."""
    parts = t.part.where("p_partkey % 13 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("a"))
    supps = t.supplier.where("s_suppkey % 17 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_suppkey").alias("b"))
    both = t.lineitem.select("l_partkey", "l_suppkey").join(parts, "l_partkey", "left").join(supps, "l_suppkey", "left")
    reason = F.when(F.col("a").isNull(), "no subject").when(F.col("b").isNull(), "no object").when(F.col("a") == F.col("b"), "loop").otherwise("kept")
    return both.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resumable_chunks(t):
    """Candidates whose key a completed log does not hold."""
    return t.orders.join(t.lineitem.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_orderstatus")


@query(f"WITH {EDGES} SELECT src, dst, rel, round(weight, 8) AS weight FROM edges WHERE weight >= 0.3 AND src IN (SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND dst IN (SELECT 'p' || p_partkey FROM part WHERE p_size <= 25)")
def induced_subgraph(t):
    a = t.customer.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"))
    b = t.part.where("p_size <= 25").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("dst"))
    out = fx.trade_edges(t).where("weight >= 0.3").join(a, "src", "left_semi").join(b, "dst", "left_semi")
    return out.select("src", "dst", "rel", F.round("weight", 8).alias("weight"))


@query(
    f"WITH {EDGES}, d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id) SELECT c_custkey, coalesce(n, 0) AS degree FROM customer LEFT JOIN d ON id = 'c' || c_custkey WHERE coalesce(n, 0) < 5"
)
def low_connectivity(t):
    degree = fx.trade_edges(t).select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    people = t.customer.select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return people.join(degree, "id", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("degree")).where("degree < 5")


@query(
    "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice) + 1e-9, 4) AS mean, grouping_id(o_orderpriority, o_orderstatus) AS g FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)"
)
def status_cube(t):
    """Counts and means by priority, status and both, and over all, in one pass."""
    out = t.orders.cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.grouping_id().alias("g"))
    return out.withColumn("mean", F.round(F.col("mean") + 1e-9, 4))


_DAY = "d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS cost, count(*) FILTER (o_orderstatus = 'F') / count(*) AS failed FROM orders GROUP BY 1)"


@query(
    f"WITH {_DAY}, m AS (SELECT *, median(cost) OVER w AS med, count(*) OVER w AS prior FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))"
    " SELECT CAST(day AS VARCHAR) AS day, concat_ws(',', CASE WHEN prior >= 5 AND cost > 1.5 * med THEN 'cost' END, CASE WHEN failed > 0.5 THEN 'failures' END) AS anomalies FROM m"
)
def daily_anomalies(t):
    """Days whose cost is beyond 1.5 times the median of up to 30 earlier ones, or with many failures.

    The window runs over one row per day, whose number does not grow with the orders of a day.
    """
    day = F.col("o_orderdate").cast("date")
    daily = t.orders.groupBy(day.alias("day")).agg(F.sum("o_totalprice").alias("cost"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("failed"))
    w = Window.orderBy("day").rowsBetween(-30, -1)
    told = daily.withColumns({"med": F.percentile("cost", F.lit(0.5)).over(w), "prior": F.count("*").over(w)})
    flags = F.concat_ws(",", F.when((F.col("prior") >= 5) & (F.col("cost") > 1.5 * F.col("med")), "cost"), F.when(F.col("failed") > 0.5, "failures"))
    return told.select(F.col("day").cast("string").alias("day"), flags.alias("anomalies"))


@query(
    "SELECT p_brand, count(*) AS n, CAST((count(*) < 30)::INT + (avg(p_size) < 25)::INT + (count(DISTINCT p_type) < 10)::INT AS INTEGER) AS fired, CASE WHEN count(*) < 30 AND avg(p_size) < 25 THEN 'stub' ELSE 'full' END AS verdict FROM part GROUP BY 1"
)
def stub_verdicts(t):
    few, small, narrow = F.count("*") < 30, F.avg("p_size") < 25, F.countDistinct("p_type") < 10
    fired = few.cast("int") + small.cast("int") + narrow.cast("int")
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n"), fired.alias("fired"), F.when(few & small, "stub").otherwise("full").alias("verdict"))


@query(
    "SELECT event_type, round(min(h), 1) AS first_hour, max_by(user_id, (value, user_id)) AS top_user, mode_ AS common_hour FROM (SELECT *, hour(ts) AS h FROM events) JOIN"
    " (SELECT event_type, first(h ORDER BY n DESC, h) AS mode_ FROM (SELECT event_type, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1) USING (event_type) GROUP BY event_type, mode_"
)
def dominant_keys(t):
    """First hour, user of the largest value and most common hour of each event type, ties by the smaller key."""
    e = t.events.withColumn("h", F.hour("ts"))
    hours = e.groupBy("event_type", "h").agg(F.count("*").alias("n")).groupBy("event_type").agg(F.max_by("h", F.struct("n", -F.col("h"))).alias("common_hour"))
    one = e.groupBy("event_type").agg(F.min("h").cast("double").alias("first_hour"), F.max_by("user_id", F.struct("value", "user_id")).alias("top_user"))
    return one.join(hours, "event_type")


@query("SELECT event_id, user_id, get_k AS k FROM (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS get_k FROM events)")
def json_properties(t):
    return t.events.select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"))


@query(
    "WITH h AS (SELECT doc_id, source, md5(doc_id || ':7') AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS n, count(*) OVER (PARTITION BY source) AS total FROM h)"
    " SELECT doc_id, source FROM r WHERE n <= greatest(3, ceil(total * 0.1))"
)
def pool_sample(t):
    """A tenth of each source's documents by hash, three at least: a sampling operator.

    Sources may be large, so counts come from an aggregate and each source's rows are limited before the shuffle.
    """
    hashed = t.documents.select("doc_id", "source", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7"))).alias("h"))
    sizes = hashed.groupBy("source").agg(F.greatest(F.lit(3), F.ceil(F.count("*") * 0.1)).alias("most"))
    w = Window.partitionBy("source").orderBy("h", "doc_id")
    return hashed.withColumn("n", F.row_number().over(w)).join(sizes, "source").where("n <= most").select("doc_id", "source")


@query(
    "WITH s AS (SELECT doc_id, sum(CASE WHEN w IN ('the', 'and') THEN 1 ELSE 0 END) AS hits, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY 1)"
    " SELECT doc_id, CAST(hits AS BIGINT) AS hits, CASE WHEN hits >= 10 THEN 'high' WHEN hits >= 1 THEN 'mid' ELSE 'none' END AS verdict FROM s"
)
def keyword_classes(t):
    w = text.tokens(F.col("text"))
    hits = F.size(F.filter(w, lambda x: x.isin("the", "and"))).cast("long")
    out = t.documents.where(F.size(w) > 0).select("doc_id", hits.alias("hits"))
    return out.withColumn("verdict", F.when(F.col("hits") >= 10, "high").when(F.col("hits") >= 1, "mid").otherwise("none"))


@query(
    "WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS b, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
    " SELECT conv_id, turn, md5(concat_ws(' | ', b, text, a)) AS context FROM t WHERE role = 'assistant'"
)
def sentence_context(t):
    """Assistant turns with the turn before and after."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    told = t.conversations.withColumns({"b": F.lag("text").over(w), "a": F.lead("text").over(w)})
    return told.where("role = 'assistant'").select("conv_id", "turn", F.md5(F.concat_ws(" | ", "b", "text", "a")).alias("context"))


@query(
    "SELECT a.vec_id AS id, round(list_inner_product(CAST(a.embedding AS DOUBLE[])[1:7], CAST(b.embedding AS DOUBLE[])[1:7]) / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[])[1:7], CAST(a.embedding AS DOUBLE[])[1:7]) *"
    " list_inner_product(CAST(b.embedding AS DOUBLE[])[1:7], CAST(b.embedding AS DOUBLE[])[1:7])) + 1e-11, 8) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
)
def frame_cosines(t):
    """Cosine of the first seven components of each vector and the next."""
    f = t.embeddings.select("vec_id", F.transform(F.slice("embedding", 1, 7), lambda x: x.cast("double")).alias("f"))
    nxt = f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("f").alias("g"))
    return f.join(nxt, "vec_id").select(F.col("vec_id").alias("id"), F.round(vectors.frame_cosine(F.col("f"), F.col("g")) + 1e-11, 8).alias("cosine"))


@query(
    "WITH m AS (SELECT o_custkey AS c, list(DISTINCT l_partkey) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"
    " SELECT a.c AS id, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) + 1e-11, 8) AS jaccard FROM m a JOIN m b ON b.c = a.c + 1"
)
def set_similarity(t):
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("c")).agg(F.collect_set("l_partkey").alias("s"))
    nxt = lines.select((F.col("c") - 1).alias("c"), F.col("s").alias("z"))
    return lines.join(nxt, "c").select(F.col("c").alias("id"), F.round(vectors.jaccard(F.col("s"), F.col("z")) + 1e-11, 8).alias("jaccard"))


@query(
    "WITH q AS (SELECT user_id % 10 AS q, event_type AS id, max(value) AS s FROM events GROUP BY 1, 2 UNION ALL SELECT user_id % 10, event_type, avg(value) FROM events GROUP BY 1, 2)"
    " SELECT q AS query_id, id, round(max(s) + 1e-9, 6) AS score, count(*) AS votes FROM q GROUP BY 1, 2"
)
def multi_query_merge(t):
    """Best score per node over two sub-queries."""
    g = t.events.groupBy((F.col("user_id") % 10).alias("query_id"), F.col("event_type").alias("id"))
    both = g.agg(F.max("value").alias("s")).union(g.agg(F.avg("value").alias("s")))
    return both.groupBy("query_id", "id").agg(F.round(F.max("s") + 1e-9, 6).alias("score"), F.count("*").alias("votes"))


@query()
def kmeans_clusters(t):
    """Spark's k-means by cosine over unit vectors, k = max(5, floor(sqrt(n))), until it settles."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = t.embeddings.select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    n = data.count()
    k = min(n, max(5, int(n**0.5)))
    model = KMeans(k=k, seed=0, distanceMeasure="cosine", maxIter=100).fit(data)
    return model.transform(data).select("vec_id", F.col("prediction").alias("cluster"))


@query(
    f"WITH {EDGES}, s AS (SELECT rel, count(*) AS n, sum(weight) AS w, stddev_pop(weight) AS sd, avg(weight) AS m FROM edges GROUP BY rel) SELECT rel, n, round(w + 1e-9, 4) AS total, sd > 3 * m AS uneven FROM s"
)
def relation_report(t):
    g = fx.trade_edges(t).groupBy("rel").agg(F.count("*").alias("n"), F.round(F.sum("weight") + 1e-9, 4).alias("total"), (F.stddev_pop("weight") > 3 * F.avg("weight")).alias("uneven"))
    return g


@query(
    "WITH e AS (SELECT c_nationkey AS k, c_custkey AS id, c_acctbal AS x FROM customer), p AS (SELECT a.id AS l, b.id AS r, abs(a.x - b.x) AS d FROM e a JOIN e b ON a.k = b.k AND a.id < b.id AND abs(a.x - b.x) <= 50),"
    " r AS (SELECT l, r, d, row_number() OVER (PARTITION BY l ORDER BY d, r) AS n FROM p) SELECT l, r, round(d + 1e-9, 4) AS d FROM r WHERE n <= 5"
)
def association_proposals(t):
    """Customers of a nation whose balances are within 50, five partners each; a range join over bands of 50."""
    e = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.floor(F.col("c_acctbal") / 50).alias("band"))
    left = e.select("k", F.col("id").alias("l"), F.col("x").alias("xl"), F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
    right = e.select("k", F.col("id").alias("r"), F.col("x").alias("xr"), "band")
    pairs = left.join(right, ["k", "band"]).where("l < r").withColumn("d", F.abs(F.col("xl") - F.col("xr"))).where("d <= 50")
    return ranking.top(pairs, ["l"], [F.col("d"), F.col("r")], 5, "n").select("l", "r", F.round(F.col("d") + 1e-9, 4).alias("d"))


@query(
    "SELECT l_orderkey, l_linenumber, o_orderdate AS asof FROM (SELECT l.l_orderkey, l.l_linenumber, o.o_orderdate, row_number() OVER (PARTITION BY rid ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS n"
    " FROM (SELECT *, row_number() OVER () AS rid FROM lineitem) l JOIN orders me ON me.o_orderkey = l.l_orderkey JOIN orders o ON o.o_custkey = me.o_custkey AND o.o_orderdate <= l.l_shipdate) WHERE n = 1"
)
def latest_order_at_shipping(t):
    """As-of join: the customer's latest order when a line shipped."""
    mine = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate").join(mine, "l_orderkey")
    timeline = lines.select("o_custkey", F.col("l_shipdate").alias("at"), F.lit(1).alias("kind"), "l_orderkey", "l_linenumber", F.lit(None).cast("timestamp_ntz").alias("o_orderdate")).unionByName(
        t.orders.select("o_custkey", F.col("o_orderdate").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("l_orderkey"), F.lit(None).cast("int").alias("l_linenumber"), "o_orderdate")
    )
    w = Window.partitionBy("o_custkey").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return timeline.withColumn("asof", F.last("o_orderdate", True).over(w)).where("kind = 1 and asof is not null").select("l_orderkey", "l_linenumber", "asof")


_FIRST = (
    ", f AS MATERIALIZED (SELECT query_id, id, round(x + 1e-11, 8) AS x FROM x2), sc AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, id) AS rank, least(1.0, x / max(x) OVER (PARTITION BY query_id)) AS score FROM f),"
    " ff AS MATERIALIZED (SELECT * FROM sc WHERE rank <= 400 AND score >= 0.0001), nd AS (SELECT id, kind, label, abs(score) AS confidence, CASE WHEN kind = 'nation' THEN NULL ELSE kind || ' ' || substr(id, 2, 1) END AS identifier FROM nodes),"
    " tt AS (SELECT ff.query_id, ff.rank, ff.score, nd.* FROM ff JOIN nd ON nd.id = ff.id) "
)


def _first_sql(tail: str) -> str:
    step = "SELECT query_id, id, sum(x) AS x FROM (SELECT query_id, dst AS id, 0.5 * sum(x * cond) AS x FROM x{p} JOIN e ON id = src GROUP BY 1, 2 UNION ALL SELECT query_id, id, x FROM seeds) GROUP BY 1, 2"
    parts = [_RAW, NODES] + [f"x{i} AS MATERIALIZED ({step.format(p=i - 1)})" for i in (1, 2)]
    return "WITH " + ", ".join(parts) + _FIRST + tail


def _first(t):
    found = first_answers.scored(_spread(t), 400, 0.0001)
    kind = F.col("kind")
    nodes = fx.trade_nodes(t).select("id", "label", F.abs("score").alias("confidence"), F.lit(None).cast("string").alias("description"), kind.alias("source_type"), F.when(kind != "nation", F.concat_ws(" ", kind, F.substring("id", 2, 1))).alias("identifier"), F.lit("").alias("location"))
    return first_answers.assembled(found, nodes, _edges(t)), found


@query(_first_sql("SELECT query_id, kind AS source_type, identifier, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first_) AS INTEGER) AS place FROM (SELECT query_id, kind, coalesce(identifier, '') AS identifier, min(rank) AS first_ FROM tt GROUP BY 1, 2, 3)"))
def first_sources(t):
    """Sources of the first generation's results, each once in the order of the nodes."""
    return _first(t)[0]["sources"]


@query(_first_sql("SELECT a.query_id, src, dst, rel, round(max(weight), 8) AS weight FROM edges JOIN ff a ON a.id = src JOIN ff b ON b.id = dst AND b.query_id = a.query_id GROUP BY 1, 2, 3, 4"))
def first_edges(t):
    """Edges among the nodes of the first generation's results."""
    return _first(t)[0]["edges"].withColumn("weight", F.round("weight", 8))


@query(
    _first_sql(
        ", k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, rank) AS place FROM tt), l AS (SELECT query_id, string_agg('- [' || id || '] ' || label || ' — ' || coalesce(identifier, 'unknown source'), chr(10) ORDER BY place) AS t, string_agg(id, ',' ORDER BY place) AS cited FROM k WHERE place <= 6 GROUP BY 1)"
        " SELECT query_id, t AS text, cited FROM l UNION ALL SELECT 'nobody', 'No language model, and no node was found.', ''"
    ).replace("nd ON nd.id = ff.id) ,", "nd ON nd.id = ff.id),")
)
def offline_answers(t):
    """Answers put together without a language model, one of a question that found nothing; confidences are left out of the comparison."""
    told, found = _first(t)
    asked = found.select("query_id").distinct().unionByName(t.spark.createDataFrame([("nobody",)], "query_id string"))
    out = first_answers.offline_answer(told["nodes"], asked)
    lines = F.regexp_replace(F.regexp_replace("text", " \\(confidence [0-9.]+\\)", ""), "^No language model: [^\n]*\n", "")
    return out.select("query_id", lines.alias("text"), F.array_join("cited", ",").alias("cited"))
