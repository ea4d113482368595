"""Queries of lookups, filters, queues, searches and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from arboryx.operators import lookup, spans, watch

from . import fixtures as fx
from .fixtures import EDGES, NODES
from .registry import query
from .source_queries import _folder


@query(f"WITH {NODES} SELECT * FROM nodes WHERE id IN (SELECT 'c' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def multi_get(t):
    """Nodes of all customers with an urgent order."""
    asked = t.orders.where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"))
    return lookup.multi_get(fx.trade_nodes(t), asked)


@query("SELECT lower(p_name) AS key, min(p_partkey) AS id FROM part WHERE lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_size % 7 = 0) GROUP BY 1")
def key_lookup(t):
    """The first part of each name that a part of some sizes has."""
    index = t.part.select(F.lower("p_name").alias("key"), F.col("p_partkey").alias("id"))
    return lookup.by_key(index, t.part.where("p_size % 7 = 0").select(F.lower("p_name").alias("key")))


@query(
    "WITH q AS (SELECT p_brand AS query_id, p_type AS label, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS ordinal FROM (SELECT DISTINCT p_brand, p_type FROM part)),"
    " f AS (SELECT p_type AS label, p_partkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part) WHERE n <= 3),"
    " s AS (SELECT query_id, id, min(ordinal) AS o, arg_min(label, ordinal) AS label FROM q JOIN f USING (label) GROUP BY 1, 2),"
    " r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o, id) AS INTEGER) AS rank, id, label FROM s) SELECT * FROM r WHERE rank <= 32"
)
def label_lookup(t):
    """Parts of any brand for the list of types that each brand has, three a type, 32 in all."""
    from pyspark.sql import Window

    types = t.part.select(F.col("p_brand").alias("query_id"), F.col("p_type").alias("label")).distinct()
    asked = types.withColumn("ordinal", F.row_number().over(Window.partitionBy("query_id").orderBy("label")))
    return lookup.by_labels(t.part.select(F.col("p_type").alias("label"), F.col("p_partkey").alias("id")), asked, 3, 32)


_LAST = "e AS (SELECT 'c' || o_custkey AS src, o_orderpriority AS dst, max(o_orderdate) AS last_traversed, avg(o_totalprice) / 100000 - 1.5 AS delta FROM orders GROUP BY 1, 2)"


def _traversed(t):
    return t.orders.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.col("o_orderpriority").alias("dst")).agg(
        F.max("o_orderdate").alias("last_traversed"), (F.avg("o_totalprice") / 100000 - 1.5).alias("delta")
    )


@query(f"WITH {_LAST} SELECT src, dst, last_traversed FROM e WHERE last_traversed < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY AND abs(delta) > 0.25")
def aged_edges(t):
    """Edges between customers and priorities not used for a year that still carry something."""
    horizon = t.orders.agg(F.max("o_orderdate").alias("m"))
    told = _traversed(t).crossJoin(F.broadcast(horizon))  # one row
    return lookup.aged(told, F.col("m") - F.expr("INTERVAL 365 DAYS"), 0.25).select("src", "dst", "last_traversed")


@query("WITH x AS (SELECT source, min(doc_id) AS x FROM documents WHERE source <> '' GROUP BY 1) SELECT doc_id AS id, source AS identifier FROM documents JOIN x USING (source) WHERE doc_id <> x")
def nodes_of_sources(t):
    """Documents of every source but its first one."""
    nodes = t.documents.select(F.col("doc_id").alias("id"), F.struct(F.col("source").alias("identifier")).alias("source_ref"))
    asked = nodes.groupBy(F.col("source_ref.identifier").alias("identifier")).agg(F.min("id").alias("exclude_id"))
    return lookup.of_source(nodes, asked).select("id", "source_ref.identifier")


@query("SELECT o_orderkey AS id, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def pending_queue(t):
    """The hundred newest orders in progress."""
    return lookup.newest_pending(t.orders.select(F.col("o_orderkey").alias("id"), "o_orderdate", "o_orderstatus"), F.col("o_orderstatus") == "P", "o_orderdate").drop("o_orderstatus")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate - INTERVAL 30 DAY ELSE o_orderdate END, o_orderdate, o_orderkey LIMIT 100")
def oldest_batch(t):
    """A batch of open orders: when sampled (two of three were, a month before), or else when they came."""
    sampled = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") - F.expr("INTERVAL 30 DAYS"))
    entries = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.col("o_orderdate").alias("acquired"), sampled.alias("sampled"))
    return lookup.oldest_first(entries, F.col("o_orderstatus") == "O", "sampled", "acquired").select("id")


@query(f"WITH {NODES} SELECT id, label, score FROM nodes WHERE kind = 'supplier'")
def layer_export(t):
    """Nodes stored by kind, one kind read back: only its folder is opened."""
    folder = _folder(t)
    fx.trade_nodes(t).write.partitionBy("kind").parquet(folder)
    return t.spark.read.parquet(folder).where("kind = 'supplier'").select("id", "label", "score")


_SEARCH = """n AS (SELECT 'p' || p_partkey AS id, lower(p_name) AS low, p_partkey AS k, p_size AS size, p_retailprice AS price FROM part),
q AS (SELECT k AS query_id, CASE WHEN k % 3 = 0 THEN id WHEN k % 3 = 1 THEN substr(low, 3, CAST(1 + (k // 50) % 9 AS INTEGER)) ELSE '~' || low END AS text, id AS own, size, price FROM n WHERE k % 50 = 0),
f AS (SELECT query_id, id, min(CASE WHEN id = text THEN 0 ELSE 1 END) AS tier, 0 AS near FROM q JOIN n ON id = text OR contains(low, text) GROUP BY 1, 2),
few AS (SELECT query_id FROM q LEFT JOIN f USING (query_id) GROUP BY 1 HAVING count(f.id) < 3),
near AS (SELECT query_id, n.id, row_number() OVER (PARTITION BY query_id ORDER BY abs(q.price - n.price), n.id) AS rank FROM q JOIN n ON q.size = n.size AND n.id <> own),
every AS (SELECT * FROM f UNION ALL SELECT query_id, id, 2, rank FROM near JOIN few USING (query_id) WHERE rank <= 20),
one AS (SELECT query_id, id, min(tier) AS tier, arg_min(near, tier * 1000 + near) AS near FROM every GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, near, id) AS INTEGER) AS rank, id, tier FROM one)"""


@query(f"WITH {_SEARCH} SELECT * FROM r WHERE rank <= 20")
def node_search(t):
    """Parts by id, by a part of their name, or else by their neighbours in price; every fiftieth part asks."""
    n = t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"), F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    low = F.lower("label")
    q = n.where("k % 50 = 0").select(F.col("k").alias("query_id"), F.when(F.col("k") % 3 == 0, F.col("id")).when(F.col("k") % 3 == 1, F.substring(low, F.lit(3), (1 + F.floor(F.col("k") / 50) % 9).cast("int"))).otherwise(F.concat(F.lit("~"), low)).alias("text"), F.col("id").alias("own"), "size", F.col("price").alias("qp"))
    near = lookup.closest(n.select("id", F.col("size").alias("grp"), F.col("price").alias("x")), q.select("query_id", "own", F.col("size").alias("grp"), F.col("qp").alias("x")))
    return lookup.search(n.select("id", "label"), q.select("query_id", "text"), near)


_NAMED = r"list_distinct(regexp_extract_all(b.text, '[A-Z][a-z]{3,}'))"


@query(
    "WITH p AS (SELECT a.conv_id, a.turn, ' ' || trim(regexp_replace(lower(a.text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS q, " + _NAMED + " AS names FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'),"
    " k AS (SELECT conv_id, turn, list_filter(names, lambda n: NOT contains(q, ' ' || lower(n) || ' ')) AS left_ FROM p) SELECT conv_id, turn, len(left_) AS names, array_to_string(list_sort(left_), ',') AS expected FROM k WHERE len(left_) > 0"
)
def names_not_asked(t):
    """Names in an answer that its question does not hold already."""
    asked = t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    names = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), 0))
    said = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), names.alias("names"))
    left = lookup.not_named(asked.join(said, ["conv_id", "turn"]), "q", "names")
    return left.select("conv_id", "turn", F.size("names").cast("long").alias("names"), F.array_join(F.array_sort("names"), ",").alias("expected"))


@query(
    "WITH l AS (SELECT conv_id, trim(text, ' ') AS s, turn FROM conversations WHERE role = 'user' AND text IS NOT NULL), f AS (SELECT * FROM l WHERE length(s) BETWEEN 1 AND 200),"
    " o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(s) ORDER BY turn) AS again FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM o WHERE again = 1),"
    " g AS (SELECT conv_id, list(s ORDER BY turn) AS ss FROM n WHERE k <= 4 GROUP BY 1), c AS (SELECT conv_id, 'conversation ' || conv_id AS a FROM l GROUP BY 1)"
    " SELECT conv_id, md5(array_to_string(CASE WHEN ss IS NULL THEN [a] WHEN len(ss) < 4 THEN list_append(ss, a) ELSE list_slice(list_prepend(a, ss), 1, 4) END, chr(10))) AS asked FROM c LEFT JOIN g USING (conv_id)"
)
def normal_sub_queries(t):
    """What a user asked in a conversation as up to four sub-queries."""
    told = t.conversations.where("role = 'user' and text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    raw = F.transform("l", lambda x: x["text"])
    anchor = F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))
    return told.select("conv_id", F.md5(F.array_join(lookup.sub_queries(raw, anchor), "\n")).alias("asked"))


@query(
    "WITH g AS (SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 1 GROUP BY 1), m AS (SELECT doc_id AS id, CASE WHEN g.doc_id IS NULL THEN 1 ELSE 0 END AS k FROM documents LEFT JOIN g USING (doc_id)),"
    " s AS (SELECT id FROM m ORDER BY k, md5(CAST(id AS VARCHAR)), id LIMIT greatest(500, (SELECT count(*) FROM g))) SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS index FROM s"
)
def sampled_corpus(t):
    """All good documents and others up to 500."""
    golds = t.labels.where("quality = 1").join(t.documents.select("doc_id"), "doc_id").select(F.col("doc_id").alias("id"))
    return lookup.sampled_corpus(t.documents.select(F.col("doc_id").alias("id")), golds, 500)


@query(f"WITH {EDGES} SELECT src, dst, rel, substr(sha256(src || chr(31) || dst || chr(31) || rel), 1, 32) AS key FROM edges")
def edge_keys(t):
    return fx.trade_edges(t).select("src", "dst", "rel", lookup.edge_key(F.col("src"), F.col("dst"), F.col("rel")).alias("key"))


@query(
    "WITH p AS (SELECT doc_id, length(text) AS n, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars // 3 - 50 END AS a, n_chars // 2 - doc_id % 400 AS b FROM documents),"
    " c AS (SELECT doc_id, n, a IS NOT NULL AND greatest(0, least(a, n)) < greatest(0, least(b, n)) AND n > 0 AS ok, greatest(0, least(a, n)) AS x, greatest(0, least(b, n)) AS y FROM p)"
    " SELECT doc_id, CAST(CASE WHEN ok THEN x ELSE 0 END AS BIGINT) AS start, CAST(CASE WHEN ok THEN y ELSE n END AS BIGINT) AS stop FROM c"
)
def spans_within(t):
    """Spans of documents made valid."""
    n = F.length("text").cast("long")
    a = F.when(F.col("doc_id") % 5 != 0, F.floor(F.col("n_chars") / 3).cast("long") - 50)
    s = spans.within(a, F.floor(F.col("n_chars") / 2).cast("long") - F.col("doc_id") % 400, n)
    return t.documents.select("doc_id", s.alias("s")).select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("stop"))


_BYTES = "('0x' || substr(h, i * 8 + 7, 2) || substr(h, i * 8 + 5, 2) || substr(h, i * 8 + 3, 2) || substr(h, i * 8 + 1, 2))::BIGINT::DOUBLE"


@query(
    "WITH p AS (SELECT p_partkey, sha256(CAST('part::' || p_name AS BLOB) || '\\x00\\x00\\x00\\x00'::BLOB) || sha256(CAST('part::' || p_name AS BLOB) || '\\x01\\x00\\x00\\x00'::BLOB) AS h FROM part),"
    f" r AS (SELECT p_partkey, list({_BYTES} / 4294967296.0::DOUBLE * 2 - 1 ORDER BY i) AS v FROM p, range(0, 16) t(i) GROUP BY 1)"
    " SELECT p_partkey, round(v[1] / sqrt(list_inner_product(v, v)) + 1e-11, 8) AS first, round(v[16] / sqrt(list_inner_product(v, v)) + 1e-11, 8) AS last FROM r"
)
def hash_vectors(t):
    """Unit vectors of part names: their first and last components."""
    v = t.part.select("p_partkey", watch.unit_vector_of(F.col("p_name"), 16, "part").alias("v"))
    return v.select("p_partkey", F.round(F.col("v")[0] + 1e-11, 8).alias("first"), F.round(F.col("v")[15] + 1e-11, 8).alias("last"))
