"""Queries that write the tables in a format or stream them, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from arboryx.lineage import shared_folder
from arboryx.operators import evolve
from arboryx.sources import blueprint, text_files
from arboryx.sources.versions import VersionedTable
from arboryx.streaming import jobs

from . import fixtures as fx
from .fixtures import EDGES, EVENT_EDGES, NODES
from .registry import query


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/query-{uuid.uuid4().hex}"


def _stream(t, name: str):
    """The table as a stream; the pattern matches a file as well as a folder."""
    return jobs.source(t.spark, f"{t.folder}/{name[:-1]}[{name[-1]}].parquet", getattr(t, name).schema)


_LINES = """l AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'X' || c_custkey ELSE 'Q' || c_custkey END AS id, c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS a, c_mktsegment AS b FROM customer)"""


@query(
    f"WITH {_LINES} SELECT id AS qid, CASE WHEN a = '' THEN b ELSE a || '|' || b END AS aliases, '' AS reason FROM l WHERE id LIKE 'Q%'"
    " UNION ALL SELECT id || chr(9) || a || chr(9) || b, '', 'bad id' FROM l WHERE id LIKE 'X%'"
)
def entity_lines(t):
    """Customers written as tab-separated entity lines and read back, with what the reader rejects."""
    path = _folder(t)
    key = F.col("c_custkey").cast("string")
    line = F.concat_ws("\t", F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("X"), key)).otherwise(F.concat(F.lit("Q"), key)), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")), "c_mktsegment")
    t.customer.select(line.alias("value")).write.text(path)
    good, bad = text_files.entities(t.spark, path)
    return good.select("qid", F.array_join("aliases", "|").alias("aliases"), F.lit("").alias("reason")).union(bad.select(F.col("value").alias("qid"), F.lit("").alias("aliases"), "reason"))


@query(
    "SELECT 'Q' || l_orderkey AS subject, 'P' || l_linenumber AS predicate, 'Q' || l_partkey AS object FROM lineitem"
    " WHERE l_orderkey IN (SELECT c_custkey FROM customer) AND l_partkey IN (SELECT c_custkey FROM customer) AND l_suppkey % 5 <> 0"
)
def triples_within(t):
    """Order lines as triples, a fifth of them torn; those with both ends among the customers' ids."""
    path = _folder(t)
    cut = F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("Q"), F.col("l_orderkey").cast("string"))).otherwise(
        F.concat(F.lit("Q"), F.col("l_orderkey").cast("string"), F.lit("\tP"), F.col("l_linenumber").cast("string"), F.lit("\tQ"), F.col("l_partkey").cast("string"))
    )
    t.lineitem.select(cut.alias("value")).write.text(path)
    ids = t.customer.select(F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("qid"))
    return text_files.within(text_files.triples(t.spark, path)[0], ids)


@query(f"WITH {NODES}, {EDGES} SELECT 'node' AS kind, id AS a, kind AS b, label AS c, round(score, 8) AS x FROM nodes UNION ALL SELECT 'edge', src, dst, rel, round(weight, 8) FROM edges")
def dump_round_trip(t):
    """The trade graph written as a gzipped dump and read back."""
    path = _folder(t)
    text_files.write_dump(fx.trade_nodes(t), fx.trade_edges(t), path)
    nodes, edges = text_files.read_dump(t.spark, path, "id string, kind string, label string, score double", "src string, dst string, rel string, weight double")
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("kind").alias("b"), F.col("label").alias("c"), F.round("score", 8).alias("x")).union(
        edges.select(F.lit("edge"), "src", "dst", "rel", F.round("weight", 8))
    )


@query(
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value) + 1e-9, 4) AS total FROM events GROUP BY 1, 2"
)
def stream_window_counts(t):
    """Events streamed into hourly counts, the complete result stored batch by batch."""
    path = _folder(t)

    def write(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{path}/out")

    jobs.drain(jobs.windowed_counts(_stream(t, "events"), lateness="10000 days"), write, f"{path}/log", "complete")
    out = t.spark.read.parquet(f"{path}/out")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round(F.col("total") + 1e-9, 4).alias("total"))


@query(
    f"WITH {EVENT_EDGES}, d AS (SELECT event_type || ':' || (user_id % 50) AS src, event_type || ':' || ((user_id + 1) % 50) AS dst, 'then' AS rel, (value - 5) / 1000 AS delta FROM events)"
    " SELECT src, dst, rel, round(least(1.0, coalesce(max(weight), 0) + coalesce(sum(delta) FILTER (delta > 0), 0)) + 1e-11, 8) AS weight"
    " FROM (SELECT src, dst, rel, weight, NULL AS delta FROM event_edges UNION ALL SELECT src, dst, rel, NULL, delta FROM d WHERE delta > 0) GROUP BY 1, 2, 3"
)
def stream_tick(t):
    """Deltas of a streamed log merged into a versioned edge table, a version per micro-batch."""
    path = _folder(t)
    edges = VersionedTable(t.spark, f"{path}/edges")
    edges.commit(fx.event_edges(t), 0)
    near = lambda k: F.concat_ws(":", "event_type", ((F.col("user_id") + k) % 50).cast("string"))
    deltas = _stream(t, "events").select(near(0).alias("src"), near(1).alias("dst"), F.lit("then").alias("rel"), ((F.col("value") - 5) / 1000).alias("delta"))
    jobs.drain(deltas, jobs.tick_writer(edges, None), f"{path}/log")
    return edges.read().withColumn("weight", F.round(F.col("weight") + 1e-11, 8))


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),"
    " w AS (SELECT user_id, event_id, i, ts AS start, 1 AS used, true AS allowed FROM e WHERE i = 1 UNION ALL"
    " SELECT e.user_id, e.event_id, e.i, CASE WHEN e.ts - w.start >= INTERVAL 1 DAY THEN e.ts ELSE w.start END,"
    " CASE WHEN e.ts - w.start >= INTERVAL 1 DAY THEN 1 WHEN w.used < 2 THEN w.used + 1 ELSE w.used END, e.ts - w.start >= INTERVAL 1 DAY OR w.used < 2"
    " FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1) SELECT user_id, event_id, CAST(used AS BIGINT) AS used, allowed FROM w"
)
def stream_quota(t):
    """Two events a day for each user, days beginning with their first event."""
    path = _folder(t)
    jobs.drain(jobs.quotas(_stream(t, "events"), 2, 86_400), lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out/epoch={n}"), f"{path}/log")
    return t.spark.read.parquet(f"{path}/out").select("user_id", "event_id", "used", "allowed")


@query(
    "WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), n AS (SELECT user_id, max(i) AS step FROM e GROUP BY 1), l AS (SELECT user_id, event_type, max(i) AS i FROM e GROUP BY 1, 2)"
    " SELECT user_id, step, event_type AS concept, round(pow(0.779, step - i), 9) AS activation FROM l JOIN n USING (user_id) WHERE pow(0.779, step - i) >= 0.01"
)
def stream_working_memory(t):
    """Activations of event types per user after the whole log."""
    path = _folder(t)
    jobs.drain(jobs.working_memory(_stream(t, "events")), lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out/epoch={n}"), f"{path}/log")
    out = t.spark.read.parquet(f"{path}/out")
    last = evolve.latest(out.select("user_id", "step").distinct(), ["user_id"], [F.desc("step")])
    return out.join(last, ["user_id", "step"]).select("user_id", "step", "concept", F.round("activation", 9).alias("activation"))


@query("SELECT user_id, session_start, n, round(total + 1e-9, 4) AS total FROM (SELECT user_id, s, min(ts) AS session_start, count(*) AS n, sum(value) AS total FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, s)")
def sessions(t):
    """Sessions that a gap of 30 minutes ends, by Spark's session window."""
    timed = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    out = timed.groupBy("user_id", F.session_window("at", "30 minutes")).agg(F.min("ts").alias("session_start"), F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", "session_start", "n", F.round(F.col("total") + 1e-9, 4).alias("total"))


_BATCHES = "b AS (SELECT *, CAST(event_id % 4 AS BIGINT) AS epoch FROM events), w AS (SELECT epoch, max(max(ts)) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 200 HOUR AS mark FROM b GROUP BY epoch), r AS (SELECT b.*, coalesce(ts < mark, false) AS late FROM b JOIN w USING (epoch))"


def _late(t):
    path = _folder(t)
    for k in range(4):  # four files, a micro-batch each
        t.events.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
    split = jobs.LateRows(t.spark, path, "200 hours")
    jobs.drain(jobs.source(t.spark, f"{path}/in", t.events.schema, 1), split, f"{path}/log")
    return split


@query(f"WITH {_BATCHES} SELECT event_id, epoch FROM r WHERE late")
def stream_late_rows(t):
    """Events that come more than 200 hours after the latest one of the files before."""
    return _late(t).rows(True).select("event_id", F.col("epoch").cast("long").alias("epoch"))


@query(f"WITH {_BATCHES} SELECT epoch, count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late FROM r GROUP BY epoch")
def stream_late_counts(t):
    """How many events of each file are on time and late."""
    return _late(t).counts.read().select("epoch", "on_time", "late")


_BLUEPRINT = """c AS (SELECT conv_id, turn, 't' || turn % 5 AS local, coalesce(text, '') AS s FROM conversations WHERE conv_id % 7 <> 0),
g AS (SELECT conv_id, turn, local, s, 'NODE-' || substr(sha256('r1' || chr(31) || conv_id || chr(31) || local || chr(31) || turn), 1, 12) AS id FROM c),
lst AS (SELECT conv_id, local, arg_max(id, turn) AS id FROM g GROUP BY 1, 2)"""


def _blueprints(t):
    path = _folder(t)
    local = F.concat(F.lit("t"), F.col("turn") % 5)
    concept = F.struct(F.col("turn").cast("string").alias("place"), local.alias("local_id"), F.coalesce("text", F.lit("")).alias("canonical_text"), F.array("role").alias("keywords"))
    link = F.struct(local.alias("source"), F.concat(F.lit("t"), F.col("turn") % 5 + 1).alias("target"), F.lit("next").alias("relation_type"), (F.col("turn") / 10).alias("weight"))
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("k"), concept.alias("c"), link.alias("l")))).alias("x"))
    body = F.to_json(F.struct(F.col("conv_id").cast("string").alias("source_id"), F.transform("x", lambda r: r["c"]).alias("concepts"), F.transform("x", lambda r: r["l"]).alias("synapses")))
    rows.select(F.when(F.col("conv_id") % 7 == 0, F.substring(body, 1, 40)).otherwise(body).alias("value")).write.text(path)
    return blueprint.read(t.spark, path, "r1")


@query(f"WITH {_BLUEPRINT} SELECT id, CAST(conv_id AS VARCHAR) AS source_id, local AS local_id, sha256(array_to_string(list_filter(regexp_split_to_array(lower(s), '\\s+'), lambda w: w <> ''), ' ')) AS anchor FROM g")
def blueprint_nodes(t):
    """Conversations as nested blueprints; their concepts as nodes."""
    return _blueprints(t)[0].select("id", "source_id", "local_id", "anchor")


@query(
    f"WITH {_BLUEPRINT}, k AS (SELECT conv_id, 't' || turn % 5 AS s, 't' || (turn % 5 + 1) AS d, turn / 10 AS w FROM c), j AS (SELECT CAST(k.conv_id AS VARCHAR) AS source_id, k.s, k.d, w, a.id AS src, b.id AS dst FROM k LEFT JOIN lst a ON a.conv_id = k.conv_id AND a.local = k.s LEFT JOIN lst b ON b.conv_id = k.conv_id AND b.local = k.d)"
    " SELECT src, dst, source_id, round(w, 6) AS weight, '' AS reason FROM j WHERE dst IS NOT NULL"
    " UNION ALL SELECT s, d, source_id, round(w, 6), 'dangling' FROM j WHERE dst IS NULL UNION ALL SELECT '', '', '', NULL, 'torn' FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 7 = 0)"
)
def blueprint_links(t):
    """Their links as edges, with links that lead nowhere and lines that cannot be read."""
    _, edges, rejects = _blueprints(t)
    kept = edges.select("src", "dst", "source_id", F.round("weight", 6).alias("weight"), F.lit("").alias("reason"))
    return kept.unionByName(rejects.select(F.coalesce("source", F.lit("")).alias("src"), F.coalesce("target", F.lit("")).alias("dst"), F.coalesce("source_id", F.lit("")).alias("source_id"), F.round("weight", 6).alias("weight"), "reason"))
