"""Queries of findings and of the counts that watch a graph's state."""

from __future__ import annotations

from pyspark.sql import functions as F

from arboryx.operators import bulk, findings

from .registry import query

_FOUND = """rep AS (SELECT o_orderkey AS run, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'completed' END WHEN 'P' THEN 'partial' ELSE 'completed' END AS status,
  CASE WHEN o_orderkey % 11 = 0 THEN 'poor' WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'good' END AS verdict, (o_orderkey % 100) / 100 AS low, (o_orderkey % 37) / 200 AS sch, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 41) / 300 END AS par FROM orders),
ent AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id * 2 END AS run FROM events),
fnd AS (SELECT event_id AS entry_id, e.run, CASE WHEN r.run IS NULL THEN 'ingest_report_missing' WHEN status = 'failed' THEN 'ingest_failed' WHEN status = 'partial' OR verdict = 'poor' THEN 'ingest_partial'
  WHEN low >= 0.5 THEN 'low_resolution_quality' WHEN sch >= 0.1 THEN 'high_schema_violation_rate' WHEN par >= 0.1 THEN 'high_parse_error_rate' ELSE 'no_issue_observed' END AS type, low, status FROM ent e LEFT JOIN rep r ON r.run = e.run),
sev AS (SELECT *, CASE type WHEN 'ingest_failed' THEN 'high' WHEN 'low_resolution_quality' THEN 'low' WHEN 'no_issue_observed' THEN 'info' ELSE 'medium' END AS severity FROM fnd)"""


def _reports(t):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", F.when(k % 3 == 0, "failed").otherwise("completed")).when(F.col("o_orderstatus") == "P", "partial").otherwise("completed")
    return t.orders.select(
        k.alias("run_id"), status.alias("status"), F.when(k % 11 == 0, "poor").when(k % 13 != 0, "good").alias("verdict"), F.lit("r").alias("reasoning"),
        ((k % 100) / 100).alias("low_tier_ratio"), ((k % 37) / 200).alias("schema_violation_rate"), F.when(k % 5 != 0, (k % 41) / 300).alias("parse_error_rate"),
    )


def _found(t):
    entries = t.events.select(F.col("event_id").alias("entry_id"), F.when(F.col("event_id") % 9 != 0, F.col("event_id") * 2).alias("run_id"))
    return findings.entry_findings(entries, _reports(t))


@query(f"WITH {_FOUND} SELECT entry_id, run AS run_id, type, severity, CASE WHEN type = 'low_resolution_quality' THEN printf('low_tier_ratio=%.4f', low) WHEN type = 'ingest_report_missing' THEN 'missing ingest report for pool_entry_id=' || entry_id WHEN type LIKE 'ingest_%' THEN 'status=' || status ELSE '' END AS evidence FROM sev")
def entry_findings(t):
    """Events as entries, orders as the reports of their ingest: what a check of each finds."""
    shown = F.col("type").isin("low_resolution_quality", "ingest_report_missing", "ingest_failed", "ingest_partial")
    return _found(t).withColumn("evidence", F.when(shown, F.col("evidence")[0]).otherwise(""))


@query(
    f"WITH {_FOUND}, pool AS (SELECT event_id, event_type AS state, event_id % 3 AS f FROM events), q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run % 2 ORDER BY run DESC) AS n FROM rep) WHERE n <= 200)"
    " SELECT 'pool_total' AS metric, '' AS key, count(*) AS n FROM pool UNION ALL SELECT 'pool_state', state, count(*) FROM pool GROUP BY 2 UNION ALL SELECT 'pool_findings', '', CAST(sum(f) AS BIGINT) FROM pool"
    " UNION ALL SELECT 'finding_cell', 'c' || entry_id % 4, count(*) FROM sev GROUP BY 2 UNION ALL SELECT 'finding_type', type, count(*) FROM sev GROUP BY 2 UNION ALL SELECT 'finding_severity', severity, count(*) FROM sev GROUP BY 2"
    " UNION ALL SELECT 'finding_unresolved', '', count(*) FROM sev WHERE entry_id % 2 = 0 OR entry_id % 5 = 0"
    " UNION ALL SELECT CASE WHEN run % 2 = 0 THEN 'query_scanned' ELSE 'ingest_scanned' END, '', count(*) FROM q GROUP BY 1 UNION ALL SELECT CASE WHEN run % 2 = 0 THEN 'query_verdict' ELSE 'ingest_verdict' END, verdict, count(*) FROM q WHERE verdict IS NOT NULL GROUP BY 1, 2"
    " UNION ALL SELECT 'latest_query', 'written', max(run) FROM rep WHERE run % 2 = 0"
)
def immune_metrics(t):
    """Counts over a pool, its findings and the newest reports."""
    pool = t.events.select(F.col("event_id").alias("entry_id"), F.col("event_type").alias("state"), (F.col("event_id") % 3).alias("findings"))
    e = F.col("entry_id")
    found = _found(t).select(e.alias("id"), F.concat(F.lit("c"), e % 4).alias("cell"), "type", "severity", F.when(e % 2 != 0, F.lit("2024-01-01")).alias("resolved_at"), F.when(e % 5 == 0, "none").otherwise("fixed").alias("action"))
    reports = _reports(t).select(F.when(F.col("run_id") % 2 == 0, "query").otherwise("ingest").alias("type"), "run_id", "verdict", F.col("run_id").alias("written"))
    return findings.immune_metrics(pool, found, reports, agents={"query": ("written",)})


@query(
    "WITH d AS (SELECT doc_id, length(text) AS n FROM documents), a AS (SELECT doc_id, n, greatest(40, least(260, n * 38 // 1000)) AS l1, greatest(10, least(24, 10 + n // 3000)) AS l2, greatest(72, least(520, n // 35)) AS k2, greatest(6, least(18, 5 + n // 1400)) AS l3 FROM d),"
    " b AS (SELECT *, greatest(l2 + 4, least(34, 16 + n // 900)) AS h2, greatest(l3 + 2, least(24, 8 + n // 600)) AS h3 FROM a), c AS (SELECT *, least(420, greatest(72, h3 * 12)) AS m3, greatest(28, least(180, l3 * 4, n // 180)) AS k3 FROM b)"
    " SELECT doc_id, concat_ws(' ', l1, greatest(l1, least(320, n * 48 // 1000)), least(2500, greatest(400, l1 * 7))) AS dense, concat_ws(' ', l2, h2, k2, least(800, greatest(k2 + 80, h2 * 20))) AS macro,"
    " concat_ws(' ', l3, h3, CASE WHEN k3 > m3 THEN greatest(24, m3 // 2) ELSE k3 END, m3) AS slice FROM c"
)
def density_targets(t):
    """How many concepts and links a reading of each document is to have."""
    n = F.length("text")
    told = t.documents.select("doc_id", bulk.density_targets(n).alias("a"), bulk.macro_targets(n).alias("b"), bulk.slice_targets(n).alias("c"))
    words = lambda c, names: F.concat_ws(" ", *[F.col(f"{c}.{x}").cast("long").cast("string") for x in names.split()])
    return told.select("doc_id", words("a", "least stretch links").alias("dense"), words("b", "least most least_links most_links").alias("macro"), words("c", "least most least_links most_links").alias("slice"))


_SEEDS = """ent AS (SELECT 'Q' || c_custkey AS qid, c_name AS alias, c_custkey AS k FROM customer UNION ALL SELECT 'Q' || c_custkey, c_name || ' again', c_custkey FROM customer WHERE c_custkey % 10 = 0),
ok AS (SELECT qid, min(alias) AS name, count(*) AS n, k FROM ent WHERE k % 7 <> 0 AND k % 5 <> 1 GROUP BY qid, k), ids AS (SELECT qid FROM ok UNION SELECT 'Q' || c_custkey FROM customer WHERE c_custkey % 5 = 1),
tri AS (SELECT 'Q' || l_orderkey AS s, 'P' || l_linenumber % 3 AS p, 'Q' || l_partkey AS o, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), tw AS (SELECT *, s IN (SELECT qid FROM ids) AND o IN (SELECT qid FROM ids) AS whole FROM tri)"""


def _seeded(t):
    key = F.concat(F.lit("Q"), F.col("c_custkey"))
    once = t.customer.select(key.alias("qid"), F.array("c_name", "c_mktsegment").alias("aliases"))
    again = t.customer.where("c_custkey % 10 = 0").select(key.alias("qid"), F.array(F.concat("c_name", F.lit(" again"))).alias("aliases"))
    texts = t.customer.where("c_custkey % 7 <> 0").select(key.alias("qid"), F.repeat("c_name", F.when(F.col("c_custkey") % 4 == 0, 200).otherwise(1)).alias("text"))
    triples = t.lineitem.select(F.concat(F.lit("Q"), F.col("l_orderkey")).alias("subject"), F.concat(F.lit("P"), F.col("l_linenumber") % 3).alias("predicate"), F.concat(F.lit("Q"), F.col("l_partkey")).alias("object"))
    names = t.region.where("r_regionkey < 2").select(F.concat(F.lit("P"), F.col("r_regionkey")).alias("pid"), F.array("r_name").alias("aliases"))
    return bulk.seed(once.unionByName(again), texts, triples, names, t.customer.where("c_custkey % 5 = 1").select(key.alias("qid")))


@query(f"WITH {_SEEDS} SELECT 'NODE-' || substr(sha256('seed:' || qid), 1, 12) AS id, qid, name, CAST(least(2048, CASE WHEN k % 4 = 0 THEN 200 ELSE 1 END * (SELECT length(c_name) FROM customer WHERE c_custkey = k)) AS INTEGER) AS chars FROM ok")
def seed_nodes(t):
    """Customers as seed entities, some known, some without a text, some twice."""
    return _seeded(t)["nodes"].select("id", "qid", "name", F.length("text").alias("chars"))


@query(f"WITH {_SEEDS} SELECT 'NODE-' || substr(sha256('seed:' || s), 1, 12) AS src, 'NODE-' || substr(sha256('seed:' || o), 1, 12) AS dst, p AS pid, coalesce((SELECT r_name FROM region WHERE 'P' || r_regionkey = p AND r_regionkey < 2), p) AS rel FROM tw WHERE whole")
def seed_edges(t):
    """Order lines as triples among them."""
    return _seeded(t)["edges"]


@query(
    f"WITH {_SEEDS} SELECT 'entities_read' AS name, count(*) AS n FROM ent UNION ALL SELECT 'entities_without_text', count(*) FROM ent WHERE k % 7 = 0 UNION ALL SELECT 'entities_known', count(*) FROM ent WHERE k % 7 <> 0 AND k % 5 = 1"
    " UNION ALL SELECT 'entities_written', count(*) FROM ok UNION ALL SELECT 'entities_repeated', CAST(sum(n - 1) AS BIGINT) FROM ok UNION ALL SELECT 'texts_cut', count(*) FROM ok WHERE k % 4 = 0"
    " UNION ALL SELECT 'triples_read', CAST(sum(n) AS BIGINT) FROM tw UNION ALL SELECT 'triples_repeated', CAST(sum(n - 1) AS BIGINT) FROM tw WHERE whole UNION ALL SELECT 'triples_without_ends', CAST(sum(n) AS BIGINT) FROM tw WHERE NOT whole UNION ALL SELECT 'edges_written', count(*) FROM tw WHERE whole"
)
def seed_counters(t):
    """What the run read, skipped, cut and wrote."""
    return _seeded(t)["counters"]
