"""Queries of the audit ledger, run reports, cached readings, relation lines and joined streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from arboryx.operators import ranking, watch
from arboryx.sources import ledger, qa, text_files
from arboryx.streaming import jobs

from .rank_queries import _centroids_of, _unit
from .registry import query
from .source_queries import _folder, _stream


@query("SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, ts AS recorded_at, event_type AS action, coalesce(props, '') AS payload FROM events ORDER BY ts DESC, id DESC LIMIT 256")
def audit_recent(t):
    """Events appended to a ledger in two commits; the newest 256 rows."""
    book = ledger.Ledger(t.spark, _folder(t))
    rows = t.events.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.col("ts").cast("timestamp").alias("recorded_at"), F.col("event_type").alias("action"), F.coalesce("props", F.lit("")).alias("payload"), "event_id"
    )
    book.append(rows.where("event_id % 2 = 0"))
    book.append(rows.where("event_id % 2 = 1"))
    return book.recent(256).withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz"))


_REPORTS = "r AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS run_id, event_type AS report_type, date_trunc('second', ts) AS started_at FROM events)"


def _reports(t):
    path = _folder(t)
    started = F.date_trunc("second", F.col("ts").cast("timestamp"))
    ledger.write_reports(t.events.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("run_id"), F.col("event_type").alias("report_type"), started.alias("started_at"), F.coalesce("props", F.lit("")).alias("body")), path)
    return path


@query(
    f"WITH {_REPORTS}, q AS (SELECT run_id, started_at FROM r WHERE report_type = 'view'), old AS (SELECT max(run_id) AS run_id FROM q WHERE started_at < TIMESTAMP '2024-01-26 12:00:00')"
    " SELECT q.run_id, q.started_at FROM q, old WHERE old.run_id IS NULL OR q.run_id > old.run_id"
)
def report_window(t):
    """Reports of one type in the five and a half days before a moment, as a scan from the newest finds them."""
    views = ledger.read_reports(t.spark, _reports(t), "view")
    out = ledger.scanned(views, F.lit("2024-02-01 00:00:00").cast("timestamp"), 5.5)
    return out.select("run_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"))


@query(f"WITH {_REPORTS}, n AS (SELECT *, row_number() OVER (PARTITION BY report_type ORDER BY run_id DESC) AS i FROM r) SELECT report_type, run_id, started_at FROM n WHERE i <= 50")
def report_retention(t):
    """The fifty newest reports of each type, which a prune would keep."""
    kept = watch.newest_of_type(ledger.read_reports(t.spark, _reports(t)), "report_type", "run_id", 50)
    return kept.select("report_type", "run_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"))


@query(
    "SELECT event_type || ':' || user_id AS key, CASE WHEN max(event_id) % 7 = 0 THEN '{}' ELSE '{\"n\":' || max(event_id) || '}' END AS reading FROM events WHERE event_id % 11 <> 0 GROUP BY 1, event_type, user_id"
)
def cached_readings(t):
    """A cache of readings per event type and user in the order of events, every eleventh line torn."""
    path = _folder(t)
    key = F.concat(F.lit('{"key":"'), "event_type", F.lit(":"), F.col("user_id").cast("string"), F.lit('"'))
    n = F.col("event_id").cast("string")
    rest = F.when(F.col("event_id") % 11 == 0, ',"reading":{').when(F.col("event_id") % 7 == 0, ',"reading":null}').otherwise(F.concat(F.lit(',"reading":{"n":'), n, F.lit("}}")))
    t.events.repartitionByRange("event_id").sortWithinPartitions("event_id").select(F.concat(key, rest).alias("value")).write.text(path)
    return ledger.readings(t.spark, path)


@query(
    "SELECT 'P' || p_partkey AS pid, p_name || '|' || p_type AS aliases, '' AS reason FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0"
    " UNION ALL SELECT 'X' || p_partkey || chr(9) || ' ' || p_name || ' ' || chr(9) || p_type, '', 'bad id' FROM part WHERE p_partkey % 5 = 0"
    " UNION ALL SELECT 'P' || p_partkey || chr(9), '', 'no alias' FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 = 0"
)
def relation_lines(t):
    """Parts written as relation lines and read back, with what the reader rejects."""
    path, key = _folder(t), F.col("p_partkey").cast("string")
    names = F.when((F.col("p_partkey") % 5 != 0) & (F.col("p_partkey") % 7 == 0), "").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" \t"), "p_type"))
    t.part.select(F.concat(F.when(F.col("p_partkey") % 5 == 0, "X").otherwise("P"), key, F.lit("\t"), names).alias("value")).write.text(path)
    good, bad = text_files.relations(t.spark, path)
    return good.select("pid", F.array_join("aliases", "|").alias("aliases"), F.lit("").alias("reason")).union(bad.select("value", F.lit(""), "reason"))


@query(
    "SELECT v.user_id, v.event_id AS first_id, p.event_id AS then_id FROM events v JOIN events p ON p.user_id = v.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 1 HOUR"
    " WHERE v.event_type = 'view' AND p.event_type = 'purchase'"
)
def stream_followed_by(t):
    """Views and purchases as two streams, joined where a user's purchase follows a view within an hour."""
    path = _folder(t)
    views, purchases = _stream(t, "events").where("event_type = 'view'"), _stream(t, "events").where("event_type = 'purchase'")
    jobs.drain(jobs.followed_by(views, purchases, lateness="2 hours"), lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out/epoch={n}"), f"{path}/log")
    return t.spark.read.parquet(f"{path}/out").select("user_id", "first_id", "then_id")


@query(
    "WITH c AS (SELECT p_partkey AS idx, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || ' ' || p_size AS title FROM part),"
    " first_ AS (SELECT lower(trim(title)) AS title, min(idx) AS idx FROM c GROUP BY 1),"
    " q AS (SELECT o_orderkey, list(DISTINCT lower(p_name) || ' ' || (p_size + l_linenumber % 2)) AS titles FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1),"
    " g AS (SELECT o_orderkey, list(DISTINCT idx ORDER BY idx) AS golds FROM (SELECT o_orderkey, unnest(titles) AS title FROM q) JOIN first_ USING (title) GROUP BY 1)"
    " SELECT CAST(o_orderkey AS VARCHAR) AS qid, o_orderpriority AS answer, CASE WHEN o_orderkey % 3 = 0 THEN 'x|y' ELSE '' END AS aliases, array_to_string(golds, '|') AS golds FROM g JOIN orders USING (o_orderkey) WHERE o_orderkey % 4 <> 1"
)
def qa_questions(t):
    """Orders as questions whose gold passages are parts by title, in two layouts, written as JSON and read back."""
    path = _folder(t)
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    t.part.select(F.col("p_partkey").alias("idx"), F.concat_ws(" ", name, "p_size").alias("title"), F.col("p_type").alias("text")).write.json(f"{path}/corpus")
    lines = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), F.concat_ws(" ", "p_name", F.col("p_size") + F.col("l_linenumber") % 2).alias("title"))
    asked = t.orders.join(lines.groupBy("o_orderkey").agg(F.collect_set("title").alias("titles")), "o_orderkey")
    key = F.col("o_orderkey")
    facts = F.when(key % 2 == 0, F.transform("titles", lambda x: F.array(x, F.lit("0"))))
    paragraphs = F.when(key % 2 == 1, F.transform("titles", lambda x: F.struct(F.concat(x, F.lit(" ")).alias("title"), F.lit(True).alias("is_supporting"))))
    asked.select(
        key.cast("string").alias("id"), F.col("o_orderpriority").alias("question"), F.when(key % 4 == 0, F.col("o_orderpriority")).alias("answer"),
        F.when(key % 4 >= 2, F.col("o_orderpriority")).alias("obj"), F.when((key % 3 == 0) & (key % 4 != 1), F.array(F.lit("x"), F.lit("y"), F.col("o_orderpriority"))).alias("answer_aliases"), facts.alias("supporting_facts"), paragraphs.alias("paragraphs"),
    ).write.json(f"{path}/questions")
    out = qa.questions(*qa.read(t.spark, f"{path}/corpus", f"{path}/questions"))
    return out.select("qid", "answer", F.array_join("aliases", "|").alias("aliases"), F.array_join("golds", "|").alias("golds"))


@query(
    "WITH unit AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 10 = 3 THEN -1 ELSE label END AS cluster, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),"
    " dims AS (SELECT cluster, i, avg(v[i]) AS m FROM unit, range(1, 65) r(i) WHERE cluster >= 0 GROUP BY 1, 2), cent AS (SELECT cluster, list(m ORDER BY i) AS v FROM dims GROUP BY cluster),"
    " s AS (SELECT u.id, c.cluster, round(list_inner_product(u.v, c.v) / sqrt(list_inner_product(c.v, c.v)), 9) AS cosine FROM unit u, cent c WHERE u.cluster = -1)"
    " SELECT id, cluster FROM unit WHERE cluster >= 0 UNION ALL SELECT id, first(cluster ORDER BY cosine DESC, cluster) FROM s GROUP BY id"
)
def noise_reassignment(t):
    """Vectors of clusters, a tenth of them noise, which goes to the nearest centroid of the others."""
    unit = _unit(t).withColumn("cluster", F.when(F.col("id") % 10 == 3, -1).otherwise(F.col("label"))).select("id", "v", "cluster")
    return ranking.reassigned(unit, _centroids_of(unit.where("cluster >= 0"), "cluster"))
