"""Queries of ingestion and consolidation: the edges of read texts, descriptions that accrue, merges as one commit."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from arboryx.lineage import shared_folder
from arboryx.operators import consolidate, ingest
from arboryx.sources.versions import VersionSet

from .registry import query


def _read(t):
    """Conversations as texts, turns as paragraphs, words of nine letters and more as mentions of a node of five."""
    units = t.conversations.where(F.length(F.trim("text")) >= 10).select(F.col("conv_id").alias("text"), F.col("turn").alias("no"), F.col("text").alias("body"))
    words = F.filter(F.regexp_extract_all(F.lower("body"), F.lit("[a-z]+"), 0), lambda w: F.length(w) >= 9)
    said = units.select("text", "no", F.posexplode(words).alias("ord", "label"))
    return units, said.withColumn("node", F.concat(F.lit("n:"), F.substring("label", 1, 5)))


_READ = """units AS (SELECT conv_id, turn, text AS body FROM conversations WHERE length(trim(text, ' ')) >= 10),
words AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(body), '[a-z]+'), lambda w: length(w) >= 9) AS ws FROM units),
said AS (SELECT conv_id, turn, generate_subscripts(ws, 1) - 1 AS ord, unnest(ws) AS label FROM words),
m AS (SELECT *, 'n:' || substr(label, 1, 5) AS node FROM said)"""

_TOPOLOGY = f"""WITH {_READ}, u AS (SELECT conv_id AS c, turn AS n, 'text:' || conv_id AS ta, 'text:' || conv_id || '#p' || turn AS pa, 'chunk:' || conv_id || '#p' || turn AS ch FROM units),
mu AS (SELECT m.*, ta, pa, ch FROM m JOIN u ON c = conv_id AND n = turn),
lab AS (SELECT DISTINCT conv_id, turn, label, node FROM m), ins AS (SELECT DISTINCT conv_id, turn, node FROM m),
rel AS (SELECT conv_id, turn, label AS source, CASE WHEN ord % 3 = 0 THEN nxt || 'x' ELSE nxt END AS target FROM (SELECT *, lead(label) OVER (PARTITION BY conv_id, turn ORDER BY ord) AS nxt FROM m) WHERE nxt IS NOT NULL),
con AS (SELECT conv_id, turn, 'c:' || substr(label, 1, 3) AS node, [label, 'unknown'] AS basis FROM m WHERE ord = 0),
pr AS (SELECT a.conv_id, a.turn AS l, b.turn AS r, count(*) AS shared FROM ins a JOIN ins b ON a.conv_id = b.conv_id AND a.node = b.node AND a.turn < b.turn GROUP BY 1, 2, 3),
bo AS (SELECT conv_id, l, r, shared FROM pr UNION ALL SELECT conv_id, r, l, shared FROM pr),
kept AS (SELECT DISTINCT conv_id, least(l, r) AS l, greatest(l, r) AS r, least(0.25 + 0.10 * shared, 0.70)::DOUBLE AS w FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, l ORDER BY shared DESC, r) AS k FROM bo) WHERE k <= 12),
e AS (
  SELECT ch AS src, pa AS dst, 'extraction' AS kind, 'extracted_from' AS descriptor, 1.0::DOUBLE AS weight FROM u
  UNION ALL SELECT pa, ta, 'hierarchy', 'is_section_of', 0.9 FROM u
  UNION ALL SELECT ch, node, 'co_occurrence', 'mentions', 0.95 FROM mu
  UNION ALL SELECT DISTINCT node, ta, 'attribution', 'appears_in_source', 0.45 FROM mu
  UNION ALL SELECT s.node, d.node, 'semantic', 'precedes', 1.0 FROM rel JOIN lab s ON s.conv_id = rel.conv_id AND s.turn = rel.turn AND s.label = source JOIN lab d ON d.conv_id = rel.conv_id AND d.turn = rel.turn AND d.label = target
  UNION ALL SELECT a.node, b.node, 'co_occurrence', 'co_mentions_in_paragraph', 0.35 FROM ins a JOIN ins b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.node <> b.node
  UNION ALL SELECT pa, node, 'hierarchy', 'has_paragraph_concept', 0.8 FROM con JOIN u ON c = conv_id AND n = turn
  UNION ALL SELECT ch, node, 'hierarchy', 'summarised_as', 0.7 FROM con JOIN u ON c = conv_id AND n = turn
  UNION ALL SELECT con.node, lab.node, 'hierarchy', 'abstracts_over', 0.85 FROM con JOIN lab ON lab.conv_id = con.conv_id AND lab.turn = con.turn AND list_contains(basis, label)
  UNION ALL SELECT 'text:' || conv_id || '#p' || l, 'text:' || conv_id || '#p' || r, 'co_occurrence', 'shares_entities_with', w FROM kept
  UNION ALL SELECT 'text:' || conv_id || '#p' || r, 'text:' || conv_id || '#p' || l, 'co_occurrence', 'shares_entities_with', w FROM kept
  UNION ALL SELECT x.node, y.node, 'semantic', 'develops_across_paragraphs', least(w, 0.55) FROM kept k JOIN con x ON x.conv_id = k.conv_id AND x.turn = k.l JOIN con y ON y.conv_id = k.conv_id AND y.turn = k.r WHERE x.node <> y.node
)"""


def _topology(t):
    units, said = _read(t)
    from pyspark.sql import Window

    after = F.lead("label").over(Window.partitionBy("text", "no").orderBy("ord"))
    target = F.when(F.col("ord") % 3 == 0, F.concat("_next", F.lit("x"))).otherwise(F.col("_next"))
    relations = said.withColumn("_next", after).where("_next is not null").select("text", "no", F.col("label").alias("source"), target.alias("target"), F.lit("semantic").alias("kind"), F.lit("precedes").alias("descriptor"))
    concepts = said.where("ord = 0").select("text", "no", F.concat(F.lit("c:"), F.substring("label", 1, 3)).alias("node"), F.array("label", F.lit("unknown")).alias("basis"))
    return ingest.topology(units.select("text", "no"), said, relations, concepts)


@query(f"{_TOPOLOGY} SELECT src, dst, kind, descriptor, round(weight, 6) AS weight, count(*) AS n FROM e GROUP BY ALL")
def ingest_topology(t):
    """All kinds of edges that reading the conversations makes."""
    edges, _ = _topology(t)
    return edges.groupBy("src", "dst", "kind", "descriptor", F.round("weight", 6).alias("weight")).agg(F.count("*").alias("n"))


@query(
    f"{_TOPOLOGY}, lost AS (SELECT rel.conv_id, rel.turn FROM rel WHERE NOT EXISTS (SELECT 1 FROM lab d WHERE d.conv_id = rel.conv_id AND d.turn = rel.turn AND d.label = target)"
    " UNION ALL SELECT conv_id, turn FROM con) SELECT conv_id AS text, turn AS no, count(*) AS dropped FROM lost GROUP BY 1, 2"
)
def ingest_dropped(t):
    """Relations and bases that name what their paragraph does not mention."""
    return _topology(t)[1]


@query(
    f"WITH {_READ}, o AS (SELECT DISTINCT conv_id, turn, node, hash_known FROM (SELECT *, ascii(substr(node, 3)) % 2 = 0 AS hash_known FROM m)), f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, node) AS first_ FROM o)"
    " SELECT conv_id AS text, turn AS no, array_to_string(list_sort(list(node)), ' ') AS node_ids FROM f WHERE hash_known OR turn > first_ GROUP BY 1, 2"
)
def ingest_firings(t):
    """Nodes that each turn fires since they were there before."""
    _, said = _read(t)
    known = F.ascii(F.substring("node", 3, 1)) % 2 == 0
    return ingest.first_references(said.withColumn("known", known)).select("text", "no", F.array_join("node_ids", " ").alias("node_ids"))


_BARE = r"regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower({0}), '\s+', ' ', 'g'), ' '), '^[\x22“”‘’'']+|[\x22“”‘’'']+$', '', 'g'), '[.!?…]+$', ''), '^[\x22“”‘’'' ]+|[\x22“”‘’'' ]+$', '', 'g')"
_SAYS = r"CASE WHEN NOT contains({h}, {k}) THEN false ELSE len(list_filter(range(1, length({h}) - length({k}) + 2), lambda i: substr({h}, i, length({k})) = {k} AND NOT regexp_matches(substr({h}, i - 1, CASE WHEN i > 1 THEN 1 ELSE 0 END), '[\p{{L}}\p{{N}}_]') AND NOT regexp_matches(substr({h}, i + length({k}), 1), '[\p{{L}}\p{{N}}_]'))) > 0 END"
_LONGER = r"CASE WHEN acc.t = '' THEN s.t WHEN regexp_matches(acc.t, '[.!?…,;:][\x22”’'')\]]*$') THEN acc.t || ' ' || s.t ELSE acc.t || '. ' || s.t END"


@query(
    r"WITH f AS (SELECT role, text, min(conv_id * 1000 + turn) AS o FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2), p AS (SELECT role, o, string_split(regexp_replace(text, '([.!?][\x22'')\]]*)[\s]+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM f),"
    r" q AS (SELECT role, o, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM p), r AS (SELECT role, list({'t': trim(regexp_replace(s, '\s+', ' ', 'g'), ' '), 'b': i = 1} ORDER BY o, i) AS ss FROM q WHERE length(trim(s, ' ')) > 0 GROUP BY role),"
    " g AS (SELECT role, list_reduce(list_transform(list_prepend({'t': role || ' of a talk', 'b': true}, ss), lambda s: {'t': s.t, 'b': s.b, 'full': false}),"
    f" lambda acc, s: {{'t': CASE WHEN (acc.full AND NOT s.b) OR {_BARE.format('s.t')} = '' OR {_SAYS.format(h=_BARE.format('acc.t'), k=_BARE.format('s.t'))} OR length({_LONGER}) > 500 THEN acc.t ELSE {_LONGER} END, 'b': false,"
    f" 'full': (acc.full AND NOT s.b) OR (NOT ({_BARE.format('s.t')} = '' OR {_SAYS.format(h=_BARE.format('acc.t'), k=_BARE.format('s.t'))}) AND length({_LONGER}) > 500)}}).t AS description FROM r)"
    " SELECT role AS id, description, length(description) AS chars FROM g"
)
def accrued_descriptions(t):
    """What each role's description grows to over all turns, up to 500 characters."""
    nodes = t.conversations.where("text is not null").select(F.col("role").alias("id")).distinct().withColumn("description", F.concat("id", F.lit(" of a talk")))
    said = t.conversations.select(F.col("role").alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.concat_ws("#", "conv_id", "turn").alias("source"), F.col("text").alias("body"))
    return ingest.accrued(nodes, said).select("id", "description", F.length("description").cast("long").alias("chars"))


def _consolidated(t):
    """Two passes over parts and their suppliers: chains, a claim by two anchors, and a second merge of what the first one made."""
    store = VersionSet(t.spark, f"{shared_folder(t.spark)}/query-{uuid.uuid4().hex}")
    key, day = F.col("p_partkey"), F.to_timestamp(F.lit("2024-01-01"))
    lines = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    nodes = t.part.join(lines, key == F.col("l_partkey"), "left").select(
        key.alias("id"), F.col("p_name").alias("description"), F.coalesce("a", day).alias("born"), F.coalesce("b", day).alias("last_fired"),
        F.coalesce("n", F.lit(0)).alias("fired_total"), F.array("p_brand", "p_type").alias("tags"), F.lit(True).alias("candidate"),
    )
    edges = t.lineitem.groupBy(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst")).agg((F.sum("l_quantity") / 200).alias("weight"), F.min("l_shipdate").alias("born"), F.max("l_shipdate").alias("last_fired"))
    deltas = t.lineitem.select(F.col("l_partkey").alias("src"), (F.col("l_partkey") % 50 + 1).alias("dst"), F.lit("near").alias("rel"), (F.col("l_quantity") / 1000).alias("delta"))
    store.commit({"nodes": nodes, "edges": edges.withColumn("rel", F.lit("supplied_by")), "deltas": deltas})
    same = lambda cond, to: t.part.where(cond).select(key.alias("member"), to.alias("anchor"), F.lit("same").alias("verdict"))
    first = same("p_partkey % 10 IN (2, 3)", key - 1).union(same("p_partkey % 10 = 4", key - 3)).union(same("p_partkey % 10 = 4", key + 1)).union(same("p_partkey % 10 = 6", key).withColumn("verdict", F.lit("other")))
    consolidate.consolidate(store, first)
    consolidate.consolidate(store, same("p_partkey % 20 = 11", key - 10))
    return store


_REMAP = "CASE WHEN {0} % 10 IN (2, 3) THEN {0} - {0} % 10 + 1 ELSE {0} END", "CASE WHEN {0} % 20 = 11 THEN {0} - 10 ELSE {0} END"


@query(
    "WITH l AS (SELECT p_partkey AS id, p_name, count(l_partkey) AS n, coalesce(min(l_shipdate), TIMESTAMP '2024-01-01') AS a, coalesce(max(l_shipdate), TIMESTAMP '2024-01-01') AS b FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2),"
    f" r AS (SELECT *, {_REMAP[0].format('id')} AS x FROM l), s AS (SELECT *, {_REMAP[1].format('x')} AS y FROM r)"
    " SELECT y AS id, min(p_name) FILTER (id = y) AS description, min(a) AS born, max(b) AS last_fired, CAST(sum(n) AS BIGINT) AS fired_total, count(*) = 1 AS candidate FROM s GROUP BY y"
)
def consolidated_nodes(t):
    """Nodes after two passes."""
    n = _consolidated(t).read("nodes")
    return n.select("id", "description", F.col("born").cast("timestamp_ntz").alias("born"), F.col("last_fired").cast("timestamp_ntz").alias("last_fired"), "fired_total", "candidate")


@query(
    f"WITH e AS (SELECT l_partkey AS src, -l_suppkey AS dst, sum(l_quantity) / 200 AS weight FROM lineitem GROUP BY 1, 2), a AS (SELECT {_REMAP[0].format('src')} AS s, dst, sum(weight) AS w, count(*) AS k, bool_or(src % 10 IN (1, 2, 3)) AS hit FROM e GROUP BY 1, 2),"
    f" b AS (SELECT s, dst, CASE WHEN hit THEN least(1.0::DOUBLE, w) ELSE w END AS w FROM a), c AS (SELECT {_REMAP[1].format('s')} AS src, dst, least(1.0::DOUBLE, sum(least(1.0::DOUBLE, w))) AS weight FROM b GROUP BY 1, 2)"
    " SELECT src, dst, round(weight + 1e-9, 6) AS weight FROM c"
)
def consolidated_edges(t):
    """Edges after two passes: convergent ones added up, none above 1."""
    return _consolidated(t).read("edges").select("src", "dst", F.round(F.col("weight") + 1e-9, 6).alias("weight"))


@query(
    "WITH d AS (SELECT l_partkey AS a, l_partkey % 50 + 1 AS b, l_quantity / 1000 AS x FROM lineitem),"
    f" p AS (SELECT {_REMAP[0].format('a')} AS a1, {_REMAP[0].format('b')} AS b1, a, b, x FROM d), q AS (SELECT {_REMAP[1].format('a1')} AS src, {_REMAP[1].format('b1')} AS dst, a1, b1, x FROM p WHERE a1 <> b1 OR a = b)"
    " SELECT src, dst, count(*) AS n, round(sum(x) + 1e-9, 6) AS delta FROM q WHERE src <> dst OR a1 = b1 GROUP BY 1, 2"
)
def consolidated_deltas(t):
    """Pending deltas after two passes: none names a node that is gone."""
    return _consolidated(t).read("deltas").groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.sum("delta") + 1e-9, 6).alias("delta"))
