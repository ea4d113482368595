"""Queries of linking, mentions, sections, spans, sweeps and summary tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from arboryx.functions import text, vectors
from arboryx.operators import graph, ranking, spans

from . import fixtures as fx
from .fixtures import EDGES, NODES, SEEDS, TOKENS
from .rank_queries import _UNIT, CHOICE, _unit
from .registry import query


@query(
    f"WITH {TOKENS}, l AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark)"
    " SELECT item_id, doc_id, count(*) AS mentions FROM l JOIN tokens USING (token) WHERE length(token) >= 6 GROUP BY 1, 2"
)
def dictionary_mentions(t):
    """Documents that mention words of a benchmark item, of six letters or more, each word once."""
    labels = t.benchmark.select("item_id", F.explode(text.tokens(F.col("text"))).alias("token")).where("length(token) >= 6").distinct()
    return labels.join(fx.tokens(t), "token").groupBy("item_id", "doc_id").agg(F.count("*").alias("mentions"))


_NAMES = (
    "names AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '\\b[A-Z][a-z]{5,}\\b')) AS ns FROM documents), idx AS (SELECT doc_id, unnest(ns) AS name FROM names),"
    " df AS (SELECT name, count(*) AS df FROM idx GROUP BY name)"
)


@query(
    f"WITH {_NAMES}, q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]{{5,}}\\b')) AS name FROM benchmark),"
    " r AS (SELECT query_id, doc_id AS id, name, df, row_number() OVER (PARTITION BY query_id ORDER BY df, name, doc_id) AS n FROM q JOIN idx USING (name) JOIN df USING (name))"
    " SELECT query_id, id, name, CAST(n AS INTEGER) AS seat FROM r WHERE n <= 8"
)
def name_anchor_seeds(t):
    """Up to eight documents per benchmark item that share a capitalised name with it, the rarest names first."""
    index = t.documents.select("doc_id", F.explode(text.capitalised(F.col("text"))).alias("name"))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.explode(text.capitalised(F.col("text"))).alias("name"))
    rarity = index.groupBy("name").agg(F.count("*").alias("df"))
    hits = asked.join(index, "name").join(rarity, "name").select("query_id", F.col("doc_id").alias("id"), "name", "df")
    return ranking.top(hits, ["query_id"], [F.col("df"), F.col("name"), F.col("id")], 8, "seat").drop("df")


@query(
    f"WITH {_UNIT}, s AS (SELECT m.id, c.id AS candidate, round(list_inner_product(m.v, c.v) + CASE WHEN m.label = c.label THEN 0.08 ELSE 0 END, 9) AS score FROM unit m JOIN unit c ON m.id % 100 = 0 AND c.id % 100 <> 0),"
    " b AS (SELECT id, max(score) AS score, first(candidate ORDER BY score DESC, candidate) AS candidate FROM s GROUP BY id)"
    " SELECT id, CASE WHEN score >= 0.72 THEN candidate ELSE -1 END AS linked, score FROM b"
)
def entity_links(t):
    """Every hundredth vector linked to the best of the others by cosine and common tag, or minted (-1)."""
    unit = _unit(t)
    # a common label adds one fixed amount: the best is that of its own label with it, or the best of all without
    mentions, others = unit.where("id % 100 = 0"), unit.where("id % 100 <> 0")
    same = ranking.nearest(others, mentions, 1, group="label").select("query_id", "id", F.round(F.col("cosine") + 0.08, 9).alias("score"))
    every = ranking.nearest(others, mentions, 1).select("query_id", "id", F.col("cosine").alias("score"))
    best = ranking.top(same.union(every), ["query_id"], [F.desc("score"), F.col("id")], 1)
    return best.select(F.col("query_id").alias("id"), F.when(F.col("score") >= 0.72, F.col("id")).otherwise(-1).alias("linked"), "score")


@query("SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS section, trim(unnest(h), ' ') AS heading FROM (SELECT page_id, regexp_extract_all(html, '<h[1-4][^>]*>([^<]*)<', 1) AS h FROM pages)")
def page_sections(t):
    return t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h[1-4][^>]*>([^<]*)<"), 1)).alias("section", "h")).select("page_id", "section", F.trim("h").alias("heading"))


@query(
    "WITH p AS (SELECT page_id, split_part(split_part(regexp_replace(url, '^https?://', ''), '/', 1), '?', 1) AS host, split_part(split_part(url, '#', 1), '?', 1) AS clean FROM pages)"
    " SELECT host, count(*) AS pages, count(DISTINCT clean) AS urls FROM p GROUP BY host"
)
def page_hosts(t):
    bare = F.regexp_replace("url", "^https?://", "")
    host = F.split(F.split(bare, "/")[0], "\\?")[0]
    clean = F.split(F.split("url", "#")[0], "\\?")[0]
    return t.pages.groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.countDistinct(clean).alias("urls"))


@query(
    "WITH RECURSIVE s AS (SELECT doc_id, 0::BIGINT AS lo, length(text)::BIGINT AS hi, 0 AS depth FROM documents UNION ALL"
    " SELECT doc_id, CASE WHEN side = 0 THEN lo ELSE (lo + hi) // 2 END, CASE WHEN side = 0 THEN (lo + hi) // 2 ELSE hi END, depth + 1 FROM s, (VALUES (0), (1)) v(side) WHERE hi - lo > 100 AND depth < 20)"
    " SELECT doc_id, depth, count(*) AS spans, max(hi - lo) AS longest FROM s GROUP BY 1, 2"
)
def span_subdivision(t):
    """Spans halved until they are 100 characters or shorter, at most twenty times; counts per level."""
    return spans.subdivided(t.documents.select("doc_id", F.length("text").cast("long").alias("n"))).groupBy("doc_id", "depth").agg(F.sum("spans").alias("spans"), F.max("length").alias("longest"))


_SWEEP = " UNION ALL ".join(
    f"SELECT {share}::DOUBLE AS share, query_id, round(sum(x * weight) + 1e-11, 8) AS mass, count(DISTINCT dst) AS reached FROM seeds JOIN edges ON id = src WHERE ('0x' || substr(md5(src || '>' || dst), 1, 8))::BIGINT < {int(share * 2**32)} GROUP BY query_id"
    for share in (0.25, 0.5, 1.0)
)


@query(f"WITH {EDGES}, {SEEDS} {_SWEEP}")
def density_sweep(t):
    """Mass and reach of one hop over growing shares of the edges, chosen by hash."""
    edges = fx.trade_edges(t).withColumn("h", F.conv(F.substring(F.md5(F.concat("src", F.lit(">"), "dst")), 1, 8), 16, 10).cast("long"))
    hop = fx.region_seeds(t).join(edges, F.col("id") == F.col("src"))
    parts = [
        hop.where(F.col("h") < int(share * 2**32)).groupBy("query_id").agg(F.round(F.sum(F.col("x") * F.col("weight")) + 1e-11, 8).alias("mass"), F.countDistinct("dst").alias("reached")).withColumn("share", F.lit(share))
        for share in (0.25, 0.5, 1.0)
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(f"WITH {EDGES}, {NODES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT id) FROM nodes) AS ids, count(*) FILTER (src NOT IN (SELECT id FROM nodes)) AS bad_src, count(*) FILTER (dst NOT IN (SELECT id FROM nodes)) AS bad_dst FROM edges")
def graph_integrity(t):
    nodes, edges = fx.trade_nodes(t), fx.trade_edges(t)
    lost = lambda c: edges.join(nodes.select(F.col("id").alias(c)), c, "left_anti").agg(F.count("*").alias(f"bad_{c}"))
    return nodes.agg(F.count("*").alias("nodes"), F.countDistinct("id").alias("ids")).crossJoin(lost("src")).crossJoin(lost("dst"))  # one row each


@query(
    "SELECT l_partkey AS src, l_suppkey AS dst, first(l_returnflag ORDER BY rk DESC, l_orderkey, l_linenumber) AS descriptor, count(*) AS entries FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS rk FROM lineitem) GROUP BY 1, 2"
)
def pair_descriptors(t):
    """The best descriptor of each pair by rank, the first seen on ties."""
    rank = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    best = F.max_by("l_returnflag", F.struct(rank.alias("r"), -F.col("l_orderkey"), -F.col("l_linenumber")))
    return t.lineitem.groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(best.alias("descriptor"), F.count("*").alias("entries"))


@query(
    f"WITH {EDGES} SELECT id, count(*) AS neighbours, md5(string_agg(n, ',' ORDER BY n)) AS digest FROM (SELECT DISTINCT src AS id, dst AS n FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst) GROUP BY id"
)
def adjacency_sets(t):
    near = graph.adjacency(fx.trade_edges(t)).groupBy("id").agg(F.array_sort(F.collect_list("neighbour")).alias("n"))
    return near.select("id", F.size("n").cast("long").alias("neighbours"), F.md5(F.array_join("n", ",")).alias("digest"))


@query(
    "WITH r AS (SELECT lang, source, count(*) AS n, count(*) FILTER (quality = 1) / count(*) AS good FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)"
    " SELECT lang, count(*) AS runs, round(avg(good) + 1e-11, 8) AS mean, round(min(good) + 1e-11, 8) AS worst, round(max(good) + 1e-11, 8) AS best FROM r GROUP BY lang"
)
def recall_spread(t):
    """Share of good documents per source, and its spread per language: two levels of aggregation."""
    runs = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id").groupBy("lang", "source").agg((F.count_if(F.col("quality") == 1) / F.count("*")).alias("good"))
    at = lambda c: F.round(c + 1e-11, 8)
    return runs.groupBy("lang").agg(F.count("*").alias("runs"), at(F.avg("good")).alias("mean"), at(F.min("good")).alias("worst"), at(F.max("good")).alias("best"))


@query(
    "SELECT lang, quality = 1 AS found_a, toxic = 0 AS found_b, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang), 2, 3"
)
def found_tables(t):
    """Two by two tables of both arms by language and over all."""
    both = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").select("lang", (F.col("quality") == 1).alias("found_a"), (F.col("toxic") == 0).alias("found_b"))
    per = both.groupBy("lang", "found_a", "found_b").agg(F.count("*").alias("n"))
    return per.union(per.groupBy(F.lit(None).cast("string").alias("lang"), "found_a", "found_b").agg(F.sum("n").alias("n")))


@query(
    "WITH d AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 8) r(i) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS l FROM d GROUP BY 1)"
    " SELECT label, CAST(i - 1 AS INTEGER) AS axis, round(m / l + 1e-11, 8) AS x FROM d JOIN n USING (label)"
)
def mean_frames(t):
    """Unit mean of the first seven components per label, by axis."""
    each = t.embeddings.select("label", F.posexplode(F.slice("embedding", 1, 7)).alias("axis", "x"))
    means = each.groupBy("label", "axis").agg(F.avg(F.col("x").cast("double")).alias("m"))
    length = means.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("l"))
    return means.join(length, "label").select("label", "axis", F.round(F.col("m") / F.col("l") + 1e-11, 8).alias("x"))


@query(
    "WITH w AS (SELECT p_partkey AS id, p_size, p_type, list_distinct(regexp_extract_all(lower(p_name), '[a-z]+')) AS w FROM part)"
    " SELECT a.id, round(least(1.0, 0.6 * len(list_intersect(a.w, b.w)) / greatest(1, len(list_distinct(list_concat(a.w, b.w)))) + 0.2 * (a.p_type = b.p_type)::INT + 0.1 * least(1.0, log10(a.p_size + 1) / 5)) + 1e-11, 8) AS score"
    " FROM w a JOIN w b ON b.id = a.id + 1"
)
def candidate_scores(t):
    """Score of each part as a source for the next: words in common, same type, size."""
    w = t.part.select(F.col("p_partkey").alias("id"), "p_size", "p_type", F.array_distinct(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), 0)).alias("w"))
    nxt = w.select((F.col("id") - 1).alias("id"), F.col("p_type").alias("y"), F.col("w").alias("z"))
    shared = F.size(F.array_intersect("w", "z")) / F.greatest(F.lit(1), F.size(F.array_union("w", "z")))
    score = F.least(F.lit(1.0), 0.6 * shared + 0.2 * (F.col("p_type") == F.col("y")).cast("int") + 0.1 * F.least(F.lit(1.0), F.log10(F.col("p_size") + 1) / 5))
    return w.join(nxt, "id").select("id", F.round(score + 1e-11, 8).alias("score"))


@query(
    "WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (n_chars < 100) / count(*) AS short, count(*) FILTER (lang <> 'en') / count(*) AS foreign_ FROM documents GROUP BY 1)"
    " SELECT source, n, CASE WHEN short > 0.2 THEN 'poor' WHEN short > 0.05 OR foreign_ > 0.6 THEN 'partial' ELSE 'good' END AS verdict, concat_ws('; ', CASE WHEN short > 0.05 THEN 'short texts' END, CASE WHEN foreign_ > 0.6 THEN 'foreign' END) AS reasons FROM s"
)
def ingest_verdicts(t):
    """Ordered thresholds over each source's shares, with reasons."""
    s = t.documents.groupBy("source").agg(F.count("*").alias("n"), (F.count_if(F.col("n_chars") < 100) / F.count("*")).alias("a"), (F.count_if(F.col("lang") != "en") / F.count("*")).alias("b"))
    verdict = F.when(F.col("a") > 0.2, "poor").when((F.col("a") > 0.05) | (F.col("b") > 0.6), "partial").otherwise("good")
    return s.select("source", "n", verdict.alias("verdict"), F.concat_ws("; ", F.when(F.col("a") > 0.05, "short texts"), F.when(F.col("b") > 0.6, "foreign")).alias("reasons"))


@query(
    "WITH q AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS dialogue, max(turn) AS last_ FROM conversations GROUP BY 1) SELECT conv_id, md5(right(dialogue || chr(10) || '---', 14000)) AS composed, CAST(last_ AS BIGINT) AS turns FROM q"
)
def query_composition(t):
    """A conversation as one query, its last 14,000 characters."""
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("l"))))
    q = t.conversations.groupBy("conv_id").agg(lines.alias("l"), F.max("turn").alias("turns"))
    whole = F.concat(F.array_join(F.transform("l", lambda x: x["l"]), "\n"), F.lit("\n---"))
    return q.select("conv_id", F.md5(F.right(whole, F.lit(14000))).alias("composed"), "turns")


@query(
    "WITH o AS (SELECT user_id, event_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) SELECT event_id, round(exp(-ln(2) * (epoch_us(ts) - epoch_us(before)) / 86400000000.0 / 365) + 1e-11, 8) AS fresh FROM o WHERE before IS NOT NULL"
)
def freshness_by_gap(t):
    """Half-life freshness of an event's predecessor of the same user and type."""
    from arboryx.functions import scalar

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    told = t.events.withColumn("before", F.lag("ts").over(w)).where("before is not null")
    return told.select("event_id", F.round(scalar.freshness_half_life((micros("ts") - micros("before")) / 86_400_000_000.0) + 1e-11, 8).alias("fresh"))


_FOLLOWS = """e AS MATERIALIZED (SELECT * FROM (SELECT lag(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS src, doc_id AS dst FROM documents) WHERE src IS NOT NULL AND src <> dst),
n AS MATERIALIZED (SELECT u.id, u.v, u.id % 10 = 0 AS is_anchor FROM unit u JOIN documents ON doc_id = u.id),
s AS (SELECT a.id AS query_id, b.id, round(list_inner_product(a.v, b.v), 9) AS cosine, b.v, b.is_anchor FROM n a, n b WHERE a.id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, 'n' || id) AS r FROM s)"""
_RETRIEVAL = f"""WITH RECURSIVE {_UNIT}, {_FOLLOWS},
pot AS (SELECT n.id, coalesce(p, 0) AS p FROM n LEFT JOIN (SELECT dst, sum(0.5::DOUBLE) AS p FROM e GROUP BY dst) ON dst = n.id), cuts AS (SELECT quantile_cont(p, 0.25) AS a, quantile_cont(p, 0.75) AS b, quantile_cont(p, 0.95) AS c FROM pot),
cls AS (SELECT id, CASE WHEN p <= a THEN 0 WHEN p <= b THEN 1 WHEN p <= c THEN 2 ELSE 3 END AS cls FROM pot, cuts),
near AS (SELECT * FROM ranked WHERE r <= 64), cand AS MATERIALIZED (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, near.id) AS r, near.id, cosine, v, cls FROM near JOIN cls USING (id)), {CHOICE},
norm AS MATERIALIZED (SELECT src, dst, 0.5 / sum(0.5) OVER (PARTITION BY src) AS cond FROM e), x0 AS (SELECT query_id, id, weight AS x FROM chosen_seeds), """ + ", ".join(
    f"x{i} AS MATERIALIZED (SELECT query_id, id, sum(x) AS x FROM (SELECT query_id, dst AS id, 0.85 * sum(x * cond) AS x FROM x{i - 1} JOIN norm ON id = src GROUP BY 1, 2 UNION ALL SELECT query_id, id, 0.15 * weight FROM chosen_seeds) GROUP BY 1, 2)" for i in range(1, 13)
) + """, few AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 12) DESC, id) AS r FROM x12 WHERE round(x, 12) > 0),
told AS (SELECT f.query_id, f.id, round(f.x, 12) AS x, is_anchor FROM few f JOIN n ON n.id = f.id WHERE r <= 66),
kk AS (SELECT *, row_number() OVER (PARTITION BY query_id, is_anchor ORDER BY x DESC, id) AS k FROM told)
SELECT query_id, id, round(x + 1e-11, 8) AS x, CAST(row_number() OVER (PARTITION BY query_id ORDER BY x DESC, id) AS INTEGER) AS rank, is_anchor FROM kk WHERE k <= CASE WHEN is_anchor THEN 3 ELSE 50 END"""


def _asked_documents(t):
    nodes = _unit(t).join(t.documents.select(F.col("doc_id").alias("id")), "id").select("id", "v", (F.col("id") % 10 == 0).alias("is_anchor"))
    return nodes, nodes.where("id % 100 = 0").select(F.col("id").alias("query_id"), "v")


@query(_RETRIEVAL)
def retrieval(t):
    """Documents and their vectors: every hundredth vector asks; documents of one source and language in turn are joined."""
    from arboryx.operators import retrieve

    along = Window.partitionBy("source", "lang").orderBy("doc_id")
    edges = t.documents.select(F.lag("doc_id").over(along).alias("src"), F.col("doc_id").alias("dst"), F.lit("follows").alias("rel"), F.lit(0.5).alias("weight")).where("src is not null")
    nodes, asked = _asked_documents(t)
    found = retrieve.retrieve(nodes, edges, asked)
    return found["nodes"].withColumn("x", F.round(F.col("x") + 1e-11, 8))


@query(f"WITH {_UNIT}, {_FOLLOWS} SELECT query_id, id, greatest(cosine, 0) AS x, CAST(r AS INTEGER) AS rank, is_anchor FROM ranked WHERE r <= 50")
def retrieval_without_edges(t):
    """The same questions of a graph that has no edge yet."""
    from arboryx.operators import retrieve

    nodes, asked = _asked_documents(t)
    return retrieve.retrieve(nodes, t.spark.createDataFrame([], "src long, dst long, rel string, weight double"), asked)["nodes"]
