"""Queries of text, vectors, ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arboryx.functions import scalar, text, vectors
from arboryx.lineage import cut
from arboryx.operators import ranking, seeding

from . import fixtures as fx
from .fixtures import TOKENS
from .registry import query

_DOT = "list_inner_product(a.v, b.v)"
_UNIT = "unit AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"


def _unit(t):
    v = vectors.l2_normalise(F.transform("embedding", lambda x: x.cast("double")))
    return t.embeddings.select(F.col("vec_id").alias("id"), "label", v.alias("v"))


_PARA = r"para AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(13), chr(10)), '\n[ \t]*\n'), lambda p: trim(p)), lambda p: length(p) >= 10) AS ps FROM documents)"


@query(f"WITH {_PARA} SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS para_no, md5(unnest(ps)) AS para FROM para")
def paragraphs(t):
    return t.documents.select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("para_no", "p")).select("doc_id", "para_no", F.md5("p").alias("para"))


@query(
    "WITH c AS (SELECT doc_id, text, greatest(CAST(ceil((length(text) - 800) / 600.0) AS INTEGER), 0) AS last_ FROM documents), n AS (SELECT doc_id, text, unnest(range(0, last_ + 1)) AS i FROM c)"
    " SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, md5(trim(substr(text, i * 600 + 1, 800), ' ')) AS chunk FROM n"
)
def overlapping_chunks(t):
    return t.documents.select("doc_id", F.posexplode(text.overlapping_chunks(F.col("text"), 800, 200)).alias("chunk_no", "c")).select("doc_id", "chunk_no", F.md5("c").alias("chunk"))


@query(
    r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?][\x22'')\]]*)[\s]+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 0)) AS n_sentences FROM documents"
)
def sentence_counts(t):
    return t.documents.select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query(
    "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || '''s ' || p_type), '''s\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS label_form,"
    " regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS relation_form, trim(regexp_replace(lower(p_brand), '[^a-z]+', ' ', 'g')) AS gold_form,"
    " array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') AS entity_form FROM part"
)
def normal_forms(t):
    return t.part.select(
        "p_partkey",
        text.label_form(F.concat("p_name", F.lit("'s "), "p_type")).alias("label_form"),
        text.relation_form(F.col("p_type")).alias("relation_form"),
        text.gold_form(F.col("p_brand")).alias("gold_form"),
        text.entity_form(F.col("p_name")).alias("entity_form"),
    )


@query("SELECT conv_id, turn, CAST(floor(octet_length(encode(text)) / 3) AS BIGINT) AS tokens, CASE WHEN length(trim(text, ' ')) <= 80 THEN trim(text, ' ') ELSE rtrim(substr(trim(text, ' '), 1, 79), ' ') || '…' END AS short FROM conversations")
def token_estimates(t):
    return t.conversations.select("conv_id", "turn", text.token_estimate(F.col("text")).alias("tokens"), text.truncated(F.col("text"), 80).alias("short"))


@query(
    "WITH t AS (SELECT conv_id, turn, CAST(floor(octet_length(encode(text)) / 3) AS BIGINT) AS n FROM conversations), r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS held FROM t)"
    " SELECT conv_id, turn, CAST(held AS BIGINT) AS held FROM r WHERE held <= 600"
)
def budget_compaction(t):
    """The latest turns of each conversation that fit into a token budget."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    sized = t.conversations.select("conv_id", "turn", text.token_estimate(F.col("text")).alias("n"))
    return sized.withColumn("held", F.sum("n").over(order)).where("held <= 600").select("conv_id", "turn", "held")


@query("SELECT page_id, count(*) AS n_links, count(DISTINCT link) AS n_distinct FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"#]+)', 1)) AS link FROM pages) GROUP BY page_id")
def page_links(t):
    found = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#]+)'), 1)).alias("link"))
    return found.groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("link").alias("n_distinct"))


@query(f"WITH {TOKENS} SELECT doc_id, count(*) AS n_distinct, CAST(sum(tf) AS BIGINT) AS n_tokens, max(tf) AS most FROM tokens GROUP BY doc_id")
def token_statistics(t):
    return fx.tokens(t).groupBy("doc_id").agg(F.count("*").alias("n_distinct"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("most"))


_BM25 = f"""{TOKENS}, q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
asked AS (SELECT query_id, token, count(*) AS times FROM q GROUP BY 1, 2), dl AS (SELECT doc_id, sum(tf) AS dl FROM tokens GROUP BY 1),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT token, count(*) AS df FROM tokens GROUP BY 1),
bm AS (
  SELECT query_id, doc_id, sum(times * greatest(0.0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM asked JOIN tokens USING (token) JOIN df USING (token) JOIN dl USING (doc_id), st GROUP BY 1, 2
), ranked AS (SELECT query_id, doc_id, round(score, 7) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 7) DESC, doc_id) AS rank FROM bm)"""


def _bm25(t):
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.explode(text.tokens(F.col("text"))).alias("token"))
    lengths = t.documents.select("doc_id", F.size(text.tokens(F.col("text"))).alias("dl"))
    scored = ranking.bm25(fx.tokens(t), asked, lengths=lengths).withColumn("score", F.round("score", 7))
    return ranking.top(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], 10)


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def bm25_top10(t):
    return _bm25(t)


_GOLDS = "golds AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> '')"


@query(
    f"WITH {_BM25}, {_GOLDS}, g AS (SELECT query_id, count(*) AS n FROM golds GROUP BY query_id),"
    " h AS (SELECT k.query_id, count(*) FILTER (rank <= 5) AS hit, min(rank) AS fst FROM ranked k JOIN golds ON golds.query_id = k.query_id AND golds.id = k.doc_id WHERE rank <= 10 GROUP BY k.query_id)"
    " SELECT query_id, round(coalesce(hit, 0) / n + 1e-11, 8) AS recall, round(coalesce(1.0 / fst, 0) + 1e-11, 8) AS rr FROM g LEFT JOIN h USING (query_id)"
)
def bm25_recall(t):
    """Recall at 5 and reciprocal rank of BM25 for benchmark passages, golds being the documents that hold them whole."""
    golds = ranking.holders(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), t.documents.select(F.col("doc_id").alias("id"), "text"))
    out = ranking.recall_and_mrr(_bm25(t).withColumnRenamed("doc_id", "id"), golds)
    return out.select("query_id", F.round(F.col("recall") + 1e-11, 8).alias("recall"), F.round(F.col("rr") + 1e-11, 8).alias("rr"))


_KNN = f"{_UNIT}, s AS (SELECT a.id AS query_id, b.id, round({_DOT}, 9) AS cosine FROM unit a JOIN unit b ON a.id <> b.id WHERE a.id % 100 = 0)"


@query(f"WITH {_KNN}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 10")
def nearest_neighbours(t):
    unit = _unit(t).select("id", "v")
    return ranking.nearest(unit, unit.where("id % 100 = 0"), 10)


@query(f"WITH {_KNN}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS INTEGER) AS rank FROM s WHERE cosine BETWEEN 0.1 AND 0.4) SELECT * FROM r WHERE rank <= 20")
def similarity_band(t):
    unit = _unit(t).select("id", "v")
    return ranking.nearest(unit, unit.where("id % 100 = 0"), 20, 0.1, 0.4)


_CENT = f"""{_UNIT}, dims AS (SELECT label, i, avg(v[i]) AS m FROM unit, range(1, 65) r(i) GROUP BY 1, 2),
cent AS (SELECT label, list(m ORDER BY i) AS v FROM dims GROUP BY label)"""


def _centroids_of(unit, label):
    each = unit.select(label, F.posexplode("v").alias("i", "x"))
    means = each.groupBy(label, "i").agg(F.avg("x").alias("m"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))


def _centroids(t):
    return _centroids_of(_unit(t), "label")


@query(f"WITH {_CENT} SELECT label, round(list_aggregate(v, 'sum') + 1e-11, 8) AS total, round(sqrt(list_inner_product(v, v)) + 1e-11, 8) AS length FROM cent")
def cluster_centroids(t):
    c = _centroids(t)
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return c.select("label", F.round(total + 1e-11, 8).alias("total"), F.round(vectors.norm(F.col("v")) + 1e-11, 8).alias("length"))


@query(
    f"WITH {_CENT}, s AS (SELECT a.id, b.label, round({_DOT} / sqrt(list_inner_product(b.v, b.v)), 9) AS cosine FROM unit a, cent b)"
    " SELECT id, first(label ORDER BY cosine DESC, label) AS cluster, max(cosine) AS cosine FROM s GROUP BY id"
)
def nearest_centroid(t):
    """Each vector's nearest centroid; a centroid per label, so their number is small and fixed."""
    c = _centroids(t).select("label", vectors.l2_normalise(F.col("v")).alias("c"))
    scored = _unit(t).select("id", "v").crossJoin(F.broadcast(c)).select("id", "label", F.round(vectors.dot(F.col("v"), F.col("c")), 9).alias("cosine"))
    return scored.groupBy("id").agg(F.max_by("label", F.struct("cosine", -F.col("label"))).alias("cluster"), F.max("cosine").alias("cosine"))


@query(
    f"WITH {_KNN}, truth AS (SELECT query_id, min(s.id) AS id FROM s JOIN embeddings q ON q.vec_id = query_id JOIN embeddings e ON e.vec_id = s.id AND e.label = q.label GROUP BY 1),"
    " known AS (SELECT query_id, s.id FROM s JOIN embeddings q ON q.vec_id = query_id JOIN embeddings e ON e.vec_id = s.id AND e.label = q.label),"
    " tgt AS (SELECT s.query_id, s.id, s.cosine FROM s JOIN truth USING (query_id, id)),"
    " o AS (SELECT s.query_id, s.cosine > t.cosine AS more, s.cosine = t.cosine AS same FROM s ANTI JOIN known USING (query_id, id) JOIN tgt t ON t.query_id = s.query_id)"
    " SELECT query_id, round(coalesce(sum(more::INT), 0) + coalesce(sum(same::INT), 0) / 2 + 1, 4) AS rank FROM tgt LEFT JOIN o USING (query_id) GROUP BY query_id"
)
def filtered_ranks(t):
    """Rank of the first vector of the query's own label, the others of that label filtered; a query sees all others, as many as there are."""
    unit = _unit(t)
    asked = unit.where("id % 100 = 0")
    two = ranking.top(unit.where("label is not null").select("label", "id"), ["label"], [F.col("id")], 2).drop("rank")  # the first, or the second where the query is the first
    truth = asked.select(F.col("id").alias("query_id"), "label").join(two, "label").where("id <> query_id").groupBy("query_id").agg(F.min("id").alias("id"))
    out = ranking.places(unit, asked, truth, apart="label").select("query_id", "rank")
    return out.withColumn("rank", F.round("rank", 4))


@query("SELECT p_partkey, p_retailprice, CASE WHEN p_retailprice <= a THEN 0 WHEN p_retailprice <= b THEN 1 WHEN p_retailprice <= c THEN 2 ELSE 3 END AS weight_class FROM part, (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.75) AS b, quantile_cont(p_retailprice, 0.95) AS c FROM part)")
def weight_classes(t):
    return seeding.weight_classes(t.part.select("p_partkey", "p_retailprice"), "p_retailprice")


#: Greedy order by relevance and diversity, and who gets a seat, of candidates ``cand`` (query_id, r, id, cosine, v, cls).
CHOICE = """sim AS MATERIALIZED (SELECT a.query_id, a.r AS i, b.r AS j, list_inner_product(a.v, b.v) AS s FROM cand a JOIN cand b ON a.query_id = b.query_id),
ord AS (
  SELECT query_id, 1 AS pos, 1::BIGINT AS pick, [1::BIGINT] AS taken FROM cand WHERE r = 1
  UNION ALL
  SELECT query_id, pos + 1, first(r ORDER BY score DESC, r), list_append(taken, first(r ORDER BY score DESC, r))
  FROM (SELECT o.query_id, o.pos, o.taken, c.r, 0.6 * c.cosine - 0.4 * max(s) AS score FROM ord o JOIN cand c ON c.query_id = o.query_id AND NOT list_contains(o.taken, c.r)
        JOIN sim ON sim.query_id = o.query_id AND sim.i = c.r AND list_contains(o.taken, sim.j) GROUP BY o.query_id, o.pos, o.taken, c.r, c.cosine) GROUP BY query_id, pos, taken
), pos AS (SELECT o.query_id, o.pos, c.id, c.cosine, c.cls, o.pos = min(o.pos) OVER (PARTITION BY o.query_id, c.cls) AND c.cls <> 3 OR o.pos = 1 AS early FROM ord o JOIN cand c ON c.query_id = o.query_id AND c.r = o.pick),
rest AS (SELECT *, count(*) FILTER (early) OVER (PARTITION BY query_id) AS n_early, count(*) FILTER (early AND cls = 3) OVER (PARTITION BY query_id) AS early_hubs,
         row_number() OVER (PARTITION BY query_id, early, cls ORDER BY pos) AS of_class FROM pos),
seated AS (SELECT *, row_number() OVER (PARTITION BY query_id, early ORDER BY cls = 3 AND of_class > 4 - early_hubs, pos) AS turn FROM rest),
chosen_seeds AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS seat, greatest(cosine, 0.001) AS weight FROM seated WHERE early OR turn <= 8 - n_early)"""


@query(
    f"WITH RECURSIVE {_KNN}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS r FROM s),"
    f" cand AS MATERIALIZED (SELECT query_id, r, ranked.id, cosine, v, label % 4 AS cls FROM ranked JOIN unit ON unit.id = ranked.id WHERE r <= 64), {CHOICE} SELECT * FROM chosen_seeds"
)
def diversified_seeds(t):
    """Seeds of every hundredth vector among all others, by relevance, diversity and classes of the label."""
    unit = _unit(t)
    near = ranking.nearest(unit.select("id", "v"), unit.where("id % 100 = 0").select("id", "v"), 64)
    return seeding.diversified(near.join(unit.select("id", "v", (F.col("label") % 4).alias("weight_class")), "id"))


@query(
    "WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2), t AS (SELECT sum(n) AS t, coalesce(sum(n) FILTER (a = b), 0) AS same FROM c),"
    " e AS (SELECT sum(x * y) AS xy FROM (SELECT a AS v, sum(n) AS x FROM c GROUP BY 1) JOIN (SELECT b AS v, sum(n) AS y FROM c GROUP BY 1) USING (v))"
    " SELECT CAST(t AS BIGINT) AS total, round(same / t + 1e-11, 8) AS observed, round((same / t - xy / (t * t)) / (1 - xy / (t * t)) + 1e-11, 8) AS kappa FROM t, e"
)
def rater_kappa(t):
    out = ranking.kappa(t.labels, "quality", "toxic")
    return out.select("total", F.round(F.col("observed") + 1e-11, 8).alias("observed"), F.round(F.col("kappa") + 1e-11, 8).alias("kappa"))


@query(
    "WITH p AS (SELECT d.lang, count(*) FILTER (quality > 1 - toxic) AS better, count(*) FILTER (quality < 1 - toxic) AS worse FROM labels JOIN documents d USING (doc_id) GROUP BY 1)"
    " SELECT lang, better, worse, CASE WHEN better + worse = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, CAST(least(better, worse) AS BIGINT) + 1),"
    " lambda i: exp(lgamma(better + worse + 1) - lgamma(i + 1) - lgamma(better + worse - i + 1) - (better + worse) * ln(2))))), 9) END AS p FROM p"
)
def paired_sign_test(t):
    """Arms quality and not toxic on the same documents, by language."""
    arms = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    a, b = F.col("quality"), 1 - F.col("toxic")
    counts = arms.groupBy("lang").agg(F.count_if(a > b).alias("better"), F.count_if(a < b).alias("worse"))
    return counts.withColumn("p", F.round(ranking.sign_test("better", "worse"), 9))


@query(
    "WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
    " SELECT conv_id, turn, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN CASE WHEN len(x) = len(y) THEN 1 ELSE 0 END ELSE"
    " 2.0 * coalesce(list_sum(list_transform(list_distinct(x), lambda k: least(len(list_filter(x, lambda z: z = k)), len(list_filter(y, lambda z: z = k))))), 0) / (len(x) + len(y)) END + 1e-11, 8) AS f1 FROM p"
)
def turn_token_f1(t):
    """Token F1 of each turn and the next, whole texts."""
    w = t.conversations.select("conv_id", "turn", text.tokens(F.col("text")).alias("w"))
    nxt = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("y"))
    return w.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(ranking.token_f1(F.col("w"), F.col("y")) + 1e-11, 8).alias("f1"))


@query("SELECT o_orderkey, ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT < 644245094 AS held_out FROM orders")
def hash_split(t):
    return t.orders.select("o_orderkey", ranking.hash_split(t.orders, "o_orderkey", 0.15).alias("held_out"))


@query("SELECT event_id, round(CASE WHEN isodow(ts) <= 5 AND (hour(ts) BETWEEN 1 AND 3 OR hour(ts) BETWEEN 6 AND 9) THEN 2.0 ELSE 1.0 END * value / 1000 + 1e-11, 8) AS cost FROM events")
def peak_hour_cost(t):
    price = F.when(scalar.is_peak(F.col("ts")), 2.0).otherwise(1.0)
    return t.events.select("event_id", F.round(price * F.col("value") / 1000 + 1e-11, 8).alias("cost"))


@query("SELECT c_custkey, 'NODE-' || substr(sha256('customer:' || c_custkey || ':' || lower(trim(regexp_replace(c_name, '\\s+', ' ', 'g')))), 1, 12) AS id FROM customer")
def deterministic_ids(t):
    return t.customer.select("c_custkey", scalar.node_id(F.lit("customer"), F.col("c_custkey").cast("string"), F.col("c_name")).alias("id"))


@query(
    "SELECT c_custkey, s_suppkey, CASE WHEN a = b THEN 4 WHEN lower(a) = lower(b) THEN 3 WHEN regexp_replace(lower(a), '\\s+', '', 'g') = regexp_replace(lower(b), '\\s+', '', 'g') THEN 2"
    " WHEN trim(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(b), '[^a-z0-9]+', ' ', 'g')) THEN 1 ELSE 0 END AS strength"
    " FROM (SELECT c_custkey, s_suppkey, replace(c_name, 'Customer', 'Firm') AS a, replace(upper(s_name), 'SUPPLIER', CASE s_suppkey % 3 WHEN 0 THEN 'Firm' WHEN 1 THEN 'FIRM' ELSE 'Fi rm' END) AS b FROM customer JOIN supplier ON c_custkey = s_suppkey)"
)
def alias_strength(t):
    pairs = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey"))
    firm = F.when(F.col("s_suppkey") % 3 == 0, "Firm").when(F.col("s_suppkey") % 3 == 1, "FIRM").otherwise("Fi rm")
    b = F.replace(F.upper("s_name"), F.lit("SUPPLIER"), firm)
    return pairs.select("c_custkey", "s_suppkey", text.match_strength(F.replace("c_name", F.lit("Customer"), F.lit("Firm")), b).alias("strength"))
