"""Graphs as edge tables (src, dst, weight, ...): build, normalise, spread activation, walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arboryx.lineage import cut, numbered, small, without_shuffle_files

#: So many edges, or fewer, are one task's work in a round of ``components``; so many words of 64 starts are broadcast by ``neighbourhood``.
FEW_EDGES, FEW_WORDS = 100_000, 2_000


def conducting(edges: DataFrame, keep_loops: bool = False) -> DataFrame:
    """(src, dst, cond): weight times frame consistency, loops dropped, parallel edges kept."""
    fits = F.col("frame_consistency") if "frame_consistency" in edges.columns else F.lit(1.0)
    out = edges.select("src", "dst", (F.col("weight") * fits).alias("cond"))
    return out if keep_loops else out.where("src <> dst")


def over_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id); loops stay."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def row_normalised(edges: DataFrame) -> DataFrame:
    """cond divided by what leaves the source (at least 1e-12); an aggregate and a join, so hot sources can be split."""
    out = edges.groupBy("src").agg(F.sum("cond").alias("_out"))
    return edges.join(out, "src").select("src", "dst", (F.col("cond") / F.greatest("_out", F.lit(1e-12))).alias("cond"))


def sym_normalised(edges: DataFrame) -> DataFrame:
    out = edges.groupBy("src").agg(F.sum("cond").alias("_out"))
    into = edges.groupBy("dst").agg(F.sum("cond").alias("_in"))
    scaled = F.col("cond") / F.sqrt(F.greatest(F.col("_out") * F.col("_in"), F.lit(1e-24)))
    return edges.join(out, "src").join(into, "dst").select("src", "dst", scaled.alias("cond"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))


def in_strength(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.sum("cond").alias("in_strength"))


def potentials(edges: DataFrame) -> DataFrame:
    """Weight at both ends of every edge, summed; a loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight")
    return ends.groupBy("id").agg(F.sum("weight").alias("potential"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbour), undirected and distinct."""
    both = edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"))
    return both.select(F.col("e.src").alias("id"), F.col("e.dst").alias("neighbour")).where("id <> neighbour").distinct()


#: Queries that may travel as columns of one row a node; out-edges from which on a source is dealt to several tasks;
#: numbers (nodes times queries) up to which activation is broadcast to the edges.
WIDE_QUERIES, HOT_DEGREE, BROADCAST_NUMBERS = 64, 200_000, 2_000_000


def _stored_by_source(edges: DataFrame, normal: bool, beta: float) -> tuple[DataFrame, DataFrame | None, int]:
    """``edges`` (src, dst, cond) with a ``salt``, stored by (src, salt); (src, salts) of the sources of more than HOT_DEGREE edges (None: there are none); and how many nodes there are at most.

    ``normal`` divides by what leaves the source, ``beta`` > 0 by in-degree ** beta. The edges are made once. A hot
    source's lie in as many partitions as it has salts, so no task holds more than about HOT_DEGREE of one. Where
    one activation of all nodes is small enough to be broadcast, edges stay as they come.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = cut(edges.select("src", "dst", "cond"))
    per = cut(base.groupBy("src").agg(F.count("*").alias("n"), F.sum("cond").alias("_out")))
    nodes = per.count() + base.agg(F.countDistinct("dst")).first()[0]
    many = cut(per.where(F.col("n") > HOT_DEGREE).select("src", F.ceil(F.col("n") / HOT_DEGREE).cast("int").alias("salts")))
    out = base.withColumn("salt", F.lit(0))
    if normal:
        out = out.join(per.select("src", "_out"), "src").withColumn("cond", F.col("cond") / F.greatest("_out", F.lit(1e-12))).drop("_out")
    if beta:
        penalty = in_degree(base).select(F.col("id").alias("dst"), F.pow(F.greatest("in_degree", F.lit(1)), F.lit(beta)).alias("_p"))
        out = out.join(penalty, "dst").withColumn("cond", F.col("cond") / F.col("_p")).drop("_p")
    if nodes <= BROADCAST_NUMBERS:
        return cut(out), None, nodes
    if many.isEmpty():
        return cut(out.repartition(n, "src")), None, nodes
    salted = out.join(many, "src", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    return cut(salted.repartition(n, "src", "salt")), many, nodes


def spread(edges: DataFrame, seeds: DataFrame, operator: str = "ppr", hops: int = 3, damping: float = 0.5, alpha: float = 0.15, iterations: int = 12, beta: float = 0.0, trace: bool = False, cut_every: int = 4) -> DataFrame:
    """Spreading activation of many queries at once.

    ``seeds`` is (query_id, id, x), ``edges`` (src, dst, cond). ``raw``: x <- damping * A'x, the last
    frontier only. ``degnorm``: the same on row-normalised edges. ``ppr``: x <- (1 - alpha) * A'x +
    alpha * seed on row-normalised edges; seeds are not scaled to one and what reaches a node without
    edges is lost. ``accumulate``: x <- damping * A'x + seed. beta > 0 divides each hop by
    in_degree ** beta. ``trace`` returns all frames with their iteration.

    Normalising and the penalty are part of the stored edges, so a hop is one join and one aggregation
    with map-side combine. An activation of at most BROADCAST_NUMBERS numbers is broadcast to the edges, which
    then stay where they are; a larger one meets edges that are dealt by their source, hot sources in several parts. Up to WIDE_QUERIES queries are columns of one row per node (null: not reached),
    so a hop moves a row per node and not one per node and query; more are rows.
    """
    graph, hot, nodes = _stored_by_source(edges, operator not in ("raw", "accumulate"), beta)
    seeds = cut(seeds.select("query_id", "id", F.col("x").cast("double").alias("x")))
    queries = [r[0] for r in seeds.select("query_id").distinct().limit(WIDE_QUERIES + 1).collect()]
    wide = len(queries) <= WIDE_QUERIES
    key = ["id"] if wide else ["query_id", "id"]
    if wide:
        names = [f"x{i}" for i in range(len(queries))]
        seed = seeds.groupBy("id").agg(*[F.sum(F.when(F.col("query_id").eqNullSafe(F.lit(q)), F.col("x"))).alias(c) for c, q in zip(names, queries)])
    else:
        names, seed = ["x"], seeds.groupBy(*key).agg(F.sum("x").alias("x"))
    seed = cut(seed) if names else seed

    def told(x: DataFrame) -> DataFrame:
        if not wide:
            return x
        if not names:
            return seeds.limit(0)
        kind = seeds.schema["query_id"].dataType
        each = F.array(*[F.struct(F.lit(q).cast(kind).alias("query_id"), F.col(c).alias("x")) for c, q in zip(names, queries)])
        return x.select("id", F.inline(each)).where("x is not null").select("query_id", "id", "x")

    ids = seeds.select("id").distinct().count()
    everywhere = (nodes + ids) * max(1, len(names)) <= BROADCAST_NUMBERS if wide else False  # no step reaches more nodes than these
    x, frames = seed, []
    scale, again = (1 - alpha, alpha) if operator == "ppr" else (damping, 1.0 if operator == "accumulate" else 0.0)
    for i in range(1, (iterations if operator == "ppr" else hops) + 1):
        if hot is None:
            met = (F.broadcast(x) if everywhere else x).join(graph, F.col("id") == F.col("src"))
        else:
            dealt = x.join(hot.withColumnRenamed("src", "id"), "id", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
            met = dealt.join(graph, (F.col("id") == F.col("src")) & (F.col("_salt") == F.col("salt")))
        moved = met.select(*[c for c in key if c != "id"], F.col("dst").alias("id"), *[(F.col(c) * F.col("cond") * scale).alias(c) for c in names])
        if again:
            moved = moved.unionByName(seed.withColumns({c: F.col(c) * again for c in names}))
        x = moved.groupBy(*key).agg(*[F.sum(c).alias(c) for c in names])
        if i % cut_every == 0:
            x = cut(x)
        if trace:
            frames.append(told(x).withColumn("iteration", F.lit(i)))
    if not trace:
        return told(x)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def codebook_spread(edges: DataFrame, seeds: DataFrame, hops: int = 3, decay: float = 0.85, threshold: float = 0.01, keep: float = 0.2) -> DataFrame:
    """Activation over edges weighted base * log1p(strength) * relu(match); x <- decay * W'x below the
    threshold cut to nothing, plus ``keep`` of x. Edges of strength zero do not conduct."""
    w = edges.select("src", "dst", (F.col("weight") * F.log1p("strength") * F.greatest("match", F.lit(0.0))).alias("w")).where("w > 0")
    w = cut(w)
    x = seeds.select("query_id", "id", F.col("x").cast("double").alias("x"))
    for _ in range(hops):
        moved = x.join(w, F.col("id") == F.col("src")).groupBy("query_id", F.col("dst").alias("id")).agg((F.sum(F.col("x") * F.col("w")) * decay).alias("x"))
        kept = x.withColumn("x", F.col("x") * keep)
        x = moved.where(F.col("x") >= threshold).unionByName(kept).groupBy("query_id", "id").agg(F.sum("x").alias("x"))
    return x


def softmax(scores: DataFrame, key: str, score: str, temperature: float = 0.1) -> DataFrame:
    top = scores.groupBy(key).agg(F.max(score).alias("_top"))
    weighed = scores.join(top, key).withColumn("_e", F.exp((F.col(score) - F.col("_top")) / temperature))
    total = weighed.groupBy(key).agg(F.sum("_e").alias("_sum"))
    return weighed.join(total, key).withColumn("x", F.col("_e") / F.col("_sum")).drop("_top", "_e", "_sum")


def mask_hubs(activation: DataFrame, edges: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """Without the n nodes of the largest in-degree, as far as they are no seeds of the query."""
    hubs = in_degree(edges).orderBy(F.desc("in_degree"), "id").limit(n).select("id", F.lit(True).alias("_hub"))
    marked = activation.join(hubs, "id", "left").join(seeds.select("query_id", "id", F.lit(True).alias("_seed")).distinct(), ["query_id", "id"], "left")
    return marked.where("_hub is null or _seed is not null").drop("_hub", "_seed")


def simple_paths(edges: DataFrame, starts: DataFrame, depth: int = 3, least_weight: float = 0.3) -> DataFrame:
    """(start, path, score): every simple path along outgoing edges of at least ``least_weight``, every prefix too."""
    strong = edges.where(F.col("weight") >= least_weight).select("src", "dst", "weight")
    now = starts.select(F.col("id").alias("start"), F.array("id").alias("path"), F.lit(1.0).alias("score"))
    out = None
    for _ in range(depth):
        now = (
            now.join(strong, F.element_at("path", -1) == F.col("src"))
            .where(~F.array_contains("path", F.col("dst")))
            .select("start", F.concat("path", F.array("dst")).alias("path"), (F.col("score") * F.col("weight")).alias("score"))
        )
        out = now if out is None else out.unionByName(now)
    return out


def multi_hop(edges: DataFrame, seeds: DataFrame, k: int = 20, hops: int = 3, least_weight: float = 0.3) -> DataFrame:
    """Best score per (query, node): the seed's own, or its score times the weight of a path; k per query."""
    paths = simple_paths(edges, seeds.select("id").distinct(), hops, least_weight)
    reached = seeds.join(paths, F.col("id") == F.col("start")).select("query_id", F.element_at("path", -1).alias("id"), (F.col("x") * F.col("score")).alias("x"))
    best = seeds.select("query_id", "id", "x").unionByName(reached).groupBy("query_id", "id").agg(F.max("x").alias("x"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("x"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, id, distance) of nodes within ``depth`` steps in either direction.

    Starts are numbered, and the 64 of a word are the bits of one number: a step joins nodes and words, not
    nodes and starts, and adds up by bitwise or. Only the result has a row per start and node.
    """
    near = adjacency(edges)
    named = cut(numbered(starts.select("id").distinct().orderBy("id"), "no"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("no") % 64).cast("int"))
    front = cut(named.select("id", F.floor(F.col("no") / 64).alias("word"), bit.alias("bits")))
    seen, frames = front, [front.withColumn("distance", F.lit(0))]
    for d in range(1, depth + 1):
        step = front.join(near, "id").groupBy(F.col("neighbour").alias("id"), "word").agg(F.bit_or("bits").alias("bits"))
        before = seen.withColumnRenamed("bits", "_old")
        both = step.join(before, ["id", "word"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_old", F.lit(0)))))
        front = both.where("bits <> 0").select("id", "word", "bits")
        front = cut(front) if d < depth else front
        frames.append(front.withColumn("distance", F.lit(d)))
        if d < depth:
            seen = cut(seen.unionByName(front).groupBy("id", "word").agg(F.bit_or("bits").alias("bits")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    # a word's starts travel with it: rows of start and node are made last and are not shuffled
    named = named.select(F.floor(F.col("no") / 64).alias("word"), F.struct("no", "id").alias("start"))
    words = small(cut(named.groupBy("word").agg(F.transform(F.array_sort(F.collect_list("start")), lambda s: s["id"]).alias("starts"))), FEW_WORDS)
    reached = F.filter(F.transform("starts", lambda s, i: F.when(F.getbit(F.col("bits"), i) == 1, s)), lambda s: s.isNotNull())
    return out.join(words, "word").select(F.explode(reached).alias("start"), "id", "distance")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, by alternating large-star and small-star rounds.

    Edges are counted before each round; up to FEW_EDGES of them take it in one task without a shuffle, more are dealt over tasks.
    """
    e = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())

    def signature(df):
        with without_shuffle_files(df.sparkSession):
            return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = signature(e)
    for _ in range(max_rounds):
        few = seen[0] <= FEW_EDGES
        both = e.union(e.select("v", "u"))
        both = both.coalesce(1) if few else both
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        stars = small.union(least.select("u", F.col("m").alias("v")))
        e = cut((stars.coalesce(1) if few else stars).distinct())
        now = signature(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def concentration(activation: DataFrame, seeds: DataFrame, tops: tuple[int, ...] = (10, 100, 1000)) -> DataFrame:
    """Participation ratio and the mass of the strongest nodes per query, seeds left out."""
    others = activation.join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti")
    ranked = others.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("x"), "id")))
    total = F.sum("x")
    shares = [(F.sum(F.when(F.col("_r") <= t, F.col("x"))) / total).alias(f"top{t}") for t in tops]
    return ranked.groupBy("query_id").agg((total * total / F.sum(F.col("x") * F.col("x"))).alias("participation"), *shares)
