"""Finding nodes and edges: by key, label or text; filters, queues and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arboryx.lineage import cut, numbered


def multi_get(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """``nodes`` whose id is among ``ids`` (id)."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def by_key(index: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, id): the smallest node id of each asked key that ``index`` (key, id) has: an external id or a label."""
    return index.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("id").alias("id"))


def by_labels(index: DataFrame, asked: DataFrame, each: int = 32, most: int = 32) -> DataFrame:
    """(query_id, rank, id, label) for lists of labels, ``asked`` being (query_id, ordinal, label), ``index`` (label, id).

    A label gives its ``each`` smallest ids; an id counts where it turns up first; a query keeps ``most`` in
    the order of labels, then ids.
    """
    first = Window.partitionBy("label").orderBy("id")
    few = index.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= each)
    seen = asked.join(few, "label").groupBy("query_id", "id").agg(F.min(F.struct("ordinal", "label")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at.ordinal", "id")
    return seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "rank", "id", "at.label")


def aged(edges: DataFrame, horizon: Column, epsilon: float) -> DataFrame:
    """Edges last traversed before ``horizon`` that still carry more than ``epsilon``; nulls never do."""
    return edges.where((F.col("last_traversed") < horizon) & (F.abs("delta") > epsilon))


def of_source(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Nodes (source_ref.identifier, id, ...) of the asked (identifier, exclude_id) sources; an empty identifier has none."""
    wanted = asked.where("identifier <> ''").select(F.col("identifier").alias("_i"), F.col("exclude_id").alias("_x"))
    found = nodes.join(wanted, F.col("source_ref.identifier") == F.col("_i"))
    return found.where(F.col("_x").isNull() | (F.col("id") != F.col("_x"))).drop("_i", "_x")


def newest_pending(nodes: DataFrame, flag: Column, at: str, limit: int = 100) -> DataFrame:
    """The newest nodes that wait for a resolution; ties by id."""
    return nodes.where(flag).orderBy(F.desc(at), "id").limit(limit)


def oldest_first(entries: DataFrame, eligible: Column, sampled: str, acquired: str, limit: int = 100) -> DataFrame:
    """A batch of eligible entries by when they were sampled, or else acquired, then acquired; ties by id."""
    return entries.where(eligible).orderBy(F.coalesce(sampled, acquired), acquired, "id").limit(limit)


def search(nodes: DataFrame, asked: DataFrame, near: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """(query_id, rank, id, tier): nodes (id, label) for texts, ``asked`` being (query_id, text).

    Tier 0 is the node whose id is the text, tier 1 those whose label has it, whatever the case. Where these
    are fewer than min(3, limit), ``near`` (query_id, id, rank) fills up as tier 2. Labels are found by their
    runs of three characters, and of one and two for texts as short as that, so that a text meets only
    labels that hold its beginning; empty texts find nothing. Equal labels are one, with the ``limit`` smallest of their
    ids, and so are equal texts: no more of them can be among the first.
    """
    first = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("id"))).where(F.col("_n") <= limit).drop("_n")
    low = F.lower("label")
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("low") - (n - 1), F.lit(1))), lambda i: F.substring("low", i, F.lit(n)))
    grams = F.array_distinct(F.concat(runs(1), runs(2), runs(3)))
    held = cut(first(nodes.select(low.alias("low"), "id").distinct(), "low"))
    index = held.select("low").distinct().select("low", F.explode(grams).alias("gram"))
    texts = asked.select("query_id", "text", F.lower("text").alias("q")).where(F.length("q") > 0)
    exact = nodes.join(texts, F.col("id") == F.col("text")).select("query_id", "id", F.lit(0).alias("tier"), F.lit(0).alias("near"))
    words = texts.select("q").distinct().withColumn("gram", F.substring("q", 1, 3))
    holds = index.join(words, "gram").where(F.contains("low", "q")).select("q", "low")
    ids = cut(first(holds.join(held, "low").select("q", "id").distinct(), "q"))
    found = cut(exact.unionByName(texts.join(ids, "q").select("query_id", "id", F.lit(1).alias("tier"), F.lit(0).alias("near"))))
    if near is not None:
        counts = found.select("query_id", "id").distinct().groupBy("query_id").agg(F.count("*").alias("n"))
        few = texts.select("query_id").join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < min(3, limit)).select("query_id")
        found = found.unionByName(near.join(few, "query_id", "left_semi").select("query_id", "id", F.lit(2).alias("tier"), F.col("rank").alias("near")))
    one = found.groupBy("query_id", "id").agg(F.min(F.struct("tier", "near")).alias("t"))
    order = Window.partitionBy("query_id").orderBy("t.tier", "t.near", "id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "id", "t.tier")


def closest(nodes: DataFrame, asked: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, id, rank): of the nodes (id, grp, x) of a query's group but ``own`` the ``k`` of the closest x, ties by id.

    ``asked`` is (query_id, own, grp, x). A group's different x are numbered in their order, so a query meets those of the k
    places on either side, each with its k + 1 smallest ids, and equal queries meet them once; the x of a group are known so
    finely that the distance tells two of them apart.
    """
    top = lambda df, by, order, n: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
    points = asked.select("grp", "x").distinct()
    both = nodes.select("grp", "x", F.lit(1).alias("here"), F.lit(0).alias("told")).unionByName(points.select("grp", "x", F.lit(0).alias("here"), F.lit(1).alias("told")))
    levels = both.groupBy("grp", "x").agg(F.max("here").alias("here"), F.max("told").alias("told"))
    placed = cut(levels.withColumn("place", F.sum("here").over(Window.partitionBy("grp").orderBy("x"))))
    few = top(nodes.select("grp", "x", "id"), ["grp", "x"], ["id"], k + 1).drop("rank").join(placed.where("here = 1").select("grp", "x", "place"), ["grp", "x"])
    reach = placed.where("told = 1").select("grp", F.col("x").alias("_x"), F.explode(F.sequence(F.col("place") - k, F.col("place") + k + 1)).alias("place"))
    met = reach.join(few, ["grp", "place"]).withColumn("far", F.abs(F.col("_x") - F.col("x")))
    some = cut(top(met, ["grp", "_x"], ["far", "id"], k + 1).select("grp", F.col("_x").alias("x"), "far", "id"))
    return top(asked.join(some, ["grp", "x"]).where("id <> own"), ["query_id"], ["far", "id"], k).select("query_id", "id", "rank")


def not_named(rows: DataFrame, question: str, expected: str) -> DataFrame:
    """Rows with the expected names that the question does not hold as whole words; rows left without any go."""
    plain = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))
    left = F.filter(expected, lambda n: ~F.contains(plain(F.col(question)), plain(n)))
    return rows.withColumn(expected, left).where(F.size(expected) > 0)


def sub_queries(raw: Column, anchor: Column, most: int = 4, longest: int = 200) -> Column:
    """Trimmed, not empty nor too long, each once whatever the case, the first ``most``.

    The anchor, the question itself, is added at the end if it is missing and there is room, and is put in
    front if there is none; alone it is the answer if nothing else is left.
    """
    bare = F.filter(F.transform(raw, lambda s: F.trim(s)), lambda s: (F.length(s) > 0) & (F.length(s) <= longest))
    once = F.filter(bare, lambda s, i: F.array_position(F.transform(bare, lambda x: F.lower(x)), F.lower(s)) == i + 1)
    some = F.slice(once, 1, most)
    there = F.exists(some, lambda s: F.lower(s) == F.lower(anchor))
    return (
        F.when(F.size(some) == 0, F.array(anchor))
        .when(there, some)
        .when(F.size(some) < most, F.concat(some, F.array(anchor)))
        .otherwise(F.slice(F.concat(F.array(anchor), some), 1, most))
    )


def sampled_corpus(passages: DataFrame, golds: DataFrame, size: int) -> DataFrame:
    """(id, index): all gold passages and, up to ``size`` in all, the others of the smallest hash, numbered anew by id.

    The result has at most max(size, golds) rows, which a caller chooses to be few.
    """
    marked = passages.select("id").join(golds.select("id", F.lit(0).alias("_g")).distinct(), "id", "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
    order = [F.col("_g"), F.md5(F.col("id").cast("string")), F.col("id")]
    n = golds.select("id").distinct().count()
    few = marked.orderBy(*order).limit(max(size, n))
    return numbered(few.select("id").orderBy("id"), "_no").select("id", F.col("_no").cast("int").alias("index"))


def edge_key(src: Column, dst: Column, rel: Column) -> Column:
    """One short key of an edge: 32 hex digits of sha256 over its parts, a unit separator between them."""
    return F.substring(F.sha2(F.concat_ws("\x1f", src, dst, rel), 256), 1, 32)
