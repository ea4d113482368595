"""Bulk seeds: entities, their texts and triples as nodes and edges of a graph that has some already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arboryx.lineage import cut


def seed(entities: DataFrame, texts: DataFrame, triples: DataFrame, relations: DataFrame, known: DataFrame, most_chars: int = 2048, most_tags: int = 50) -> dict[str, DataFrame]:
    """``nodes``, ``edges``, ``audit`` and ``counters`` of a run.

    ``entities`` is (qid, aliases), ``texts`` (qid, text), ``triples`` (subject, predicate, object), ``relations`` (pid, aliases),
    ``known`` (qid) what the graph has. An entity needs a text; of rows of one qid the one with the smallest aliases counts, and
    what is known is skipped. A node is (id, qid, name, tags, text): the first alias (else the qid), ``most_tags`` aliases, the text
    cut at ``most_chars`` for embedding. Edges (src, dst, pid, rel) join ends that are known or new, each triple once, named by
    their relation's first alias (else the pid). ``audit`` has a row (action, qid) per node.
    ``counters`` (name, n) say how many rows of each kind were read, skipped, cut and written.
    """
    one_text = texts.groupBy("qid").agg(F.min("text").alias("text"))
    told = entities.join(one_text, "qid", "left").join(known.select("qid", F.lit(True).alias("_known")).distinct(), "qid", "left")
    told = cut(told)
    fresh = told.where("text is not null and _known is null").groupBy("qid").agg(F.count("*").alias("_n"), F.min(F.struct("aliases", "text")).alias("f"))
    fresh = cut(fresh.select("qid", "_n", "f.aliases", "f.text"))
    name = F.coalesce(F.get("aliases", F.lit(0)), F.col("qid"))
    nodes = fresh.select(node_id(F.col("qid")).alias("id"), "qid", name.alias("name"), F.slice("aliases", 1, most_tags).alias("tags"), F.substring("text", 1, most_chars).alias("text"))

    ids = fresh.select("qid").unionByName(known.select("qid")).distinct()
    ends = lambda side: ids.select(F.col("qid").alias(side), F.lit(True).alias(f"_{side}"))
    labels = relations.groupBy(F.col("pid").alias("predicate")).agg(F.min("aliases").alias("_a")).select("predicate", F.get("_a", F.lit(0)).alias("_label"))
    linked = cut(triples.groupBy("subject", "predicate", "object").agg(F.count("*").alias("_n")).join(ends("subject"), "subject", "left").join(ends("object"), "object", "left"))
    whole = F.col("_subject").isNotNull() & F.col("_object").isNotNull()
    edges = linked.where(whole).join(labels, "predicate", "left").select(node_id(F.col("subject")).alias("src"), node_id(F.col("object")).alias("dst"), F.col("predicate").alias("pid"), F.coalesce("_label", "predicate").alias("rel"))

    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    of = lambda df, **counts: df.agg(F.array(*[F.struct(F.lit(k).alias("name"), zero(v).alias("n")) for k, v in counts.items()]).alias("a")).select(F.inline("a"))
    counters = of(told, entities_read=F.count("*"), entities_without_text=F.count_if(F.col("text").isNull()), entities_known=F.count_if(F.col("text").isNotNull() & F.col("_known")))
    counters = counters.unionByName(of(fresh, entities_written=F.count("*"), entities_repeated=F.sum(F.col("_n") - 1), texts_cut=F.count_if(F.length("text") > most_chars)))
    counters = counters.unionByName(of(linked, triples_read=F.sum("_n"), triples_repeated=F.sum(F.when(whole, F.col("_n") - 1)), triples_without_ends=F.sum(F.when(~whole, F.col("_n"))), edges_written=F.count_if(whole)))
    return {"nodes": nodes, "edges": edges, "audit": nodes.select(F.lit("seed_node_created").alias("action"), "qid"), "counters": counters}


def node_id(qid: Column) -> Column:
    return F.concat(F.lit("NODE-"), F.substring(F.sha2(F.concat(F.lit("seed:"), qid), 256), 1, 12))


def _between(low: int, x: Column, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def density_targets(n_chars: Column) -> Column:
    """(least, stretch, links) for a text that is to be read densely; fixed values."""
    n = F.greatest(F.lit(0), n_chars)
    least = _between(40, F.floor(n * 38 / 1000), 260)
    return F.struct(least.alias("least"), F.greatest(least, F.least(F.lit(320), F.floor(n * 48 / 1000))).alias("stretch"), F.least(F.lit(2500), F.greatest(F.lit(400), least * 7)).alias("links"))


def macro_targets(n_chars: Column) -> Column:
    """(least, most, least_links, most_links) for the first pass of a reading in levels; fixed values."""
    n = F.greatest(F.lit(0), n_chars)
    low = _between(10, 10 + F.floor(n / 3000), 24)
    high = F.greatest(low + 4, F.least(F.lit(34), 16 + F.floor(n / 900)))
    links = _between(72, F.floor(n / 35), 520)
    return F.struct(low.alias("least"), high.alias("most"), links.alias("least_links"), F.least(F.lit(800), F.greatest(links + 80, high * 20)).alias("most_links"))


def slice_targets(n_chars: Column) -> Column:
    """(least, most, least_links, most_links) for one slice of a subdivision; fixed values."""
    n = F.greatest(F.lit(1), n_chars)
    low = _between(6, 5 + F.floor(n / 1400), 18)
    high = F.greatest(low + 2, F.least(F.lit(24), 8 + F.floor(n / 600)))
    most = F.least(F.lit(420), F.greatest(F.lit(72), high * 12))
    links = F.greatest(F.lit(28), F.least(F.lit(180), low * 4, F.floor(n / 180)))
    return F.struct(low.alias("least"), high.alias("most"), F.when(links > most, F.greatest(F.lit(24), F.floor(most / 2))).otherwise(links).alias("least_links"), most.alias("most_links"))
