"""From read texts to a graph: the edges of every paragraph, and descriptions that grow with each mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arboryx.functions import text as forms
from arboryx.lineage import cut

from . import identity

#: What each edge of a read text is called, its kind and its weight.
EXTRACTED, SECTION, MENTIONS, APPEARS = ("extracted_from", "extraction", 1.0), ("is_section_of", "hierarchy", 0.9), ("mentions", "co_occurrence", 0.95), ("appears_in_source", "attribution", 0.45)
CO_MENTIONS, HAS_CONCEPT, SUMMARISED, ABSTRACTS = ("co_mentions_in_paragraph", "co_occurrence", 0.35), ("has_paragraph_concept", "hierarchy", 0.8), ("summarised_as", "hierarchy", 0.7), ("abstracts_over", "hierarchy", 0.85)
SHARES, DEVELOPS = ("shares_entities_with", "co_occurrence"), ("develops_across_paragraphs", "semantic")
RELATION_WEIGHT, SHARE_BASE, SHARE_STEP, SHARE_MOST, DEVELOPS_MOST = 1.0, 0.25, 0.10, 0.70, 0.55
DESCRIPTION_CHARS = 500


def text_anchor(text: Column) -> Column:
    return F.concat(F.lit("text:"), text.cast("string"))


def paragraph_anchor(text: Column, no: Column) -> Column:
    return F.concat(text_anchor(text), F.lit("#p"), no.cast("string"))


def chunk(text: Column, no: Column) -> Column:
    return F.concat(F.lit("chunk:"), text.cast("string"), F.lit("#p"), no.cast("string"))


def topology(units: DataFrame, mentions: DataFrame, relations: DataFrame, concepts: DataFrame, most_partners: int = 12) -> tuple[DataFrame, DataFrame]:
    """(src, dst, kind, descriptor, weight), and (text, no, dropped): edges of all read paragraphs, and what could not be resolved.

    ``units`` is (text, no) of the paragraphs; ``mentions`` (text, no, ord, label, node) their entities as they
    were linked; ``relations`` (text, no, source, target, kind, descriptor) by label; ``concepts`` (text, no, node,
    basis array of labels), one a paragraph at most.

    A paragraph's chunk is extracted from its anchor, which is a section of the text's anchor. Every mention is an
    edge of the chunk, and the first of a node in a text ties the node to the text. A label means the node that
    its last mention in the paragraph was linked to; relations and bases whose labels it does not mention are
    dropped and counted. Nodes of a paragraph are tied to each other both ways. Paragraphs of a text that share
    nodes are tied as far as either is among the ``most_partners`` closest of the other, the stronger the more they
    share, and the earlier one's concept to the later one's, if they differ.
    """
    place = ["text", "no"]
    t, n = F.col("text"), F.col("no")

    def edges(df: DataFrame, src: Column, dst: Column, of: tuple[str, str, float]) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(of[1]).alias("kind"), F.lit(of[0]).alias("descriptor"), F.lit(of[2]).alias("weight"))

    said = mentions.join(units.select(*place).distinct(), place, "left_semi")
    out = [edges(units, chunk(t, n), paragraph_anchor(t, n), EXTRACTED), edges(units, paragraph_anchor(t, n), text_anchor(t), SECTION)]
    out += [edges(said, chunk(t, n), F.col("node"), MENTIONS), edges(said.select("text", "node").distinct(), F.col("node"), text_anchor(t), APPEARS)]
    labels = said.groupBy(*place, "label").agg(F.max_by("node", "ord").alias("node"))

    ends = lambda name: labels.select(*place, F.col("label").alias(name), F.col("node").alias(f"_{name}"))
    related = relations.join(ends("source"), [*place, "source"], "left").join(ends("target"), [*place, "target"], "left")
    whole = F.col("_source").isNotNull() & F.col("_target").isNotNull()
    out.append(related.where(whole).select(F.col("_source").alias("src"), F.col("_target").alias("dst"), "kind", "descriptor", F.lit(RELATION_WEIGHT).alias("weight")))

    inside = said.select(*place, "node").distinct()
    a, b = inside.alias("a"), inside.alias("b")  # a paragraph's own nodes, whose number is that of its mentions
    out.append(edges(a.join(b, place).where("a.node <> b.node"), F.col("a.node"), F.col("b.node"), CO_MENTIONS))

    made = concepts.join(units.select(*place).distinct(), place, "left_semi")
    out += [edges(made, paragraph_anchor(t, n), F.col("node"), HAS_CONCEPT), edges(made, chunk(t, n), F.col("node"), SUMMARISED)]
    based = made.select(*place, F.col("node").alias("concept"), F.explode("basis").alias("label")).join(labels, [*place, "label"], "left")
    out.append(edges(based.where("node is not null"), F.col("concept"), F.col("node"), ABSTRACTS))

    members = inside.select(F.struct(*place).alias("unit"), F.struct("text", "node").alias("item"))
    pairs = identity.shared_pairs(members, "unit", "item", most_partners).withColumn("w", F.least(F.lit(SHARE_BASE) + F.lit(SHARE_STEP) * F.col("shared"), F.lit(SHARE_MOST)))
    pairs = cut(pairs)
    both = pairs.select("l", "r", "w").unionByName(pairs.select(F.col("r").alias("l"), F.col("l").alias("r"), "w"))
    anchor = lambda c: paragraph_anchor(F.col(f"{c}.text"), F.col(f"{c}.no"))
    out.append(both.select(anchor("l").alias("src"), anchor("r").alias("dst"), F.lit(SHARES[1]).alias("kind"), F.lit(SHARES[0]).alias("descriptor"), F.col("w").alias("weight")))
    of = lambda side: made.select(F.struct(*place).alias(side), F.col("node").alias(f"_{side}"))
    grown = pairs.join(of("l"), "l").join(of("r"), "r").where("_l <> _r")
    out.append(grown.select(F.col("_l").alias("src"), F.col("_r").alias("dst"), F.lit(DEVELOPS[1]).alias("kind"), F.lit(DEVELOPS[0]).alias("descriptor"), F.least("w", F.lit(DEVELOPS_MOST)).alias("weight")))

    all_edges = out[0]
    for df in out[1:]:
        all_edges = all_edges.unionByName(df)
    lost = related.where(~whole).select(*place).unionByName(based.where("node is null").select(*place))
    return all_edges, lost.groupBy(*place).agg(F.count("*").alias("dropped"))


def first_references(mentions: DataFrame) -> DataFrame:
    """(text, no, node_ids): per paragraph the nodes that were there before it, which it fires; paragraphs that fire none are left out.

    ``mentions`` is (text, no, node, known); ``known`` nodes existed before the read. Paragraphs of a text are read
    in their order; the first one that mentions a new node makes it.
    """
    once = mentions.groupBy("text", "no", "node").agg(F.max("known").alias("known"))
    first = F.min("no").over(Window.partitionBy("text", "node"))
    return once.withColumn("_first", first).where(F.col("known") | (F.col("no") > F.col("_first"))).groupBy("text", "no").agg(F.array_sort(F.collect_set("node")).alias("node_ids"))


def comparable(x: Column) -> Column:
    """Lower case, spaces squeezed, without quotes around it and marks at its end."""
    low = F.trim(F.regexp_replace(F.lower(x), "\\s+", " "))
    bare = F.regexp_replace(low, "^[\"“”‘’']+|[\"“”‘’']+$", "")
    return F.regexp_replace(F.regexp_replace(bare, "[.!?…]+$", ""), "^[\"“”‘’' ]+|[\"“”‘’' ]+$", "")


def _says(haystack: Column, needle: Column) -> Column:
    """Whether ``needle`` stands in ``haystack`` as whole words."""
    quoted = F.concat(F.lit("(?<![\\w])\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![\\w])"))
    return F.regexp_like(haystack, F.concat(F.lit("(?U)"), quoted))


def grown(standing: Column, sentences: Column, most: int = DESCRIPTION_CHARS) -> Column:
    """``standing`` with the ``sentences`` that it does not say yet, in order, until one would make it longer than ``most``.

    What stands stays as it is at the front. A sentence is joined by a space, after a full stop if none of
    .!?…,;: ends the text (closing quotes and brackets aside).
    """
    begin = F.struct(F.coalesce(F.trim(standing), F.lit("")).alias("text"), F.lit(False).alias("full"))

    def step(now: Column, sentence: Column) -> Column:
        key, said = comparable(sentence), now["text"]
        ends = F.regexp_like(said, F.lit("[.!?…,;:][\"”’')\\]]*$"))
        longer = F.when(said == "", sentence).otherwise(F.concat(said, F.when(ends, " ").otherwise(". "), sentence))
        skip = now["full"] | (key == "") | _says(comparable(said), key)
        fits = F.length(longer) <= most
        return F.struct(F.when(~skip & fits, longer).otherwise(said).alias("text"), (now["full"] | (~skip & ~fits)).alias("full"))

    return F.aggregate(sentences, begin, step)["text"]


def accrued(nodes: DataFrame, mentions: DataFrame, most: int = DESCRIPTION_CHARS, at_once: int = 64) -> DataFrame:
    """(id, description, revisions, sources): ``nodes`` (id, description) after all ``mentions`` (id, ord, source, body) in their order.

    Each body adds its new sentences and stops at the first that does not fit. Equal bodies of a node count
    once, the first. What adds nothing to a text adds nothing to any longer one, so mentions are dropped as soon
    as they say nothing new: a round takes the first ``at_once`` of each node (limited before the shuffle), folds
    them in order, and holds the others against the result. Rounds end when none is left; a node that may be
    mentioned by a third of all rows never has more than ``at_once`` bodies in one place. Null bodies say nothing;
    mentions of unknown nodes are left out. ``revisions`` counts the mentions that added something, ``sources`` are theirs, in order.
    """
    text = F.coalesce(F.trim("description"), F.lit(""))
    now = cut(nodes.select("id", text.alias("description"), F.lit(0).cast("long").alias("revisions"), F.array().cast("array<struct<ord:bigint,source:string>>").alias("sources")))
    firsts = mentions.where("body is not null").groupBy("id", "body").agg(F.min(F.struct(F.col("ord").cast("long").alias("ord"), F.col("source").cast("string").alias("source"))).alias("first"))
    rest = firsts.select("id", "body", "first.ord", "first.source")
    fold = lambda said, body: grown(said, F.transform(forms.sentences(body), lambda s: F.trim(F.regexp_replace(s, "\\s+", " "))), most)

    def step(state: Column, m: Column) -> Column:
        longer = fold(state["description"], m["body"])
        new = longer != state["description"]
        return F.struct(
            longer.alias("description"),
            (state["revisions"] + new.cast("long")).alias("revisions"),
            F.when(new, F.array_append(state["sources"], F.struct(m["ord"].alias("ord"), m["source"].alias("source")))).otherwise(state["sources"]).alias("sources"),
        )

    while True:
        standing = now.select("id", "description")
        # a body that adds nothing now never will
        rest = rest.join(standing, "id").where(fold(F.col("description"), F.col("body")) != F.col("description")).drop("description")
        ranked = cut(rest.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("ord", "body"))))
        if ranked.isEmpty():
            return now.select("id", "description", "revisions", F.transform("sources", lambda s: s["source"]).alias("sources"))
        taken = ranked.where(F.col("_r") <= at_once).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ord", "body", "source"))).alias("bodies"))
        state = F.struct("description", "revisions", "sources")
        after = now.join(taken, "id", "left").withColumn("state", F.aggregate(F.coalesce("bodies", F.array().cast(taken.schema["bodies"].dataType)), state, step))
        now = cut(after.select("id", "state.*"))
        rest = ranked.where(F.col("_r") > at_once).drop("_r")
