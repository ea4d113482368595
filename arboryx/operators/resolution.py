"""Which known entity a mention means: mentions grouped by form, candidates filtered by type, tiers by alias evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arboryx.functions import text
from arboryx.lineage import cut, small

#: Confidence of a node minted at each tier.
CONFIDENCE = {4: 0.9, 3: 0.75, 2: 0.65, 1: 0.55, 0: 0.5}


def mention_groups(mentions: DataFrame) -> DataFrame:
    """(form, ner, text, mentions) of mentions (mention_id, text, ner): equal normal forms of one label are one group.

    ``text`` is the group's commonest spelling, of equally common ones that of the smallest id. Spellings
    are counted before groups are formed, so a very common name is not gathered. Null texts are left out.
    """
    spelt = mentions.where("text IS NOT NULL").groupBy(text.label_form(F.col("text")).alias("form"), "ner", "text")
    counted = spelt.agg(F.count("*").alias("n"), F.min("mention_id").alias("first"))
    return counted.groupBy("form", "ner").agg(F.max_by("text", F.struct("n", -F.col("first"))).alias("text"), F.sum("n").alias("mentions"))


def cascade(groups: DataFrame, candidates: DataFrame, aliases: DataFrame, types: DataFrame, accepted: DataFrame, languages: Sequence[str]) -> DataFrame:
    """A row per group: (form, ner, mentions, tier, entity, label, confidence, reason).

    ``candidates`` (form, language, entity) are the hits of a search, ``aliases`` (entity, language, alias,
    ordinal) the names, ``types`` (entity, type) what an entity is, and ``accepted`` (ner, type) what a label may be;
    a null type there accepts all, and a label that is not there is never looked up. Tier 4 is the only survivor of the
    type filter, spelt alike in two languages or more; tier 3 the one that most languages name but for case, then the one
    found in most languages, then the last by id, if two languages or more name it. All else is tier 0 and says why.
    ``label`` is an entity's first alias in the first of ``languages`` that has one, for tier 0 the group's spelling.
    """
    keys = ["form", "ner"]
    # stored, so that what follows doesn't make them again for each of its joins, in one plan of all copies
    groups, accepted = cut(groups), cut(accepted)
    known = accepted.select("ner").distinct().withColumn("_known", F.lit(True))
    known = small(cut(known))
    looked = small(cut(groups.join(known.drop("_known"), "ner", "left_semi")))
    hits = cut(looked.join(candidates, "form").groupBy(*keys, "entity").agg(F.first("text").alias("text"), F.count_distinct("language").alias("found_in")))
    fitting = types.join(small(accepted.where("type IS NOT NULL")), "type").select("entity", "ner").distinct()
    free = small(cut(accepted.where("type IS NULL").select("ner").distinct()))
    survivors = hits.join(free, "ner", "left_semi").unionByName(hits.join(free, "ner", "left_anti").join(fitting, ["entity", "ner"], "left_semi"))
    strength = survivors.join(aliases, "entity", "left").groupBy(*keys, "entity", "found_in", "language").agg(F.max(text.match_strength(F.col("alias"), F.col("text"))).alias("strength"))
    evidence = strength.groupBy(*keys, "entity", "found_in").agg(F.count_if(F.col("strength") == 4).alias("exact"), F.count_if(F.col("strength") >= 3).alias("cased"))
    best = cut(
        evidence.groupBy(*keys).agg(
            F.count("*").alias("left_over"), F.max("exact").alias("exact"), F.max_by(F.struct("entity", "cased"), F.struct("cased", "found_in", "entity")).alias("best")
        )
    )
    tier = F.when((F.col("left_over") == 1) & (F.col("exact") >= 2), 4).when(F.col("best.cased") >= 2, 3).otherwise(0)
    reason = (
        F.when(F.col("_known").isNull(), "label is not looked up")
        .when(F.col("_hit").isNull(), "no candidate")
        .when(F.col("left_over").isNull(), "no candidate of an accepted type")
        .when(F.col("tier") == 0, "names agree too little")
    )
    told = groups.join(known, "ner", "left").join(hits.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left").join(best, keys, "left").withColumn("tier", tier)
    order = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("language"))
    chosen = small(cut(best.select("best.entity").distinct()))
    names = aliases.where(order > 0).join(chosen, "entity", "left_semi").groupBy("entity").agg(F.min_by("alias", F.struct(order, "ordinal")).alias("name"))
    minted = told.withColumn("entity", F.when(F.col("tier") > 0, F.col("best.entity"))).withColumn("reason", reason).join(names, "entity", "left")
    confidence = F.element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair]), F.col("tier"))
    return minted.select(*keys, "mentions", "tier", "entity", F.coalesce("name", "text").alias("label"), confidence.alias("confidence"), "reason")


def concept_tags(label, tags, entity_type):
    """The trimmed label, the other tags once each, the entity type; ``concept`` where all are missing."""
    given = F.filter(F.concat(F.array(F.trim(label)), F.coalesce(tags, F.array().cast("array<string>")), F.array(entity_type)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(given) == 0, F.array(F.lit("concept"))).otherwise(F.array_distinct(given))
