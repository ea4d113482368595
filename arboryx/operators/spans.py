"""Spans of texts: halving, and offsets made valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arboryx.functions import text


def subdivided(texts: DataFrame, most: int = 100, depth: int = 20) -> DataFrame:
    """(..., depth, length, spans): how many spans of each length every level of halving has.

    ``texts`` has the length ``n`` beside other columns. A span of more than ``most`` characters is halved,
    its first half rounded down, at most ``depth`` times. Halves of one level differ by at most one
    character, so a level is two rows at most however long the text; all stays in one projection.
    """
    others = [c for c in texts.columns if c != "n"]
    level = F.lit(0)
    lengths = F.array(F.struct(F.col("n").alias("length"), F.lit(1).cast("long").alias("spans"), level.alias("depth")))
    out = []
    now = texts.select(*others, F.explode(lengths).alias("s")).select(*others, "s.*")
    for d in range(1, depth + 1):
        out.append(now)
        low = F.floor(F.col("length") / 2).cast("long")
        halves = F.when(
            F.col("length") > most,
            F.array(F.struct(low.alias("length"), "spans"), F.struct((F.col("length") - low).alias("length"), "spans")),
        )
        now = now.select(*others, F.explode(halves).alias("s")).select(*others, "s.length", "s.spans").groupBy(*others, "length").agg(F.sum("spans").alias("spans"))
        now = now.select(*others, "length", "spans", F.lit(d).alias("depth"))
    return reduce(lambda a, b: a.unionByName(b), [*out, now])


def within(start: Column, end: Column, length: Column) -> Column:
    """struct(start, end): a half-open span clamped into a text; the whole text where it is missing or empty."""
    inside = lambda x: F.greatest(F.lit(0), F.least(x, length))
    valid = start.isNotNull() & end.isNotNull() & (inside(start) < inside(end)) & (length > 0)
    return F.struct(F.when(valid, inside(start)).otherwise(0).alias("start"), F.when(valid, inside(end)).otherwise(F.greatest(length, F.lit(0))).alias("end"))


def evidenced(relations: DataFrame, sentences: DataFrame, types: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Relations that their sentence bears out, and the others with a ``reason``.

    ``relations`` is (sentence_id, subject, object, type, evidence, confidence), ``sentences`` (sentence_id, text). A relation
    needs a subject, an object, a known type, a confidence in 0 to 1 (held there), and evidence that stands in
    the sentence word for word once accents, cases and spaces are evened out. The first thing it lacks is the reason.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    told = relations.join(sentences.select("sentence_id", text.folded(F.col("text")).alias("_said")), "sentence_id", "left").withColumn("_evidence", text.folded(F.col("evidence")))
    reason = (
        F.when(blank("subject"), "no subject").when(blank("object"), "no object").when(~F.coalesce(F.col("type").isin(*types), F.lit(False)), "unknown type")
        .when(blank("evidence"), "no evidence").when(F.col("confidence").isNull() | F.isnan("confidence"), "no confidence")
        .when(~F.coalesce(F.contains("_said", "_evidence"), F.lit(False)), "not in the sentence")
    )
    told = told.withColumn("reason", reason).select(*relations.columns, "reason")
    good = told.where("reason is null").drop("reason").withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence").cast("double"))))
    return good, told.where("reason is not null")
