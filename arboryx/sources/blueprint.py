"""Nested blueprints of extracted graphs: concepts with local ids and links between them, one JSON object a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONCEPT = "place string, local_id string, canonical_text string, granularity string, abstraction double, is_implicit boolean, char_start int, char_end int, keywords array<string>"
LINK = "source string, target string, relation_type string, weight double"
SCHEMA = f"source_id string, concepts array<struct<{', '.join(f'{x.split()[0]}: {x.split()[1]}' for x in CONCEPT.split(', '))}>>, synapses array<struct<{', '.join(f'{x.split()[0]}: {x.split()[1]}' for x in LINK.split(', '))}>>, _torn string"


def global_id(run: Column, source: Column, local: Column, place: Column) -> Column:
    """The same for the same run, source and concept, so that a batch that is read again makes the same nodes."""
    return F.concat(F.lit("NODE-"), F.substring(F.sha2(F.concat_ws("\x1f", run, source, local, place), 256), 1, 12))


def read(spark: SparkSession, path: str, run_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, source_id, local_id, label, anchor, ...), edges (src, dst, rel, weight, source_id), and rejects.

    Local ids count inside their line; a line's links are resolved in the line itself, without a join. Of concepts that share a
    local id each is a node, and links mean the last. ``anchor`` is a hash of the text, lower case and
    with single spaces. Links to ids that the line does not have are rejected as "dangling", lines that are no such
    object as "torn": rejects are (source_id, source, target, relation_type, weight, reason).
    """
    rows = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").json(path)
    rows = rows.withColumn("_bad", F.col("_torn").isNotNull() | F.col("source_id").isNull())
    good = rows.where("not _bad").select("source_id", F.coalesce("concepts", F.array().cast(rows.schema["concepts"].dataType)).alias("concepts"), F.coalesce("synapses", F.array().cast(rows.schema["synapses"].dataType)).alias("synapses"))
    named = good.withColumn("ids", F.transform("concepts", lambda c: global_id(F.lit(run_id), F.col("source_id"), c["local_id"], c["place"])))
    each = named.select("source_id", F.explode(F.arrays_zip("concepts", "ids")).alias("x")).select(F.col("x.ids").alias("id"), "source_id", "x.concepts.*")
    squeezed = F.array_join(F.filter(F.split(F.lower("canonical_text"), "\\s+"), lambda w: w != ""), " ")
    nodes = each.select("id", "source_id", "local_id", F.col("canonical_text").alias("label"), F.sha2(squeezed, 256).alias("anchor"), "granularity", "abstraction", "is_implicit", "char_start", "char_end", "keywords")

    def of(local: Column) -> Column:
        """The last concept's id of a local id; null if there is none."""
        places = F.transform("concepts", lambda c, i: F.when(c["local_id"] == local, i))
        return F.get(F.col("ids"), F.array_max(places))

    linked = named.select("source_id", F.explode(F.transform("synapses", lambda s: F.struct(s.alias("link"), of(s["source"]).alias("src"), of(s["target"]).alias("dst")))).alias("x")).select("source_id", "x.link.*", "x.src", "x.dst")
    whole = F.col("src").isNotNull() & F.col("dst").isNotNull()
    edges = linked.where(whole).select("src", "dst", F.col("relation_type").alias("rel"), "weight", "source_id")
    dangling = linked.where(~whole).select("source_id", "source", "target", "relation_type", "weight", F.lit("dangling").alias("reason"))
    torn = rows.where("_bad").select("source_id", *[F.lit(None).cast(k).alias(c) for c, k in (("source", "string"), ("target", "string"), ("relation_type", "string"), ("weight", "double"))], F.lit("torn").alias("reason"))
    return nodes, edges, dangling.unionByName(torn)
