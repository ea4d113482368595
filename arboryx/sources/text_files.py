"""Line-based sources with a side output of what they reject, and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value"), F.split("value", "\t").alias("f"))


def _id(c: Column, letter: str) -> Column:
    return c.rlike(f"^{letter}[0-9]+$")


def _told(lines: DataFrame, reasons: list[tuple[Column, str]]) -> DataFrame:
    reason = F.lit(None).cast("string")
    for wrong, name in reversed(reasons):
        reason = F.when(wrong, F.lit(name)).otherwise(reason)
    return lines.withColumn("reason", reason)


def entities(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(qid, aliases) of lines ``Q1<TAB>alias<TAB>...``, and (value, reason) of the others."""
    aliases = F.filter(F.slice("f", 2, 1_000_000), lambda a: F.trim(a) != "")
    told = _told(_lines(spark, path).withColumn("aliases", aliases), [(F.trim("value") == "", "blank"), (~_id(F.col("f")[0], "Q"), "bad id"), (F.size("aliases") == 0, "no alias")])
    return told.where("reason is null").select(F.col("f")[0].alias("qid"), "aliases"), told.where("reason is not null").select("value", "reason")


def texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(qid, text) of lines ``Q1<TAB>text``, the text being all after the first tab; and the rejects."""
    parts = spark.read.text(path).select("value", F.split("value", "\t", 2).alias("f"))
    told = _told(parts, [(F.trim("value") == "", "blank"), (~_id(F.col("f")[0], "Q"), "bad id"), ((F.size("f") < 2) | (F.trim(F.try_element_at("f", F.lit(2))) == ""), "no text")])
    return told.where("reason is null").select(F.col("f")[0].alias("qid"), F.col("f")[1].alias("text")), told.where("reason is not null").select("value", "reason")


def relations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pid, aliases) of lines ``P1<TAB>alias<TAB>...``, and (value, reason) of the others."""
    aliases = F.filter(F.transform(F.slice("f", 2, 1_000_000), lambda a: F.trim(a)), lambda a: a != "")
    told = _told(_lines(spark, path).withColumn("aliases", aliases), [(F.trim("value") == "", "blank"), (~F.trim(F.col("f")[0]).startswith("P"), "bad id"), (F.size("aliases") == 0, "no alias")])
    return told.where("reason is null").select(F.trim(F.col("f")[0]).alias("pid"), "aliases"), told.where("reason is not null").select("value", "reason")


def triples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(subject, predicate, object) of lines of exactly three fields with their letters, and the rejects."""
    at = lambda i: F.try_element_at("f", F.lit(i))
    told = _told(_lines(spark, path), [(F.trim("value") == "", "blank"), (F.size("f") != 3, "not three fields"), (~(_id(at(1), "Q") & _id(at(2), "P") & _id(at(3), "Q")), "bad id")])
    return told.where("reason is null").select(at(1).alias("subject"), at(2).alias("predicate"), at(3).alias("object")), told.where("reason is not null").select("value", "reason")


def selection(spark: SparkSession, path: str) -> DataFrame:
    """Ids in the first column of a list; lines that begin with # are comments."""
    return _lines(spark, path).where(~F.col("value").startswith("#") & _id(F.col("f")[0], "Q")).select(F.col("f")[0].alias("qid"))


def within(triples_df: DataFrame, ids: DataFrame) -> DataFrame:
    """Triples with subject and object among ``ids`` (qid)."""
    one = ids.select("qid").distinct()
    return triples_df.join(one.withColumnRenamed("qid", "subject"), "subject", "left_semi").join(one.withColumnRenamed("qid", "object"), "object", "left_semi")


def delta_log(spark: SparkSession, path: str) -> DataFrame:
    """Edge deltas of a JSON-lines log; torn lines are skipped."""
    return spark.read.schema("src string, dst string, rel string, delta double").option("mode", "DROPMALFORMED").json(path)


def write_dump(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as gzipped JSON lines, one kind per line."""
    rows = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("body")).union(
        edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("body"))
    )
    rows.write.option("compression", "gzip").json(path)


def read_dump(spark: SparkSession, path: str, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a dump; an unknown kind is an error."""
    rows = spark.read.schema("kind string, body string").json(path)
    known = rows.withColumn("kind", F.when(F.col("kind").isin("node", "edge"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), "kind"))))
    of = lambda kind, schema: known.where(F.col("kind") == kind).select(F.from_json("body", schema).alias("b")).select("b.*")
    return of("node", node_schema), of("edge", edge_schema)
