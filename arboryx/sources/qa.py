"""Question sets with gold passages, as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "idx long, title string, text string"
#: The answer stands under one of two names, other accepted forms under three; golds come in two layouts.
QUESTIONS = (
    "id string, question string, answer string, obj string, type string, possible_answers array<string>, o_aliases array<string>, answer_aliases array<string>,"
    " supporting_facts array<array<string>>, paragraphs array<struct<title: string, is_supporting: boolean>>"
)


def read(spark: SparkSession, corpus: str, questions: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Passages and questions of JSON lines, or of files that are one array each with ``multi_line``."""
    load = lambda schema, path: spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return load(CORPUS, corpus), load(QUESTIONS, questions)


def _title(x):
    return F.lower(F.trim(x))


def _gold_titles(questions: DataFrame) -> DataFrame:
    facts = F.transform(F.filter(F.coalesce("supporting_facts", F.array().cast("array<array<string>>")), lambda f: F.size(f) > 0), lambda f: _title(f[0]))
    told = F.transform(F.filter(F.coalesce("paragraphs", F.array().cast("array<struct<title:string,is_supporting:boolean>>")), lambda p: p["is_supporting"]), lambda p: _title(p["title"]))
    return questions.select("id", F.explode(F.array_distinct(F.concat(facts, told))).alias("title"))


def questions(corpus: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, question, answer, aliases, golds, type): golds are the passages of the gold titles, of equal titles the first.

    Titles are compared trimmed and in lower case. Questions without a gold passage or without an answer are left out; an
    answer that is only among the other forms is the first of them.
    """
    first = corpus.groupBy(_title(F.col("title")).alias("title")).agg(F.min("idx").alias("idx"))
    golds = _gold_titles(asked).join(first, "title").groupBy("id").agg(F.sort_array(F.collect_set("idx")).alias("golds"))
    none = F.array().cast("array<string>")
    forms = F.filter(F.concat(*[F.coalesce(c, none) for c in ("possible_answers", "o_aliases", "answer_aliases")]), lambda x: x != "")
    answer = F.coalesce(F.when(F.col("answer") != "", F.col("answer")), F.when(F.col("obj") != "", F.col("obj")), F.try_element_at(forms, F.lit(1)))
    told = asked.join(golds, "id").withColumns({"_answer": answer, "_forms": forms}).where("_answer IS NOT NULL")
    return told.select(F.col("id").alias("qid"), "question", F.col("_answer").alias("answer"), F.filter("_forms", lambda x: x != F.col("_answer")).alias("aliases"), "golds", "type")


def gold_coverage(corpus: DataFrame, asked: DataFrame) -> DataFrame:
    """(gold_coverage): the share of gold titles that the corpus has; 0 without any."""
    titles, known = _gold_titles(asked), corpus.select(_title(F.col("title")).alias("title"), F.lit(1).alias("_known")).distinct()
    return titles.join(known, "title", "left").agg((F.count("_known") / F.greatest(F.count("*"), F.lit(1))).alias("gold_coverage"))
