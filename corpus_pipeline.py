"""From raw documents to packed training sequences: five stages, each an operator of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arboryx.lineage import shared_folder
from arboryx.llm import jaccard, mixing, packing, quality, substring

#: No SQL: a trained classifier, Newton's iterations and a tokenizer are among the stages.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is probably of the best grade, neither toxic nor of low quality.

    Null texts are graded as empty ones, repeated rows alike; without any label all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, quality.label_grades(labels), 3)
    return quality.keep_selected(docs, model, least_grade=2)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (a Jaccard similarity of 0.8 or more between five-word shingles).

    Found by SimHash fingerprints of 256 bits of those shingles, by blocks and a Hamming distance, and then verified.
    The one of the smallest id stays, and of rows that share it the one with the smallest hash of the
    text; of rows with equal id and text one stays. Rows without an id stay. Null and empty texts are
    copies of each other. An empty table gives no row.
    """
    return jaccard.drop_near_duplicates(docs, width=5, least=0.8)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words or more that an earlier place also has.

    Rows stay, all of them: a text of which nothing is removed as it is, one of which all is removed
    empty, a null one null. Rows without an id are not compared.
    """
    return substring.strip_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, repeated or left out so that sources come near their share of words.

    Null sources are one source; texts without words are taken once; each repeated row counts.
    """
    return mixing.apply_mix(docs, mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of up to 4096 tokens; a null or empty text is its end token."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("near_copies", one_of_near_copies),
    ("repeats", without_repeats),
    ("mixing", mixed_sources),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; what a stage returns is stored in the shared folder.

    The stored tables stay there: the result is read from the last of them, and a run that was lost can
    be looked into. An empty table passes through as one.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
