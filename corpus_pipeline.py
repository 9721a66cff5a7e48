"""From raw documents to token sequences of a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes what a stage returns and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from snaptext.llm import bpe, mixing, pii, quality, queries, shingles
from snaptext.scale import stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; trusted are those labelled good."""
    return quality.keep_good(docs, queries.trusted(spark, sf_dir))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard 0.8 on five-word shingles), that of the smallest id."""
    return shingles.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; ``n_chars`` follows where one is cut."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every row and of their decoded text."""
    return bpe.digests(docs, queries.vocabulary())


STAGES = [
    ("quality rules", keep_good),
    ("simhash near-dedup", one_of_each),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: Fingerprints, the classifier and the tokenizer can't be written in SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
