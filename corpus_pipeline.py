"""A corpus pipeline over ``documents``: quality filter, near duplicates out,
personal data replaced, sources mixed to their weights, packed into sequences.

Every stage takes all rows that the one before it left, as a Parquet table with
the columns of ``documents``; the last one returns the packed pieces (columns
of ``packing.digest``). A null or empty table runs through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm import jaccard_join, mixing, ordinal_quality, packing, pii
from opslens.llm.common import table
from opslens.llm.warc import scratch_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for the best grade; the others go."""
    return ordinal_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked by shingles."""
    return jaccard_join.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities in the texts replaced by surrogates; ``n_chars`` follows."""
    out, count = pii.replace(docs)
    return out.withColumn("n_chars", F.when(F.col(count) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources meet their weights."""
    return mixing.mix_sources(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return packing.digest(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("ngram_jaccard_join", without_near_copies),
    ("pii_surrogates", without_personal_data),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

#: The classifier's fit is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
