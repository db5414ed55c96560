"""A training corpus from raw documents: language, near duplicates, personal data, mixture, packing.

Every stage works on all that its predecessor kept and returns a DataFrame; all
but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import common, langid, mixing, packing, pii, simhash
from quadrille.shipping import ship


def _measured(df: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set lang to the predicted language; documents without any letter go."""
    ship(spark)
    return langid.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id."""
    ship(spark)
    return simhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; every document stays."""
    ship(spark)
    return _measured(pii.masked(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become what the mixture takes of them."""
    ship(spark)
    return _measured(mixing.mixed(docs))


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with length bucket, batch and slot."""
    ship(spark)
    return packing.packed(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", batches)]

#: The random field, the shingle similarity and the fitted language model have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
