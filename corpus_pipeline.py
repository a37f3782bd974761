"""Corpus pipeline: quality rules, near-duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept;
``run`` writes every stage's rows as Parquet in the shared folder and rereads them. The
first three stages return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import packing, pii, quality, simhash
from sheaf.llm.common import ship, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy of the rule ledger rejects go."""
    ship(spark)
    return quality.apply_policy(docs, quality.POLICIES[quality.PRODUCTION])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that with the smallest id."""
    ship(spark)
    return simhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind; no document goes. ``n_chars`` stays what the
    source table says."""
    ship(spark)
    accepted = pii.fit(stored(pii.candidates(docs)))["accepted"]
    return pii.redact(docs, accepted)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every document left, with its sequence and place."""
    ship(spark)
    return packing.op9(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizer ids are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
