"""The corpus pipeline: each stage reads the documents its predecessor kept and writes the next one's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wardgrid.llm.common import table
from wardgrid.llm.decontaminate import decontaminate
from wardgrid.llm.mixing import mix
from wardgrid.llm.neardup import deduplicate
from wardgrid.llm.pii import pseudonymise
from wardgrid.llm.quality import good
from wardgrid.session import shared_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier keeps."""
    return good(docs, table(spark, sf_dir, "labels"))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by shingles of five words."""
    return deduplicate(docs)


def no_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by pseudonyms."""
    return pseudonymise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their places in the mixture of sources."""
    return mix(docs)


STAGES = [("quality classifier", good_quality), ("near-duplicates", no_near_duplicates),
          ("benchmark decontamination", no_contamination), ("personal data", no_personal_data), ("source mixing", mixed)]

#: A trained classifier decides which rows stay, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline_{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
