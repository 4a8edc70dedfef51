"""The corpus pipeline: five stages from raw documents to a mixed training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
Together with ``quillspark.llm`` this module can be taken away.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import shared_dir, table
from quillspark.llm.decontaminate import drop_contaminated
from quillspark.llm.exact_dedup import drop_exact_duplicates
from quillspark.llm.jaccard_join import drop_near_duplicates
from quillspark.llm.language_id import accepted
from quillspark.llm.mixing import mixed_documents


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those that the language model rejects go."""
    return accepted(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the largest id."""
    return drop_exact_duplicates(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; one window is enough for a document to go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with how often each goes into the mix, those with no copy too.

    ``quillspark.llm.mixing.repeated_documents`` makes the training set of it."""
    return mixed_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", dedup_exact),
    ("near_dedup", dedup_near),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: No SQL can express the language model or the balancing; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, every stage between written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
