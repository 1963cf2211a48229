"""A training corpus in five stages, each a Spark job over all that the one before it kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns
of ``documents``; the last returns the sampled encodings of what is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.common import shared_dir, table
from marginalia.llm.decontamination import keep_uncontaminated
from marginalia.llm.language_id import keep_known_languages
from marginalia.llm.line_dedup import template_line_dedup
from marginalia.llm.sentencepiece_sampling import sampled_encodings
from marginalia.llm.simhash import keep_one_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the model learns from all rows with a lang."""
    return keep_known_languages(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first; n_chars follows the text."""
    return template_line_dedup(docs, count_col="n_chars").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return keep_one_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled encodings of every document: their ids, and the digests of what the ids decode to."""
    return sampled_encodings(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
