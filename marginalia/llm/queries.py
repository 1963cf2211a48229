"""The queries opN_<name> of this subpackage; each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, lexical_search
from .ann import nearest_neighbours
from .common import table
from .language_id import language_report
from .line_dedup import template_line_dedup
from .lm_scoring import lm_scores
from .sentencepiece_sampling import sampled_encodings
from .sharding import balanced_label_propagation
from .simhash import simhash_report
from .token_counts import token_counts
from .token_files import token_file_round_trip
from .whitening import whitened_vectors


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_label_propagation(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = template_line_dedup(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "text", "n_lines", "n_dropped")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_report(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op9_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_encodings(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_vectors(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_id": op5_language_id,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_token_id_output": op9_token_id_output,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_ranked_search": op12_ranked_search,
    "op13_exact_dedup": op13_exact_dedup,
}

#: DuckDB SQL for those that SQL can express.
ORACLES: dict[str, str] = {
    "op6_benchmark_decontamination": decontamination.ORACLE, "op12_ranked_search": lexical_search.ORACLE, "op13_exact_dedup": exact_dedup.ORACLE}
