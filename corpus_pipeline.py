"""A corpus pipeline of five stages: quality, exact copies, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnmill.llm import decontaminate, exact, jaccard, packing, quality
from tarnmill.llm.queries import tokenizer_path
from tarnmill.runtime import materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score reaches the threshold. The text decides: null and empty texts are scored like others; repeated
    rows and null ids share their text's fate; an empty table stays empty."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the row with the smallest id (a null id only where there is no other); null
    counts as empty, so of null and empty texts one row stays. An empty table stays empty."""
    return exact.drop_exact_duplicates(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.75 or more) the row with the smallest id. Rows are
    judged by id and text; texts without words stay. An empty table stays empty."""
    return jaccard.keep_one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of the benchmark occurs; null and empty texts stay. An empty benchmark takes nothing."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the rows' tokens with their places in sequences, row by row, null text as empty. An empty table gives none."""
    return packing.pack(docs, tokenizer_path(), payload="ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_quality),
    ("exact_dedup", one_of_equal_texts),
    ("ngram_jaccard_join", one_of_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("packing", packed),
]

#: Trained trees and token ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
