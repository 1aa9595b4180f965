"""A training-data pipeline: quality rules, line dedup, near-dedup, secret scans, packing.

Each stage takes ``docs`` as they are read from files, so that a row's file and place there
name it in every read. Defined results, of every stage: a null text counts as empty (quality
rules reject it, the others leave it null); an empty table gives no rows; repeated rows and
rows of null doc_id are judged each; other columns, whatever their names, are kept, but for the
last stage, which returns the pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import line_dedup, packing, quality, secrets, simhash
from shelfspark.llm.support import place_in_file, write_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose host does, go."""
    return quality.keep(docs, F.col("source"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines, and long lines, that an earlier place has too are deleted; a document stays even if it becomes empty."""
    return line_dedup.delete_repeats(docs, row=place_in_file)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group connected by five-word shingle sets of similarity 0.8 or more stays."""
    return simhash.verified_representatives(docs, words=5, row=place_in_file)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced by a mark."""
    return secrets.redact(docs, F.concat_ws("/", "source", "lang"), F.col("source"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has neither the fingerprints' hash nor the tokenizer; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; between stages the documents are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = write_table(docs, f"stage-{name}")
    return docs
