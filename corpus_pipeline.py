"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token files.

Rows without an id, a text or a source pass like others: an empty text scores the share of good documents, is no copy, holds no
test item, is read by no pass of the mix. Rows of one id stay or go together as copies and are mixed as one. An empty table gives
an empty result after every stage. Columns beyond those of documents go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqlattice.llm import decontamination, jaccard_join, mixing, quality, tokenstore
from seqlattice.llm.common import fold, materialize, table
from seqlattice.llm.queries import tokenizer_path

#: Word shingles and similarity of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line chain, fitted on the training labels, accepts."""
    chain = quality.train(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return quality.keep_good(docs, chain)


def first_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones."""
    return jaccard_join.keep_first(docs, SHINGLE, PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, in training order; a document that its source's target cuts ends there."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold of each document, in the order in which the mixing stage wrote them."""
    return tokenstore.token_files(docs, tokenizer_path(), order=tokenstore.file_order(docs)).drop("ids")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", first_of_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("token_files", token_ids),
]

#: No stage but decontamination and mixing can be said in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each written as Parquet for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
