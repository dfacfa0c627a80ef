"""A training-data pipeline of five of the operators, each stage written and read again.

1. quality rules: documents that a rule rejects go.
2. n-gram Jaccard join: of each class of near-duplicates (five words, 0.8) the
   document with the smallest id stays.
3. secret scans: secrets in the texts are replaced by their kind.
4. mixing sources to target weights: a document is in the mix once for every
   pass that takes the block of its first word, so it may go or come twice.
5. best-fit packing: the mix's token pieces and their places in sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotiles.llm import mixing, ngram_join, packing, quality_rules, secret_scan
from geotiles.llm.common import materialize

SHINGLE_WORDS = 5
SIMILARITY = ngram_join.Bound(80, 100)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what no rule rejects."""
    return quality_rules.cascade(docs).where("kept").select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: the one with the smallest doc_id, and of equal ids the first in all columns.

    Documents without words are in no class and stay.
    """
    return ngram_join.keep_one(docs, SHINGLE_WORDS, SIMILARITY)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redact secrets; n_chars follows the text."""
    clean = secret_scan.redact(docs, secret_scan.train(secret_scan.labelled(docs)))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time the mix takes a document."""
    return mixing.sampled(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's pieces with their places."""
    return packing.best_fit_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Permutations, automata and packing have no SQL; the tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
