"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

Needs the training-data subpackage; import errors are not swallowed here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cinderlake.llm import exact_dedup, mixing, piece_bpe, quality_classifier, shingle_join
from cinderlake.llm.common import bound_batches, materialize, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs that the quality classifier, learned from the labelled documents, does not reject.

    Null and empty texts are scored as the classifier defines. Without labels of both classes nothing is
    rejected.
    """
    bound_batches(spark)
    return quality_classifier.keep_good(docs, quality_classifier.trained(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of docs for each text, that of the smallest id; null counts as the empty text."""
    bound_batches(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of docs for each group of near copies, the smallest id; rows with null ids stay.

    Near copies have a Jaccard similarity of their five-word shingles of 0.8 or more; SimHash fingerprints
    and pivot distances prune the pairs that are verified. Null and empty texts are alike.
    """
    bound_batches(spark)
    return shingle_join.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs as often as their source's target weight draws them, shuffled globally.

    A null source counts as the source ''. Null and empty texts add no characters to their source, and a
    source without any goes. Rows with null ids are drawn by their text; repeated rows are drawn alike.
    """
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, piece_ids of every row of docs; null and empty texts have no ids."""
    bound_batches(spark)
    return piece_bpe.encode_pieces(docs, keep=("source",)).select("doc_id", "source", "piece_ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("sentencepiece encoding", encode),
]

#: The classifier and the encoder have no SQL; the stages are tested against plain versions of themselves.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
