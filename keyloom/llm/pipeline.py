"""The stages of the corpus pipeline, each one operator on whole tables.

Every stage but the last returns the columns of its documents.  Rows without a doc_id, null texts and repeated rows are
treated as the operators define; a stage given an empty table returns an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import SortKey, with_position
from . import near_dedup, packing, pii, quality, suffix_dedup
from .common import fresh, staged, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of op6, fitted on these documents and the labels of sf_dir, does not reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: five-word shingles, similarity of 0.8 or more.

    Of rows that share an id, each different text is a document, in the order of the texts; of equal rows one stays.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    if named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        rows, key = named, "doc_id"
    else:  # numbered in the order of id and text, the texts are told apart and the first of a class is as before
        (key,) = fresh(docs, "_nth")
        rows = with_position(named.dropDuplicates(["doc_id", "text"]), (SortKey("doc_id"), SortKey("text", nulls_last=False)), key)
    kept = near_dedup.classes(rows.select(F.col(key).alias("doc_id"), "text"), words=5, percent=80).where("kept").select(F.col("doc_id").alias(key)).distinct()
    out = rows.join(kept, key, "left_semi").select(*docs.columns)
    return out.unionByName(docs.where(F.col("doc_id").isNull()))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes and more that an earlier document has; all rows stay."""
    return suffix_dedup.remove(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; all rows stay."""
    return pii.mask(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences."""
    from .queries import tokenizer_path

    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in stages:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
