"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omiclake.llm.common import fold


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int = 5) -> DataFrame:
    """doc_id, text and y (0 or 1) of at most so many rows, those of the smallest hashes of doc_id.

    Rows of fold 0 (crc32 of the id mod folds) are held out; so are null ids, null labels and labels other than 0 and 1.
    The sample's size is the bound of what is broadcast; the texts are read once and not shuffled.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    own = own.where(fold(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("doc_id", "text", "y")
