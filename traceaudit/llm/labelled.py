"""Bounded samples of labelled documents, for the classifiers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, where: Column | None = None) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled documents, the bound of every model that is fitted here.

    The labelled ids that come first in hash order are taken; ids with a null label or with both labels are left out. The
    sample has at most `most` narrow rows, so it is broadcast and no text is shuffled. docs: (doc_id, text).
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known if where is None else known.filter(where)
    known = known.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("top")).filter("y = top")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.col("y").cast("int").alias("y"))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
