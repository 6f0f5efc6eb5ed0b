"""The corpus pipeline: documents -> toxicity -> quality -> near duplicates -> decontamination -> SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs, so every stage works on all that its predecessor kept. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traceaudit.llm import decontaminate, jaccard_join, pieces, quality, toxicity
from traceaudit.llm.common import cut
from traceaudit.session import table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the character n-gram classifier scores as toxic; it learns from the labelled documents of sf_dir."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of poor quality; the classifier and the outcomes of hosts and paths come from the labelled documents of sf_dir."""
    return quality.drop_poor(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group that five-word shingle links of Jaccard 0.8 and more connect."""
    return jaccard_join.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that tile at least half of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids): what is left, as SentencePiece ids."""
    return pieces.encode(docs).select("doc_id", "lang", "source", "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: The classifiers and the tokenizer have no SQL form; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{n}")
    return docs
