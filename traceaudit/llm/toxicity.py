"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts become sets of hashed character 3- and 5-grams. Over a bounded sample of labelled documents, log-count ratios are
counted by Spark; the n-grams with the strongest ratios stay, each as a binary feature times its ratio, and
logistic regression is fitted on them. Scoring is one pass without a shuffle; all that tasks receive is the weight table, whose
size is fixed by BUCKETS.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceaudit.llm.common import cut, new_names, pieces_of, require_new
from traceaudit.llm.labelled import crc_remainder, training_sample
from traceaudit.session import table

BUCKETS = 1 << 20
ORDERS = (3, 5)
#: At most so many labelled documents train the model.
TRAINING_ROWS = 12_000
#: So many n-grams with the most significant ratios become features, of those that at least 3 documents of the sample have. Like BUCKETS, a bound of the model.
FEATURES = 6_000
THRESHOLD = 0.3
#: Rows that are Python objects at once in a task.
TASK_ROWS = 500


def gram_buckets(text: str | None) -> np.ndarray:
    """Bucket of each character n-gram of the lower-cased UTF-8 text between two spaces, in text order, repeats included; n-grams are taken over bytes."""
    b = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    parts = []
    for n in ORDERS:
        if len(b) < n:
            continue
        h = np.full(len(b) - n + 1, n, np.uint32)
        for j in range(n):
            h = h * np.uint32(0x01000193) + b[j : len(b) - n + 1 + j]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        parts.append(h & np.uint32(BUCKETS - 1))
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def bucket_counts(sample: DataFrame) -> DataFrame:
    """(bucket, pos, neg): in how many toxic and other documents of sample(text, y) a bucket occurs; bucket -1 counts documents."""

    def count(batches):
        pos, neg, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), [0, 0]
        for batch in pieces_of(batches, TASK_ROWS):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                (pos if y else neg)[np.unique(gram_buckets(text))] += 1
                n[bool(y)] += 1
        at = np.flatnonzero(pos + neg)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(pos[at], n[1])), pa.array(np.append(neg[at], n[0]))], ["bucket", "pos", "neg"])

    return sample.select("text", "y").mapInArrow(count, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def train(docs: DataFrame, labels: DataFrame, where=None, most: int = TRAINING_ROWS, features: int = FEATURES) -> tuple[np.ndarray, float]:
    """(weight of each bucket, intercept), fitted on at most `most` rows of labels(doc_id, toxic) and their docs(doc_id, text).

    With labels of one class or none, all weights are 0 and the intercept is that of the smoothed class share.
    """
    sample = training_sample(docs, labels, "toxic", most, where)
    counts = bucket_counts(sample)
    sizes = counts.filter("bucket = -1").first()
    n_pos, n_neg = (sizes["pos"], sizes["neg"]) if sizes else (0, 0)
    weights = np.zeros(BUCKETS, np.float32)
    if not n_pos or not n_neg:
        return weights, float(np.log((n_pos + 1) / (n_neg + 1)))
    p, q = F.col("pos") + 0.5, F.col("neg") + 0.5
    ratio = F.log(p / (n_pos + 1.0)) - F.log(q / (n_neg + 1.0))
    kept = (
        counts.filter("bucket >= 0 AND pos + neg >= 3")
        .select("bucket", ratio.alias("ratio"), (F.abs(ratio) / F.sqrt(1 / p + 1 / q)).alias("z"))
        .orderBy(F.desc("z"), "bucket")
        .limit(features)
        .toPandas()
        .sort_values("bucket")
    )
    ids = kept["bucket"].to_numpy(np.int64)
    if not len(ids):
        return weights, float(np.log((n_pos + 1) / (n_neg + 1)))
    mask = np.zeros(BUCKETS, bool)
    mask[ids] = True

    def active(batches):
        for batch in pieces_of(batches, TASK_ROWS):
            grams = []
            for text in batch.column("text").to_pylist():
                h = gram_buckets(text)
                grams.append(np.unique(h[mask[h]]).astype(str).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.float64()), pa.array(grams, pa.list_(pa.string()))], ["label", "grams"])

    rows = cut(sample.select("text", "y").mapInArrow(active, "label double, grams array<string>"), "toxicity-sample")
    to_vector = CountVectorizerModel.from_vocabulary([str(i) for i in ids], inputCol="grams", outputCol="binary", minTF=1.0).setBinary(True)
    scale = ElementwiseProduct(scalingVec=Vectors.dense(kept["ratio"].tolist()), inputCol="binary", outputCol="features")
    fit = LogisticRegression(maxIter=40, regParam=2e-4, standardization=False).fit(scale.transform(to_vector.transform(rows)).select("label", "features"))
    weights[ids] = (fit.coefficients.toArray() * kept["ratio"].to_numpy()).astype(np.float32)
    return weights, float(fit.intercept)


def score(docs: DataFrame, model: tuple[np.ndarray, float], column: str = "toxicity") -> DataFrame:
    """docs with one more column, 0 to 1, higher where toxicity is likelier. A null or empty text scores what its few n-grams give; other columns stay, and none may have that name."""
    require_new(docs, column)
    weights = docs.sparkSession.sparkContext.broadcast(model[0])
    intercept = model[1]

    def run(batches):
        w = weights.value
        for batch in pieces_of(batches, TASK_ROWS):
            z = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column("text").to_pylist()):
                h = gram_buckets(text)
                h = np.unique(h[w[h] != 0])
                z[i] = intercept + w[h].sum(dtype=np.float64)
            yield batch.append_column(column, pa.array(np.round(1 / (1 + np.exp(-np.clip(z, -500, 500))), 9)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, train_docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at least `threshold`; all columns stay. labels with crc32(doc_id) mod 4 = 2 are not learnt from."""
    model = train(train_docs, labels, crc_remainder(F.col("doc_id"), 4) != 2)
    (column,) = new_names(docs, "toxicity")
    return score(docs, model, column).filter(F.col(column) < threshold).drop(column)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents; learns from labelled rows whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, crc_remainder(F.col("doc_id"), 4) != 2)
    return score(docs, model, "score").select(
        "doc_id", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
