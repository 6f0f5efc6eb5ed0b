"""Quality: document classifier evidence combined with host- and path-level posteriors by hierarchical empirical Bayes.

A logistic regression over shape measures of a text and over the naive Bayes log-count ratio of its words gives each document
a probability. The posteriors of a host (source) and of a path on it (source, lang) come from labelled outcomes, counted over all labels with
partial sums, so a host with a third of all rows is summed before the shuffle. A path's rate shrinks towards its host's, a
host's towards the global rate, by prior strengths that are estimated from the counts (see shrinkage); a document's log-odds move by
what its path's posterior rate differs from the global one. Outcomes are counted in folds of documents, and a document's
posteriors leave out its own fold, so its own label never speaks for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceaudit.llm.common import cut, new_names, pieces_of, require_new
from traceaudit.llm.labelled import training_sample
from traceaudit.llm.shrinkage import prior_strength
from traceaudit.session import table

#: At most so many labelled documents train the document classifier: half of them the ratios of words, half the regression.
TRAINING_ROWS = 12_000
THRESHOLD = 0.4
FOLDS = 5
#: Words are hashed into so many buckets.
BUCKETS = 1 << 18
#: Rows that are Python objects at once in a task, and words whose buckets it remembers.
TASK_ROWS = 500
MEMO_WORDS = 200_000
_KIND = np.zeros(256, np.uint8)  # 1 space, 2 upper, 3 lower, 4 digit, 5 plain punctuation, 6 other ASCII, 7 part of a longer UTF-8 character
_KIND[128:] = 7
_KIND[33:127] = 6
for _chars, _k in ((b" \t\n\r\x0b\x0c", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"abcdefghijklmnopqrstuvwxyz", 3), (b"0123456789", 4), (b".,;:'\"-()", 5)):
    _KIND[list(_chars)] = _k
N_FEATURES = 12


class WordBuckets(dict):
    """Bucket of each word; forgets all when MEMO_WORDS are known."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        b = self[word] = xxhash.xxh3_64_intdigest(word) % BUCKETS
        return b

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def measures(text: str | None, buckets: WordBuckets, ratios: np.ndarray) -> list[float]:
    """Shape of a text: shares of character kinds, of repeated words and neighbours, word and line lengths; last the mean log-count ratio of its words. All zero for a null or empty text but the first."""
    b = (text or "").encode("utf-8", "surrogatepass")
    if not b.strip():
        return [1.0] + [0.0] * (N_FEATURES - 1)
    n = np.bincount(_KIND[np.frombuffer(b, np.uint8)], minlength=8)
    letters = n[2] + n[3] + n[7]
    words = b.split()
    m = len(words)
    ids = buckets.of(words)
    return [
        0.0,
        n[2] / max(letters, 1),
        n[4] / len(b),
        n[5] / len(b),
        min(1.0, 5 * n[6] / len(b)),
        letters / len(b),
        len(set(words)) / m,
        float((ids[1:] == ids[:-1]).mean()) if m > 1 else 0.0,
        min(len(b) / m, 30) / 10,
        float(np.log1p(m)) / 10,
        min(m / (b.count(b".") + 1), 100) / 100,
        float(ratios[ids].mean()),
    ]


def word_ratios(sample: DataFrame) -> np.ndarray:
    """Log-count ratio of each bucket between good and other texts of sample(text, y): how often texts have it, plus one half. 0 for all without both kinds."""

    def count(batches):
        buckets, found, n = WordBuckets(), np.zeros((2, BUCKETS), np.int64), [0, 0]
        for batch in pieces_of(batches, TASK_ROWS):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                found[y, np.unique(buckets.of((text or "").encode("utf-8", "surrogatepass").split()))] += 1
                n[y] += 1
        at = np.flatnonzero(found.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[1, at], n[1])), pa.array(np.append(found[0, at], n[0]))], ["bucket", "good", "poor"])

    counts = sample.select("text", "y").mapInArrow(count, "bucket long, good long, poor long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("poor").alias("poor")).toPandas()  # BUCKETS + 1 rows at most
    ratios = np.zeros(BUCKETS, np.float32)
    sizes = counts[counts["bucket"] == -1]
    n_good, n_poor = (int(sizes[c].sum()) for c in ("good", "poor"))
    if n_good and n_poor:
        kept = counts[(counts["bucket"] >= 0) & (counts["good"] + counts["poor"] >= 3)]
        ratios[kept["bucket"].to_numpy(np.int64)] = np.log((kept["good"] + 0.5) / (n_good + 1)) - np.log((kept["poor"] + 0.5) / (n_poor + 1))
    return ratios


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> tuple[np.ndarray, list[float], float]:
    """(word ratios, coefficients, intercept) fitted on at most `most` rows of labels(doc_id, quality); with labels of one class or none, the smoothed share alone."""
    sample = cut(training_sample(docs, labels, "quality", most), "quality-sample")
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    ratios = word_ratios(sample.filter(half == 0))
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        buckets = WordBuckets()
        for batch in pieces_of(batches, TASK_ROWS):
            found = [measures(t, buckets, shared.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.float64()), pa.array(found, pa.list_(pa.float64()))], ["label", "measures"])

    rows = cut(sample.filter(half == 1).select("text", "y").mapInArrow(run, "label double, measures array<double>"), "quality-measures")
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if good in (0, n):
        return ratios, [0.0] * N_FEATURES, float(np.log((good + 1) / (n - good + 1)))
    fit = LogisticRegression(maxIter=60, regParam=1e-4).fit(rows.select("label", array_to_vector("measures").alias("features")))
    return ratios, fit.coefficients.tolist(), float(fit.intercept)


def with_probability(docs: DataFrame, model: tuple[np.ndarray, list[float], float], column: str) -> DataFrame:
    """docs with the classifier's probability that a text is good; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        ratios, coefficients, intercept = shared.value
        buckets, weights = WordBuckets(), np.array(coefficients)
        for batch in pieces_of(batches, TASK_ROWS):
            z = np.array([measures(t, buckets, ratios) for t in batch.column("text").to_pylist()]) @ weights + intercept
            yield batch.append_column(column, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500)))))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def logit(p: Column) -> Column:
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(p / (1 - p))


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(FOLDS)).cast("int")


def site_outcomes(docs: DataFrame, labels: DataFrame, host: str, path: str) -> DataFrame:
    """(h, p, fold, n, k): labelled documents and good ones per host, path and fold. Ids without a label, or with both, take no part."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("top")).filter("y = top")
    sites = docs.select("doc_id", site(host).alias("h"), site(path).alias("p"))
    return sites.join(known.select("doc_id", "y"), "doc_id").groupBy("h", "p", fold_of(F.col("doc_id")).alias("fold")).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("k"))


def site(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def path_shifts(outcomes: DataFrame) -> DataFrame:
    """(h, p, shifts) from site_outcomes: for each fold, the log-odds of the path's posterior rate without that fold's outcomes, less those of the global rate.

    The entry of fold -1 leaves out none, for folds without outcomes. A path without any has no row and does not shift.
    """
    outcomes = cut(outcomes, "quality-outcomes")
    paths = outcomes.groupBy("h", "p").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    strength, host_strength = prior_strength(paths, ["h"]), prior_strength(hosts, [])
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    own = outcomes.select("h", "p", "fold", F.col("n").alias("n_own"), F.col("k").alias("k_own")).union(paths.select("h", "p", F.lit(-1), F.lit(0), F.lit(0)))
    host_own = outcomes.groupBy("h", "fold").agg(F.sum("n").alias("hn_own"), F.sum("k").alias("hk_own"))
    rows = own.join(paths, ["h", "p"]).join(hosts.select("h", F.col("n").alias("hn"), F.col("k").alias("hk")), "h").join(host_own, ["h", "fold"], "left").fillna(0, ["hn_own", "hk_own"])
    g = F.lit((total[1] + 1.0) / (total[0] + 2.0))
    host_rate = (F.col("hk") - F.col("hk_own") + host_strength * g) / (F.col("hn") - F.col("hn_own") + host_strength)
    rate = (F.col("k") - F.col("k_own") + strength * host_rate) / (F.col("n") - F.col("n_own") + strength)
    entries = rows.select("h", "p", F.struct("fold", (logit(rate) - logit(g)).alias("shift")).alias("entry"))
    return entries.groupBy("h", "p").agg(F.map_from_entries(F.collect_list("entry")).alias("shifts"))  # FOLDS + 1 at most


def score(docs: DataFrame, model: tuple[np.ndarray, list[float], float], outcomes: DataFrame, host: str = "source", path: str = "lang", column: str = "quality") -> DataFrame:
    """docs with one more column: the probability that a document is good. All rows and columns stay; a column of that name must not exist.

    outcomes: site_outcomes of labelled documents. Null hosts and paths form groups of their own; hosts and paths without outcomes do not
    shift. The table of posteriors is written first, so Spark knows its size and broadcasts it only if it is small.
    """
    require_new(docs, column)
    p, h, q, by_fold = new_names(docs, "p", "h", "q", "by_fold")
    shifts = cut(path_shifts(outcomes), "quality-paths").toDF(h, q, by_fold)
    joined = with_probability(docs, model, p).join(shifts, (site(host) == F.col(h)) & (site(path) == F.col(q)), "left")
    shift = F.coalesce(F.try_element_at(by_fold, fold_of(F.col("doc_id"))), F.try_element_at(by_fold, F.lit(-1)), F.lit(0.0))
    final = 1 / (1 + F.exp(-(logit(F.col(p)) + shift)))
    return joined.withColumn(column, F.round(final, 9)).select(*[F.col(f"`{c}`") for c in docs.columns], column)


def drop_poor(docs: DataFrame, labels: DataFrame, train_docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose quality is below `threshold`; all columns stay. Learns, and counts the outcomes of sites, from labels(doc_id, quality) and train_docs."""
    (column,) = new_names(docs, "quality")
    return score(docs, train(train_docs, labels), site_outcomes(train_docs, labels, "source", "lang"), column=column).filter(F.col(column) >= threshold).drop(column)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, quality (0 to 1), keep (quality >= THRESHOLD)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, train(docs, labels), site_outcomes(docs, labels, "source", "lang"))
    return scored.select("doc_id", "quality", (F.col("quality") >= THRESHOLD).alias("keep"))
