"""Queries: clusters of samples and their entropy."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.functions import text as tx
from traceaudit.operators import cluster as cu
from traceaudit.plans.base import query, responses
from traceaudit.session import table

ENTROPY = """h AS (SELECT user_id, n AS n_valid, CASE WHEN n > 1 THEN -sum(c::DOUBLE / n * ln(c::DOUBLE / n)) ELSE 0.0 END AS entropy, count(*) AS n_clusters
  FROM (SELECT *, sum(c) OVER (PARTITION BY user_id) AS n FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY user_id, event_type)) GROUP BY user_id, n)"""


def user_entropy(spark, d):
    return cu.cluster_entropy(table(spark, d, "events"), "user_id", "event_type")


@query()
def c1_greedy_clusters(spark, d):
    return cu.greedy_clusters(table(spark, d, "conversations"), "conv_id", "turn", "text")


def fingerprints(spark, d):
    """Vectors as samples of ten prompts (label), with their fingerprint: the positive components, none for every eleventh."""
    bits = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    e = table(spark, d, "embeddings").filter("embedding IS NOT NULL")
    return e.select("label", "vec_id", F.when(F.col("vec_id") % 11 == 0, F.array().cast("array<int>")).otherwise(bits).alias("bits"), F.col("embedding").alias("v"))


@query()
def c1_structure_clusters(spark, d):
    return cu.greedy_clusters(fingerprints(spark, d), "label", "vec_id", "bits", "structure", threshold=0.45)


@query()
def c1_set_clusters(spark, d):
    """Samples are sets of two structures, a vector's and that of the next of its label's thousand."""
    rows = fingerprints(spark, d).select("label", "vec_id", F.struct((F.col("vec_id") % 40).cast("string").alias("canonical"), "bits").alias("part"))
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("part").alias("other"))
    return cu.greedy_clusters(rows.join(nxt, "vec_id").select("label", "vec_id", F.array("part", "other").alias("parts")), "label", "vec_id", "parts", "set", threshold=0.4)


@query()
def c1_embedding_clusters(spark, d):
    return cu.greedy_clusters(fingerprints(spark, d), "label", "vec_id", "v", "embedding", threshold=0.3)


@query("SELECT user_id, event_type, min(event_id) AS first_event FROM events GROUP BY ALL")
def c1_label_clusters(spark, d):
    e = table(spark, d, "events")
    c = cu.greedy_clusters(e, "user_id", "event_id", "event_type", "label")
    firsts = c.groupBy("user_id", "cluster").agg(F.min("event_id").alias("first_event"))
    return firsts.join(e.select("user_id", F.col("event_id").alias("first_event"), "event_type"), ["user_id", "first_event"]).select("user_id", "event_type", "first_event")


@query(f"WITH {ENTROPY} SELECT user_id, n_valid::BIGINT AS n_valid, n_clusters, round(entropy, 6) AS entropy, round(CASE WHEN n_valid > 1 THEN entropy / ln(n_valid) ELSE 0 END, 6) AS normalized FROM h")
def c2_cluster_entropy(spark, d):
    return user_entropy(spark, d).select("user_id", "n_valid", "n_clusters", F.round("entropy", 6).alias("entropy"), F.round("normalized", 6).alias("normalized"))


def reasoned_samples(spark, d):
    """Responses as samples of their prompt: (prompt, doc_id, output, reasoning), with an empty reasoning where there is no trace."""
    r = responses(spark, d)
    output = F.coalesce(tx.extract_answer(F.col("answer")), F.col("answer"))
    return r.select(F.md5("question").alias("prompt"), "doc_id", output.alias("output"), F.coalesce(tx.extract_reasoning(F.col("answer")), F.lit("")).alias("reasoning"))


@query()
def c3_dual_entropy(spark, d):
    return cu.dual_entropy(reasoned_samples(spark, d), "prompt", "doc_id", "output", "reasoning")


@query("""SELECT user_id, count(*) AS n_samples, count(DISTINCT floor(value / 10)) AS n_unique, avg(CAST(value < 60 AS INTEGER)) AS validity_rate, max(value) AS best, bool_or(value > 95) AS hit FROM events GROUP BY 1 HAVING count(*) >= 2""")
def c4_sample_validity(spark, d):
    e = table(spark, d, "events").withColumn("bucket", F.floor(F.col("value") / 10))
    return cu.sample_validity(e, "user_id", "bucket", F.col("value") < 60, "value", F.col("value") > 95)


@query(f"""WITH {ENTROPY}, r AS (SELECT round(entropy, 9) AS e, round(CASE WHEN n_valid > 1 THEN entropy / ln(n_valid) ELSE 0 END, 9) AS z FROM h)
  SELECT count(*) AS n, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std, round(quantile_cont(e, 0.5), 6) AS median, round(min(e), 6) AS least, round(max(e), 6) AS most, round(avg(z), 6) AS mean_normalized,
    count(*) FILTER (z < 0.3) AS n_low, count(*) FILTER (z >= 0.3 AND z < 0.7) AS n_medium, count(*) FILTER (z >= 0.7) AS n_high FROM r""")
def c5_entropy_summary(spark, d):
    rows = user_entropy(spark, d).select(F.round("entropy", 9).alias("entropy"), F.round("normalized", 9).alias("normalized"))
    out = cu.entropy_summary(rows)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "least", "most", "mean_normalized")], "n_low", "n_medium", "n_high")


@query("""WITH c AS (SELECT user_id AS uid, event_type AS cond, count(*) AS c FROM events GROUP BY user_id, event_type, floor(value / 10)), h AS (SELECT uid, cond, CASE WHEN sum(c) > 1 THEN ln(sum(c)) - sum(c * ln(c)) / sum(c) ELSE 0.0 END AS h FROM c GROUP BY ALL),
  w AS (SELECT uid, max(h) FILTER (cond = 'view') AS b, max(h) FILTER (cond = 'click') AS d, max(h) FILTER (cond = 'error') AS e, max(h) FILTER (cond = 'signup') AS s FROM h GROUP BY 1)
  SELECT uid, round(b, 6) AS h_base, round(d - b, 6) AS ig_presence, round(e - b, 6) AS ig_content, round(s - b, 6) AS ig_swap FROM w WHERE b IS NOT NULL AND d IS NOT NULL AND e IS NOT NULL""")
def c6_condition_entropy(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("uid"), F.col("event_type").alias("cond"), F.floor(F.col("value") / 10).alias("bucket"))
    out = cu.condition_entropy(e, "uid", "cond", "bucket", "view", "click", "error", "signup")
    return out.select("uid", *[F.round(c, 6).alias(c) for c in ("h_base", "ig_presence", "ig_content", "ig_swap")])
