"""Queries: windows over tokens, saliency shares and attention."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.operators import stats
from traceaudit.operators import windows as wn
from traceaudit.plans.base import TOKENS, query, tokens
from traceaudit.session import table


@query(f"""WITH {TOKENS} SELECT event_id, round(CASE WHEN region <> 'answer' THEN sal / CASE WHEN coalesce(top, 0) = 0 THEN 1 ELSE top END ELSE 0 END, 6) AS sal_norm FROM (SELECT *, max(CASE WHEN region <> 'answer' THEN sal END) OVER (PARTITION BY doc) AS top FROM tokens)""")
def w1_normalise_within(spark, d):
    return wn.normalise_within(tokens(spark, d), "doc", "sal", F.col("region") != "answer", "sal_norm").select("event_id", F.round("sal_norm", 6).alias("sal_norm"))


@query(f"""WITH {TOKENS}, x AS (SELECT *, CASE WHEN sum(CASE WHEN cat = 'click' THEN sal ELSE 0 END) OVER (PARTITION BY doc) > 0 THEN CASE WHEN cat = 'click' THEN sal ELSE 0 END ELSE sal END AS v FROM tokens),
  s AS (SELECT doc, token_index, round(sum(v) OVER w, 9) AS t, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY doc ORDER BY token_index ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING))
  SELECT doc, arg_min(token_index, (-t, token_index)) AS start, round(max(t), 6) AS total FROM s WHERE n = 20 GROUP BY 1""")
def w2_hottest_window(spark, d):
    return wn.hottest_window(tokens(spark, d), "doc", "token_index", "sal", F.col("cat") == "click", 20).select("doc", "start", F.round("total", 6).alias("total"))


@query(f"""WITH {TOKENS}, f AS (SELECT *, CASE WHEN lag(cat) OVER (PARTITION BY doc ORDER BY token_index) IS DISTINCT FROM cat THEN 1 ELSE 0 END AS fresh FROM tokens), r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY token_index) AS run FROM f)
  SELECT doc, cat, min(token_index) AS start, count(*) AS length FROM r GROUP BY doc, run, cat""")
def w3_category_runs(spark, d):
    return wn.category_runs(tokens(spark, d), "doc", "token_index", "cat")


@query(f"WITH {TOKENS} SELECT event_id FROM tokens WHERE token_index >= floor(0.25 * n_tokens) AND token_index < floor(0.75 * n_tokens)")
def w4_trace_slice(spark, d):
    return wn.trace_slice(tokens(spark, d), "doc", "token_index", 0.25, 0.75).select("event_id")


@query(f"WITH {TOKENS} SELECT doc, region, arg_min(event_id, (CAST(cat <> 'click' AS INTEGER), token_index)) AS event_id FROM tokens GROUP BY ALL")
def w5_pick_first(spark, d):
    rows = tokens(spark, d).select("doc", "region", "token_index", "cat", "event_id")
    return wn.pick_first(rows, ["doc", "region"], F.col("cat") != "click", "token_index").select("doc", "region", "event_id")


SHARES = f"""{TOKENS}, per AS (SELECT doc % 3 AS stratum, doc, cat, sum(sal) AS s, count(*) AS c FROM tokens GROUP BY ALL), tot AS (SELECT stratum, doc, sum(s) AS t FROM per GROUP BY ALL), nd AS (SELECT stratum, count(*) AS n FROM tot GROUP BY 1),
  shares AS (SELECT p.stratum, p.cat, sum(p.s / CASE WHEN t = 0 THEN 1 ELSE t END) / any_value(n) AS share, sum(p.c)::BIGINT AS count FROM per p JOIN tot USING (stratum, doc) JOIN nd USING (stratum) GROUP BY ALL)"""


def shares(spark, d):
    return stats.saliency_share(tokens(spark, d).withColumn("stratum", F.col("doc") % 3), "doc", "cat", "sal", ["stratum"])


@query(f"WITH {SHARES} SELECT stratum, cat, round(share, 6) AS share, count FROM shares")
def a10_saliency_share(spark, d):
    return shares(spark, d).withColumn("share", F.round("share", 6))


@query(f"WITH {SHARES} SELECT stratum, cat, round(round(share / (count / sum(count) OVER (PARTITION BY stratum)), 6), 5) AS enrichment FROM shares")
def a11_enrichment(spark, d):
    return stats.enrichment(shares(spark, d), ["stratum"]).select("stratum", "cat", F.round("enrichment", 5).alias("enrichment"))


@query(f"""WITH {TOKENS}, w AS (SELECT doc % 3 AS stratum, doc, avg(attn) FILTER (region = 'input') AS attn_input, avg(attn) FILTER (region = 'trace') AS attn_trace, avg(attn) FILTER (region = 'answer' AND cat = 'click') AS attn_answer FROM tokens GROUP BY ALL)
  SELECT stratum, region, round(avg(v), 6) AS mean, count(v) AS n FROM (SELECT stratum, 'attn_input' AS region, attn_input AS v FROM w UNION ALL SELECT stratum, 'attn_trace', attn_trace FROM w UNION ALL SELECT stratum, 'attn_answer', attn_answer FROM w) WHERE v IS NOT NULL GROUP BY ALL""")
def a12_region_attention(spark, d):
    r = lambda cond: F.avg(F.when(cond, F.col("attn")))
    wide = tokens(spark, d).groupBy((F.col("doc") % 3).alias("stratum"), "doc").agg(r(F.col("region") == "input").alias("attn_input"), r(F.col("region") == "trace").alias("attn_trace"), r((F.col("region") == "answer") & (F.col("cat") == "click")).alias("attn_answer"))
    return stats.region_attention(wide, ["stratum"], ["attn_input", "attn_trace", "attn_answer"]).withColumn("mean", F.round("mean", 6))


@query("SELECT label, round(avg(embedding[len(embedding) // 2 + 1]::DOUBLE), 6) AS middle, round(avg(CASE WHEN abs(embedding[1]) > 0 AND abs(embedding[2]) > 0 THEN abs(embedding[1]::DOUBLE) / (abs(embedding[1]::DOUBLE) + abs(embedding[2]::DOUBLE)) END), 6) AS share FROM embeddings GROUP BY 1")
def a13_middle_layer(spark, d):
    e = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(F.avg(stats.middle_layer(e)), 6).alias("middle"), F.round(F.avg(stats.attention_share(F.abs(e[0]), F.abs(e[1]))), 6).alias("share"))


@query(f"WITH {TOKENS} SELECT cat, round(avg(sal - attn), 6) AS mean_delta, count(*) AS n FROM tokens WHERE region = 'trace' GROUP BY 1")
def a14_perturbation_delta(spark, d):
    per = stats.perturbation_delta(tokens(spark, d).filter("region = 'trace'"), ["cat"], "attn", "sal")
    return per.select("cat", F.round("mean_delta", 6).alias("mean_delta"), "n")
