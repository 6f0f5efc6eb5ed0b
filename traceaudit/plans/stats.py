"""Queries: roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.functions.text import ascii_borders
from traceaudit.operators import stats
from traceaudit.plans.base import FAMILY, VERDICTS, family_rows, query, turn_pairs, verdicts
from traceaudit.plans.scores import AUDITED, OVERALL, ROUNDED, STATS, audited, overall_of
from traceaudit.session import table

OVER = f"{VERDICTS}, o AS (SELECT *, {OVERALL})"
r6 = lambda *cols: [F.round(c, 6).alias(c) for c in cols]


@query(f"""WITH {AUDITED} SELECT model, stratum, {STATS} FROM (SELECT *, 'all' AS stratum FROM audited UNION ALL SELECT *, CASE WHEN er = 0 THEN 'er0' ELSE 'erpos' END FROM audited) GROUP BY ALL""")
def a1_task_stats_strata(spark, d):
    rows = audited(spark, d)
    both = rows.withColumn("stratum", F.explode(F.array(F.lit("all"), F.when(F.col("er") == 0, "er0").otherwise("erpos"))))
    return stats.task_stats(both, ["model", "stratum"]).select("model", "stratum", "n", *r6(*ROUNDED))


@query(f"""WITH {VERDICTS}, s AS (SELECT *, CASE WHEN er IS NULL THEN NULL WHEN er = 0 THEN 'er0' ELSE 'erpos' END AS st FROM verdicts)
  SELECT task, stratum, count(*) AS n, round(avg(ir), 6) AS ir, round(avg(eo), 6) AS eo FROM (SELECT task, 'all' AS stratum, ir, eo FROM s UNION ALL SELECT task, st, ir, eo FROM s WHERE st IS NOT NULL) GROUP BY ALL""")
def a2_stratified_stats(spark, d):
    return stats.stratified(verdicts(spark, d), ["task"], "er", [F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("ir", "eo")]])


@query(f"""WITH {VERDICTS}, s AS (SELECT *, CASE WHEN er IS NULL OR er = 0 THEN 'er0' ELSE 'erpos' END AS st FROM verdicts)
  SELECT task, stratum, count(*) AS n FROM (SELECT task, 'all' AS stratum FROM s UNION ALL SELECT task, st FROM s) GROUP BY ALL""")
def a2_strata_null_is_clean(spark, d):
    return stats.stratified(verdicts(spark, d), ["task"], "er", [F.count("*").alias("n")], null_er="clean")


@query(f"""WITH {FAMILY}, t AS (SELECT model, family, task, count(*) AS n, avg(perf) AS perf, avg(er) AS er, avg(perf) FILTER (er = 0) AS perf_er0 FROM family_rows GROUP BY ALL)
  SELECT model, family, sum(n)::BIGINT AS n, round(sum(perf * n) / sum(n), 6) AS perf, round(sum(er * n) / sum(n), 6) AS er, round(sum(perf_er0 * n) / sum(CASE WHEN perf_er0 IS NOT NULL THEN n END), 6) AS perf_er0 FROM t GROUP BY ALL""")
def a3_family_stats(spark, d):
    per = family_rows(spark, d).groupBy("model", "family", "task").agg(F.count("*").alias("n"), F.avg("perf").alias("perf"), F.avg("er").alias("er"), F.avg(F.when(F.col("er") == 0, F.col("perf"))).alias("perf_er0"))
    return stats.family_stats(per, ["model", "family"], ["perf", "er", "perf_er0"]).select("model", "family", "n", *r6("perf", "er", "perf_er0"))


@query("""WITH t AS (SELECT user_id % 7 AS model, event_type AS task, avg(value) AS m, sum(value) AS s, count(value) AS c FROM events GROUP BY ALL)
  SELECT model, count(*) AS n_tasks, round(avg(m), 6) AS mean_of_tasks, round(sum(s) / sum(c), 6) AS pooled FROM t GROUP BY 1""")
def a4_mean_of_tasks(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 7).alias("model"), "event_type", "value")
    return stats.mean_of_tasks(e, "model", "event_type", "value").select("model", "n_tasks", *r6("mean_of_tasks", "pooled"))


@query(f"""WITH {FAMILY}, t AS (SELECT family, model, avg(perf) AS p FROM family_rows GROUP BY ALL) SELECT family, round(max(p) FILTER (model = 'A'), 6) AS base, round(max(p) FILTER (model = 'R'), 6) AS variant, round(max(p) FILTER (model = 'R') - max(p) FILTER (model = 'A'), 6) AS change FROM t GROUP BY 1""")
def a5_compare_variants(spark, d):
    per = family_rows(spark, d).groupBy("family", "model").agg(F.avg("perf").alias("p"))
    return stats.compare_variants(per, ["family"], "model", "A", "R", "p").select("family", *r6("base", "variant", "change"))


@query(f"""WITH {AUDITED} SELECT model, task, round(100 * avg(perf) FILTER (er = 0) - 100 * avg(perf) FILTER (er > 0), 6) AS gap FROM audited GROUP BY ALL""")
def a5_decoupling_gap(spark, d):
    return stats.decoupling_gap(stats.task_stats(audited(spark, d), ["model", "task"])).select("model", "task", F.round("gap", 6).alias("gap"))


@query(rf"""WITH {AUDITED}, f AS (SELECT *, regexp_matches(trace, '(?i)\b(that|which)\b') AS h, regexp_matches(trace, '(?i) (nicht|pas) ') AS ab,
    CASE WHEN len(ps) > 0 THEN (list_min(ps) - 1)::DOUBLE / length(trace) END AS pos FROM (SELECT *, list_filter(list_transform(list_concat(fabricated, list_transform(fabricated, lambda g: replace(g, '_', ' ')), list_transform(fabricated, lambda g: replace(g, '_', ''))), lambda g: position(g IN lower(trace))), lambda p: p > 0) AS ps FROM audited)),
  t AS (SELECT model, task, count(*) AS c, sum(n_verified) AS v, sum(n_fabricated) AS f, CASE WHEN sum(n_verified) + sum(n_fabricated) > 0 THEN sum(n_fabricated)::DOUBLE / (sum(n_verified) + sum(n_fabricated)) END AS rate, count(*) FILTER (h) AS h, count(*) FILTER (ab) AS ab, sum(pos) AS p, count(pos) AS np FROM f GROUP BY ALL)
  SELECT model, sum(c)::BIGINT AS n, round((sum(v) + sum(f))::DOUBLE / sum(c), 6) AS claims_per_response, round(avg(rate), 6) AS fabrication_rate, round(sum(h)::DOUBLE / sum(c), 6) AS hedge_rate, round(sum(ab)::DOUBLE / sum(c), 6) AS abstain_rate, round(sum(p) / sum(np), 6) AS mean_position, sum(np)::BIGINT AS n_positions FROM t GROUP BY 1""")
def a6_mechanism_ladder(spark, d):
    from traceaudit.operators.claims import first_claim_position

    rows = audited(spark, d).withColumns({"hedge": F.col("trace").rlike(ascii_borders(r"(?i)\b(that|which)\b")), "abstain": F.col("trace").rlike(r"(?i) (nicht|pas) "), "position": first_claim_position(F.col("trace"), F.col("fabricated"))})
    return stats.mechanism_ladder(rows, "model", "task").select("model", "n", *r6("claims_per_response", "fabrication_rate", "hedge_rate", "abstain_rate", "mean_position"), "n_positions")


@query(f"""WITH {OVER} SELECT task, count(er) AS n, round(avg(er), 6) AS mean, round(quantile_cont(er, 0.5), 6) AS median, min(er) AS least, max(er) AS most, round(stddev_pop(er), 6) AS std, count(*) FILTER (er < 30) AS n_low, count(*) FILTER (er >= 30 AND er < 60) AS n_moderate, count(*) FILTER (er >= 60) AS n_high FROM o GROUP BY 1""")
def a16_describe_scores(spark, d):
    return stats.describe_scores(overall_of(verdicts(spark, d)), ["task"], "er").select("task", "n", *r6("mean", "median"), "least", "most", *r6("std"), "n_low", "n_moderate", "n_high")


@query("SELECT l_returnflag, count(*) AS n, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS upper_median FROM lineitem GROUP BY 1")
def a16_upper_median(spark, d):
    return stats.upper_median(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query(f"""WITH {OVER} SELECT task, count(*) AS n, round(corr(er, ir), 6) AS r, round(regr_slope(ir, er), 6) AS slope, round(regr_intercept(ir, er), 6) AS intercept FROM o WHERE er IS NOT NULL GROUP BY 1""")
def a17_correlate(spark, d):
    return stats.correlate(verdicts(spark, d), ["task"], "er", "ir").select("task", "n", *r6("r", "slope", "intercept"))


@query(f"""WITH {VERDICTS}, m AS (SELECT model, CASE WHEN exact THEN 'right' ELSE 'wrong' END AS outcome, CASE WHEN er > 0 THEN 'fabricating' ELSE 'faithful' END AS trace FROM verdicts WHERE er IS NOT NULL AND exact IS NOT NULL),
  c AS (SELECT model, coalesce(outcome, 'all') AS outcome, coalesce(trace, 'all') AS trace, count(*) AS n FROM m GROUP BY GROUPING SETS ((model, outcome, trace), (model, outcome), (model, trace)))
  SELECT c.*, round(n::DOUBLE / t, 6) AS share FROM c JOIN (SELECT model, count(*) AS t FROM m GROUP BY 1) USING (model)""")
def a18_contingency(spark, d):
    return stats.contingency(verdicts(spark, d), ["model"]).withColumn("share", F.round("share", 6))


@query(f"""WITH {VERDICTS} SELECT exact, count(er) AS n, round(avg(er), 6) AS mean, round(quantile_cont(er, 0.25), 6) AS q1, round(quantile_cont(er, 0.5), 6) AS q2, round(quantile_cont(er, 0.75), 6) AS q3 FROM verdicts WHERE exact IS NOT NULL GROUP BY 1""")
def a19_group_quartiles(spark, d):
    return stats.group_quartiles(verdicts(spark, d).filter("exact IS NOT NULL"), ["exact"], "er").select("exact", "n", *r6("mean", "q1", "q2", "q3"))


@query(f"""WITH {VERDICTS}, t AS (SELECT model, task, avg(ir) AS ir, avg(io) AS io, avg(er) AS er, avg(eo) AS eo FROM verdicts GROUP BY ALL), m AS (SELECT model, 0.15 * avg(ir) AS ir, 0.25 * avg(io) AS io, 0.25 * avg(er) AS er, 0.35 * avg(eo) AS eo FROM t GROUP BY 1)
  SELECT model, d AS dimension, round(v, 6) AS contribution, round(coalesce(ir, 0) + coalesce(io, 0) + coalesce(er, 0) + coalesce(eo, 0), 6) AS total FROM (SELECT *, unnest(['ir', 'io', 'er', 'eo']) AS d, unnest([ir, io, er, eo]) AS v FROM m)""")
def a21_dimension_contributions(spark, d):
    from traceaudit.functions.scores import WEIGHTS

    return stats.dimension_contributions(verdicts(spark, d), "model", "task", WEIGHTS).select("model", "dimension", *r6("contribution", "total"))


@query("""SELECT source, round(avg(n_chars) FILTER (lang = 'en'), 6) AS en, round(avg(n_chars) FILTER (lang = 'de'), 6) AS de, round(avg(n_chars) FILTER (lang = 'fr'), 6) AS fr, round(avg(n_chars) FILTER (lang = 'es'), 6) AS es FROM documents GROUP BY 1""")
def a22_heatmap(spark, d):
    return stats.heatmap(table(spark, d, "documents"), "source", "lang", ["en", "de", "fr", "es"], F.round(F.avg("n_chars"), 6))


@query("""WITH c AS (SELECT 'corpus' AS experiment, lang AS task, source AS model, count(*) AS c FROM documents GROUP BY ALL UNION ALL SELECT 'labelled', lang, source, count(*) FROM documents JOIN labels USING (doc_id) GROUP BY ALL
  UNION ALL SELECT 'events', event_type, CAST(user_id % 5 AS VARCHAR), count(*) FROM events GROUP BY ALL)
  SELECT experiment, task, count(*) AS n_models, min(c) AS least, max(c) AS most, string_agg(model, ',' ORDER BY model) AS models FROM c GROUP BY ALL""")
def a23_coverage_inventory(spark, d):
    docs = table(spark, d, "documents")
    parts = {"corpus": docs.select("source", "lang"), "labelled": docs.join(table(spark, d, "labels"), "doc_id").select("source", "lang")}
    parts["events"] = table(spark, d, "events").select((F.col("user_id") % 5).alias("source"), F.col("event_type").alias("lang"))
    return stats.coverage_inventory(parts, "source", "lang")


@query()
def a24_caption_scores(spark, d):
    from traceaudit.functions import similarity as sim

    out = sim.caption_scores(turn_pairs(spark, d).withColumn("model", F.col("conv_id") % 3), ["model"], "question", "reply")
    return out.select("model", "n", *r6("bleu2", "bleu4", "rouge1", "rouge2", "rouge_l"))
