"""Queries: outcomes of perturbed traces, annotations, and perturbations of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.functions.scores import er_bin
from traceaudit.operators import perturb as pb
from traceaudit.operators import stats
from traceaudit.operators.joins import pair_donor
from traceaudit.plans.base import ANNOTATIONS, EXTRACTED, GENERIC, LEXICON, OUTCOMES, RESPONSES, annotations, extracted, facts, outcomes, query, responses

ER_BIN = "CASE WHEN er IS NULL THEN 'na' WHEN er = 0 THEN '0' WHEN er <= 25 THEN '<=25' ELSE '>25' END"


@query(f"""WITH {OUTCOMES}, b AS (SELECT *, {ER_BIN} AS er_bin FROM outcomes)
  SELECT level, cond, task, er_bin, n, round(a, 6) AS drift_rate, round(p, 6) AS mean_dperf FROM (
  SELECT 'cond' AS level, cond, NULL AS task, NULL AS er_bin, count(*) AS n, avg(drift) AS a, avg(dperf) AS p FROM b GROUP BY cond UNION ALL SELECT 'task', cond, task, NULL, count(*), avg(drift), avg(dperf) FROM b GROUP BY cond, task
  UNION ALL SELECT 'er_bin', cond, NULL, er_bin, count(*), avg(drift), avg(dperf) FROM b GROUP BY cond, er_bin)""")
def a7_drift_summary(spark, d):
    out = stats.drift_summary(outcomes(spark, d).withColumn("er_bin", er_bin(F.col("er"))))
    return out.select("level", "cond", "task", "er_bin", "n", F.round("drift_rate", 6).alias("drift_rate"), F.round("mean_dperf", 6).alias("mean_dperf"))


@query(f"WITH {OUTCOMES} SELECT task, cond, count(*) AS n, round(avg(CAST(dperf = -1 AS INTEGER)), 6) AS flip_rate FROM outcomes WHERE base_correct = 1 GROUP BY ALL")
def a8_flip_to_wrong(spark, d):
    return stats.flip_to_wrong(outcomes(spark, d), ["task", "cond"]).withColumn("flip_rate", F.round("flip_rate", 6))


@query(f"""WITH {OUTCOMES}, f AS (SELECT coalesce(task, 'all') AS task, cond, avg(CAST(dperf = -1 AS INTEGER)) AS r FROM outcomes WHERE base_correct = 1 AND n_draft > 0 GROUP BY GROUPING SETS ((task, cond), (cond)))
  SELECT task, round(max(r) FILTER (cond = 'click'), 6) AS click, round(max(r) FILTER (cond = 'error'), 6) AS error FROM f GROUP BY 1""")
def a9_draft_subset(spark, d):
    rows = outcomes(spark, d).filter("n_draft > 0")
    both = rows.unionByName(rows.withColumn("task", F.lit("all")))
    return stats.flip_to_wrong(both, ["task", "cond"]).groupBy("task").pivot("cond", ["click", "error"]).agg(F.round(F.max("flip_rate"), 6))


@query(f"""WITH {ANNOTATIONS}, k AS (SELECT *, split_part(key, '|', 4) AS verdict FROM annotations)
  SELECT annotator, round(avg(CAST(label = 'claims' AS INTEGER)) FILTER (label <> 'unsure' AND verdict = 'fabricated'), 6) AS fabricated_precision, round(avg(CAST(label = 'claims' AS INTEGER)) FILTER (label <> 'unsure' AND verdict = 'verified'), 6) AS verified_agreement,
    round(avg(CAST(label = 'claims' AS INTEGER)) FILTER (label <> 'unsure'), 6) AS pooled, count(*) FILTER (label <> 'unsure') AS n, count(*) FILTER (label = 'unsure') AS n_unsure FROM k GROUP BY 1""")
def a15_audit_precision(spark, d):
    rows = annotations(spark, d).withColumn("verdict", F.split("key", r"\|")[3])
    return stats.audit_precision(rows, ["annotator"]).select("annotator", *[F.round(c, 6).alias(c) for c in ("fabricated_precision", "verified_agreement", "pooled")], "n", "n_unsure")


@query(f"WITH {OUTCOMES} SELECT cond, count(*) AS n, round(avg(base_correct), 6) AS p, round(1.96 * sqrt(avg(base_correct) * (1 - avg(base_correct)) / count(*)), 6) AS half_width FROM outcomes GROUP BY 1")
def a20_proportion_ci(spark, d):
    per = outcomes(spark, d).groupBy("cond").agg(F.count("*").alias("n"), F.avg("base_correct").alias("p"))
    return per.select("cond", "n", F.round("p", 6).alias("p"), F.round(stats.proportion_ci(F.col("p"), F.col("n")), 6).alias("half_width"))


def _sql_present(c: str, words) -> str:
    cases = " ".join(f"WHEN contains(lower({c}), '{k}') THEN '{k}'" for k in sorted(words, key=lambda k: (-len(k), k)))
    return f"CASE {cases} END"


SPECIFIC = {g: w for g, w in LEXICON.items() if g not in GENERIC}
TARGET = "CASE " + " ".join(f"WHEN {_sql_present('trace', w)} IS NOT NULL THEN '{g}:' || {_sql_present('trace', w)}" for g, w in SPECIFIC.items()) + " END"


@query(f"WITH {EXTRACTED} SELECT id, split_part(t, ':', 1) AS \"group\", split_part(t, ':', 2) AS keyword FROM (SELECT id, {TARGET} AS t FROM extracted) WHERE t IS NOT NULL")
def t1_choose_target(spark, d):
    return pb.with_target(extracted(spark, d).select("id", "trace"), pb.choose_target(F.col("trace"), LEXICON, GENERIC)).select("id", "t.*")


@query(f"""WITH {EXTRACTED}, t AS (SELECT id, trace, split_part(t, ':', 2) AS k FROM (SELECT *, {TARGET} AS t FROM extracted) WHERE t IS NOT NULL)
  SELECT id, md5(substr(trace, 1, position(k IN lower(trace)) - 1) || 'CORRUPT' || substr(trace, position(k IN lower(trace)) + length(k))) AS digest FROM t""")
def t2_corrupt_claim(spark, d):
    rows = pb.with_target(extracted(spark, d).select("id", "trace"), pb.choose_target(F.col("trace"), LEXICON, GENERIC))
    return rows.select("id", F.md5(pb.replace_first(F.col("trace"), F.col("t.keyword"), F.lit("CORRUPT"))).alias("digest"))


@query()
def t2_corruptions(spark, d):
    rows = pb.with_target(extracted(spark, d).select("id", "trace", "question"), pb.choose_target(F.col("trace"), LEXICON, GENERIC, F.col("question")))
    wrong = pb.other_group_keyword(F.col("t.group"), F.col("id"), LEXICON)
    same = pb.synonym(F.col("t.group"), F.col("t.keyword"), LEXICON)
    swap = lambda new: F.md5(pb.replace_first(F.col("trace"), F.col("t.keyword"), new))
    return rows.select("id", F.col("t.group").alias("group"), swap(wrong).alias("wrong"), swap(same).alias("synonym"), F.md5(pb.corrupt_all(F.col("trace"), LEXICON, "xx")).alias("all"), F.md5(pb.replace_first(F.col("question"), F.col("t.keyword"), wrong)).alias("input"))


@query(rf"""WITH {RESPONSES} SELECT id, regexp_replace(answer, '(?s)<think>.*?</think>', '<think></think>', 'g') AS dropped FROM responses""")
def t3_drop_trace(spark, d):
    return responses(spark, d).select("id", pb.drop_trace(F.col("answer")).alias("dropped"))


@query()
def t3_swap_and_mask(spark, d):
    rows = responses(spark, d)
    donors = pair_donor(extracted(spark, d).select("task", "id", "trace"), "task", "id", "trace")
    upper = F.regexp_extract_all("answer", F.lit(r"[A-Z]{4,}"), 0)
    return rows.join(donors, "id", "left").select("id", F.md5(pb.swap_trace(F.col("answer"), F.col("donor_text"))).alias("swapped"), F.md5(pb.mask_fragments(F.col("answer"), upper)).alias("masked"))


@query(rf"""WITH {RESPONSES}, c AS (SELECT id, task, 'base' AS cond, answer AS p FROM responses UNION ALL SELECT id, task, 'drop', regexp_replace(answer, '(?s)<think>.*?</think>', '<think></think>', 'g') FROM responses WHERE contains(answer, '<think>')
  UNION ALL SELECT id, task, 'short', CASE WHEN length(answer) > 500 THEN substr(answer, 1, 500) END FROM responses) SELECT task, cond, count(*) AS n, sum(length(p))::BIGINT AS chars FROM c WHERE p IS NOT NULL GROUP BY ALL""")
def t5_stack_conditions(spark, d):
    a = F.col("answer")
    conds = {"base": a, "drop": F.when(a.contains("<think>"), pb.drop_trace(a)), "short": F.when(F.length(a) > 500, F.substring(a, 1, 500))}
    return pb.stack_conditions(responses(spark, d), ["id", "task"], conds).groupBy("task", "cond").agg(F.count("*").alias("n"), F.sum(F.length("prefix")).cast("long").alias("chars"))


def substitutes(known):
    """Whole canonical values of the valid facts."""
    return known.filter("valid").select(F.col("canonical").alias("key")).distinct()


@query()
def t4_corrupt_fragments(spark, d):
    pool = substitutes(facts(spark, d))
    rows = extracted(spark, d).select("id", "trace")
    out = pb.corrupt_fragments(rows, "id", "trace", F.regexp_extract_all("trace", F.lit(r"[A-Z]{4,}"), 0), pool)
    return out.select("id", F.md5("corrupted").alias("digest"), (F.col("corrupted") != F.col("trace")).alias("changed"))
