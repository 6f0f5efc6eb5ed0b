"""Queries: the branches of operators that their main queries do not run."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.functions import scores as sc
from traceaudit.functions import similarity as sim
from traceaudit.functions import text as tx
from traceaudit.operators import claims as cl
from traceaudit.operators import cluster as cu
from traceaudit.operators import prepare as pr
from traceaudit.operators import stats
from traceaudit.operators import windows as wn
from traceaudit.plans.base import CLAIMED, EXTRACTED, LEXICON, OUTCOMES, RESPONSES, TOKENS, VERDICTS, WHITE, claimed, extracted, outcomes, query, responses, sql_groups, sql_norm, tokens, verdicts
from traceaudit.plans.samples import ENTROPY, user_entropy
from traceaudit.plans.scores import OVERALL, overall_of
from traceaudit.session import table

r6 = lambda *cols: [F.round(c, 6).alias(c) for c in cols]


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS label FROM documents LEFT JOIN labels USING (doc_id)")
def p3_one_or_no(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", pr.binary_label(F.col("quality"), others_no=True).alias("label"))


@query(f"""WITH p AS (SELECT doc_id, trim(split_part(text, '. ', 1), {WHITE}) AS l, trim(substr(text, position('. ' IN text) + 2), {WHITE}) AS r FROM documents WHERE contains(text, '. '))
  SELECT id, task, md5(input) AS input, md5(gt) AS gt FROM (SELECT doc_id::VARCHAR AS id, 'forward' AS task, l AS input, r AS gt FROM p UNION ALL SELECT doc_id::VARCHAR, 'retro', r, l FROM p)""")
def p5_pair_tasks(spark, d):
    rows = pr.pair_tasks(table(spark, d, "documents"), "doc_id", "text", ". ", "forward", "retro")
    return rows.select("id", "task", F.md5("input").alias("input"), F.md5("gt").alias("gt"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE END AS number, CASE p_partkey % 3 WHEN 1 THEN p_brand END AS text FROM part""")
def p6_number_or_text(spark, d):
    k = F.col("p_partkey") % 3
    v = pr.number_or_text(F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, F.col("p_brand")).otherwise(F.lit("  ")))
    return table(spark, d, "part").select("p_partkey", v["number"].alias("number"), v["text"].alias("text"))


@query(r"SELECT doc_id, coalesce(NULLIF(regexp_extract(text, '([A-Z]{4,})', 1), ''), lang) AS source FROM documents")
def p8_source_of(spark, d):
    return table(spark, d, "documents").select("doc_id", pr.source_of(F.col("text"), "([A-Z]{4,})", F.col("lang")).alias("source"))


@query(rf"""WITH {EXTRACTED} SELECT id, coalesce(pred, NULLIF(regexp_extract(answer, '[A-Z][A-Za-z0-9@+\-\[\]\\/()=#]{{5,}}'), '')) AS found FROM extracted""")
def x3_last_resort(spark, d):
    return extracted(spark, d).select("id", tx.last_resort_structure(F.col("answer")).alias("found"))


ELEMENTS = {"C": "(^|[^a-z])(carbon|de)([^a-z]|$)", "N": "(^|[^a-z])(nitrogen|nicht)([^a-z]|$)", "O": "(^|[^a-z])(oxygen|of)([^a-z]|$)"}


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{n}' END" for n, p in ELEMENTS.items()) + f"], lambda x: x IS NOT NULL), ',') AS elements FROM (SELECT doc_id, {sql_norm('text')} AS t FROM documents)")
def x10_extract_elements(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(cl.named_by_pattern(F.col("text"), ELEMENTS), ",").alias("elements"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS rings, floor(sum(o_totalprice) / 10000) AS carbons, bool_or(o_orderpriority = '1-URGENT') AS n, bool_or(o_orderstatus = 'P') AS o, bool_or(o_orderpriority = '5-LOW') AS p FROM orders GROUP BY 1),
  r(class, min_rings, min_carbons, rn, ro, rp) AS (VALUES ('BUILDING', 10, 100, true, true, false), ('MACHINERY', 12, NULL, false, true, true), ('FURNITURE', NULL, NULL, NULL, NULL, true))
  SELECT class, broken, count(*) AS n FROM (SELECT class, array_to_string(list_filter([CASE WHEN coalesce(rings, 0) < min_rings THEN 'rings' END, CASE WHEN coalesce(carbons, 0) < min_carbons THEN 'carbons' END, CASE WHEN rn AND NOT coalesce(n, false) THEN 'n' END,
    CASE WHEN ro AND NOT coalesce(o, false) THEN 'o' END, CASE WHEN rp AND NOT coalesce(p, false) THEN 'p' END], lambda x: x IS NOT NULL), ',') AS broken
  FROM customer JOIN r ON class = c_mktsegment LEFT JOIN o ON o_custkey = c_custkey WHERE NOT (c_nationkey % 5 = 0 AND c_mktsegment = 'BUILDING')) WHERE broken <> '' GROUP BY ALL""")
def v3_class_rules_elements(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    has = {"n": F.col("o_orderpriority") == "1-URGENT", "o": F.col("o_orderstatus") == "P", "p": F.col("o_orderpriority") == "5-LOW"}
    sums = o.groupBy("o_custkey").agg(F.count("*").alias("rings"), F.floor(F.sum("o_totalprice") / 10000).alias("carbons"), *[F.bool_or(x).alias(f"has_{k}") for k, x in has.items()])
    rows = c.join(sums, c.c_custkey == sums.o_custkey, "left").fillna(0, ["rings", "carbons"])
    rows = rows.withColumn("class", F.col("c_mktsegment")).withColumn("named", F.when(F.col("c_nationkey") % 5 == 0, F.array(F.lit("BUILDING"))))
    rules = spark.createDataFrame([("BUILDING", 10, 100, True, True, False), ("MACHINERY", 12, None, False, True, True), ("FURNITURE", None, None, None, None, True)], "class string, min_rings int, min_carbons int, requires_n boolean, requires_o boolean, requires_p boolean")
    return cl.class_rule_violations(rows, rules, "named").groupBy("class", F.array_join("broken", ",").alias("broken")).agg(F.count("*").alias("n"))


@query(f"""WITH {CLAIMED}, p AS (SELECT *, {sql_groups(f"({sql_norm('pred')})")} AS predicted FROM claimed WHERE pred IS NOT NULL)
  SELECT id, array_to_string(list_filter(in_gt, lambda x: NOT list_contains(predicted, x)), ',') AS missing, array_to_string(list_filter(in_gt, lambda x: list_contains(claimed, x) AND NOT list_contains(predicted, x)), ',') AS unfaithful,
    array_to_string(list_filter([CASE WHEN length(pred) % 3 IS DISTINCT FROM length(gt) % 3 THEN 'formula' END, CASE WHEN NULLIF(length(pred) % 4, 0) IS DISTINCT FROM NULLIF(length(gt) % 4, 0) THEN 'rings' END], lambda x: x IS NOT NULL), ',') AS differs FROM p""")
def v4_description_faults(spark, d):
    rows = claimed(spark, d).filter("pred IS NOT NULL").withColumn("predicted", cl.named_groups(F.col("pred"), LEXICON))
    missing, unfaithful = cl.description_faults(F.col("in_gt"), F.col("claimed"), F.col("predicted"))
    part = lambda c, n: F.length(c) % n
    differs = cl.mismatches(part("pred", 3), part("gt", 3), F.nullif(part("pred", 4), F.lit(0)), F.nullif(part("gt", 4), F.lit(0)))
    return rows.select("id", *[F.array_join(x, ",").alias(n) for x, n in ((missing, "missing"), (unfaithful, "unfaithful"), (differs, "differs"))])


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN l_suppkey % 4 = 2 WHEN 1 THEN l_suppkey % 4 = 0 WHEN 2 THEN l_suppkey % 4 = 0 AND l_partkey % 3 = 2
    WHEN 3 THEN l_suppkey % 4 < 1 ELSE l_suppkey % 4 > 1 END::INTEGER AS success FROM lineitem""")
def k6_edit_success(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("add", "delete", "substitute", "down", "up")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    text = F.when(kind == "down", F.lit("Please REDUCE it")).when(kind == "up", F.lit("Please raise it"))
    kind = F.when(text.isNotNull(), sc.direction(text)).otherwise(kind)
    ok = sc.edit_success(kind, F.lit(1), F.col("l_suppkey") % 4, F.lit(1), F.col("l_partkey") % 3)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ok.alias("success"))


@query(f"""WITH {VERDICTS}, o AS (SELECT *, {OVERALL}), g AS (SELECT *, 2 * least(doc_id % 6, 5) / 5.0::DOUBLE * (doc_id % 6) / greatest(doc_id % 6 + doc_id % 4, 1) AS g, doc_id % 11 = 0 AS failed, least(n, 1500) / 1500.0::DOUBLE AS len FROM o WHERE er IS NOT NULL)
  SELECT id, round(0.1 + 0.4 * CASE WHEN er = 0 AND exact AND NOT failed THEN 1.0 ELSE 0.0 END + 0.4 * (1 - CASE WHEN failed THEN 100 ELSE overall END / 100) + 0.2 * CASE WHEN failed THEN 0 ELSE g END + 0.05 * len, 9) AS reward FROM g""")
def k10_bonus_and_failures(spark, d):
    rows = overall_of(verdicts(spark, d)).filter("er IS NOT NULL")
    g, length = sc.grounded(F.col("doc_id") % 6, F.col("doc_id") % 4), F.least("n", F.lit(1500)) / 1500.0
    reward = sc.grounded_reward(F.lit(1.0), F.col("exact").cast("double"), F.col("overall"), g, F.col("er"), True, 0.05, length, F.col("doc_id") % 11 == 0)
    return rows.select("id", F.round(reward, 9).alias("reward"))


@query("""SELECT bucket, count(*) AS n FROM (SELECT (CASE WHEN p_retailprice > 1500 THEN 'heavy' ELSE 'light' END) || '/' || (CASE WHEN p_size > 45 OR p_partkey % 7 > 3 OR length(p_name) > 30 THEN 'complex' ELSE 'simple' END) AS bucket FROM part) GROUP BY 1""")
def m12_property_bucket_all_rules(spark, d):
    bucket = sim.property_bucket(F.col("p_retailprice"), F.col("p_size"), 1500, 45, F.col("p_partkey") % 7, 3, F.length("p_name"), 30)
    return table(spark, d, "part").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {ENTROPY}, r AS (SELECT round(CASE WHEN n_valid > 1 THEN entropy / ln(n_valid) ELSE 0 END, 9) AS z, CASE WHEN user_id >= 0 THEN user_id % 10 END AS t FROM h)
  SELECT round(stddev_pop(z), 6) AS std_normalized, round(quantile_cont(z, 0.5), 6) AS median_normalized, round(100.0 * count(*) FILTER (z < 0.3) / count(*), 6) AS pct_low, round(100.0 * count(*) FILTER (z >= 0.3 AND z < 0.7) / count(*), 6) AS pct_medium,
    round(100.0 * count(*) FILTER (z >= 0.7) / count(*), 6) AS pct_high, round(CASE WHEN count(t) = count(*) THEN corr(z, t) END, 6) AS truth_correlation, NULL::DOUBLE AS partly FROM r""")
def c5_entropy_and_truth(spark, d):
    rows = user_entropy(spark, d).select(F.round("entropy", 9).alias("entropy"), F.round("normalized", 9).alias("normalized"), (F.col("user_id") % 10).cast("double").alias("t"), F.when(F.col("user_id") % 2 == 0, 1.0).alias("part"))
    out = cu.entropy_summary(rows, truth="t").crossJoin(cu.entropy_summary(rows, truth="part").select(F.col("truth_correlation").alias("partly")))  # one row each
    return out.select(*r6("std_normalized", "median_normalized", "pct_low", "pct_medium", "pct_high", "truth_correlation"), "partly")


@query(f"""WITH {EXTRACTED}, w AS (SELECT id, regexp_extract_all(trace, '[A-Z][a-z]{{3,}}') AS f, regexp_extract(coalesce(pred, answer), '^[A-Za-z]+') AS a FROM extracted),
  known AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS key FROM benchmark)
  SELECT id, a IN (SELECT key FROM known) AND len(list_filter(f, lambda x: lower(x) = lower(a))) > 0 AND lower(a) IN (SELECT lower(key) FROM known WHERE list_contains(f, key)) AS copied FROM w""")
def j8_copied_fragments(spark, d):
    known = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0)).alias("key")).distinct().withColumn("canonical", F.lower("key"))
    rows = extracted(spark, d).withColumn("a", F.regexp_extract(F.coalesce("pred", "answer"), "^[A-Za-z]+", 0))
    return cl.copied_fragments(rows, known, "id", F.regexp_extract_all("trace", F.lit("[A-Z][a-z]{3,}"), 0), "a")


@query(f"""WITH {VERDICTS}, e AS (SELECT source AS model, lang AS task, n_chars % 100 / 10.0::DOUBLE AS h FROM documents WHERE doc_id % 3 = 0)
  SELECT v.model, v.task, round(100 * avg((io < 40)::INTEGER), 6) AS validity, round(avg(CASE WHEN exact IS NOT NULL THEN 100 - eo END), 6) AS mean_similarity, round(any_value(m), 6) AS mean_entropy
  FROM verdicts v LEFT JOIN (SELECT model, task, avg(h) AS m FROM e GROUP BY ALL) x ON x.model = v.model AND x.task = v.task GROUP BY ALL""")
def a1_task_extras(spark, d):
    entropies = table(spark, d, "documents").filter("doc_id % 3 = 0").select(F.col("source").alias("model"), F.col("lang").alias("task"), (F.col("n_chars") % 100 / 10.0).alias("h"))
    out = stats.task_extras(verdicts(spark, d), ["model", "task"], F.col("io") < 40, F.when(F.col("exact").isNotNull(), 100 - F.col("eo")), entropies, "h")
    return out.select("model", "task", *r6("validity", "mean_similarity", "mean_entropy"))


@query(f"""WITH {OUTCOMES} SELECT task, cond, count(*) AS n, round(avg(base_correct), 6) AS base_rate, round(avg(base_correct + dperf), 6) AS perturbed_rate FROM outcomes GROUP BY ALL""")
def a7_base_and_perturbed(spark, d):
    return stats.base_and_perturbed(outcomes(spark, d), ["task"]).select("task", "cond", "n", *r6("base_rate", "perturbed_rate"))


@query(f"""WITH {OUTCOMES} SELECT task, count(*) AS n, round(avg(c), 6) AS base_accuracy FROM (SELECT task, uid, max(base_correct) AS c FROM outcomes GROUP BY ALL) GROUP BY 1""")
def a7_base_accuracy(spark, d):
    return stats.base_accuracy(outcomes(spark, d), ["task"]).select("task", "n", *r6("base_accuracy"))


@query(f"""WITH {OUTCOMES} SELECT task, count(*) AS n, round(avg(x), 6) AS coverage FROM (SELECT task, uid, max((n_draft > 0)::INTEGER) AS x FROM outcomes WHERE base_correct = 1 GROUP BY ALL) GROUP BY 1""")
def a9_draft_coverage(spark, d):
    return stats.draft_coverage(outcomes(spark, d), ["task"]).select("task", "n", *r6("coverage"))


@query(f"""WITH {TOKENS}, p AS (SELECT doc, cat, sum(sal) AS s FROM tokens GROUP BY ALL) SELECT doc, cat, round(100 * s / CASE WHEN sum(s) OVER (PARTITION BY doc) = 0 THEN 1 ELSE sum(s) OVER (PARTITION BY doc) END, 6) AS percent FROM p""")
def a10_document_shares(spark, d):
    return stats.document_shares(tokens(spark, d), "doc", "cat", "sal").select("doc", "cat", *r6("percent"))


@query(f"""WITH {RESPONSES} SELECT model, count(*) FILTER (length(answer) <= 3000 AND contains(answer, '<answer>')) AS n_kept, count(*) FILTER (length(answer) > 3000) AS n_too_long, count(*) FILTER (length(answer) <= 3000 AND NOT contains(answer, '<answer>')) AS n_badly_tagged FROM responses GROUP BY 1""")
def a10_skipped_documents(spark, d):
    a = F.col("answer")
    return stats.skipped_documents(responses(spark, d), ["model"], F.length(a) > 3000, ~a.contains("<answer>"))


@query(f"""WITH {CLAIMED} SELECT task, round(avg(CASE WHEN pred IS NOT NULL THEN contains({sql_norm('trace')}, {sql_norm('pred')})::INTEGER END), 6) AS copy_rate FROM claimed GROUP BY 1""")
def a12_copy_rate(spark, d):
    return extracted(spark, d).groupBy("task").agg(F.round(F.avg(cl.copied_from_trace(F.col("trace"), F.col("pred")).cast("int")), 6).alias("copy_rate"))


@query(f"""WITH {TOKENS}, m AS (SELECT doc, sum(attn) FILTER (region = 'trace') AS t, sum(attn) FILTER (region = 'input') AS i, count(*) FILTER (region = 'trace') AS nt, count(*) FILTER (region = 'input') AS ni FROM tokens GROUP BY 1)
  SELECT doc, round(coalesce(t, 0) / (coalesce(i, 0) + coalesce(t, 0) + 1e-9), 6) AS share, round((coalesce(t, 0) / greatest(nt, 1)) / (coalesce(i, 0) / greatest(ni, 1) + coalesce(t, 0) / greatest(nt, 1) + 1e-9), 6) AS per_token FROM m""")
def a13_trace_share(spark, d):
    at = lambda r, c: F.when(F.col("region") == r, c)
    m = tokens(spark, d).groupBy("doc").agg(*[f(at(r, F.col("attn"))).alias(n) for n, f, r in (("t", F.sum, "trace"), ("i", F.sum, "input"), ("nt", F.count, "trace"), ("ni", F.count, "input"))])
    t, i = F.col("t"), F.col("i")
    return m.select("doc", F.round(stats.trace_share(t, i), 6).alias("share"), F.round(stats.trace_share(t, i, F.col("nt"), F.col("ni")), 6).alias("per_token"))


@query(f"""WITH {VERDICTS} SELECT task, round(100 * avg((io < 40)::INTEGER), 6) AS pct_valid, round(100 * avg(exact::INTEGER), 6) AS pct_exact, round(avg(eo), 6) AS mean_similarity, round(avg(n), 6) AS mean_length, round(100 * avg((er < 30)::INTEGER), 6) AS pct_low,
  round(100 * avg((er >= 30 AND er < 60)::INTEGER), 6) AS pct_moderate, round(100 * avg((er >= 60)::INTEGER), 6) AS pct_high FROM verdicts GROUP BY 1""")
def a16_describe_rates(spark, d):
    out = stats.describe_rates(verdicts(spark, d), ["task"], "er", F.col("io") < 40, F.col("exact"), ["tanimoto", "eo"], F.col("n"))
    return out.select("task", *r6("pct_valid", "pct_exact", "mean_similarity", "mean_length", "pct_low", "pct_moderate", "pct_high"))


@query("""WITH c AS (SELECT lang AS task, source AS model, count(*) AS c FROM documents GROUP BY ALL), m AS (SELECT task, max(c) AS most FROM c GROUP BY 1)
  SELECT experiment, declared, total, total = declared AS agrees FROM (SELECT 'corpus' AS experiment, (SELECT sum(most) FROM m)::BIGINT AS declared, (SELECT sum(most) FROM m)::BIGINT AS total UNION ALL SELECT 'absent', 5, 0)""")
def a23_check_total(spark, d):
    docs = table(spark, d, "documents").select("source", "lang")
    inventory = stats.coverage_inventory({"corpus": docs}, "source", "lang")
    own = docs.groupBy("lang", "source").count().groupBy("lang").agg(F.max("count").alias("m")).agg(F.lit("corpus").alias("experiment"), F.sum("m").alias("declared"))
    return stats.check_total(inventory, own.unionByName(spark.createDataFrame([("absent", 5)], "experiment string, declared long")))


@query(f"""WITH {TOKENS} SELECT event_id, round((sal - min(sal) OVER (PARTITION BY doc)) / (max(sal) OVER (PARTITION BY doc) - min(sal) OVER (PARTITION BY doc) + 1e-9), 6) AS sal_norm FROM tokens""")
def w1_min_max_within(spark, d):
    return wn.min_max_within(tokens(spark, d), "doc", "sal", "sal_norm").select("event_id", F.round("sal_norm", 6).alias("sal_norm"))
