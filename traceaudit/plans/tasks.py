"""Queries: task rows, prompts, splits, caps, mixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.operators import prepare as pr
from traceaudit.operators import stats
from traceaudit.plans.base import EXTRACTED, RESPONSES, VERDICTS, WHITE, extracted, query, responses, verdicts
from traceaudit.session import table

TEMPLATES = {"en": "Describe: {input}", "de": "Beschreibe: {input}", "fr": "Décris : {input}"}
SQL_PROMPT = "CASE task WHEN 'en' THEN 'Describe: ' || question WHEN 'de' THEN 'Beschreibe: ' || question WHEN 'fr' THEN 'Décris : ' || question END"


@query(f"WITH {RESPONSES} SELECT id, question AS input, gt, 'forward' AS task FROM responses UNION ALL SELECT id, gt, question, 'backward' FROM responses")
def p1_to_task_rows(spark, d):
    return pr.to_task_rows(responses(spark, d), F.col("id"), F.col("question"), F.col("gt"), "forward", "backward")


@query("""SELECT doc_id, CASE WHEN quality = 1 OR toxic = 1 THEN 'Yes' WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 'No' END AS any_label, CASE quality WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END AS label FROM documents LEFT JOIN labels USING (doc_id)""")
def p2_p3_labels(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", pr.any_positive_label([F.col("quality"), F.col("toxic")]).alias("any_label"), pr.binary_label(F.col("quality")).alias("label"))


@query("SELECT o_orderkey, CASE WHEN r <= 500 THEN 'test' WHEN r <= 1000 THEN 'valid' ELSE 'train' END AS split FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS r FROM orders)")
def p4_tail_split(spark, d):
    return pr.tail_split(table(spark, d, "orders"), "o_orderkey", 500).select("o_orderkey", "split")


@query(f"SELECT doc_id, trim(split_part(text, '. ', 1), {WHITE}) AS left, length(trim(substr(text, position('. ' IN text) + 2), {WHITE}))::INTEGER AS n_right FROM documents WHERE contains(text, '. ')")
def p5_split_pair(spark, d):
    return pr.split_pair(table(spark, d, "documents"), "text", ". ").select("doc_id", "left", F.length("right").alias("n_right"))


@query("SELECT p_partkey, 'brand=' || p_brand || ',size=' || p_size AS metadata FROM part")
def p6_constraint_metadata(spark, d):
    m = pr.constraint_metadata({"brand": F.col("p_brand"), "size": F.col("p_size"), "blank": F.lit(" \t\n"), "none": F.lit(None)})
    pairs = F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return table(spark, d, "part").select("p_partkey", F.array_join(pairs, ",").alias("metadata"))


@query(f"WITH {RESPONSES} SELECT id, {SQL_PROMPT} AS prompt FROM responses")
def p7_render_prompt(spark, d):
    return pr.render_prompt(responses(spark, d), TEMPLATES, "task", "question").select("id", "prompt")


@query(f"WITH {RESPONSES} SELECT id, 'system: Be brief.|user: ' || gt AS messages FROM responses")
def p7_build_messages(spark, d):
    m = pr.build_messages("Be brief.", F.col("gt"))
    return responses(spark, d).select("id", F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "|").alias("messages"))


@query("SELECT p_partkey, 'carbon=' || (p_size + 1) || ',oxygen=' || p_size AS constraints FROM part")
def p8_parse_constraints(spark, d):
    text = F.concat(F.lit("use "), F.col("p_size").cast("string"), F.lit(" carbon atoms, 3 neon atoms, "), F.col("p_size").cast("string"), F.lit(" oxygen bonds and "), (F.col("p_size") + 1).cast("string"), F.lit(" carbon atoms"))
    pairs = F.array_sort(F.transform(F.map_entries(pr.parse_constraints(text, ["carbon", "oxygen"])), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return table(spark, d, "part").select("p_partkey", F.array_join(pairs, ",").alias("constraints"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey < 4")
def p9_route_tasks(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    dim = n.filter("n_regionkey < 4").join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    known, _ = pr.route_tasks(table(spark, d, "customer"), dim, "c_nationkey")
    return known.select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey >= 4")
def p9_unknown_tasks(spark, d):
    dim = table(spark, d, "nation").filter("n_regionkey < 4").select(F.col("n_nationkey").alias("c_nationkey"))
    return pr.route_tasks(table(spark, d, "customer"), dim, "c_nationkey")[1].select("c_custkey")


@query(r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(lower(text), '[a-z0-9]+')) <= 300")
def p10_filter_overlong(spark, d):
    from traceaudit.functions.text import tokenize

    return pr.filter_overlong(table(spark, d, "documents"), F.size(tokenize(F.col("text"))), 300).select("doc_id")


@query(f"WITH {RESPONSES} SELECT model, task, count(*) AS n FROM responses WHERE answer <> '' GROUP BY ALL")
def p11_drop_unanswered(spark, d):
    return pr.drop_unanswered(responses(spark, d), "answer").groupBy("model", "task").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW'")
def p12_select_models(spark, d):
    rows = pr.select_models(table(spark, d, "orders"), "o_orderstatus", include=["F", "O"])
    return pr.select_models(rows, "o_orderpriority", exclude=["5-LOW"]).select("o_orderkey")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Houses' WHEN 'MACHINERY' THEN 'Machines' ELSE c_mktsegment END AS segment FROM customer")
def p13_resolve_aliases(spark, d):
    aliases = spark.createDataFrame([("BUILDING", "Houses"), ("MACHINERY", "Machines")], "alias string, label string")
    return pr.resolve_aliases(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), aliases, "segment")


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5")
def l1_head_per_source(spark, d):
    return pr.head_per_source(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 5)


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 20")
def l2_cap_per_group(spark, d):
    return pr.cap_per_group(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 20)


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents")
def l3_every_kth(spark, d):
    return pr.every_kth(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 10).select("doc_id", "split")


@query("""SELECT task, shuffle_key, doc_id FROM (SELECT CASE lang WHEN 'en' THEN 'english' ELSE lang END AS task, doc_id, md5('42|' || CASE lang WHEN 'en' THEN 'english' ELSE lang END || '|' || doc_id) AS shuffle_key FROM documents)""")
def l4_mix_sources(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("task"), "doc_id")
    return pr.mix_sources([rows.filter("task = 'en'"), rows.filter("task <> 'en'")], {"en": "english"}, "task", "doc_id")


@query(f"WITH {VERDICTS} SELECT model, round(avg(eo), 6) AS eo FROM verdicts GROUP BY 1 ORDER BY eo DESC, model LIMIT 10")
def l5_rank_report(spark, d):
    return stats.rank_report(verdicts(spark, d), "model", F.round(F.avg("eo"), 6), "eo")


@query("SELECT m.source, t.lang FROM (SELECT DISTINCT source FROM documents) m, (SELECT DISTINCT lang FROM documents) t WHERE NOT EXISTS (SELECT 1 FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND source = m.source AND lang = t.lang)")
def l6_missing_pairs(spark, d):
    docs = table(spark, d, "documents")
    present = docs.join(table(spark, d, "labels").filter("toxic = 1"), "doc_id")
    return pr.missing_pairs(present, docs.select("source").distinct(), docs.select("lang").distinct())


@query(f"""WITH {EXTRACTED} SELECT 'Solve.' || chr(10) || question AS problem, task, '{{"task":"' || task || '","gt":"' || id || '"}}' AS answer FROM extracted""")
def l7_training_rows(spark, d):
    return pr.training_rows(extracted(spark, d), "Solve.", "question", "id", "task")


@query("SELECT conv_id, coalesce(arg_min(text, turn), '') AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1")
def l8_first_completion(spark, d):
    return pr.first_completion(table(spark, d, "conversations").filter("role = 'assistant'"), ["conv_id"], "turn", "text")
