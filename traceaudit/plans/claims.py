"""Queries: claims and their verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.operators import claims as cl
from traceaudit.plans.base import CLAIMED, EXTRACTED, FACTS, GENERIC, LEXICON, PAIRS, claimed, extracted, facts, query, sql_groups, sql_norm, turn_pairs
from traceaudit.session import table

joined = lambda c: F.array_join(c, ",").alias(c)


@query(f"WITH {CLAIMED} SELECT id, array_to_string(claimed, ',') AS claimed FROM claimed")
def x8_extract_claims(spark, d):
    return claimed(spark, d).select("id", joined("claimed"))


@query(rf"""WITH {EXTRACTED}, t AS (SELECT id, {sql_norm("coalesce(trace, '')")} AS t FROM extracted), kw(word, g) AS (VALUES {", ".join(f"('{w}{s}', '{g}')" for g, words in LEXICON.items() for w in words for s in ("", "s", "es"))}),
  runs AS (SELECT id, t, unnest(regexp_extract_all(t, '[a-z]+|[^a-z]+')) AS p, generate_subscripts(regexp_extract_all(t, '[a-z]+|[^a-z]+'), 1) AS i FROM t),
  placed AS (SELECT id, t, p, (sum(length(p)) OVER (PARTITION BY id ORDER BY i))::BIGINT AS e FROM runs),
  named AS (SELECT DISTINCT id, g FROM (SELECT *, greatest(0, e - length(p) - 60) AS low FROM placed JOIN kw ON word = p) WHERE NOT regexp_matches(substr(t, low + 1, e + 60 - low), '(^|[^\p{{L}}\p{{N}}_])(nicht|not|pas)([^\p{{L}}\p{{N}}_]|$)'))
  SELECT id, coalesce(string_agg(g, ',' ORDER BY g), '') AS claimed FROM t LEFT JOIN named USING (id) GROUP BY id""")
def x9_claims_outside_derivation(spark, d):
    rows = cl.named_groups_outside(extracted(spark, d), "trace", LEXICON, phrases=r"\bnicht\b|\bnot\b|\bpas\b", column="claimed")
    return rows.select("id", joined("claimed"))


CLASSES = {"von": ("von",), "pour": ("pour",), "this": ("this",)}


@query(f"SELECT doc_id, array_to_string({sql_groups('t', CLASSES)}, ',') AS classes FROM (SELECT doc_id, {sql_norm('text')} AS t FROM documents)")
def x10_extract_classes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(cl.named_groups(F.col("text"), CLASSES), ",").alias("classes"))


@query(f"""WITH {CLAIMED} SELECT id, CASE WHEN len(ps) > 0 THEN (list_min(ps) - 1)::DOUBLE / length(trace) END AS position FROM (
  SELECT id, trace, list_filter(list_transform(list_concat(fabricated, list_transform(fabricated, lambda g: replace(g, '_', ' ')), list_transform(fabricated, lambda g: replace(g, '_', ''))), lambda g: position(g IN lower(trace))), lambda p: p > 0) AS ps FROM claimed)""")
def x12_first_claim_position(spark, d):
    return claimed(spark, d).select("id", cl.first_claim_position(F.col("trace"), F.col("fabricated")).alias("position"))


@query(f"WITH {CLAIMED} SELECT id, model, task, array_to_string(verified, ',') AS verified, array_to_string(fabricated, ',') AS fabricated FROM claimed")
def v1_verify_claims(spark, d):
    return claimed(spark, d).select("id", "model", "task", joined("verified"), joined("fabricated"))


@query(f"""WITH {CLAIMED} SELECT model, task, g AS "group", g IN ('g_the', 'g_and') AS generic, verdict, count(*) AS n FROM (
  SELECT model, task, unnest(verified) AS g, 'verified' AS verdict FROM claimed UNION ALL SELECT model, task, unnest(fabricated), 'fabricated' FROM claimed) GROUP BY ALL""")
def v1_claims_long(spark, d):
    return cl.claims_long(claimed(spark, d), ["model", "task"], GENERIC).groupBy("model", "task", "group", "generic", "verdict").agg(F.count("*").alias("n"))


@query(f"WITH {CLAIMED} SELECT id, array_to_string(evidence, ',') AS evidence FROM claimed")
def v2_evidence_for_task(spark, d):
    return claimed(spark, d).select("id", joined("evidence"))


@query("""SELECT c_mktsegment AS class, broken, count(*) AS n FROM (
  SELECT c_mktsegment, array_to_string(list_filter([CASE WHEN n_orders < min_rings THEN 'rings' END, CASE WHEN floor(total / 10000) < min_carbons THEN 'carbons' END, CASE WHEN requires_n AND NOT has_n THEN 'n' END], lambda x: x IS NOT NULL), ',') AS broken
  FROM (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n_orders, coalesce(sum(o_totalprice), 0) AS total, coalesce(bool_or(o_orderpriority = '1-URGENT'), false) AS has_n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
  JOIN (VALUES ('BUILDING', 10, 100, true), ('MACHINERY', 12, NULL, false), ('AUTOMOBILE', NULL, 120, true)) r(class, min_rings, min_carbons, requires_n) ON class = c_mktsegment) WHERE broken <> '' GROUP BY ALL""")
def v3_class_rules(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    sums = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    rows = c.join(sums, c.c_custkey == sums.o_custkey, "left").select(
        F.col("c_mktsegment").alias("class"), F.coalesce("n", F.lit(0)).alias("rings"), F.floor(F.coalesce("total", F.lit(0.0)) / 10000).alias("carbons"), F.coalesce("urgent", F.lit(False)).alias("has_n")
    )
    rules = spark.createDataFrame([("BUILDING", 10, 100, True), ("MACHINERY", 12, None, False), ("AUTOMOBILE", None, 120, True)], "class string, min_rings int, min_carbons int, requires_n boolean")
    return cl.class_rule_violations(rows, rules).groupBy("class", F.array_join("broken", ",").alias("broken")).agg(F.count("*").alias("n"))


@query(f"WITH {CLAIMED} SELECT id, array_to_string(list_filter(in_gt, lambda x: NOT list_contains(claimed, x)), ',') AS missing, array_to_string(list_filter(claimed, lambda x: NOT list_contains(in_gt, x)), ',') AS extra FROM claimed")
def v4_group_diff(spark, d):
    missing, extra = cl.group_diff(F.col("claimed"), F.col("in_gt"))
    return claimed(spark, d).select("id", F.array_join(missing, ",").alias("missing"), F.array_join(extra, ",").alias("extra"))


@query(f"""WITH {CLAIMED} SELECT id, len(list_filter(verified, lambda x: x NOT IN ('g_the', 'g_and')))::INTEGER AS n_verified, len(list_filter(fabricated, lambda x: x NOT IN ('g_the', 'g_and')))::INTEGER AS n_fabricated FROM claimed""")
def v5_specific_counts(spark, d):
    return claimed(spark, d).select("id", F.size(cl.specific(F.col("verified"), GENERIC)).alias("n_verified"), F.size(cl.specific(F.col("fabricated"), GENERIC)).alias("n_fabricated"))


@query(f"""WITH {EXTRACTED}, {FACTS.strip()} SELECT e.id, f.valid, array_to_string(f.groups, ',') AS groups, len(f.parts)::INTEGER AS n_parts FROM extracted e LEFT JOIN facts f ON f.key = e.gt""")
def j4_facts_join(spark, d):
    from traceaudit.operators.joins import facts_join

    rows = facts_join(extracted(spark, d).select("id", "gt"), facts(spark, d).drop("item_id", "fp"), "gt")
    return rows.select("id", F.col("fact_valid").alias("valid"), F.array_join("fact_groups", ",").alias("groups"), F.size("fact_parts").alias("n_parts"))


@query(f"""WITH {EXTRACTED} SELECT id, contains({sql_norm('trace')}, {sql_norm('pred')}) AS copied FROM extracted WHERE pred IS NOT NULL""")
def j8_copied_from_trace(spark, d):
    return extracted(spark, d).filter("pred IS NOT NULL").select("id", cl.copied_from_trace(F.col("trace"), F.col("pred")).alias("copied"))


WORDS = ["the", "which", "nicht", "dans", "und", "del"]


@query(f"""WITH {PAIRS}, hits AS (SELECT conv_id, turn, k, position(k IN lower(question)) AS a, position(k IN lower(reply)) AS b FROM turn_pairs, (SELECT unnest({WORDS}) AS k))
  SELECT conv_id, turn, arg_min(k, (-length(k), k)) AS keyword, arg_min(a, (-length(k), k))::INTEGER AS left_at, arg_min(b, (-length(k), k))::INTEGER AS right_at FROM hits WHERE a > 0 AND b > 0 GROUP BY ALL""")
def j9_matched_mentions(spark, d):
    m = cl.matched_mention(F.col("question"), F.col("reply"), WORDS)
    return turn_pairs(spark, d).select("conv_id", "turn", m.alias("m")).filter("m IS NOT NULL").select("conv_id", "turn", "m.*")
