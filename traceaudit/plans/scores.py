"""Queries: scores, similarities and the flagship audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.functions import scores as sc
from traceaudit.functions import similarity as sim
from traceaudit.functions import text as tx
from traceaudit.operators import audit, stats
from traceaudit.operators import claims as cl
from traceaudit.operators import joins as jn
from traceaudit.operators import prepare as pr
from traceaudit.plans.base import CLAIMED, EXTRACTED, GENERIC, LEXICON, PAIRS, RESPONSES, SQL_ANSWER, SQL_TRACE, VERDICTS, claimed, evidence, extracted, facts, query, responses, sql_bleu, sql_groups, sql_norm, sql_strip, turn_pairs, verdicts
from traceaudit.session import table


def sql_ir(c: str) -> str:
    n = sql_norm(c)
    quote = lambda p: p.replace("'", "''")
    parts = " + ".join(f"len(regexp_extract_all(n_t, '{quote(p)}')) * {w}" for p, w in sc.CORRECTIONS)
    return f"""(SELECT CASE WHEN length({sql_strip(c)}) >= 20 THEN least(100.0::DOUBLE, {parts}
      + CASE WHEN len(regexp_extract_all(n_t, '{quote(sc.FLIP)}')) > 3 THEN (len(regexp_extract_all(n_t, '{quote(sc.FLIP)}')) - 3) * 5 ELSE 0 END
      + CASE WHEN len(ss) - len(list_distinct(ss)) > 2 THEN (len(ss) - len(list_distinct(ss))) * 3 ELSE 0 END
      + CASE WHEN length({c}) > 10000 THEN least(20.0::DOUBLE, (length({c}) - 10000) / 1000.0::DOUBLE) ELSE 0.0::DOUBLE END) ELSE 0.0::DOUBLE END
      FROM (SELECT {n} AS n_t, list_filter(list_transform(string_split({c}, '.'), lambda s: {sql_norm('s')}), lambda s: length(s) > 20) AS ss))"""


@query(f"SELECT doc_id, {sql_ir('text')} AS ir FROM documents")
def k1_self_contradiction(spark, d):
    return table(spark, d, "documents").select("doc_id", sc.self_contradiction(F.col("text")).cast("double").alias("ir"))


@query(rf"""WITH {EXTRACTED}, p AS (SELECT id, {sql_strip("coalesce(pred, '')")} AS c FROM extracted)
  SELECT id, CASE WHEN length(c) < 10 THEN 80.0::DOUBLE ELSE CASE WHEN contains(lower(c), 'molecule is') THEN 0.0::DOUBLE ELSE 25.0::DOUBLE END + CASE WHEN len(list_filter(string_split_regex(c, '\s+'), lambda w: w <> '')) < 8 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END END AS io FROM p""")
def k2_caption_validity(spark, d):
    return extracted(spark, d).select("id", sc.caption_validity(F.col("pred")).alias("io"))


@query(rf"""WITH {EXTRACTED}, p AS (SELECT id, {sql_strip("coalesce(pred, answer)")} AS c FROM extracted)
  SELECT id, CASE WHEN length(c) < 10 THEN 80.0::DOUBLE ELSE CASE WHEN contains(lower(c), 'molecule is') THEN 0.0::DOUBLE ELSE 25.0::DOUBLE END + CASE WHEN len(list_filter(string_split_regex(c, '\s+'), lambda w: w <> '')) < 8 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END END AS io FROM p""")
def k2_caption_validity_whole(spark, d):
    """Of the whole answer, or of the whole text where it has no tags."""
    return whole_caption_validity(responses(spark, d))


def whole_caption_validity(rows):
    return audit.extract(rows).select("id", sc.caption_validity(F.coalesce("pred", "answer")).alias("io"))


@query("""SELECT l_orderkey, CASE WHEN count(*) > 0 THEN 80.0::DOUBLE * (count(*) - count(*) FILTER (l_returnflag = 'N')) / count(*) ELSE 80.0::DOUBLE END AS io FROM lineitem GROUP BY 1""")
def k2_set_validity(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("p"), F.count(F.when(F.col("l_returnflag") == "N", 1)).alias("v"))
    return per.select("l_orderkey", sc.set_validity(F.col("p"), F.col("v")).alias("io"))


@query(f"""WITH {CLAIMED} SELECT id, CASE WHEN len(claimed) > 0 THEN least(100.0::DOUBLE, 60.0::DOUBLE * len(fabricated) / len(claimed)) ELSE 0.0::DOUBLE END AS er,
  least(100.0::DOUBLE, 15.0::DOUBLE * (5 * len(fabricated) + 8 * w) / (greatest(len(claimed), 1) + w)) AS er_classes FROM (SELECT *, CAST(contains(trace, 'von') AS INTEGER) AS w FROM claimed)""")
def k3_fabrication(spark, d):
    c, f, w = F.size("claimed"), F.size("fabricated"), F.col("trace").contains("von").cast("int")
    return claimed(spark, d).select("id", sc.fabrication(c, f).alias("er"), sc.fabrication(c, f, w).alias("er_classes"))


def sql_tokens(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"


def sql_jaccard(a: str, b: str) -> str:
    return f"(SELECT CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) ELSE 0.0::DOUBLE END FROM (SELECT {sql_tokens(a)} AS x, {sql_tokens(b)} AS y))"


@query(f"""WITH {EXTRACTED}, j AS (SELECT id, coalesce(pred = gt, false) AS exact, CASE WHEN pred IS NOT NULL THEN {sql_jaccard('pred', 'gt')} END AS s FROM extracted)
  SELECT id, CASE WHEN exact THEN 0.0::DOUBLE WHEN s IS NULL THEN 80.0::DOUBLE ELSE 100 * (1 - s) END AS eo, CASE WHEN s >= 0.85 THEN 0.0::DOUBLE ELSE 100 * (1 - s) END AS eo_caption,
    CASE WHEN s IS NULL THEN 100.0::DOUBLE WHEN s >= 1 THEN 60.0::DOUBLE WHEN s < 0.2 THEN 80.0::DOUBLE WHEN s > 0.95 THEN 40.0::DOUBLE ELSE 50 * (1 - s) END AS eo_edit FROM j""")
def k4_deviation(spark, d):
    s = F.when(F.col("pred").isNotNull(), sim.token_jaccard(F.col("pred"), F.col("gt")))
    rows = extracted(spark, d).select("id", F.coalesce(F.col("pred") == F.col("gt"), F.lit(False)).alias("exact"), s.alias("s"))
    return rows.select("id", sc.deviation(F.col("exact"), F.col("s")).alias("eo"), sc.caption_deviation(F.col("s")).alias("eo_caption"), sc.edit_deviation(F.col("s").isNotNull(), F.lit(True), F.col("s")).alias("eo_edit"))


@query("""WITH t AS (SELECT p_partkey AS k, p_size AS want, coalesce(c, 0) AS got, p_size % 10 AS want2, coalesce(q, 0) AS got2 FROM part LEFT JOIN (SELECT l_partkey, count(*) AS c, count(*) FILTER (l_returnflag = 'R') AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)
  SELECT k, CASE WHEN want > 0 OR want2 > 0 THEN least(100.0::DOUBLE, 100 * (CASE WHEN want > 0 THEN abs(got - want) / want::DOUBLE ELSE 0 END + CASE WHEN want2 > 0 THEN abs(got2 - want2) / want2::DOUBLE ELSE 0 END) / ((want > 0)::INTEGER + (want2 > 0)::INTEGER)) ELSE 0.0::DOUBLE END AS eo,
    CAST((want <= 0 OR got = want) AND (want2 <= 0 OR got2 = want2) AS INTEGER) AS success FROM t""")
def k5_k6_constraints(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("c"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("q"))
    part = table(spark, d, "part")
    rows = part.join(counts, part.p_partkey == counts.l_partkey, "left")
    targets = F.create_map(F.lit("all"), F.col("p_size").cast("string"), F.lit("returned"), (F.col("p_size") % 10).cast("string"))
    got = F.create_map(F.lit("all"), F.coalesce("c", F.lit(0)).cast("int"), F.lit("returned"), F.coalesce("q", F.lit(0)).cast("int"))
    return rows.select(F.col("p_partkey").alias("k"), sc.constraint_deviation(targets, got).alias("eo"), sc.constraint_success(targets, got).alias("success"))


OVERALL = """CASE WHEN m > 0 THEN t / m END AS overall FROM (SELECT *, 0.15 * ir + CASE WHEN no_io THEN 0.0 ELSE 0.25 * io END + CASE WHEN no_er THEN 0.0 ELSE 0.25 * er END + CASE WHEN no_eo THEN 0.0 ELSE 0.35 * eo END AS t,
  (0.15 + CASE WHEN no_io THEN 0.0 ELSE 0.25 END + CASE WHEN no_er THEN 0.0 ELSE 0.25 END + CASE WHEN no_eo THEN 0.0 ELSE 0.35 END)::DOUBLE AS m
  FROM (SELECT *, er IS NULL AS no_er, doc_id % 13 = 0 AS no_io, doc_id % 13 = 0 AS no_eo FROM verdicts))"""


def overall_of(df):
    skip = {"er": F.col("er").isNull(), "io": F.col("doc_id") % 13 == 0, "eo": F.col("doc_id") % 13 == 0}
    return df.withColumn("overall", sc.overall({k: F.col(k) for k in ("ir", "io", "er", "eo")}, skip))


@query(f"WITH {VERDICTS} SELECT id, round({OVERALL.replace(' AS overall', ', 9) AS overall', 1)}")
def k7_overall_score(spark, d):
    return overall_of(verdicts(spark, d)).select("id", F.round("overall", 9).alias("overall"))


@query(f"""WITH {VERDICTS}, o AS (SELECT *, {OVERALL}) SELECT task, CASE WHEN overall < 30 THEN 'low' WHEN overall < 60 THEN 'moderate' ELSE 'high' END AS band,
  CASE WHEN er IS NULL THEN 'na' WHEN er = 0 THEN '0' WHEN er <= 25 THEN '<=25' ELSE '>25' END AS er_bin, count(*) AS n FROM (SELECT task, er, round(overall, 9) AS overall FROM o) GROUP BY ALL""")
def k8_bands(spark, d):
    rows = overall_of(verdicts(spark, d)).withColumn("overall", F.round("overall", 9))
    return rows.groupBy("task", sc.band(F.col("overall"), (30, 60), ("low", "moderate", "high")).alias("band"), sc.er_bin(F.col("er")).alias("er_bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {VERDICTS}, o AS (SELECT *, {OVERALL}), g AS (SELECT *, CASE WHEN v > 0 THEN 2 * least(v, 5) / 5.0::DOUBLE * v / (v + f) ELSE 0.0::DOUBLE END AS g FROM (SELECT *, doc_id % 6 AS v, doc_id % 4 AS f FROM o WHERE er IS NOT NULL))
  SELECT id, round(0.1 + 0.4 * CASE WHEN er = 0 AND exact THEN 1.0 ELSE 0.0 END + 0.4 * (1 - overall / 100) + 0.2 * g, 9) AS coupled, round(0.1 + 0.4 * exact::INTEGER + 0.4 * (1 - overall / 100) + 0.2 * g, 9) AS plain FROM g""")
def k10_grounded_reward(spark, d):
    rows = overall_of(verdicts(spark, d)).filter("er IS NOT NULL")
    g = sc.grounded(F.col("doc_id") % 6, F.col("doc_id") % 4)
    reward = lambda c: F.round(sc.grounded_reward(F.lit(1.0), F.col("exact").cast("double"), F.col("overall"), g, F.col("er"), c), 9)
    return rows.select("id", reward(True).alias("coupled"), reward(False).alias("plain"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, {sql_jaccard('question', 'reply')} AS jaccard FROM turn_pairs")
def m1_token_jaccard(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", sim.token_jaccard(F.col("question"), F.col("reply")).alias("jaccard"))


@query("""WITH b AS (SELECT vec_id, label, list_filter(list_transform(range(0, len(embedding)), lambda i: CASE WHEN embedding[i + 1] > 0 THEN i END), lambda i: i IS NOT NULL) AS fp, embedding FROM embeddings)
  SELECT a.vec_id, round(len(list_intersect(a.fp, b.fp))::DOUBLE / len(list_distinct(list_concat(a.fp, b.fp))), 6) AS tanimoto, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM b a JOIN b ON b.vec_id = a.vec_id + 1""")
def m2_m3_vector_similarity(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    a, b = F.col("embedding"), F.col("other")
    return e.join(nxt, "vec_id").select("vec_id", F.round(sim.tanimoto(sim.on_bits(a), sim.on_bits(b)), 6).alias("tanimoto"), F.round(sim.cosine(a, b), 6).alias("cosine"))


@query("""SELECT a.event_id, greatest(0.0::DOUBLE, 1 - abs(a.value - b.value) / 5.0::DOUBLE) AS similarity, CAST(a.event_type = b.event_type AS INTEGER) AS same FROM events a JOIN events b ON b.event_id = a.event_id + 1""")
def m4_m5_value_similarity(spark, d):
    e = table(spark, d, "events")
    nxt = e.select((F.col("event_id") - 1).alias("event_id"), F.col("value").alias("v"), F.upper("event_type").alias("t"))
    return e.join(nxt, "event_id").select("event_id", sim.numeric_similarity(F.col("value"), F.col("v"), 5.0).alias("similarity"), sim.label_match(F.col("event_type"), F.col("t")).alias("same"))


@query()
def m6_best_match(spark, d):
    f = facts(spark, d).select("item_id", F.transform("parts", lambda p: F.array_distinct(F.split(p, " "))).alias("sets"))
    nxt = f.select((F.col("item_id") - 1).alias("item_id"), F.col("sets").alias("other"))
    return f.join(nxt, "item_id").select("item_id", sim.best_match(F.col("sets"), F.col("other")).alias("similarity"))


@query(f"""WITH {EXTRACTED} SELECT model, task, count(*) AS n, count(*) FILTER ({sql_norm('coalesce(pred, answer)')} = {sql_norm('gt')}) AS n_exact, count(*) FILTER (pred IS NOT NULL AND {sql_jaccard('pred', 'gt')} >= 0.1) AS n_close FROM extracted GROUP BY ALL""")
def m7_exact_match(spark, d):
    rows = extracted(spark, d).withColumn("said", tx.normalize_text(F.coalesce("pred", "answer")))
    rows = jn.exact_by_facts(rows, facts(spark, d).dropDuplicates(["key"]), "said", "gt")
    close = F.col("pred").isNotNull() & (sim.token_jaccard(F.col("pred"), F.col("gt")) >= 0.1)
    return rows.groupBy("model", "task").agg(F.count("*").alias("n"), F.count(F.when(F.col("exact"), 1)).alias("n_exact"), F.count(F.when(close, 1)).alias("n_close"))


@query("""WITH b AS (SELECT vec_id, label, list_filter(list_transform(range(0, len(embedding)), lambda i: CASE WHEN embedding[i + 1] > 0 THEN i END), lambda i: i IS NOT NULL) AS fp FROM embeddings)
  SELECT a.vec_id AS id, round(1 - max(len(list_intersect(a.fp, b.fp))::DOUBLE / len(list_distinct(list_concat(a.fp, b.fp)))), 6) AS novelty FROM b a, b WHERE a.label < 5 AND b.label >= 5 GROUP BY 1""")
def m8_novelty(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", sim.on_bits(F.col("embedding")).alias("bits"))
    return sim.novelty(e.filter("label < 5"), e.filter("label >= 5")).select("id", F.round("novelty", 6).alias("novelty"))


BLEU_PAIRS = f"""WITH {PAIRS}, p AS (SELECT conv_id, turn, question AS ref, reply AS hyp FROM turn_pairs), {sql_bleu("p", "conv_id, turn")}
  SELECT conv_id, turn, round(bleu2, 9) AS bleu2, round(bleu4, 9) AS bleu4 FROM bleus"""


@query(BLEU_PAIRS)
def m9_bleu(spark, d):
    both = turn_pairs(spark, d).select("conv_id", "turn", sim.bleus(F.col("question"), F.col("reply")).alias("b"))
    return both.select("conv_id", "turn", F.round("b.bleu2", 9).alias("bleu2"), F.round("b.bleu4", 9).alias("bleu4"))


@query(f"""WITH {PAIRS}, t AS (SELECT conv_id, turn, regexp_extract_all(lower(question), '[a-z0-9]+') AS a, regexp_extract_all(lower(reply), '[a-z0-9]+') AS b FROM turn_pairs),
  x AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(a) AS w FROM t) GROUP BY ALL), y AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(b) AS w FROM t) GROUP BY ALL),
  h AS (SELECT conv_id, turn, sum(least(x.c, y.c)) AS hits FROM x JOIN y USING (conv_id, turn, w) GROUP BY ALL)
  SELECT conv_id, turn, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN 2.0::DOUBLE * coalesce(hits, 0) / (len(a) + len(b)) ELSE 0.0 END, 9) AS rouge1 FROM t LEFT JOIN h USING (conv_id, turn)""")
def m10_rouge_1(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", F.round(sim.rouge_n(F.col("question"), F.col("reply"), 1), 9).alias("rouge1"))


@query(f"""WITH {PAIRS}, t AS (SELECT conv_id, turn, regexp_extract_all(lower(question), '[a-z0-9]+') AS a, regexp_extract_all(lower(reply), '[a-z0-9]+') AS b FROM turn_pairs),
  x AS (SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest([a[i] || ' ' || a[i + 1] FOR i IN range(1, len(a))]) AS g FROM t) GROUP BY ALL),
  y AS (SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest([b[i] || ' ' || b[i + 1] FOR i IN range(1, len(b))]) AS g FROM t) GROUP BY ALL),
  h AS (SELECT conv_id, turn, sum(least(x.c, y.c)) AS hits FROM x JOIN y USING (conv_id, turn, g) GROUP BY ALL)
  SELECT conv_id, turn, round(CASE WHEN len(a) > 1 AND len(b) > 1 THEN 2.0::DOUBLE * coalesce(hits, 0) / (len(a) + len(b) - 2) ELSE 0.0 END, 9) AS rouge2 FROM t LEFT JOIN h USING (conv_id, turn)""")
def m10_rouge_2(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", F.round(sim.rouge_n(F.col("question"), F.col("reply"), 2), 9).alias("rouge2"))


@query()
def m10_rouge_l(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", F.round(sim.rouge_n(F.col("question"), F.col("reply"), 2), 9).alias("rouge2"), F.round(sim.rouge_l(F.col("question"), F.col("reply")), 9).alias("rouge_l"))


@query("""WITH p AS (SELECT doc_id, string_split(lang || '.' || source, '.') AS ps FROM documents), s AS (SELECT doc_id, unnest(ps) AS part FROM p)
  SELECT doc_id, count(*) AS n_parts, count(*) FILTER (part IN (SELECT lang FROM documents)) AS n_valid, count(*) = count(*) FILTER (part IN (SELECT lang FROM documents)) AS all_valid FROM s GROUP BY 1""")
def m11_set_validity(spark, d):
    docs = table(spark, d, "documents")
    known = docs.select(F.col("lang").alias("key")).distinct().withColumn("valid", F.lit(True))
    parts = docs.select("doc_id", F.explode(F.split(F.concat_ws(".", "lang", "source"), r"\.")).alias("part"))
    per = jn.set_counts_by_facts(parts, known, ["doc_id"], "part")
    return per.select("doc_id", F.col("parts").alias("n_parts"), F.col("valid_parts").alias("n_valid"), (F.col("parts") == F.col("valid_parts")).alias("all_valid"))


@query("SELECT bucket, count(*) AS n FROM (SELECT (CASE WHEN p_retailprice > 1500 THEN 'heavy' ELSE 'light' END) || '/' || (CASE WHEN p_size > 25 THEN 'complex' ELSE 'simple' END) AS bucket FROM part) GROUP BY 1")
def m12_property_bucket(spark, d):
    return table(spark, d, "part").groupBy(sim.property_bucket(F.col("p_retailprice"), F.col("p_size"), 1500, 25).alias("bucket")).agg(F.count("*").alias("n"))


def audited(spark, d):
    """Responses with all scores, ready for the roll-ups."""
    return audit.diagnose(responses(spark, d), LEXICON, GENERIC, evidence())


AUDITED = CLAIMED + rf""",
scored AS (
  SELECT *, {sql_ir('trace')} AS ir,
    CASE WHEN length(coalesce(pred, '')) < 10 THEN 80.0::DOUBLE ELSE CASE WHEN contains(lower(pred), 'molecule is') THEN 0.0::DOUBLE ELSE 25.0::DOUBLE END + CASE WHEN len(list_filter(string_split_regex(pred, '\s+'), lambda w: w <> '')) < 8 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END END AS io,
    CASE WHEN len(claimed) > 0 THEN least(100.0::DOUBLE, 60.0::DOUBLE * len(fabricated) / len(claimed)) ELSE 0.0::DOUBLE END AS er,
    CASE WHEN pred IS NOT NULL THEN {sql_jaccard('pred', 'gt')} ELSE 0.0::DOUBLE END AS perf,
    len(list_filter(verified, lambda x: x NOT IN ('g_the', 'g_and'))) AS n_verified, len(list_filter(fabricated, lambda x: x NOT IN ('g_the', 'g_and'))) AS n_fabricated, length(trace) AS trace_length FROM claimed),
audited AS (
  SELECT *, (0.15 * ir + 0.25 * io + CASE WHEN len(claimed) = 0 THEN 0.0 ELSE 0.25 * er END + CASE WHEN pred IS NULL THEN 0.0 ELSE 0.35 * eo END)
    / (0.4 + CASE WHEN len(claimed) = 0 THEN 0.0 ELSE 0.25 END + CASE WHEN pred IS NULL THEN 0.0 ELSE 0.35 END)::DOUBLE AS overall
  FROM (SELECT *, CASE WHEN perf >= 0.85 THEN 0.0::DOUBLE ELSE 100 * (1 - perf) END AS eo FROM scored))"""
ROUNDED = ("perf", "perf_er0", "perf_erpos", "pct_er0", "overall", "ir", "io", "er", "eo", "grounded_claims", "claim_precision", "length", "info")
STATS = """count(*) AS n, round(100 * avg(perf), 6) AS perf, round(100 * avg(perf) FILTER (er = 0), 6) AS perf_er0, round(100 * avg(perf) FILTER (er > 0), 6) AS perf_erpos, round(100 * avg(CAST(er = 0 AS INTEGER)), 6) AS pct_er0,
  round(avg(overall), 6) AS overall, round(avg(ir), 6) AS ir, round(avg(io), 6) AS io, round(avg(er), 6) AS er, round(avg(eo), 6) AS eo, round(avg(n_verified), 6) AS grounded_claims,
  round(CASE WHEN sum(n_verified) + sum(n_fabricated) > 0 THEN 100.0 * sum(n_verified) / (sum(n_verified) + sum(n_fabricated)) END, 6) AS claim_precision, round(avg(trace_length), 6) AS length, round(1000.0 * sum(n_verified) / greatest(sum(trace_length), 1), 6) AS info"""


@query(f"WITH {AUDITED} SELECT model, task, {STATS} FROM audited GROUP BY ALL")
def flagship_task_stats(spark, d):
    """From tagged text to a table per model and task: extract, claim, verify, score, roll up."""
    return stats.task_stats(audited(spark, d), ["model", "task"]).select("model", "task", "n", *[F.round(c, 6).alias(c) for c in ROUNDED])


@query(f"""WITH {EXTRACTED}, s AS (SELECT id, task, coalesce(pred = gt, false) AS exact, CASE WHEN pred IS NOT NULL THEN {sql_jaccard('pred', 'gt')} END AS cap, length(pred) % 2 AS ok FROM extracted)
  SELECT task, count(*) AS n, round(avg(coalesce(CASE task WHEN 'en' THEN cap WHEN 'de' THEN ok::DOUBLE ELSE exact::INTEGER::DOUBLE END, 0.0)), 6) AS perf FROM s GROUP BY 1""")
def k9_task_performance(spark, d):
    rows = extracted(spark, d)
    kind = F.when(F.col("task") == "en", "caption").when(F.col("task") == "de", "constraint").otherwise("exact")
    cap = F.when(F.col("pred").isNotNull(), sim.token_jaccard(F.col("pred"), F.col("gt")))
    perf = audit.task_performance(kind, F.coalesce(F.col("pred") == F.col("gt"), F.lit(False)), cap, F.length("pred") % 2)
    return rows.groupBy("task").agg(F.count("*").alias("n"), F.round(F.avg(perf), 6).alias("perf"))


@query(f"""WITH {EXTRACTED}, p AS (SELECT id, gt AS ref, left(coalesce(pred, ''), 500) AS hyp FROM extracted), {sql_bleu("p", "id")}
  SELECT id, round(CASE WHEN hyp <> '' AND coalesce(ref, '') <> '' THEN bleu4 ELSE 0.0 END, 9) AS perf FROM p JOIN bleus USING (id)""")
def k9_caption_performance(spark, d):
    return responses(spark, d).filter("answer IS NOT NULL AND answer <> ''").select("id", F.round(audit.caption_performance(F.col("answer"), F.col("gt")), 9).alias("perf"))


@query(BLEU_PAIRS)
def u3_registered_bleu(spark, d):
    audit.register(spark)
    return turn_pairs(spark, d).selectExpr("conv_id", "turn", "round(bleu2(question, reply), 9) AS bleu2", "round(bleu4(question, reply), 9) AS bleu4")


#: Language and every other ten documents -> family; a code that is missing here is an unknown task.
FAMILY_OF = {"en0": "caption", "en1": "structure", "de0": "label", "de1": "constraint", "fr0": "set", "fr1": "edit", "es0": "label"}
EVIDENCE_OF = {"caption": ("question",), "label": ("question",), "structure": ("question", "pred", "gt")}


def sql_groups_outside(c: str) -> str:
    """sql_groups, of keywords without a derivation phrase around them."""
    from traceaudit.operators.claims import DERIVATION, DERIVATION_WINDOW

    def named(words):
        at = f"regexp_extract(substr({c}, i), '^((?:{'|'.join(words)})(?:e?s)?)(?:[^a-z]|$)', 1)"
        near = f"substr({c}, greatest(1, i - {DERIVATION_WINDOW}), i + length({at}) + {DERIVATION_WINDOW} - greatest(1, i - {DERIVATION_WINDOW}))"
        return f"len(list_filter(range(1, length({c}) + 1), lambda i: {at} <> '' AND NOT regexp_matches(substr({c}, i - 1, 1), '^[a-z]') AND NOT regexp_matches({near}, '{DERIVATION}'))) > 0"

    cases = ", ".join(f"CASE WHEN {named(words)} THEN '{g}' END" for g, words in LEXICON.items())
    return f"CASE WHEN regexp_matches({c}, '{DERIVATION}') THEN list_sort(list_filter([{cases}], lambda x: x IS NOT NULL)) ELSE {sql_groups(c)} END"


def sql_parts(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, '.'), lambda p: {sql_strip('p')}), lambda p: p <> '')"


def sql_canonical(parts: str) -> str:
    return f"list_sort(list_transform(list_filter({parts}, lambda p: length(p) % 7 <> 0), lambda p: {sql_norm('p')}))"


SQL_WHOLE = f"coalesce(tagged, {sql_strip('answer')})"
SQL_SET_SIMILARITY = """list_avg(list_transform(truth_set, lambda a: list_max(list_transform(pred_set, lambda b:
    len(list_intersect(string_split(a, ' '), string_split(b, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' '))))))))"""
BY_FAMILY = RESPONSES + rf""",
families(code, family) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in FAMILY_OF.items())}),
routed AS (SELECT id, family, question, gt, CASE WHEN family = 'label' AND doc_id % 3 = 1 THEN replace(answer, '<answer>', '<answer>Yes ') ELSE answer END AS answer
  FROM responses JOIN families ON code = task || (doc_id // 10) % 2 WHERE answer <> ''),
tags AS (SELECT *, {SQL_ANSWER} AS tagged, coalesce({SQL_TRACE}, answer) AS trace FROM routed),
preds AS (SELECT *, CASE WHEN family = 'label' THEN nullif(regexp_extract(lower({SQL_WHOLE}), '(^|[^\pL\pN_])(yes|no)([^\pL\pN_]|$)', 2), '') WHEN family IN ('caption', 'set') THEN {SQL_WHOLE}
    WHEN family = 'structure' THEN coalesce(tagged, nullif(regexp_extract(answer, '{tx.BARE_STRUCTURE}'), '')) ELSE tagged END AS pred FROM tags),
texts AS (SELECT *, {sql_norm('question')} AS nq, {sql_norm('gt')} AS ng, {sql_norm("coalesce(pred, '')")} AS np, {sql_norm('trace')} AS nt, {sql_norm("concat_ws(' ', trace, pred)")} AS nc FROM preds),
named AS (SELECT *, {sql_groups('nq')} AS in_question, {sql_groups('ng')} AS in_gt, {sql_groups('np')} AS in_pred,
    CASE family WHEN 'structure' THEN {sql_groups_outside('nt')} WHEN 'caption' THEN {sql_groups('nc')} ELSE {sql_groups('nt')} END AS claimed FROM texts),
checked AS (SELECT *, list_filter(claimed, lambda x: NOT list_contains(evidence, x)) AS fabricated, {sql_ir('trace')} AS ir, coalesce(pred IS NOT NULL AND length(pred) % 7 <> 0, false) AS ok, {sql_jaccard('pred', 'gt')} AS jac,
    {sql_jaccard('pred', 'question')} AS near, {sql_parts('pred')} AS parts, {sql_canonical(sql_parts('pred'))} AS pred_set, {sql_canonical(sql_parts('gt'))} AS truth_set, list_intersect(in_question, claimed) AS known,
    list_distinct(regexp_extract_all(trace, '[A-Z][a-z]{{6,}}')) AS frags, CAST(contains(trace, 'von') AS INTEGER) AS wrong, CASE WHEN length(gt) % 2 = 1 THEN 'yes' ELSE 'no' END AS truth_label, length(gt) % 4 AS t1, length(gt) % 3 AS t2
  FROM (SELECT *, CASE WHEN family IN ('caption', 'label') THEN in_question WHEN family = 'structure' THEN list_concat(in_question, in_pred, in_gt) ELSE list_concat(in_question, in_pred) END AS evidence FROM named)),
dims AS (SELECT *,
    CASE family WHEN 'caption' THEN CASE WHEN length(pred) < 10 THEN 80.0::DOUBLE ELSE CASE WHEN contains(lower(pred), 'molecule is') THEN 0.0::DOUBLE ELSE 25.0::DOUBLE END + CASE WHEN len(list_filter(string_split_regex(pred, '\s+'), lambda w: w <> '')) < 8 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END END
      WHEN 'label' THEN CASE WHEN pred IS NULL THEN 70.0::DOUBLE ELSE 0.0::DOUBLE END
      WHEN 'set' THEN CASE WHEN len(parts) > 0 THEN 80.0::DOUBLE * (len(parts) - len(pred_set)) / len(parts) ELSE 80.0::DOUBLE END
      WHEN 'structure' THEN CASE WHEN ok THEN least(100.0::DOUBLE, least(40.0::DOUBLE, 10.0::DOUBLE * (length(pred) % 6)) + CASE WHEN len(in_question) > 0 THEN 30.0::DOUBLE * len(list_filter(in_question, lambda x: NOT list_contains(in_pred, x))) / len(in_question) ELSE 0 END
        + CASE WHEN length({sql_strip('trace')}) > 20 AND len(known) > 0 THEN 25.0::DOUBLE * len(list_filter(known, lambda x: NOT list_contains(in_pred, x))) / len(known) ELSE 0 END
        + CASE WHEN length({sql_strip('trace')}) > 20 AND len(frags) > 0 THEN 15.0::DOUBLE * len(list_filter(frags, lambda x: NOT contains(pred, x))) / len(frags) ELSE 0 END) ELSE 0.0::DOUBLE END
      ELSE CASE WHEN ok THEN 0.0::DOUBLE ELSE 80.0::DOUBLE END END AS io,
    CASE WHEN family = 'structure' THEN least(100.0::DOUBLE, 15.0::DOUBLE * (5 * len(fabricated) + 8 * wrong) / (greatest(len(claimed), 1) + 2 * wrong)) WHEN len(claimed) > 0 THEN least(100.0::DOUBLE, 60.0::DOUBLE * len(fabricated) / len(claimed)) ELSE 0.0::DOUBLE END AS er,
    CASE family WHEN 'caption' THEN CASE WHEN jac >= 0.85 THEN 0.0::DOUBLE ELSE 100 * (1 - jac) END WHEN 'label' THEN CASE WHEN pred IS NULL OR pred = truth_label THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END
      WHEN 'set' THEN CASE WHEN pred_set = truth_set THEN 0.0::DOUBLE WHEN len(pred_set) = 0 OR len(truth_set) = 0 THEN 80.0::DOUBLE ELSE 100 * (1 - {SQL_SET_SIMILARITY}) END
      WHEN 'structure' THEN CASE WHEN NOT ok OR np = ng THEN 0.0::DOUBLE WHEN length(gt) % 5 = 0 THEN 80.0::DOUBLE ELSE 100 * (1 - jac) END
      WHEN 'edit' THEN CASE WHEN NOT ok THEN 100.0::DOUBLE WHEN length(gt) % 6 = 0 THEN 50.0::DOUBLE WHEN np = nq THEN 60.0::DOUBLE WHEN near < 0.2 THEN 80.0::DOUBLE WHEN near > 0.95 THEN 40.0::DOUBLE ELSE 50 * (1 - near) END
      ELSE CASE WHEN NOT ok THEN 100.0::DOUBLE WHEN t1 > 0 OR t2 > 0 THEN least(100.0::DOUBLE, 100 * (CASE WHEN t1 > 0 THEN abs(length(pred) % 4 - t1) / t1::DOUBLE ELSE 0 END + CASE WHEN t2 > 0 THEN abs(length(pred) % 3 - t2) / t2::DOUBLE ELSE 0 END) / ((t1 > 0)::INTEGER + (t2 > 0)::INTEGER)) ELSE 0.0::DOUBLE END END AS eo,
    CASE family WHEN 'caption' THEN len(list_filter(string_split_regex(pred, '\s+'), lambda w: w <> '')) >= 3 WHEN 'label' THEN pred IS NOT NULL WHEN 'set' THEN len(parts) > 0 AND len(parts) = len(pred_set) ELSE ok END AS pred_valid,
    CASE family WHEN 'caption' THEN jac WHEN 'label' THEN coalesce(pred = truth_label, false)::INTEGER::DOUBLE WHEN 'set' THEN (len(pred_set) > 0 AND pred_set = truth_set)::INTEGER::DOUBLE WHEN 'structure' THEN (ok AND np = ng)::INTEGER::DOUBLE
      WHEN 'edit' THEN coalesce(length(pred) > length(question), false)::INTEGER::DOUBLE ELSE coalesce((t1 <= 0 OR length(pred) % 4 = t1) AND (t2 <= 0 OR length(pred) % 3 = t2), false)::INTEGER::DOUBLE END AS perf,
    family = 'structure' AND NOT ok AS no_io, family <> 'structure' AND len(claimed) = 0 AS no_er, (family = 'structure' AND NOT ok) OR (family = 'label' AND pred IS NULL) OR (family = 'set' AND len(pred_set) = 0) AS no_eo FROM checked)"""


@query(f"""WITH {BY_FAMILY} SELECT id, family, round(ir, 6) AS ir, round(io, 6) AS io, round(er, 6) AS er, round(eo, 6) AS eo, round(perf, 6) AS perf, pred_valid, CASE WHEN NOT pred_valid THEN CASE WHEN coalesce(pred, '') = '' THEN 'no_prediction' ELSE 'invalid' END END AS validity_issue,
  round((0.15 * ir + CASE WHEN no_io THEN 0.0 ELSE 0.25 * io END + CASE WHEN no_er THEN 0.0 ELSE 0.25 * er END + CASE WHEN no_eo THEN 0.0 ELSE 0.35 * eo END) / (0.15 + CASE WHEN no_io THEN 0.0 ELSE 0.25 END + CASE WHEN no_er THEN 0.0 ELSE 0.25 END + CASE WHEN no_eo THEN 0.0 ELSE 0.35 END)::DOUBLE, 6) AS overall FROM dims""")
def u3_diagnose_families(spark, d):
    """Responses routed to all six task families and scored by the rules of each."""
    dimension = spark.createDataFrame(list(FAMILY_OF.items()), "code string, family string")
    rows = responses(spark, d).withColumn("code", F.concat("task", (F.floor(F.col("doc_id") / 10) % 2).cast("string")))
    rows, _ = pr.route_tasks(rows, dimension, "code")
    yes = F.when((F.col("family") == "label") & (F.col("doc_id") % 3 == 1), F.replace("answer", F.lit("<answer>"), F.lit("<answer>Yes "))).otherwise(F.col("answer"))
    rows = audit.extract(rows.withColumn("answer", yes), family="family")
    named = {c: cl.named_groups(F.col(c), LEXICON) for c in ("gt", "question", "pred")}
    rows = audit.verify(rows, LEXICON, cl.evidence_for_task(F.col("family"), named, EVIDENCE_OF, ("question", "pred")), family="family")
    pred, gt, question, n, length = F.col("pred"), F.col("gt"), F.col("question"), F.length("gt"), F.coalesce(F.length("pred"), F.lit(0))
    same = lambda a, b: tx.normalize_text(a) == tx.normalize_text(b)
    parts = lambda c: F.filter(F.transform(F.split(c, r"\."), tx.strip), lambda p: p != "")
    good = lambda c: F.transform(F.filter(parts(c), lambda p: F.length(p) % 7 != 0), tx.normalize_text)
    words = lambda c: F.transform(good(c), lambda p: F.array_distinct(F.split(p, " ")))
    fragments = F.array_distinct(F.regexp_extract_all("trace", F.lit("[A-Z][a-z]{6,}"), 0))
    counts = lambda c, kind: F.create_map(F.lit("a"), (c % 4).cast(kind), F.lit("b"), (c % 3).cast(kind))
    targets, got = counts(n, "string"), counts(F.length("pred"), "int")
    success = F.when(F.col("family") == "edit", sc.edit_success(F.lit("up"), F.length("question"), F.length("pred"))).otherwise(sc.constraint_success(targets, got))
    measures = {
        "similarity": F.when(pred.isNotNull(), sim.token_jaccard(pred, gt)), "truth_label": F.when(n % 2 == 1, "Yes").otherwise("No"), "valid": length % 7 != 0,
        "parts": F.size(parts(pred)), "valid_parts": F.size(good(pred)), "pred_set": good(pred), "truth_set": good(gt), "set_similarity": sim.best_match(words(gt), words(pred)),
        "exact": same(pred, gt), "structure_similarity": F.when(n % 5 != 0, sim.token_jaccard(pred, gt)), "violations": length % 6, "wanted": named["question"], "pred_groups": named["pred"],
        "fragments": F.size(fragments), "fragments_found": F.size(F.filter(fragments, lambda x: F.contains(pred, x))), "wrong_classes": F.col("trace").contains("von").cast("int"), "classes": F.lit(2),
        "source_similarity": sim.token_jaccard(pred, question), "unchanged": same(pred, question), "has_source": n % 6 != 0, "targets": targets, "got": got, "success": success,
    }
    out = audit.score_by_family(rows, GENERIC, "family", measures)
    return out.select("id", "family", *[F.round(c, 6).alias(c) for c in ("ir", "io", "er", "eo", "perf")], "pred_valid", "validity_issue", F.round("overall", 6).alias("overall"))
