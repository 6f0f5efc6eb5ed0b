"""Queries: joins on record keys, records kept last, intervals, donors, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.operators import joins as jn
from traceaudit.operators import windows as wn
from traceaudit.plans.base import TOKENS, VERDICTS, query, tokens, verdicts
from traceaudit.session import table
from traceaudit.sources import records


@query(f"WITH {VERDICTS} SELECT v.id, v.er, d.n_chars, CASE WHEN v.doc_id % 2 = 0 THEN d.lang ELSE d.source END AS meta FROM verdicts v LEFT JOIN documents d ON d.doc_id = v.doc_id")
def j1_assemble(spark, d):
    docs = table(spark, d, "documents")
    keys = ["model", "task", "id"]
    keyed = docs.select(F.col("source").alias("model"), F.col("lang").alias("task"), F.col("doc_id").cast("string").alias("id"), "doc_id", "n_chars", "lang", "source")
    own = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("k"), F.col("lang"))).otherwise(F.create_map().cast("map<string,string>"))
    side = keyed.select(*keys, F.create_map(F.lit("k"), F.col("source")).alias("metadata"))
    out = jn.assemble(verdicts(spark, d).select(*keys, "er"), keyed.select(*keys, "n_chars", own.alias("metadata")), side)
    return out.select("id", "er", "n_chars", F.col("metadata")["k"].alias("meta"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j2_pending(spark, d):
    return jn.pending(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]).select("doc_id", "lang")


@query("""WITH a AS (SELECT doc_id, quality, toxic FROM labels WHERE quality IS NOT NULL), b AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels WHERE toxic = 0 OR quality = 0),
  r AS (SELECT coalesce(a.doc_id, b.doc_id) % 10 AS part, coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'f' WHEN a.doc_id IS NULL THEN 's' WHEN a.quality <> b.quality OR a.toxic <> b.toxic THEN 'd' ELSE 'e' END AS k FROM a FULL JOIN b ON a.doc_id = b.doc_id)
  SELECT part, count(*) FILTER (k = 'e') AS n_same, count(*) FILTER (k = 'd') AS n_differing, count(*) FILTER (k = 'f') AS only_fresh, count(*) FILTER (k = 's') AS only_shipped, CASE WHEN count(*) FILTER (k = 'd') > 0 THEN 'quality' END AS first_field,
    count(*) FILTER (k = 'e') > 0 AND count(*) FILTER (k = 'd') = 0 AS passed FROM r GROUP BY 1""")
def j3_diff_records(spark, d):
    labels = table(spark, d, "labels").withColumn("part", F.col("doc_id") % 10)
    a = labels.filter("quality IS NOT NULL")
    b = labels.filter("toxic = 0 OR quality = 0").withColumn("quality", F.when(F.col("doc_id") % 9 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return jn.diff_records(a, b, ["part", "doc_id"], ["quality", "toxic"], ["part"])


@query(f"""WITH {TOKENS}, spans AS (SELECT DISTINCT doc, (token_index // 20) * 120 AS lo, (token_index // 20) * 120 + 64 AS hi, token_index // 20 AS span FROM tokens)
  SELECT t.doc, s.span, count(DISTINCT t.token_index) AS n FROM tokens t JOIN spans s ON s.doc = t.doc AND t.char_start >= s.lo AND t.char_end <= s.hi AND t.char_end > t.char_start GROUP BY ALL""")
def j5_tokens_in_spans(spark, d):
    t = tokens(spark, d)
    k = F.floor(F.col("token_index") / 20)
    spans = t.select("doc", (k * 120).alias("lo"), (k * 120 + 64).alias("hi"), k.alias("span")).distinct()
    return jn.tokens_in_spans(t, spans).groupBy("doc", "span").agg(F.count_distinct("token_index").alias("n"))


@query(f"WITH {TOKENS} SELECT CASE WHEN cat = 'error' THEN 'answer' WHEN region = 'trace' THEN 'trace' WHEN region = 'input' THEN 'input' ELSE 'other' END AS region, count(*) AS n FROM tokens GROUP BY 1")
def j5_regions(spark, d):
    flags = {"answer": F.col("cat") == "error", "trace": F.col("region") == "trace", "input": F.col("region") == "input"}
    return tokens(spark, d).groupBy(jn.region_of(flags).alias("region")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY md5(lang || '|' || doc_id), doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
  SELECT doc_id, donor FROM (SELECT r.doc_id, CASE WHEN a.text <> r.text THEN a.doc_id WHEN b.text <> r.text THEN b.doc_id END AS donor FROM r
  JOIN r a ON a.lang = r.lang AND a.k = (r.k + 1) % r.n JOIN r b ON b.lang = r.lang AND b.k = (r.k + 2) % r.n) WHERE donor IS NOT NULL""")
def j6_pair_donor(spark, d):
    return jn.pair_donor(table(spark, d, "documents"), "lang", "doc_id", "text").select("doc_id", "donor")


@query("""WITH l AS (SELECT user_id AS uid, event_type AS cond, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL)
  SELECT a.uid, a.cond, a.v, b.v AS base_value FROM l a JOIN l b ON a.uid = b.uid AND b.cond = 'view' WHERE a.cond <> 'view'""")
def j7_against_base(spark, d):
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("uid"), F.col("event_type").alias("cond")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    return jn.against_base(last, "uid", "cond", "v", "view")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def w6_keep_last(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("position"), "event_id", "value")
    return wn.keep_last(rows, ["user_id", "event_type"], "position").select("user_id", "event_type", "event_id", "value")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def s6_select_by_index(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    splits = c.groupBy(F.when(F.col("c_mktsegment") == "BUILDING", "valid").otherwise("train").alias("split"), F.floor(F.col("c_custkey") / 1000).alias("b")).agg(F.collect_list("c_custkey").alias("indexes"))
    return records.select_by_index(o, "o_custkey", splits, "val").select("o_orderkey", "o_custkey")


@query(f"WITH {TOKENS} SELECT doc, token_index, cat FROM tokens")
def s8_flatten_tokens(spark, d):
    nested = tokens(spark, d).groupBy("doc").agg(F.collect_list(F.struct("token_index", "cat")).alias("tokens"))
    return records.flatten_tokens(nested, ["doc"])


@query(f"WITH {TOKENS} SELECT doc % 3 AS model, region AS stratum, cat AS type, round(sum(sal), 6) AS share, count(*) AS count FROM tokens GROUP BY ALL")
def s9_melt_nested_maps(spark, d):
    per = tokens(spark, d).groupBy((F.col("doc") % 3).alias("model"), F.col("region").alias("stratum"), F.col("cat").alias("type")).agg(F.round(F.sum("sal"), 6).alias("s"), F.count("*").alias("c"))
    inner = per.groupBy("model", "stratum").agg(F.map_from_entries(F.collect_list(F.struct("type", "s"))).alias("ms"), F.map_from_entries(F.collect_list(F.struct("type", "c"))).alias("mc"))
    maps = inner.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("stratum", "ms"))).alias("shares"), F.map_from_entries(F.collect_list(F.struct("stratum", "mc"))).alias("counts"))
    return records.melt_nested_maps(maps, ["model"], "shares", "counts")
