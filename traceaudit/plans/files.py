"""Queries: the readers and writers, by a round trip of the given tables through files of each format."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.functions import text as tx
from traceaudit.plans.base import EXTRACTED, RESPONSES, VERDICTS, extracted, query, responses, sql_strip, verdicts
from traceaudit.session import scratch_dir, table
from traceaudit.sources import records

#: Rows that one JSON array or object holds.
ROWS = 2_000


@query(f"WITH {RESPONSES} SELECT model, task, count(*) AS n, sum(length(answer))::BIGINT AS chars, count(DISTINCT question) AS n_questions FROM responses GROUP BY ALL")
def s1_read_responses(spark, d):
    """JSON arrays of responses, each of ROWS records at most."""
    fields = ["id", "question", "gt", "answer", "model", "task"]
    group = F.floor(F.col("doc_id") / ROWS)
    arrays = responses(spark, d).groupBy(group.alias("g")).agg(F.to_json(F.collect_list(F.struct(*fields))).alias("value"))
    path = scratch_dir(spark, "responses")
    arrays.write.partitionBy("g").text(path)
    return records.read_responses(spark, f"{path}/*/*").groupBy("model", "task").agg(F.count("*").alias("n"), F.sum(F.length("answer")).cast("long").alias("chars"), F.count_distinct("question").alias("n_questions"))


@query(f"""WITH {RESPONSES} SELECT model, task, count(*) AS n, sum(length(answer))::BIGINT AS chars, count(*) FILTER (doc_id % 3 = 0) AS n_tagged, max(CASE WHEN doc_id % 3 = 0 THEN lang END) AS top
  FROM responses JOIN documents USING (doc_id) GROUP BY ALL""")
def s1_read_indented(spark, d):
    """Indented JSON arrays with metadata, of ROWS records at most, each file read by as many tasks as Spark splits it into."""
    metadata = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("lang"), F.col("task"), F.lit("n"), F.col("doc_id").cast("string")))
    record = F.to_json(F.struct("id", "question", "gt", "answer", "model", "task", metadata.alias("metadata")), {"pretty": "true"})
    group = F.floor(F.col("doc_id") / ROWS).alias("g")
    laid = responses(spark, d).select(group, F.concat(F.lit("  "), F.replace(record, F.lit("\n"), F.lit("\n  "))).alias("r"))
    arrays = laid.groupBy("g").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("r"), ",\n"), F.lit("\n]")).alias("value"))
    path = scratch_dir(spark, "indented")
    arrays.write.partitionBy("g").text(path)
    rows = records.read_responses(spark, f"{path}/*/*", indent=2)
    return rows.groupBy("model", "task").agg(F.count("*").alias("n"), F.sum(F.length("answer")).cast("long").alias("chars"), F.count("metadata").alias("n_tagged"), F.max(F.col("metadata")["lang"]).alias("top"))


@query("""SELECT conv_id::VARCHAR AS id, count(*) AS n, sum(length(text))::BIGINT AS chars, md5(arg_min(text, turn)) AS first FROM conversations WHERE text IS NOT NULL GROUP BY 1""")
def s1_read_completions(spark, d):
    """Conversations as prompts with their turns as completions, in JSON arrays of ROWS prompts at most."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    prompts = table(spark, d, "conversations").filter("text IS NOT NULL").groupBy("conv_id").agg(turns.alias("completions")).select(F.col("conv_id").cast("string").alias("id"), F.lit("q").alias("input"), F.lit("").alias("gt"), "completions", F.lit("t").alias("task"))
    arrays = prompts.groupBy(F.floor(F.col("id").cast("long") / ROWS).alias("g")).agg(F.to_json(F.collect_list(F.struct(*prompts.columns))).alias("value"))
    path = scratch_dir(spark, "completions")
    arrays.write.partitionBy("g").text(path)
    rows = records.samples_of(records.read_completions(spark, f"{path}/*/*"))
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"), F.md5(F.min_by("text", "position")).alias("first"))


@query(f"WITH {VERDICTS} SELECT model, task, count(*) AS n, count(*) FILTER (exact) AS n_exact, round(avg(er), 6) AS er, round(avg(0.5 * ir + 0.5 * io), 6) AS overall FROM verdicts GROUP BY ALL")
def s2_read_verdicts(spark, d):
    """JSON lines of verdicts."""
    scores = F.create_map(F.lit("ER"), F.col("er"), F.lit("IR"), F.col("ir"))
    rows = verdicts(spark, d).select("id", "task", "model", F.col("exact").alias("exact_match"), scores.alias("hallucination_scores"), (0.5 * F.col("ir") + 0.5 * F.col("io")).alias("overall_hallucination_score"))
    path = scratch_dir(spark, "verdicts")
    rows.write.option("compression", "gzip").json(path)
    per = records.read_verdicts(spark, path).groupBy("model", "task")
    return per.agg(F.count("*").alias("n"), F.count(F.when(F.col("exact_match"), 1)).alias("n_exact"), F.round(F.avg(F.col("hallucination_scores")["ER"]), 6).alias("er"), F.round(F.avg("overall_hallucination_score"), 6).alias("overall"))


@query("""SELECT event_type, model, count(*) AS n, sum(k) AS total FROM (SELECT event_type, CASE WHEN user_id % 3 = 0 THEN 'a' ELSE 'b' END AS model, CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT) AS k FROM events) GROUP BY ALL""")
def s3_read_sidecar(spark, d):
    """JSON objects {id: metadata}, each of ROWS entries at most, joined back to their events."""
    e = table(spark, d, "events")
    entry = F.struct(F.col("event_id").cast("string"), F.from_json("props", "map<string,string>"))
    objects = e.groupBy(F.floor(F.col("event_id") / ROWS).alias("g")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    path = scratch_dir(spark, "sidecar")
    objects.write.partitionBy("g").text(path)
    side = records.read_sidecar(spark, f"{path}/*/*").select(F.col("id").cast("long").alias("event_id"), F.col("metadata")["k"].cast("long").alias("k"))
    rows = e.select("event_id", "event_type", F.when(F.col("user_id") % 3 == 0, "a").otherwise("b").alias("model")).join(side, "event_id", "left")
    return rows.groupBy("event_type", "model").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query(r"SELECT item_id::VARCHAR AS key, md5(text) AS structure, md5(regexp_replace(text, '[\t\r\n]+', ' ', 'g') || chr(9) || item_id) AS digest FROM benchmark")
def s4_read_pairs_tsv(spark, d):
    """Tab-separated lines with a header in each file; the last part has a tab of its own."""
    b = table(spark, d, "benchmark").repartition(3)
    flat = F.regexp_replace("text", r"[\t\r\n]+", " ")
    rows = b.select(F.col("item_id").cast("string").alias("key"), F.md5("text").alias("structure"), F.concat(flat, F.lit("\t"), F.col("item_id").cast("string")).alias("description"))
    path = scratch_dir(spark, "pairs")
    rows.select(F.concat_ws("\t", "key", "structure", "description").alias("key\tstructure\tdescription")).write.options(header=True, sep="\x01", quote="", escape="").csv(path)
    return records.read_pairs_tsv(spark, path).select("key", "structure", F.md5("description").alias("digest"))


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name || ', \"' || p_brand || '\"' || chr(10) || p_type AS note FROM part")
def s5_read_csv_rows(spark, d):
    """CSV with quotes and line breaks inside values; all values come back as text."""
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\n'), "p_type").alias("note"))
    path = scratch_dir(spark, "csv")
    rows.write.options(header=True, escape='"', quoteAll=True).csv(path)
    return records.read_csv_rows(spark, path)


@query(f"WITH {VERDICTS} SELECT model, task, count(*) AS n, round(sum(CASE WHEN task = 'de' THEN 0 ELSE io END), 6) AS io FROM verdicts GROUP BY ALL")
def s7_write_table(spark, d):
    """A table by (model, task), of which the folders of one task are written again with other values and all others stay."""
    rows = verdicts(spark, d).select("id", "model", "task", "io")
    path = scratch_dir(spark, "table")
    records.write_table(rows, path)
    records.write_table(rows.filter("task = 'de'").withColumn("io", F.lit(0.0)), path)
    return spark.read.parquet(path).groupBy("model", "task").agg(F.count("*").alias("n"), F.round(F.sum("io"), 6).alias("io"))


@query(rf"""WITH {EXTRACTED}, x AS (SELECT *, CASE task WHEN 'en' THEN 'numeric' WHEN 'de' THEN 'label' WHEN 'fr' THEN 'text' ELSE 'other' END AS kind,
    CASE WHEN regexp_matches(answer, '(?s)<answer>.*?</answer>') THEN {sql_strip("regexp_extract(answer, '(?s)<answer>(.*?)</answer>', 1)")} END AS a FROM extracted)
  SELECT id, kind, CASE kind WHEN 'text' THEN pred WHEN 'label' THEN CASE WHEN contains(lower(a), 'yes') THEN 'yes' WHEN contains(lower(a), 'no') THEN 'no' ELSE lower(a) END
    WHEN 'numeric' THEN CASE WHEN coalesce(TRY_CAST(a AS DOUBLE), TRY_CAST(regexp_extract_all(answer, '[-+]?\d*\.?\d+')[-1] AS DOUBLE)) IS NOT NULL THEN 'number' END
    ELSE CASE WHEN length(regexp_extract(pred, '^\S+')) BETWEEN 1 AND 999 THEN regexp_extract(pred, '^\S+') END END AS found FROM x""")
def u1_extractor_registry(spark, d):
    """Each task's answers by the extractor that is registered for its kind, or the default one."""
    kind = F.when(F.col("task") == "en", "numeric").when(F.col("task") == "de", "label").when(F.col("task") == "fr", "text").otherwise("other")
    a = F.col("answer")
    found = tx.extractor("other")(a)
    for name in ("numeric", "label", "text"):
        value = tx.extractor(name)(a)
        found = F.when(kind == name, F.when(value.isNotNull(), F.lit("number")) if name == "numeric" else value).otherwise(found)
    return extracted(spark, d).select("id", kind.alias("kind"), found.alias("found"))
