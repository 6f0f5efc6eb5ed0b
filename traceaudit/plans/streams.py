"""Queries: incremental scoring over a folder of files."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from traceaudit.functions.scores import self_contradiction
from traceaudit.operators import stats
from traceaudit.plans.base import query
from traceaudit.plans.scores import AUDITED, ROUNDED, STATS, audited, sql_ir
from traceaudit.session import scan_parts, scratch_dir, table
from traceaudit.streaming import stream


@query(f"SELECT doc_id, {sql_ir('text')} AS ir FROM documents")
def r1_score_stream(spark, d):
    """All documents, arriving as files of a folder and scored as a stream; the result is what the sink holds after the stream has caught up."""
    home = scratch_dir(spark, "score-stream")
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs.write.parquet(f"{home}/in")
    score = lambda df: df.select("doc_id", self_contradiction(F.col("text")).cast("double").alias("ir"))
    stream.score_stream(spark, f"{home}/in", docs.schema, score, f"{home}/out", f"{home}/checkpoint", ["doc_id"], by_row=True)
    return spark.read.schema("doc_id long, ir double").parquet(f"{home}/out")


@query(f"SELECT doc_id, {sql_ir('text')} AS ir FROM documents")
def r1_score_stream_kept(spark, d):
    """All documents in files that land twice and out of order, half of them at a time; known keys are state with an age limit."""
    home = scratch_dir(spark, "score-stream")
    docs = table(spark, d, "documents").select("doc_id", "text")
    parts = scan_parts(spark, d, "documents", 4)
    docs.repartition(parts, "doc_id").write.parquet(f"{home}/in")
    docs.filter("doc_id % 3 = 0").repartition(parts // 2).write.mode("append").parquet(f"{home}/in")
    score = lambda df: df.select("doc_id", self_contradiction(F.col("text")).cast("double").alias("ir"))
    stream.score_stream(spark, f"{home}/in", docs.schema, score, f"{home}/out", f"{home}/checkpoint", ["doc_id"], keep=timedelta(days=1), files=3 * parts // 4, by_row=True)
    return spark.read.schema("doc_id long, ir double").parquet(f"{home}/out")


@query(f"WITH {AUDITED} SELECT model, task, {STATS} FROM audited GROUP BY ALL")
def r2_running_stats(spark, d):
    """Audited responses, arriving as files and added up batch by batch."""
    home, by = scratch_dir(spark, "running-stats"), ["model", "task"]
    rows = audited(spark, d).select(*by, *[c.split()[0] for c in stats.TASK_ROW.split(", ")])
    rows.repartition(4).write.parquet(f"{home}/in")
    stream.running_stats(spark, f"{home}/in", rows.schema, by, f"{home}/out", f"{home}/checkpoint", files=2)
    return stream.current_stats(spark, f"{home}/out", by, {c: "string" for c in by}).select(*by, "n", *[F.round(c, 6).alias(c) for c in ROUNDED])
