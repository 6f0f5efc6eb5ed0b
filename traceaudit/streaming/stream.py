"""Incremental scoring: files are scored once as they land, and running statistics follow."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceaudit.operators import stats

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def score_stream(
    spark: SparkSession, source: str, schema, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, keys: list[str], arrival: str | None = None, lateness: str = "1 day", keep: timedelta | None = None, files: int | None = None, by_row: bool = False
) -> None:
    """Score the Parquet files of a folder that were not scored yet, each key once, into out; a restart goes on where the checkpoint ends.

    What keys are known is state, and state has a bound in two of three ways. With `arrival`, a time column, keys are forgotten once the watermark
    passes them by `lateness`. With `keep`, the time is that of the batch that a row lands in: a key is forgotten by the first batch that starts more than `keep` after the one that
    scored it has advanced the watermark, whatever the rows say, so files that land late and out of order are scored. Without either, keys are kept for good. State lies in
    RocksDB, on disk and not in the heap. files: files of one batch at most. A checkpoint belongs to one of these ways. by_row: score makes one row of each row, by itself, and keeps the
    keys (and arrival); it is then applied before the keys meet, so that its columns are shuffled and not the source's, and rows of known keys are scored once more and dropped.
    """
    before, after = (score, lambda df: df) if by_row else (lambda df: df, score)
    reader = spark.readStream.schema(schema)
    rows = before((reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source))
    if keep is not None:
        landed = "_" * (1 + max(len(c) for c in rows.columns))  # a name that no column has
        once = rows.withColumn(landed, F.current_timestamp()).withWatermark(landed, f"{int(keep.total_seconds() * 1000)} milliseconds").dropDuplicatesWithinWatermark(keys).drop(landed)
    elif arrival:
        once = rows.withWatermark(arrival, lateness).dropDuplicatesWithinWatermark(keys)
    else:
        once = rows.dropDuplicates(keys)
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKS):
        query = after(once).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()


def newest_sums(spark: SparkSession, out: str, schema: T.StructType, below: int | None = None) -> DataFrame:
    """The sums of the newest version in out that is complete (of those below a number): one that has as many rows as it says. No rows if there is none."""
    found = spark.read.schema(T.StructType([*schema.fields, T.StructField("rows", T.LongType()), T.StructField("version", T.LongType())])).option("basePath", out).parquet(out)
    if below is not None:
        found = found.filter(F.col("version") < below)
    whole = found.groupBy("version").agg(F.count("*").alias("n"), F.max("rows").alias("rows")).filter("n = rows").agg(F.max("version").alias("version")).filter("version IS NOT NULL")
    return found.join(F.broadcast(whole), "version", "left_semi").drop("rows", "version")  # one row


def add_batch(batch: DataFrame, number: int, by: list[str], out: str) -> None:
    """Version number + 1 of the sums: those of the newest complete version before it and those of the batch. The same batch again gives the same version again."""
    spark, sums = batch.sparkSession, stats.task_sums(batch, by)
    total = stats.merge_sums(newest_sums(spark, out, sums.schema, number + 1).unionByName(sums), by)
    total = total.persist()
    try:
        total.withColumn("rows", F.lit(total.count())).write.mode("overwrite").parquet(f"{out}/version={number + 1}")
    finally:
        total.unpersist()


def running_stats(spark: SparkSession, source: str, schema, by: list[str], out: str, checkpoint: str, score: Callable[[DataFrame], DataFrame] = lambda df: df, files: int | None = None) -> None:
    """Sums of task_stats per `by` over all files that have landed, a version for each batch; see current_stats.

    score turns rows of the schema into rows that task_stats takes. Only sums of a batch and of groups are written, never rows. A version is written beside its predecessors and counts
    once it is whole, so readers see the one before until then, a crash loses nothing, and a batch that is repeated after a restart is added once.
    """
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    empty = stats.task_sums(score(spark.createDataFrame([], rows.schema)), by)
    empty.withColumn("rows", F.lit(0).cast("long")).write.mode("ignore").parquet(f"{out}/version=0")
    query = rows.writeStream.foreachBatch(lambda df, number: add_batch(score(df), number, by, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current_stats(spark: SparkSession, out: str, by: list[str], types: dict[str, str]) -> DataFrame:
    """task_stats per `by` (columns of these types) over all that running_stats has added to out."""
    nothing = spark.createDataFrame([], ", ".join(f"{c} {types[c]}" for c in by) + ", " + stats.TASK_ROW)
    return stats.stats_of_sums(newest_sums(spark, out, stats.task_sums(nothing, by).schema), by)
