"""Windows over the tokens of one document, and first or last records of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalise_within(df: DataFrame, doc: str, value: str, inside: Column, column: str) -> DataFrame:
    """value over its largest value inside the document (1 where that is 0 or missing); 0 outside."""
    top = F.max(F.when(inside, F.col(value))).over(Window.partitionBy(doc))
    top = F.when(F.coalesce(top, F.lit(0.0)) == 0, 1.0).otherwise(top)
    return df.withColumn(column, F.when(inside, F.col(value) / top).otherwise(0.0))


def min_max_within(df: DataFrame, doc: str, value: str, column: str, eps: float = 1e-9) -> DataFrame:
    """(value - least) / (largest - least + eps) inside the document; nulls stay null."""
    low, high = (f(value).over(Window.partitionBy(doc)) for f in (F.min, F.max))
    return df.withColumn(column, (F.col(value) - low) / (high - low + eps))


def hottest_window(df: DataFrame, doc: str, index: str, value: str, focus: Column, size: int = 120) -> DataFrame:
    """(doc, start, total): where the window of `size` tokens with the largest focus sum begins, first on ties; all tokens count in a document without focus value. Full windows only."""
    of_doc = Window.partitionBy(doc)
    w = of_doc.orderBy(index).rowsBetween(0, size - 1)
    any_focus = F.sum(F.when(focus, F.col(value)).otherwise(0.0)).over(of_doc)
    counted = F.when(any_focus > 0, F.when(focus, F.col(value)).otherwise(0.0)).otherwise(F.col(value))
    sums = df.withColumn("_x", counted).withColumn("total", F.sum("_x").over(w)).withColumn("_n", F.count("*").over(w)).filter(F.col("_n") == size)
    return sums.groupBy(doc).agg(F.min(F.struct((-F.round("total", 9)).alias("t"), F.col(index).alias("start"))).alias("m")).select(doc, F.col("m.start").alias("start"), (-F.col("m.t")).alias("total"))


def category_runs(df: DataFrame, doc: str, index: str, category: str) -> DataFrame:
    """Contiguous runs of one category: (doc, category, start, length)."""
    w = Window.partitionBy(doc).orderBy(index)
    fresh = (~F.lag(category).over(w).eqNullSafe(F.col(category))) | F.lag(index).over(w).isNull()
    runs = df.select(doc, index, category, fresh.cast("int").alias("fresh")).withColumn("run", F.sum("fresh").over(w))
    return runs.groupBy(doc, "run", category).agg(F.min(index).alias("start"), F.count("*").alias("length")).drop("run")


def trace_slice(df: DataFrame, doc: str, index: str, lo: float, hi: float) -> DataFrame:
    """Rows from floor(lo n) to before floor(hi n) of each document."""
    at = F.row_number().over(Window.partitionBy(doc).orderBy(index)) - 1
    n = F.count("*").over(Window.partitionBy(doc))
    return df.withColumn("_at", at).withColumn("_n", n).filter((F.col("_at") >= F.floor(lo * F.col("_n"))) & (F.col("_at") < F.floor(hi * F.col("_n")))).drop("_at", "_n")


def pick_first(df: DataFrame, keys: list[str], fallback: Column, position: str) -> DataFrame:
    """The first record of each key by position; records for which fallback is true only where a key has no other. By partial aggregation, not a window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(fallback.cast("int"), F.col(position))).alias("r"))
    return best.select(*keys, "r.*")


def keep_last(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last record of each key by position. By partial aggregation, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(position)).alias("r")).select(*keys, "r.*")
