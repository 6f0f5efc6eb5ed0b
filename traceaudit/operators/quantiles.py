"""Exact quantiles per group by distributed selection, without a buffer or a task that grows with a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.session import cut

#: Distinct values of a group that one window sorts at most.
AT_ONCE = 100_000
#: Cuts that narrow a larger group down in one round, and the accuracy of the sketch that they come from.
CUTS, ACCURACY = 64, 2_000


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on keys where nulls are equal, with left's key columns."""
    renamed = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_on_{k}" for k in keys])


def elements_at(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column], at_once: int = AT_ONCE) -> DataFrame:
    """Per `by`, over rows with a value: n, and the elements of the sorted values at `ranks`, places from 0 as expressions of the column n.

    Values are counted first, so a value is one row however often it occurs. Groups of at most `at_once` distinct values are summed up in order in a window.
    A larger one is narrowed: a sketch of its values gives cuts, sums per bucket between them tell in which bucket each place lies, and only values of
    these buckets go on, as groups of their own. A rough sketch costs a round more and changes no result. Groups without values give no row.
    """
    keys = [*by, "_path"]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c")).withColumn("_path", F.lit(""))
    counts = cut(counts, "quantiles-counts")
    sizes = cut(counts.groupBy(*keys).agg(F.sum("_c").alias("n"), F.count("*").alias("_m")), "quantiles-sizes")
    place = F.explode(F.array(*[F.struct(F.lit(k).alias("_name"), r.cast("long").alias("_r")) for k, r in ranks.items()])).alias("x")
    want, groups, found = sizes.select(*keys, place).select(*keys, "x.*"), sizes, []
    while True:
        large = groups.filter(F.col("_m") > at_once).select(*keys)
        done = large.isEmpty()
        small = counts if done else join_on(counts, large, keys, "left_anti")
        upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v"))
        hits = join_on(small.withColumn("_upto", upto), want, keys).filter((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_c")))
        found.append(hits.select(*by, "_name", "_v"))
        if done:
            break
        rest = join_on(counts, large, keys, "left_semi")
        cuts = F.percentile_approx("_v", F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)]), ACCURACY)
        cuts = cut(rest.groupBy(*keys).agg(F.array_distinct(cuts).alias("_cuts")), "quantiles-cuts")
        # a cut is a bucket of its own, what lies between two cuts is another
        bucket = 2 * F.size(F.filter("_cuts", lambda x: x < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")
        placed = cut(join_on(rest, cuts, keys).withColumn("_bucket", bucket).drop("_cuts"), "quantiles-placed")
        sums = placed.groupBy(*keys, "_bucket").agg(F.sum("_c").alias("_s"), F.count("*").alias("_m"))
        sums = sums.withColumn("_start", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_s"))  # two rows a cut
        inside = join_on(want, sums, keys).filter((F.col("_r") >= F.col("_start")) & (F.col("_r") < F.col("_start") + F.col("_s")))
        path = F.concat_ws("/", "_path", "_bucket").alias("_path")
        inside = cut(inside.select(*by, path, "_name", (F.col("_r") - F.col("_start")).alias("_r"), "_m"), "quantiles-places")
        want, groups = inside.drop("_m"), inside.select(*keys, "_m").distinct()
        counts = cut(join_on(placed.select(*by, path, "_v", "_c"), groups.select(*keys), keys, "left_semi"), "quantiles-counts")
    every = reduce(DataFrame.unionByName, found).groupBy(*by).agg(*[F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in ranks])
    return join_on(sizes.select(*by, "n"), every, by) if by else every.join(F.broadcast(sizes.select("n"))).select("n", *ranks)  # one row each


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], at_once: int = AT_ONCE) -> DataFrame:
    """Per `by`: n and the interpolated quantiles of the values, by name: of places (n - 1) * share, exact."""
    ends = {}
    for k, p in shares.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        ends |= {f"{k}_lo": F.floor(at), f"{k}_hi": F.ceil(at)}
    found = elements_at(df, by, value, ends, at_once)
    between = lambda k, p: F.col(f"{k}_lo").cast("double") + (F.col(f"{k}_hi").cast("double") - F.col(f"{k}_lo").cast("double")) * ((F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p))))
    value_of = lambda k, p: F.when(F.col(f"{k}_lo") == F.col(f"{k}_hi"), F.col(f"{k}_lo").cast("double")).otherwise(between(k, p))
    return found.select(*by, "n", *[value_of(k, p).alias(k) for k, p in shares.items()])
