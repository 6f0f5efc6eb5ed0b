"""Clusters of repeated samples and their entropy."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.functions.similarity import SIMILARITIES
from traceaudit.functions.text import strip
from traceaudit.operators.leaders import leaders_of
from traceaudit.operators.quantiles import quantiles
from traceaudit.operators.stats import correlation
from traceaudit.session import cut

#: Distinct values of a key that are clustered in order at once; what is left of larger keys is matched with the leaders found so far, in parts of so many values.
AT_ONCE = 1_000
PART = 50_000
#: Kinds whose index keeps the cost of a value from growing with the leaders, so that a round may take more values in order.
INDEXED = ("text", "reasoning", "numeric")
#: Rows of an Arrow batch that are Python objects at once.
ROWS = 256


def unlike_itself(value: Column, kind: str) -> Column:
    """Whether a value is similar to nothing, itself included: blank text, a structure without bits, a vector of norm 0 or with parts that are no numbers."""
    if kind in ("text", "reasoning"):
        return strip(value) == ""
    if kind == "structure":
        return F.size(value) == 0
    if kind == "numeric":
        return F.isnan(value.cast("double"))
    if kind == "embedding":
        norm = F.aggregate(value, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        return ~F.coalesce((norm > 0) & (norm < float("inf")), F.lit(False))
    return F.lit(False)


def matched(rows: DataFrame, key: str, value: str, make: Callable, grow: bool) -> DataFrame:
    """rows(key, _part, _side, _first, value, ...) with `_leader`, the _first of the leader that each value joins.

    Rows come by (key, part), leaders (_side 0) first and then the values, in order. With grow a value that fits no leader becomes one; without, its
    _leader is null. A task holds the leaders of one part at a time.
    """

    names = rows.columns
    at = {c: i for i, c in enumerate(names)}

    def run(batches):
        now, leaders = None, None
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                found = []
                for k, part, side, first, v in zip(*[batch.column(at[c]).to_pylist() for c in (key, "_part", "_side", "_first", value)], strict=True):
                    if leaders is None or now != (k, part):
                        now, leaders = (k, part), make()
                    leader = first if side == 0 else leaders.find(v)
                    if side == 0 or leader is None and grow:
                        leaders.add(v, first)
                        leader = first
                    found.append(leader)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, batch.schema.field(at["_first"]).type)], [*names, "_leader"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*rows.schema.fields, rows.schema["_first"]])
    schema = schema[: schema.rindex("`_first`")] + f"`_leader` {rows.schema['_first'].dataType.simpleString()}"
    return rows.repartition(key, "_part").sortWithinPartitions(key, "_part", "_side", "_first").mapInArrow(run, schema)


def leader_of_each(firsts: DataFrame, key: str, value: str, make: Callable, at_once: int = AT_ONCE, part: int = PART, double: bool = False) -> DataFrame:
    """(key, _first, _leader) for firsts(key, value, _first): the first earlier leader that each value is similar to, else itself.

    In rounds. The first `at_once` values of each key that are left are clustered in order, which gives their leaders; every other value of
    the key comes later than these, so it can be matched with them in parts, in parallel, and joins the first that fits. What fits none goes into the next round. Keys of
    at most `at_once` values are done in one, and no task gets more of a key than a part and the leaders of a round. With double, each round takes twice as many
    values in order as the one before, a part at most, so that what is left is not written again for every `at_once` values of the largest key.
    """
    todo, done = cut(firsts.select(key, value, "_first"), "clusters-values"), []
    place = F.row_number().over(Window.partitionBy(key).orderBy("_first"))
    while True:
        heads = todo.withColumn("_place", place).filter(F.col("_place") <= at_once).drop("_place")  # a limit in each group, applied before the shuffle
        heads = cut(matched(heads.select(F.lit(0).alias("_part"), F.lit(1).alias("_side"), key, value, "_first"), key, value, make, grow=True), "clusters-heads")
        done.append(heads.select(key, "_first", "_leader"))
        full = heads.groupBy(key).agg(F.count("*").alias("_n"), F.max("_first").alias("_last")).filter(F.col("_n") == at_once).select(F.col(key).alias("_key"), "_last")
        full = cut(full, "clusters-full")  # keys with more values: at most one in at_once
        if full.isEmpty():
            break
        same = F.col(key).eqNullSafe(F.col("_key"))
        rest = todo.join(full, same).filter(F.col("_first") > F.col("_last")).drop("_key", "_last")
        parts = rest.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count("*") / part).cast("int").alias("_parts"))
        parts = cut(parts, "clusters-parts")
        leaders = heads.filter(F.col("_first") == F.col("_leader")).join(parts, same).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        others = rest.join(parts, same).withColumn("_part", F.pmod(F.xxhash64("_first"), F.col("_parts")).cast("int"))
        columns = lambda df, side: df.select("_part", F.lit(side).alias("_side"), key, value, "_first")
        met = matched(columns(leaders, 0).unionByName(columns(others, 1)), key, value, make, grow=False).filter("_side = 1")
        met = cut(met.select(key, value, "_first", "_leader"), "clusters-met")
        done.append(met.filter("_leader IS NOT NULL").select(key, "_first", "_leader"))
        todo = met.filter("_leader IS NULL").drop("_leader")
        at_once = max(at_once, min(2 * at_once, part)) if double else at_once
    return reduce(DataFrame.unionByName, done)


def greedy_clusters(df: DataFrame, key: str, position: str, value: str, kind: str = "text", similarity=None, threshold: float | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """(key, position, cluster): in order, each value joins the first cluster whose first value is similar enough, else opens one.

    The kind names the similarity and how leaders are indexed (see leaders); a function of (first value of a cluster, value) may stand in for it. Values by kind: text and
    reasoning: string; numeric: number; label: anything; structure: array of on-bits; set: array of struct(canonical, bits); embedding: array of numbers. The order of samples decides
    and similarity need not be transitive; a value that is unlike itself opens a cluster each time. Null values take no part, positions are a key of their
    group. Equal values of a key are one before any of them is compared. Labels are equal or not, which takes no comparing: they are numbered by first place alone.
    """
    default = SIMILARITIES[kind][1]
    least = default if threshold is None else threshold
    rows = df.filter(F.col(value).isNotNull()).select(key, position, value)
    if kind == "label" and similarity is None:
        rows = rows.select(key, position, F.lower(strip(F.col(value).cast("string"))).alias("_v"), F.lit(None).cast("int").alias("_alone"))
        firsts = rows.groupBy(key, "_v", "_alone").agg(F.min(position).alias("_first"))
        leaders = firsts.withColumn("_leader", F.col("_first"))
    else:
        alone = F.when(unlike_itself(F.col(value), kind), F.col(position))
        rows = rows.select(key, position, F.col(value).alias("_v"), alone.alias("_alone"))
        firsts = cut(rows.groupBy(key, "_v", "_alone").agg(F.min(position).alias("_first")), "clusters-firsts")
        leaders = leader_of_each(firsts, key, "_v", lambda: leaders_of(kind, similarity, least), at_once, double=similarity is None and kind in INDEXED)
    leaders = leaders.select(F.col(key).alias("_key"), F.col("_first").alias("_at"), "_leader")
    number = F.row_number().over(Window.partitionBy("_key").orderBy("_leader")) - 1
    numbers = leaders.filter("_at = _leader").select(F.col("_key").alias("_k"), F.col("_leader").alias("_l"), number.cast("int").alias("cluster"))
    clusters = leaders.join(numbers, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_leader") == F.col("_l"))).select("_key", "_at", "cluster")
    firsts = firsts.join(clusters, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_first") == F.col("_at"))).select(F.col(key).alias("_k"), F.col("_v").alias("_w"), F.col("_alone").alias("_b"), "cluster")
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_v") == F.col("_w")) & F.col("_alone").eqNullSafe(F.col("_b"))
    return rows.join(firsts, same).select(key, position, "cluster")


def cluster_entropy(df: DataFrame, key: str, cluster: str) -> DataFrame:
    """Per key: n_samples, n_valid (non-null cluster), n_clusters, entropy in nats, normalised by ln of the valid samples, cluster_sizes in descending order.

    Under two valid samples both entropies are 0.
    """
    sizes = df.groupBy(key, cluster).agg(F.count("*").alias("_c"))
    valid = F.col(cluster).isNotNull()
    n = sizes.groupBy(key).agg(
        F.sum("_c").alias("n_samples"),
        F.coalesce(F.sum(F.when(valid, F.col("_c"))), F.lit(0)).alias("n_valid"),
        F.count(F.when(valid, 1)).alias("n_clusters"),
        F.coalesce(F.sum(F.when(valid, F.col("_c") * F.log(F.col("_c").cast("double")))), F.lit(0.0)).alias("cl"),
        F.sort_array(F.collect_list(F.when(valid, F.col("_c"))), asc=False).alias("cluster_sizes"),
    )
    h = F.when(F.col("n_valid") > 1, F.log(F.col("n_valid").cast("double")) - F.col("cl") / F.col("n_valid")).otherwise(0.0)
    return n.select(key, "n_samples", "n_valid", "n_clusters", h.alias("entropy"), F.when(F.col("n_valid") > 1, h / F.log(F.col("n_valid").cast("double"))).otherwise(0.0).alias("normalized"), "cluster_sizes")


def dual_entropy(df: DataFrame, key: str, position: str, output: str, reasoning: str, shortest: int = 20) -> DataFrame:
    """Normalised entropy of outputs and of reasonings over `shortest` characters, and reasoning less output (gap)."""
    parts = []
    for name, value, kind in (("output_entropy", output, "text"), ("reasoning_entropy", reasoning, "reasoning")):
        kept = df.filter(F.length(strip(F.col(value))) > shortest) if kind == "reasoning" else df
        parts.append(cluster_entropy(greedy_clusters(kept, key, position, value, kind), key, "cluster").select(key, F.col("normalized").alias(name)))
    both = df.select(key).distinct().join(parts[0], key, "left").join(parts[1], key, "left").na.fill(0.0, ["output_entropy", "reasoning_entropy"])
    return both.withColumn("entropy_gap", F.col("reasoning_entropy") - F.col("output_entropy"))


def sample_validity(df: DataFrame, key: str, value: str, valid, score: str, hit, least: int = 2) -> DataFrame:
    """Per key with at least `least` samples: n_samples, n_unique values, validity_rate, best score and whether any sample is a hit. valid, hit: boolean columns."""
    per = df.groupBy(key).agg(F.count("*").alias("n_samples"), F.count_distinct(value).alias("n_unique"), F.avg(valid.cast("int")).alias("validity_rate"), F.max(score).alias("best"), F.bool_or(hit).alias("hit"))
    return per.filter(F.col("n_samples") >= least)


def entropy_summary(df: DataFrame, entropy: str = "entropy", normalized: str = "normalized", truth: str | None = None) -> DataFrame:
    """One row: mean, population deviation, interpolated median, least and largest entropy; mean, deviation and median of the normalised one, its bands as
    counts and percentages; with truth (a column of similarities to the truth) its correlation with the normalised entropy, null unless every row has one."""
    x, y = F.col(entropy), F.col(normalized)
    low, middle, high = F.count(F.when(y < 0.3, 1)), F.count(F.when((y >= 0.3) & (y < 0.7), 1)), F.count(F.when(y >= 0.7, 1))
    percent = lambda n: F.try_divide(100.0 * n, F.count("*"))
    more = [] if truth is None else [F.when(F.count(truth) == F.count("*"), correlation(y, F.col(truth))).alias("truth_correlation")]
    one = df.agg(
        F.count("*").alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.min(x).alias("least"),
        F.max(x).alias("most"),
        F.avg(y).alias("mean_normalized"),
        F.stddev_pop(y).alias("std_normalized"),
        low.alias("n_low"),
        middle.alias("n_medium"),
        high.alias("n_high"),
        *[percent(n).alias(f"pct_{k}") for k, n in (("low", low), ("medium", middle), ("high", high))],
        *more,
    )
    for c, name in ((entropy, "median"), (normalized, "median_normalized")):
        one = one.join(F.broadcast(quantiles(df, [], c, {name: 0.5}).drop("n")), how="left")  # one row each
    return one.select("n", "mean", "std", "median", "least", "most", "mean_normalized", "std_normalized", "median_normalized", "n_low", "n_medium", "n_high", *[c for c in one.columns if c.startswith("pct_") or c == "truth_correlation"])


def condition_entropy(df: DataFrame, uid: str, cond: str, value: str, base: str, drop: str, corrupt: str, swap: str | None = None) -> DataFrame:
    """Entropy of values per (uid, condition), wide, with information gains against the base; a uid needs base, drop and corrupt, swap may be missing (null)."""
    keyed = df.withColumn("_k", F.struct(uid, cond))
    h = cluster_entropy(keyed, "_k", value).select(F.col(f"_k.{uid}").alias(uid), F.col(f"_k.{cond}").alias(cond), "entropy")
    names = [base, drop, corrupt] + ([swap] if swap else [])
    wide = h.groupBy(uid).pivot(cond, names).agg(F.max("entropy")).dropna(subset=names[:3])
    out = wide.select(uid, F.col(base).alias("h_base"), F.col(drop).alias("h_drop"), F.col(corrupt).alias("h_corrupt"), (F.col(drop) - F.col(base)).alias("ig_presence"), (F.col(corrupt) - F.col(base)).alias("ig_content"), *([(F.col(swap) - F.col(base)).alias("ig_swap")] if swap else []))
    return out
