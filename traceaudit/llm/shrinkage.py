"""Strength of beta priors, estimated from counts by moments. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Strength where the data say nothing of it, and its bounds.
DEFAULT, LEAST, MOST = 20.0, 1.0, 10_000.0


def prior_strength(children: DataFrame, parent: list[str]) -> float:
    """Strength s = alpha + beta of the beta prior from which the rates of children(n, k) are drawn around the rate of their parent.

    Moments of the beta-binomial: with m the pooled rate of a parent, the sum of n (k / n - m)^2 / (m (1 - m)) over its c children of n outcomes
    each is expected to be (c - 1) (1 - r) + r (N - sum of n^2 / N), with r = 1 / (s + 1). Parents whose outcomes are all alike tell nothing.
    Two grouped aggregations; one row comes back. DEFAULT where no parent has children that could differ.
    """
    held = children.filter("n > 0").withColumns({"n": F.col("n").cast("double"), "k": F.col("k").cast("double")})
    sums = held.groupBy(*parent).agg(F.sum("n").alias("pn"), F.sum("k").alias("pk"), F.count("*").alias("c"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"))
    m = F.col("pk") / F.col("pn")
    sums = sums.filter("pk > 0 AND pk < pn AND c > 1")
    found: Row = sums.agg(F.sum((F.col("kk") - F.col("pk") * m) / (m * (1 - m))).alias("t"), F.sum(F.col("c") - 1).alias("free"), F.sum(F.col("pn") - F.col("squares") / F.col("pn")).alias("spread")).first()
    if found["t"] is None or found["spread"] <= found["free"]:
        return DEFAULT
    r = (found["t"] - found["free"]) / (found["spread"] - found["free"])
    return MOST if r <= 0 else min(MOST, max(LEAST, 1 / r - 1))
