"""Quantiles by selection against sorted lists, in one round and in several."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceaudit.operators import quantiles as q


@pytest.mark.parametrize("at_once", [3, 40, 100_000])
def test_quantiles(spark, monkeypatch, at_once):
    monkeypatch.setattr(q, "CUTS", 4)
    rng = random.Random(at_once)
    draw = {"hot": lambda: rng.gauss(0, 1) ** 3, "many": lambda: float(rng.randrange(3)), None: lambda: 10.0 ** rng.randrange(-300, 300), "one": lambda: 5.0}
    rows = [(g, f() if rng.random() < 0.9 else None) for g, f in draw.items() for _ in range({"hot": 400, "one": 3}.get(g, 90))] + [("none", None), ("single", 2.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in q.quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}, at_once).collect()}
    assert set(got) == {"hot", "many", None, "one", "single"}
    for g, r in got.items():
        values = [v for k, v in rows if k == g and v is not None]
        assert r["n"] == len(values)
        for name, p in zip("abcde", (0, 0.25, 0.5, 0.9, 1), strict=True):
            assert math.isclose(r[name], np.quantile(values, p), rel_tol=1e-12), (g, name)
    upper = {r["g"]: r["u"] for r in q.elements_at(df, ["g"], "v", {"u": F.floor(F.col("n") / 2)}, at_once).collect()}
    assert upper == {g: sorted(v for k, v in rows if k == g and v is not None)[r["n"] // 2] for g, r in got.items()}


def test_without_groups_and_rows(spark):
    df = spark.createDataFrame([(v,) for v in (4, 1, 3, 2)], "v int")
    assert [tuple(r) for r in q.quantiles(df, [], "v", {"m": 0.5}).collect()] == [(4, 2.5)]
    assert q.quantiles(df.limit(0), [], "v", {"m": 0.5}).count() == 0
    assert q.quantiles(df.limit(0), ["v"], "v", {"m": 0.5}).count() == 0
