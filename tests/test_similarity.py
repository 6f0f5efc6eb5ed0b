"""Novelty, subsequences and BLEU against plain versions."""

import random
import time

import numpy as np
import pytest

from traceaudit.functions import similarity as sim


def brute_novelty(new, known):
    out = {}
    for i, a in new:
        best = max((len(set(a) & set(b)) / len(set(a) | set(b)) for b in known if a and b), default=0.0)
        out[i] = min(out.get(i, 1.0), 1 - best)
    return out


@pytest.mark.parametrize("group", [1, 32])
def test_novelty(spark, group):
    rng = random.Random(group)
    bits = lambda: rng.choice([None, [], *[sorted(rng.sample(range(60), rng.randrange(1, 50))) for _ in range(8)]])
    new = [(i, bits()) for i in range(150)] + [(7, [1, 2]), (500, [65_000, 3, 3])]
    known = [(i, bits()) for i in range(100)] + [(300, [65_000, 3])]
    a, b = (spark.createDataFrame(x, "id long, bits array<int>") for x in (new, known))
    got = {r["id"]: r["novelty"] for r in sim.novelty(a, b, rows=8, group=group).collect()}
    assert got == pytest.approx(brute_novelty(new, [k for _, k in known]))
    assert {r["novelty"] for r in sim.novelty(a, b.limit(0)).collect()} == {1.0} and sim.novelty(a.limit(0), b).count() == 0


def test_blocks_of_other_sizes_are_not_met():
    class Row:
        def __init__(self, lists):
            self.least, self.most, self.n, self.ids = min(map(len, lists)), max(map(len, lists)), len(lists), list(range(len(lists)))
            self.bits = np.array([(i, b) for i, x in enumerate(lists) for b in x], np.int32).tobytes()

    mine = sim.Fingerprints(Row([list(range(40)), list(range(1, 42))]))
    near, far = sim.Fingerprints(Row([list(range(41))])), sim.Fingerprints(Row([list(range(300))]))
    assert mine.bound(far) == 41 / 300 and mine.bound(near) == 1.0
    mine.meet(near)
    mine.meet(far)
    assert mine.met == 1 and mine.best.tolist() == [40 / 41, 40 / 42]


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_lcs_equals_the_table():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert sim.lcs_length(a, b) == table_lcs(a, b)


def test_lcs_of_long_texts():
    rng = random.Random(3)
    a, b = ([str(rng.randrange(3000)) for _ in range(20_000)] for _ in range(2))
    began = time.process_time()
    assert sim.lcs_length(a, a) == 20_000 and 0 < sim.lcs_length(a, b) < 20_000
    assert time.process_time() - began < 4  # two pairs, on a busy machine


def test_bleu_equals_the_plain_version(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "b", "c.", "dé", "(e)", "_f"]) for _ in range(n))
    rows = [(text(rng.randrange(0, 30)), text(rng.randrange(0, 30))) for _ in range(120)] + [(None, "a"), ("a", None), ("", ""), ("a b c", "a b c"), ("漢字 x", "漢字")]
    df = spark.createDataFrame(rows, "r string, h string")
    from pyspark.sql import functions as F

    plan = df.select("r", "h", sim.bleus(F.col("r"), F.col("h"), (1, 2, 4)).alias("b"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    for r in plan.collect():
        assert [r["b"][f"bleu{n}"] for n in (1, 2, 4)] == pytest.approx([sim.bleu_score(r["r"], r["h"], n) for n in (1, 2, 4)]), r
