"""Hard negatives against brute force, with edge rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceaudit.llm import hard_negatives as h


def brute(rows, is_anchor, k=5):
    """rows: (id, label, vector)."""
    best = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        c = [math.floor(256 * x) for x in v]
        if math.sqrt(sum(256 * x * (256 * x) for x in v)) + math.sqrt(len(v)) < 2**31:
            best[i] = min(best.get(i, (label, c)), (label, c))
    out = set()
    for a, (label, v) in best.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, other) for j, (other, w) in best.items() if j != a and len(w) == len(v))
        for p, positive, _ in [s for s in scored if s[2] == label][:k]:
            fits = [(-s, j) for s, j, other in scored if other != label and 80 * -p <= 100 * -s <= 100 * -p]
            out |= {(a, positive, n + 1, j, -p, s) for n, (s, j) in enumerate(fits[:k])}
    return out


def vectors(rng, n, dim, scale=1.0, labels=3, centres=4):
    middle = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    rows = []
    for i in range(n):
        m = rng.choice(middle)
        rows.append((i, rng.randrange(labels), [scale * (x + rng.gauss(0, 0.05)) for x in m]))
    return rows


SCHEMA = "id long, label int, v array<double>"


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_mine(spark, monkeypatch, scale):
    for name, value in (("CANDIDATES", 64), ("ANCHORS", 8), ("CANDIDATE_BLOCKS", 2), ("ANCHOR_BLOCKS", 2), ("PIVOTS", 5)):
        monkeypatch.setattr(h, name, value)
    rng = random.Random(int(scale))
    rows = vectors(rng, 400, 6, scale)
    rows += [(400 + i, i % 2, rows[0][2]) for i in range(40)]  # one vector many times: ties
    nan, inf = float("nan"), float("inf")
    rows += [(900, 1, None), (910, 1, []), (920, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (930, 1, [nan] * 6), (940, 1, [inf] * 6), (950, None, [1.0] * 6), (None, 1, [1.0] * 6), (960, 1, [1e300] * 6), (970, 1, [0.0] * 6)]
    rows += [(980, 1, [1.0, 2.0]), (981, 1, [1.0, 1.0]), (982, 2, [0.9, 0.9]), (0, 0, rows[0][2]), (5, 2, rows[9][2]), (990, 7, rows[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", block string")
    got = [tuple(r) for r in h.mine(df, F.col("id") % 10 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_few_rows(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.9, 0.1])], SCHEMA)
    assert {tuple(r) for r in h.mine(df, F.col("id") == 0).collect()} == brute([tuple(r) for r in df.collect()], lambda i: i == 0)
    assert h.mine(df.limit(0), F.col("id") == 0).count() == 0
    assert h.mine(df, F.col("id") == 77).count() == 0
    assert h.mine(df.filter("label = 2"), F.lit(True)).count() == 0


def block(rows):
    ids, labels, v = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    return h.Block({"dim": v.shape[1], "ids": ids.tobytes(), "labels": labels.tobytes(), "codes": v.tobytes()})


def test_bounds_spare_most_scores_of_clustered_vectors():
    rng = np.random.default_rng(3)
    middle = rng.integers(-200, 200, (20, 16))
    rows = [(i, i % 3, (middle[i % 20] + rng.integers(-3, 4, 16)).tolist()) for i in range(2000)]
    anchors = block(rows[::10])
    tree = h.Tree(anchors, np.full((200, 1), -h.FAR), np.full((200, 1), h.FAR), 5, True)
    for at in range(0, 2000, 250):
        tree.meet(block(rows[at : at + 250]))
    assert tree.rescored < 0.6 * tree.seen
    exact = anchors.codes @ np.array([r[2] for r in rows]).T
    for a in range(0, 200, 17):
        mine = sorted((-int(exact[a, j]), j) for j in range(2000) if j % 3 == anchors.labels[a] and j != anchors.ids[a])[:5]
        assert [(-s, i) for s, i in zip(tree.scores[a, 0].tolist(), tree.ids[a, 0].tolist(), strict=True)] == mine


def test_spanning_tree():
    x = np.array([[0, 0], [10, 0], [11, 0], [0, 9], [30, 30]])
    levels, parent, edge = h.spanning_tree(x)
    assert sorted(np.concatenate(levels).tolist()) == list(range(5)) and len(levels[0]) == 1 and edge[levels[0][0]] == 0
    assert math.isclose(edge.sum(), 9 + 10 + 1 + math.hypot(19, 30))
    for n, level in enumerate(levels[1:]):
        assert set(parent[level].tolist()) <= set(levels[n].tolist())
