"""The range join against all pairs, and how many rows it makes."""

import random
from collections import Counter

import pytest

from traceaudit.operators import joins


def rows_made(df):
    """Output rows of each join of an executed plan."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
            continue
        if "Join" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return found


@pytest.mark.parametrize("width", [1, 7, 256])
def test_tokens_in_spans(spark, width):
    rng = random.Random(width)
    tokens = [(rng.choice(["hot", "hot", "b", None]), i, s, s + rng.randrange(-1, 6)) for i in range(300) for s in [rng.randrange(-20, 400)]] + [("hot", 900, None, 5), ("hot", 901, 5, None)]
    spans = [(rng.choice(["hot", "b", "c"]), s, s + rng.choice([-1, 0, 3, 10, 40, 300]), i) for i in range(60) for s in [rng.randrange(-20, 400)]] + [("hot", None, 9, 90), ("hot", 1, None, 91)]
    t = spark.createDataFrame(tokens, "doc string, token int, char_start int, char_end int")
    s = spark.createDataFrame(spans, "doc string, lo int, hi int, _bin int")
    got = Counter((r["token"], r["_bin"]) for r in joins.tokens_in_spans(t, s, width=width).collect())
    fits = lambda t, s: None not in (*t[2:], *s[1:3]) and t[0] is not None and t[0] == s[0] and t[3] > t[2] and t[2] >= s[1] and t[3] <= s[2]
    assert got == Counter((t[1], s[3]) for t in tokens for s in spans if fits(t, s)) and len(got) > 50


def test_a_token_meets_near_spans_alone(spark):
    t = spark.range(20_000).selectExpr("'d' AS doc", "id AS token", "id * 6 AS char_start", "id * 6 + 5 AS char_end")
    s = spark.range(1_000).selectExpr("'d' AS doc", "id * 120 AS lo", "id * 120 + 64 AS hi", "id AS span")
    found = joins.tokens_in_spans(t, s)
    assert found.count() == 10_000  # ten of each twenty
    assert 10_000 <= sum(rows_made(found)) < 60_000  # 20 million pairs share the document


def test_no_spans(spark):
    t = spark.createDataFrame([("d", 1, 0, 5)], "doc string, token int, char_start int, char_end int")
    s = spark.createDataFrame([], "doc string, lo int, hi int, span int")
    assert joins.tokens_in_spans(t, s).count() == 0
