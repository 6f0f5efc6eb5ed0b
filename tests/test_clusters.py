"""Greedy clusters of every kind against a walk over all leaders, in one round and in many."""

import math
import random

import pytest

from traceaudit.functions.similarity import SIMILARITIES
from traceaudit.operators import cluster, leaders
from traceaudit.plans.registry import QUERIES
from traceaudit.plans.samples import fingerprints

TYPES = {
    "text": "string",
    "reasoning": "string",
    "numeric": "double",
    "label": "string",
    "structure": "array<int>",
    "set": "array<struct<canonical:string,bits:array<int>>>",
    "embedding": "array<double>",
}


def alone(kind, v):
    return (kind in ("text", "reasoning") and not v.strip()) or (kind == "structure" and not v) or (kind == "embedding" and not any(v)) or (kind == "numeric" and math.isnan(v))


def walk(rows, kind, threshold):
    """rows: (key, position, value) -> {(key, position): cluster}."""
    similar, out, heads = SIMILARITIES[kind][0], {}, {}
    for key, position, v in sorted((r for r in rows if r[2] is not None), key=lambda r: r[1]):
        mine = heads.setdefault(key, [])
        at = len(mine) if alone(kind, v) else next((i for i, h in enumerate(mine) if similar(h, v) >= threshold), len(mine))
        if at == len(mine):
            mine.append(v)
        out[key, position] = at
    return out


def value(kind, rng):
    bits = lambda: sorted(rng.sample(range(14), rng.randrange(0, 8)))
    if kind in ("text", "reasoning"):
        return rng.choice(["", " \t", " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 8)))])
    if kind == "numeric":
        return rng.choice([float("nan"), round(rng.random() / 3, 3), round(rng.random() / 3, 3), 1e9])
    if kind == "label":
        return rng.choice(["Yes", " yes", "no", "NO ", "maybe"])
    if kind == "structure":
        return bits()
    if kind == "set":
        return [{"canonical": rng.choice("abc"), "bits": bits()} for _ in range(rng.randrange(0, 4))]
    return [float(rng.randrange(-2, 3)) for _ in range(rng.choice([2, 3]))]


@pytest.mark.parametrize("kind", list(TYPES))
@pytest.mark.parametrize("at_once", [5, 1000])
def test_kinds(spark, monkeypatch, kind, at_once):
    monkeypatch.setattr(cluster, "PART", 7)
    rng = random.Random(kind)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([value(kind, rng), value(kind, rng), None])) for i in rng.sample(range(1000), 150)]
    df = spark.createDataFrame(rows, f"k string, place long, v {TYPES[kind]}")
    threshold = {"structure": 0.5, "set": 0.6, "embedding": 0.9, "text": 0.5, "reasoning": 0.5}.get(kind)
    got = {(r["k"], r["place"]): r["cluster"] for r in cluster.greedy_clusters(df, "k", "place", "v", kind, threshold=threshold, at_once=at_once).collect()}
    assert got == walk(rows, kind, threshold or SIMILARITIES[kind][1])


def test_similarity_of_its_own(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(["x", "xx", "yyy", "x", "yyyy"])], "k string, place long, v string")
    got = cluster.greedy_clusters(df, "k", "place", "v", similarity=lambda a, b: float(a[0] == b[0]), threshold=1).collect()
    assert {r["place"]: r["cluster"] for r in got} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 1}
    assert cluster.greedy_clusters(df.limit(0), "k", "place", "v").count() == 0


def test_sizes_meet_few_leaders():
    seen = []

    class Seen(frozenset):
        def __and__(self, other):
            seen.append(1)
            return frozenset.__and__(self, other)

    index = leaders.Sizes(Seen, 0.85)
    for n in range(1, 60):
        index.add(range(n), n)
    assert index.find(range(40)) == 34 and len(seen) < 15  # sizes from 34 to 48 alone, up to the first hit of each


@pytest.mark.parametrize(("name", "kind", "column", "threshold"), [("c1_structure_clusters", "structure", "bits", 0.45), ("c1_embedding_clusters", "embedding", "v", 0.3)])
def test_queries(spark, sf_dir, name, kind, column, threshold):
    rows = [(r["label"], r["vec_id"], r[column]) for r in fingerprints(spark, sf_dir).collect()]
    got = {(r["label"], r["vec_id"]): r["cluster"] for r in QUERIES[name](spark, sf_dir).collect()}
    assert got == walk(rows, kind, threshold) and 10 < len(set(got.items()))
    assert max(got.values()) > 0 and len(got) > len({(k, c) for (k, _), c in got.items()})


def counted(make, texts):
    """How often sets of words are met with another by an index, and what it finds for each."""
    met = 0

    class Counting:
        def __init__(self, words):
            self.words = words

        def __len__(self):
            return len(self.words)

        def __iter__(self):
            return iter(self.words)

        def __and__(self, other):
            nonlocal met
            met += 1
            return self.words & other.words

    index, found = make(lambda t: Counting(frozenset(t.split()))), []
    if isinstance(index, leaders.Words):
        similar = index.similar
        index.similar = lambda *args: (setattr(index, "met", getattr(index, "met", 0) + 1), similar(*args))[1]
    for i, t in enumerate(texts):
        at = index.find(t)
        if at is None:
            index.add(t, i)
        found.append(i if at is None else at)
    return met + getattr(index, "met", 0), found


def test_texts_with_rare_words_meet_few_leaders():
    rng = random.Random(5)
    texts = [" ".join([*rng.sample("abcdefghijklmnopqrst", 10), *(f"w{rng.randrange(10**6)}" for _ in range(10))]) for _ in range(300)]
    texts += [t + " more" for t in texts[::7]] + [" ".join(rng.sample("abcdefghijklmnopqrst", 4)) for _ in range(300)]
    rng.shuffle(texts)
    for least in (0.0, 0.5, 0.75, 0.8, 1.0):
        few, found = counted(lambda members, least=least: leaders.Words(members, least), texts)
        many, walked = counted(lambda members, least=least: leaders.Sizes(members, least), texts)
        assert found == walked
        assert least < 0.75 or few < many / 4


def test_rounds_of_texts_double(spark, monkeypatch):
    rows = spark.createDataFrame([("k", i, f"a{i} b{i} c{i}") for i in range(90)] + [("k", 90 + i, f"a{i} b{i} c{i}  ") for i in range(10)], "k string, i int, v string")
    rounds, plain = [], cluster.matched
    monkeypatch.setattr(cluster, "matched", lambda *args, grow: (rounds.append(grow), plain(*args, grow=grow))[1])
    got = cluster.greedy_clusters(rows, "k", "i", "v", "text", at_once=4)
    assert {(r["i"], r["cluster"]) for r in got.collect()} == {(i, i % 90) for i in range(100)}
    assert sum(rounds) == 5  # 4, 8, 16, 32 and the rest, not 25
