"""The rule cascade and the filter audit against brute force, with edge rows."""

import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from compare import differences
from pyspark.sql import functions as F

from traceaudit.llm import filter_audit, rule_cascade
from traceaudit.llm.queries import ORACLE_SQL, QUERIES
from traceaudit.llm.rule_cascade import BASE, MEASURES, Measure, Rule

BLANKS = " \t\n\v\f\r"
LONG = " ".join(f"w{i % 9000}" for i in range(60_000))


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in BLANKS:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def brute_measures(text):
    text = text or ""
    words = words_of(text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked), len(lines)


def brute_kept(n, chars, symbols, dup, repeat, lines):
    return not (n < 20 or 100 * repeat > 30 * n or chars < 2 * n or chars > 15 * n or 100 * symbols > 10 * n or (dup > 3 and 100 * dup > 30 * lines))


def texts():
    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa é 漢字 x#y $5".split())
    out = [None, "", " \t\n", "a", "a b c", "x " * 40, "one\ntwo\n" * 12, "|" * 300, LONG, "tail \n\n \n tail"]
    for n in (7, 8, 9, 15, 16, 17, 30, 200):
        out += [" ".join(word() for _ in range(n)) for _ in range(4)]
        block = [word() for _ in range(n)]
        out += [" ".join(block + block), "\n".join(block), "\r\n".join(block * 2), " ".join([*block, "end", *block[:8]])]
    return out


def test_measures_and_verdicts(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts())] + [(None, "a b", 2, "y"), (3, "a", 3, "z"), (3, "a", 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int, words string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = Counter(tuple(r) for r in rule_cascade.judge(docs, report=names).collect())
    want = Counter()
    for i, t, *_ in rows:
        m = brute_measures(t)
        want[(i, brute_kept(*m), *m[:5])] += 1
    assert got == want
    kept = rule_cascade.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, k, *_ in want.elements() if k)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rule_cascade.judge(docs, report=["n_words"]).count() == 0 and rule_cascade.keep(docs).count() == 0


def test_order_follows_rejection_per_cost():
    measures = {"cheap": Measure(("text",), len), "dear": Measure(("text",), len), "more": Measure(("dear",), lambda x: x)}
    rules = [Rule("a", ("dear",), bool), Rule("b", ("cheap",), bool), Rule("c", ("more",), bool), Rule("d", ("cheap",), bool)]
    rejected = np.array([[1, 1, 0, 0]] * 5 + [[1, 0, 1, 0]] * 3 + [[0, 0, 0, 1]] + [[0, 0, 0, 0]], bool)
    seconds = np.array([[1.0, 10.0, 1.0]] * 10)
    order = rule_cascade.best_order(rejected, seconds, rules, measures)
    # b rejects half for 1 s; then d costs nothing more; then a rejects 3 of 4 that are left for 10 s; c comes last, what it rejects is gone
    assert [r.name for r, _, _ in order] == ["b", "d", "a", "c"]
    assert [round(share, 3) for _, share, _ in order] == [0.5, 0.2, 0.75, 0.0] and [cost for *_, cost in order] == [1.0, 0.0, 10.0, 1.0]
    assert rule_cascade.best_order(np.zeros((0, 4), bool), np.zeros((0, 3)), rules, measures)[0][0].name == "a"


def test_short_circuit_leaves_later_measures_alone():
    text = rule_cascade.Text("too short", MEASURES)
    assert any(map(text.rejected_by, rule_cascade.RULES)) and "lines" not in text and "n_repeat_words" not in text
    assert rule_cascade.closure(BASE[1].measures) == {"n_repeat_words", "words", "n_words"}


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(rule_cascade, "shingle_hashes", lambda h, k: np.zeros(len(h) - k + 1, np.uint64))
    assert rule_cascade.repeat_words([str(i).encode() for i in range(50)]) == 0
    assert rule_cascade.repeat_words([str(i % 20).encode() for i in range(40)]) == 40


@pytest.mark.parametrize("name", ["op11_rule_cascade", "op12_filter_audit", "op13_hard_negatives"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    diff, n = differences(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])
    assert not diff and n


def test_galloping_lists():
    rng = random.Random(8)
    for _ in range(300):
        lists = [sorted(rng.sample(range(200), rng.randrange(0, 120))) if rng.random() < 0.7 else list(range(rng.randrange(100), rng.randrange(100, 200))) for _ in range(rng.randrange(0, 6))]
        assert filter_audit.union(lists) == sorted(set().union(*lists))
        for a in lists:
            for b in lists:
                assert filter_audit.difference(a, b) == sorted(set(a) - set(b)) and filter_audit.shared(a, b) == len(set(a) & set(b))
    ids = [3, 5, 5, 9, 30, 31]
    assert [filter_audit.gallop(ids, 1, x) for x in (0, 5, 6, 31, 40)] == [1, 1, 3, 5, 6] and filter_audit.gallop(ids, 6, 1) == 6


def brute_audit(rows, filters="ABCDE"):
    """rows: (part, set of failing filters, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        mine, shapley = [r for r in rows if r[0] == part], Counter()
        for order in permutations(filters):
            left = mine
            for n, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                failing = sum(f in r[1] for r in mine)
                out[part, "".join(order), n + 1] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[v[6]]
    return out


@pytest.mark.parametrize("width", [5, 64, 1 << 16])
def test_audit(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["", "en", "hot", "hot", "hot"]), {f for f in "ABC" if rng.random() < 0.4}, rng.random() < 0.3, rng.random() < 0.2) for _ in range(300)] + [("clean", set(), True, False)]
    df = spark.createDataFrame([(p, 3 * i + (1 << 33) * (i % 2), sorted(s) + ["good"] * g + ["toxic"] * t) for i, (p, s, g, t) in enumerate(rows)], "part string, row long, lists array<string>")
    got = {(r["part"], r["filter_order"], r["step"]): [r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]] for r in filter_audit.audit(df, "ABC", width=width).collect()}
    assert got == brute_audit(rows, "ABC")


def test_failing_rows(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT_SHARE", 4)
    unique, many = " ".join(f"a{i}" for i in range(150)), " ".join(f"b{i % 50}" for i in range(150))
    rows = [(1, unique, "en", 0), (2, unique, "de", 0), (2, unique, "en", 0), (None, unique, None, 0), (4, None, "en", 0), (5, "", "en", 0), (6, many, "en", 0), (7, "AB cd", "fr", 0), (8, "no $", "fr", 0), (9, LONG, "fr", 0), (9, LONG, "fr", 0)]
    rows += [(100 + i, "same text", "en", 0) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, part int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (2, 1, 1), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.failing_rows(docs, labels, F.coalesce("lang", F.lit("")))
    assert got.select("row").distinct().count() == len(rows)
    want = [("en", ["good"]), ("de", ["E", "good", "toxic"]), ("en", ["E", "good", "toxic"]), ("", []), ("en", ["A"]), ("en", ["A", "E"]), ("en", ["B"]), ("fr", ["A", "C", "toxic"]), ("fr", ["A", "D"]), ("fr", ["B"]), ("fr", ["B"])]
    want += [("en", ["A"])] + [("en", ["A", "E"])] * 8
    assert sorted((r["part"], sorted(r["lists"])) for r in got.collect()) == sorted((p, sorted(x)) for p, x in want)
    assert filter_audit.audit(filter_audit.failing_rows(docs.limit(0), labels, F.lit("x"))).count() == 0
    assert {r["good_lost"] for r in filter_audit.audit(filter_audit.failing_rows(docs, labels.limit(0), F.lit("x"))).collect()} == {0}
