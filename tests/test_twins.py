"""Queries that have no SQL, row by row against plain Python over the same tables."""

import hashlib
import math
import re
from collections import Counter

import pytest

from traceaudit.functions.similarity import bleu_score, on_bits
from traceaudit.operators.claims import keyword_pattern
from traceaudit.plans.base import GENERIC, LEXICON, extracted, facts, responses, turn_pairs
from traceaudit.plans.registry import QUERIES
from traceaudit.plans.samples import reasoned_samples
from traceaudit.session import table

md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
norm = lambda t: re.sub(r"[ \t\n\x0b\f\r]+", " ", t.lower()).strip(" ")


def rows_of(df, key):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def answered(spark, sf_dir):
    return rows_of(extracted(spark, sf_dir), "id")


def run(spark, sf_dir, name, key="id"):
    return rows_of(QUERIES[name](spark, sf_dir), key)


def test_claims_outside_derivation(spark, sf_dir, answered):
    got = run(spark, sf_dir, "x9_claims_outside_derivation")
    near = re.compile(r"\bnicht\b|\bnot\b|\bpas\b")
    assert got.keys() == answered.keys()
    for i, r in answered.items():
        t = norm(r["trace"])
        named = [g for g, words in LEXICON.items() if any(not near.search(t[max(0, m.start() - 60) : m.end() + 60]) for m in re.finditer(keyword_pattern(words), t))]
        assert got[i]["claimed"] == ",".join(sorted(named))


def test_fragments(spark, sf_dir):
    got = run(spark, sf_dir, "x11_extract_fragments", "doc_id")
    patterns = (r"(?a)(?<!\w)([A-Z][a-z]?(?:[\[\]()=#@/\\+\-\d]|[A-Z][a-z]?){3,})(?!\w)", r"(?a)(?<!\w)((?:[CNOSPFIBcnos][\[\]()=#@/\\+\-\d]*){4,})(?!\w)")
    for r in table(spark, sf_dir, "documents").collect():
        found = [x for p in patterns for x in re.findall(p, r["text"]) if len(x) >= 4 and re.search("[CNOcno]", x) and not re.fullmatch("[A-Z][a-z]+", x)]
        assert (got[r["doc_id"]]["n_fragments"], got[r["doc_id"]]["fragments"]) == (len(found), " ".join(sorted(set(found))))


def target(trace, prefer=None):
    named = []
    for g, words in LEXICON.items():
        hit = next((w for w in sorted(words, key=lambda k: (-len(k), k)) if w in trace.lower()), None)
        if g not in GENERIC and hit:
            named.append((g, hit))
    also = [x for x in named if prefer is not None and x[1] in prefer.lower()]
    return (also or named or [None])[0]


def swapped(text, old, new):
    at = text.lower().find(old.lower())
    return text if at < 0 or new is None else text[:at] + new + text[at + len(old) :]


def test_corruptions(spark, sf_dir, answered):
    got = run(spark, sf_dir, "t2_corruptions")
    groups = list(LEXICON)
    n = 0
    for i, r in answered.items():
        t = target(r["trace"], r["question"])
        assert (t is None) == (i not in got)
        if t:
            n += 1
            at = (groups.index(t[0]) + int(md5(i)[:8], 16) % (len(groups) - 1) + 1) % len(groups)
            wrong = LEXICON[groups[at]][0]
            same = next((w for w in LEXICON[t[0]] if w != t[1]), None)
            every = r["trace"]
            for words in LEXICON.values():
                hit = next((w for w in sorted(words, key=lambda k: (-len(k), k)) if w in every.lower()), None)
                every = swapped(every, hit, "xx") if hit else every
            want = (t[0], md5(swapped(r["trace"], t[1], wrong)), None if same is None else md5(swapped(r["trace"], t[1], same)), md5(every), md5(swapped(r["question"], t[1], wrong)))
            assert tuple(got[i][c] for c in ("group", "wrong", "synonym", "all", "input")) == want
    assert n > 100


def donors_of(answered):
    out, tasks = {}, {}
    for i, r in answered.items():
        tasks.setdefault(r["task"], []).append((md5(f"{r['task']}|{i}"), i))
    for members in tasks.values():
        order = [i for _, i in sorted(members)]
        for k, i in enumerate(order):
            for step in (1, 2):
                donor = order[(k + step) % len(order)]
                if answered[donor]["trace"] != answered[i]["trace"]:
                    out[i] = answered[donor]["trace"]
                    break
    return out


def test_swap_and_mask(spark, sf_dir, answered):
    got, donors = run(spark, sf_dir, "t3_swap_and_mask"), donors_of(answered)
    for i, r in rows_of(responses(spark, sf_dir), "id").items():
        a = r["answer"]
        start, end = a.find("<think>"), a.find("</think>")
        swap = a[: start + 7] + donors[i] + a[end:] if i in donors and 0 <= start < end else None
        masked = a
        for f in sorted(dict.fromkeys(re.findall("[A-Z]{4,}", a)), key=lambda f: -len(f)):
            masked = masked.replace(f, "[...]")
        assert (got[i]["swapped"], got[i]["masked"]) == (md5(swap), md5(masked))


def test_corrupt_fragments(spark, sf_dir, answered):
    pool = facts(spark, sf_dir).filter("valid").selectExpr("canonical AS key").distinct().selectExpr("key", "pmod(xxhash64(key), 64) AS slice").collect()
    pool = [r["key"] for r in sorted(pool, key=lambda r: (r["slice"], md5(r["key"])))]
    got = run(spark, sf_dir, "t4_corrupt_fragments")
    for i, r in answered.items():
        text = r["trace"]
        swaps = [(-len(f), f, pool[int(md5(f)[:8], 16) % len(pool)]) for f in set(re.findall("[A-Z]{4,}", text))]
        for _, f, p in sorted(x for x in swaps if x[1] != x[2]):
            text = text.replace(f, p)
        assert (got[i]["digest"], got[i]["changed"]) == (md5(text), text != r["trace"])
    assert any(r["changed"] for r in got.values())


def greedy(values, least):
    leaders, out = [], []
    for v in values:
        words = set(v.lower().split())
        at = next((n for n, f in enumerate(leaders) if words and f and len(words & f) / len(words | f) >= least), len(leaders))
        if at == len(leaders):
            leaders.append(words)
        out.append(at)
    return out


def conversations(spark, sf_dir):
    out = {}
    for r in sorted(table(spark, sf_dir, "conversations").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        out.setdefault(r["conv_id"], []).append((r["turn"], r["text"]))
    return out


def test_greedy_clusters(spark, sf_dir):
    got = {(r["conv_id"], r["turn"]): r["cluster"] for r in QUERIES["c1_greedy_clusters"](spark, sf_dir).collect()}
    want = {}
    for c, turns in conversations(spark, sf_dir).items():
        kept = [(t, x) for t, x in turns if x is not None]
        want |= {(c, t): n for (t, _), n in zip(kept, greedy([x for _, x in kept], 0.8), strict=True)}
    assert got == want


def entropy(clusters):
    n = len(clusters)
    return -sum(c / n * math.log(c / n) for c in Counter(clusters).values()) / math.log(n) if n > 1 else 0.0


def test_dual_entropy(spark, sf_dir):
    got, prompts = run(spark, sf_dir, "c3_dual_entropy", "prompt"), {}
    for r in sorted(reasoned_samples(spark, sf_dir).collect(), key=lambda r: r["doc_id"]):
        prompts.setdefault(r["prompt"], []).append(r)
    assert got.keys() == prompts.keys() and any(r["reasoning_entropy"] > 0 for r in got.values())
    for p, rows in prompts.items():
        outputs = entropy(greedy([r["output"] for r in rows if r["output"] is not None], 0.8))
        reasons = entropy(greedy([r["reasoning"] for r in rows if len(r["reasoning"].strip(" \t\n\x0b\f\r")) > 20], 0.75))
        assert (got[p]["output_entropy"], got[p]["reasoning_entropy"], got[p]["entropy_gap"]) == (pytest.approx(outputs), pytest.approx(reasons), pytest.approx(reasons - outputs))


def test_best_match(spark, sf_dir):
    got = run(spark, sf_dir, "m6_best_match", "item_id")
    sets = {r["item_id"]: [list(dict.fromkeys(p.split(" "))) for p in r["parts"]] for r in facts(spark, sf_dir).collect()}
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    assert len(got) > 10
    for i, r in got.items():
        left, right = sets[i], sets[i + 1]
        want = 1.0 if sorted(left) == sorted(right) else sum(max((jaccard(a, b) for b in right), default=0.0) for a in left) / len(left) if left else 0.0
        assert r["similarity"] == pytest.approx(want)


def grams(text, n):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return Counter(zip(*[w[i:] for i in range(n)], strict=False))


def rouge(a, b, n):
    x, y = grams(a, n), grams(b, n)
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values())) if x and y else 0.0


def longest(a, b):
    table_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table_[i + 1][j + 1] = table_[i][j] + 1 if x == y else max(table_[i][j + 1], table_[i + 1][j])
    return table_[-1][-1]


def test_rouge_and_captions(spark, sf_dir):
    got = {(r["conv_id"], r["turn"]): r for r in QUERIES["m10_rouge_l"](spark, sf_dir).collect()}
    per = {}
    for r in turn_pairs(spark, sf_dir).collect():
        q, a = r["question"], r["reply"]
        x, y = (re.findall("[a-z0-9]+", (t or "").lower()) for t in (q, a))
        want = 2 * longest(x, y) / (len(x) + len(y)) if x and y else 0.0
        assert (got[r["conv_id"], r["turn"]]["rouge2"], got[r["conv_id"], r["turn"]]["rouge_l"]) == (pytest.approx(rouge(q, a, 2), abs=1e-8), pytest.approx(want, abs=1e-8))
        if q.strip():
            per.setdefault(r["conv_id"] % 3, []).append((bleu_score(q, a, 2), bleu_score(q, a, 4), rouge(q, a, 1), rouge(q, a, 2), want))
    for r in QUERIES["a24_caption_scores"](spark, sf_dir).collect():
        mine = per[r["model"]]
        means = [100 * sum(x[k] for x in mine) / len(mine) for k in range(5)]
        assert r["n"] == len(mine) and [r[c] for c in ("bleu2", "bleu4", "rouge1", "rouge2", "rouge_l")] == pytest.approx(means, abs=1e-5)


def test_novelty_of_equal_fingerprints(spark):
    from traceaudit.functions.similarity import novelty

    df = spark.createDataFrame([(i, [1.0, -1.0, 2.0]) for i in range(50)] + [(99, [-1.0, 1.0, -1.0])], "id long, v array<double>").select("id", on_bits("v").alias("bits"))
    got = {r["id"]: r["novelty"] for r in novelty(df, df.filter("id < 50"), rows=8).collect()}
    assert got[99] == 1.0 and {got[i] for i in range(50)} == {0.0}
