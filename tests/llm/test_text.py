"""SentencePiece, toxicity, decontamination, Katz scoring, quality and the pipeline, with edge rows."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceaudit.llm import decontaminate, katz, pieces, quality, toxicity
from traceaudit.llm.labelled import crc_remainder, training_sample
from traceaudit.llm.queries import QUERIES
from traceaudit.session import table

TEXTS = ["Hello  world", " a b ", "x\ty\nz", "é́ ﬁ ①", "", "  ", "a▁b", "日本\U0001f600", "   x   yy  ", "aaaaaaaaaaaaaaaaaaaa", "a" * 3000, "def f(x):\n    return  x**2 # <s> </s> <0x41>", "\x07 z", "ÄÖÜß naïve", None]
needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")


def library(kind):
    """The sentencepiece library, which reads the vocabulary file as a model of this kind."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = {"unigram": model.trainer_spec.UNIGRAM, "bpe": model.trainer_spec.BPE}[kind]
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


@needs_model
@pytest.mark.parametrize("kind", ["unigram", "bpe"])
def test_pieces_equal_the_library(spark, kind):
    theirs = library(kind)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, decoded_ids string").repartition(2)
    for r in pieces.decode(pieces.encode(docs, kind=kind)).collect():
        want = TEXTS[r["doc_id"]]
        if kind == "bpe":
            assert r["ids"] == (None if want is None else theirs.encode(want))
        assert r["decoded"] == (None if want is None else theirs.decode(theirs.encode(want)))
    assert pieces.encode(docs.limit(0), kind=kind).count() == 0
    for clash in (lambda: pieces.encode(docs, column="Text"), lambda: pieces.decode(pieces.encode(docs), column="decoded_ids")):
        with pytest.raises(ValueError):
            clash()


def random_texts(seed=5):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("etaoinshr éßñ.-1") for _ in range(rng.randrange(1, 14))) for _ in range(30)) for _ in range(60)]


@needs_model
def test_merged_pieces_of_random_words_equal_the_library():
    ids, sizes = pieces.Encoder({**pieces.load(), "kind": "bpe"}).encode(*pieces.words_in(random_texts()))
    theirs = library("bpe").encode(random_texts())
    assert ids.tolist() == [i for t in theirs for i in t] and sizes.tolist() == list(map(len, theirs))


@needs_model
def test_viterbi_pieces_of_random_words_score_best():
    """The library's exact n-best search over the same pieces and scores finds nothing better, and what it finds best scores the same."""
    theirs, encoder = library("unigram"), pieces.Encoder({**pieces.load(), "kind": "unigram"})
    words = sorted({w for t in random_texts() for w in t.split()} | {"the", "thehe", "there", "internationalisation"})
    ids, sizes = encoder.encode(*pieces.words_in(words))
    total = lambda found: sum(encoder.scores[i] for i in found)
    for w, mine in zip(words, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert total(mine.tolist()) == total(theirs.nbest_encode_as_ids(w, 3)[0]), w
        assert "".join(encoder.pieces[i] for i in mine) == "▁" + w


def test_decoding_ids_that_are_no_text():
    model = {"pieces": ["<unk>", "▁a", "b", "<0xE2>", "<0x82>", "<s>"], "byte_ids": {0xE2: 3, 0x82: 4}, "unk": 0, "silent": [5]}
    lists = [[1, 2], [3], [4, 2], [], None, [5, 1, 0, 1], [1, 3, 4]]
    flat, offsets = np.array([i for x in lists if x for i in x]), np.concatenate([[0], np.cumsum([len(x or []) for x in lists])])
    got = pieces.Decoder(model).decode(flat, offsets, np.array([x is None for x in lists])).to_pylist()
    assert got == ["ab", "\ufffd", "\ufffdb", "", None, "a ⁇  a", "a\ufffd"]


@needs_model
def test_queries_of_pieces(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    bpe, encoder = library("bpe"), pieces.Encoder({**pieces.load(), "kind": "unigram"})
    viterbi = lambda t: encoder.encode(*pieces.words_in([t]))[0].tolist()  # noqa: E731  itself held against the library's n-best above
    for query, encode in ((pieces.op3_sentencepiece, viterbi), (pieces.sentencepiece_merges, bpe.encode)):
        by_id = {r["doc_id"]: r for r in query(spark, sf_dir).collect()}
        want = spark.createDataFrame([(i, encode(t)) for i, t in rows if t is not None], "doc_id long, a array<int>").select("doc_id", F.size("a"), F.xxhash64("a")).collect()
        assert len(want) > 100 and all(tuple(by_id[r[0]])[1:3] == tuple(r)[1:] and by_id[r[0]]["round_trip"] for r in want)


def test_unigram_viterbi_against_all_segmentations():
    names = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    scores = [0.0, -1.0, -2.0, -2.5, -3.1, -2.2, -3.3, -4.9]
    model = {"pieces": names, "scores": scores, "plain": [False] + [True] * 7, "byte_ids": {}, "unk": 0, "silent": [], "kind": "unigram"}
    encoder = pieces.Encoder(model)

    def best(text):
        if not text:
            return 0.0
        found = [scores[i] + best(text[len(names[i]) :]) for i in range(1, 8) if text.startswith(names[i])]
        return max([*found, min(scores) - 10 + best(text[1:])])

    for text in ("ab", "abab", "ba", "aabb", "bx", "a ab b"):
        ids = encoder.encode(*pieces.words_in([text]))[0].tolist()
        assert sum(scores[i] if i else min(scores) - 10 for i in ids) == pytest.approx(sum(best("▁" + w) for w in text.split(" ")))


BAD = ["trash", "moron", "pathetic"]


def labelled(spark, n=600):
    rng, rows, labels = random.Random(0), [], []
    for i in range(n):
        words = ["".join(rng.choice(["an", "er", "th", "on", "ti"]) for _ in range(3)) for _ in range(40)]
        toxic, good = i % 5 == 0, i % 7 != 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(BAD)
        if not good:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), f"s{i % 3}", "en"))
        labels.append((i, int(good), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


EDGES = [(9001, None, None, None), (9002, "", "s1", "en"), (None, "x", "s1", "en"), (9003, "word " * 60_000, "new", "xx")]


def with_edges(spark, docs):
    return docs.unionByName(spark.createDataFrame(EDGES, docs.schema)).withColumns({"score": F.lit("x"), "_p": F.lit(1), "y": F.lit(2), "p": F.lit(7), "h": F.lit(8), "shift": F.lit(9), "Q": F.lit(10), "by_fold": F.lit(11), "toxicity": F.lit(12)})


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels, crc_remainder(F.col("doc_id"), 4) != 2)
    scored = toxicity.score(with_edges(spark, docs), model, "t").withColumn("held", crc_remainder(F.col("doc_id"), 4) == 2)
    rows = scored.join(labels, "doc_id").filter("held").collect()
    right = sum((r["t"] >= toxicity.THRESHOLD) == bool(r["toxic"]) for r in rows)
    assert len(rows) > 50 and right >= 0.95 * len(rows)
    edges = scored.filter("doc_id > 9000 OR doc_id IS NULL").collect()
    assert len(edges) == 4 and all(0 <= r["t"] <= 1 for r in edges)
    kept = toxicity.drop_toxic(docs, labels, docs)
    assert kept.columns == docs.columns and kept.join(labels.filter("toxic = 1"), "doc_id").count() <= 10


def test_toxicity_without_both_classes(spark):
    docs, labels = labelled(spark, 30)
    for part in (labels.limit(0), labels.filter("toxic = 0")):
        assert toxicity.score(docs, toxicity.train(docs, part), "t").filter("t BETWEEN 0 AND 1").count() == 30
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels.limit(0)), "t").count() == 0


def test_training_sample_is_bounded_and_skips_conflicts(spark):
    docs, labels = labelled(spark, 50)
    odd = labels.union(spark.createDataFrame([(3, 1, 1), (None, 1, 1), (4, 1, None)], labels.schema))
    ids = {r["doc_id"] for r in training_sample(docs, odd, "toxic", 1000).collect()}
    assert len(ids) == 49 and 3 not in ids
    assert training_sample(docs, odd, "toxic", 10).count() == 10


def test_toxicity_against_a_plain_model(spark):
    """The same features, ratios and regression without Spark's counting and scoring."""
    docs, labels = labelled(spark, 200)
    weights, intercept = toxicity.train(docs, labels, features=300)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    sets = {r["doc_id"]: {int(x) for x in toxicity.gram_buckets(r["text"])} for r in docs.collect()}
    n = [sum(1 for t in truth.values() if t == y) for y in (0, 1)]
    ratios = {}
    for x in set().union(*sets.values()):
        c = [sum(1 for i, s in sets.items() if x in s and truth[i] == y) for y in (0, 1)]
        if sum(c) >= 3:
            ratio = math.log((c[1] + 0.5) / (n[1] + 1)) - math.log((c[0] + 0.5) / (n[0] + 1))
            ratios[x] = ratio, abs(ratio) / math.sqrt(1 / (c[1] + 0.5) + 1 / (c[0] + 0.5))
    chosen = sorted(ratios, key=lambda x: (-round(ratios[x][1], 9), x))[:300]
    assert set(np.flatnonzero(weights)) <= set(ratios) and len(set(np.flatnonzero(weights)) & set(chosen)) >= 290
    for r in toxicity.score(docs, (weights, intercept), "t").collect():
        z = intercept + sum(float(weights[x]) for x in sets[r["doc_id"]])
        assert r["t"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def plain_toxicity(texts, truth):
    """Weight of each bucket and the intercept, from the definition of the model, by Newton steps over the training rows."""
    sets = {i: {int(x) for x in toxicity.gram_buckets(texts[i])} for i in truth}
    n = [sum(t == y for t in truth.values()) for y in (0, 1)]
    counts = [Counter(x for i, s in sets.items() if truth[i] == y for x in s) for y in (0, 1)]
    ratios = {}
    for x in counts[0].keys() | counts[1].keys():
        q, p = (c[x] + 0.5 for c in counts)
        if p + q >= 4:
            ratio = math.log(p / (n[1] + 1)) - math.log(q / (n[0] + 1))
            ratios[x] = abs(ratio) / math.sqrt(1 / p + 1 / q), ratio
    chosen = sorted(ratios, key=lambda x: (-ratios[x][0], x))[: toxicity.FEATURES]
    ids = sorted(truth)
    features = np.array([[ratios[x][1] if x in sets[i] else 0.0 for x in chosen] for i in ids])
    y, k, reg, m = np.array([truth[i] for i in ids], float), features @ features.T, 2e-4, len(ids)
    a, b = np.zeros(m), 0.0
    for _ in range(60):
        z = k @ a + b
        p = 1 / (1 + np.exp(-z))
        g, w = (p - y) / m, p * (1 - p) / m
        system = np.block([[w[:, None] * k + reg * np.eye(m), w[:, None]], [(w[:, None] * k).sum(0)[None], np.array([[w.sum()]])]])
        step = np.linalg.solve(system, -np.append(g + reg * a, g.sum()))
        a, b = a + step[:-1], b + step[-1]
    return dict(zip(chosen, (features.T @ a) * np.array([ratios[x][1] for x in chosen]), strict=True)), b


def test_query_of_toxicity_against_a_plain_model(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    plain, plain_intercept = plain_toxicity(texts, {r["doc_id"]: r["toxic"] for r in labels if not held(r["doc_id"]) and r["doc_id"] in texts})
    model, intercept = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_remainder(F.col("doc_id"), 4) != 2)
    assert set(np.flatnonzero(model).tolist()) == plain.keys()  # the same n-grams are features
    got = {r["doc_id"]: r for r in QUERIES["op5_toxicity"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    both = []
    for i, r in got.items():
        grams = {int(x) for x in toxicity.gram_buckets(texts[i])}
        z = intercept + sum(float(model[x]) for x in grams)
        assert r["held_out"] == held(i) and r["predicted"] == int(r["score"] >= 0.3) and r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)
        both.append((z, plain_intercept + sum(plain.get(x, 0.0) for x in grams)))
    # some sixty rows leave the fit room: the library stops at its tolerance, the Newton steps go on
    z, want = np.array(both).T
    assert np.corrcoef(z, want)[0, 1] > 0.75 and ((z > -0.85) == (want > -0.85)).mean() > 0.9


def quality_scores(spark, docs, labels):
    return quality.score(docs, quality.train(docs.select("doc_id", "text"), labels), quality.site_outcomes(docs, labels, "source", "lang"), column="quality_now")


def test_quality(spark):
    docs, labels = labelled(spark)
    wide = with_edges(spark, docs)
    scored = quality_scores(spark, wide, labels).withColumnRenamed("quality_now", "q_now")
    assert scored.columns == [*wide.columns, "q_now"] and {(r["p"], r["h"], r["shift"], r["_p"]) for r in scored.collect()} == {(7, 8, 9, 1)}
    rows = scored.join(labels, "doc_id").collect()
    assert sum((r["q_now"] >= quality.THRESHOLD) == bool(r["quality"]) for r in rows) >= 0.97 * len(rows)
    assert scored.filter("doc_id > 9000 OR doc_id IS NULL").count() == 4
    assert scored.filter("q_now IS NULL OR q_now < 0 OR q_now > 1").count() == 0
    assert quality_scores(spark, docs.limit(0), labels.limit(0)).count() == 0
    kept = quality.drop_poor(wide, labels, docs)
    assert kept.columns == wide.columns and kept.filter("p <> 7").count() == 0
    with pytest.raises(ValueError):
        quality.score(wide, (np.zeros(quality.BUCKETS), [0.0] * quality.N_FEATURES, 0.0), quality.site_outcomes(docs, labels, "source", "lang"), column="P")
    with pytest.raises(ValueError):
        toxicity.score(wide, (np.zeros(toxicity.BUCKETS), 0.0), "toxicity")


def brute_shifts(rows, strength, host_strength, leave_out):
    """Log-odds shifts per (host, path) from rows (host, path, fold, n, k), without the fold that is left out."""
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    g = (sum(r[4] for r in rows) + 1) / (sum(r[3] for r in rows) + 2)
    out = {}
    for h, p in {r[:2] for r in rows}:
        of_host, of_path = ([r for r in rows if r[0] == h and (x or r[1] == p) and r[2] != leave_out] for x in (True, False))
        rate = (sum(r[4] for r in of_host) + host_strength * g) / (sum(r[3] for r in of_host) + host_strength)
        out[h, p] = logit((sum(r[4] for r in of_path) + strength * rate) / (sum(r[3] for r in of_path) + strength)) - logit(g)
    return out


def test_site_posteriors_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(h, p, f, n, rng.randrange(n + 1)) for h in ("a", "b", "c") for p in ("x", "y") for f in range(quality.FOLDS) for n in (rng.randrange(1, 30),) if rng.random() < 0.8]
    rows += [("big", "x", 0, 500, 480), ("bad", "x", 1, 500, 20), ("tiny", "x", 2, 1, 0)]
    df = spark.createDataFrame(rows, "h string, p string, fold int, n long, k long")
    paths = df.groupBy("h", "p").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    strengths = quality.prior_strength(paths, ["h"]), quality.prior_strength(paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), [])
    got = {(r["h"], r["p"]): r["shifts"] for r in quality.path_shifts(df).collect()}
    for fold in range(-1, quality.FOLDS):
        for key, shift in brute_shifts(rows, *strengths, fold).items():
            if fold in got[key]:
                assert got[key][fold] == pytest.approx(shift)
    assert all(set(got[r[:2]]) >= {-1, r[2]} for r in rows)
    assert got["bad", "x"][-1] < got["tiny", "x"][-1] < 0 < got["big", "x"][-1]


def brute_tiles(text, item, k):
    used_t, used_i, tiles = set(), set(), []
    k = min(k, len(item))
    while True:
        best = (0, 0, 0)
        for q in range(len(item)):
            for p in range(len(text)):
                n = 0
                while p + n < len(text) and q + n < len(item) and text[p + n] == item[q + n] and p + n not in used_t and q + n not in used_i:
                    n += 1
                if n > best[0]:
                    best = (n, q, p)
        n, q, p = best
        if n < k or not n:
            return tiles
        used_t |= set(range(p, p + n))
        used_i |= set(range(q, q + n))
        tiles.append((p, q, n))


def test_tiling_against_brute_force():
    rng = random.Random(7)
    for _ in range(60):
        item = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 25))]
        text = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))]
        cut = rng.randrange(len(item))
        text[len(text) // 2 :] = item[cut:] + item[:cut]
        assert decontaminate.tile(text, item, 3) == brute_tiles(text, item, 3)
    assert decontaminate.tile(["a"] * 50, ["a"] * 7, 4) == [(0, 0, 7)]
    assert decontaminate.tile([], ["a"], 4) == decontaminate.tile(["a"], [], 4) == []


def test_decontamination(spark):
    item = [f"q{i}" for i in range(40)]
    reordered = " ".join(item[20:] + ["filler"] * 10 + item[:20])
    bench = spark.createDataFrame([(1, " ".join(item)), (8, " ".join(item)), (2, None), (3, ""), (4, "Two Words"), (5, "...")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x " * 100_000 + reordered.upper()), (2, " ".join(item[:10])), (3, None), (4, ""), (5, "only two words here"), (6, "two other words"), (7, " ".join(item[:20])), (7, " ".join(item[:20]))], "doc_id long, text string"
    ).withColumns({"item_id": F.lit("clash"), "t1": F.lit("x"), "h": F.lit(None)})
    got = sorted((r["doc_id"], r["item_id"], r["n_items"], r["n_tiles"], r["coverage"]) for r in decontaminate.contaminated_pairs(docs, bench).collect())
    assert got == [(1, 1, 2, 2, 1.0), (5, 4, 1, 1, 1.0), (7, 1, 2, 1, 0.5), (7, 1, 2, 1, 0.5)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()) == [2, 3, 4, 6]
    assert decontaminate.contaminated_pairs(docs.limit(0), bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 8
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns


def test_query_of_contaminated_pairs_against_brute_force(spark, sf_dir):
    read = lambda name, key: [(r[key], decontaminate.tokens(r["text"])) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]
    grams = lambda w: {tuple(w[i : i + min(4, len(w))]) for i in range(max(1, len(w) - 3))} if w else set()
    docs, want = [(i, w, grams(w)) for i, w in read("documents", "doc_id")], set()
    for item, words in read("benchmark", "item_id"):
        mine = grams(words)
        for i, w, theirs in docs:
            if mine & theirs:
                starts = {p + j for p in range(len(w)) if tuple(w[p : p + 4]) in mine for j in range(4)}  # brute force over the parts that share a 4-gram
                part = [x if p in starts else None for p, x in enumerate(w) if p in starts or p - 1 in starts]
                covered = sum(t[2] for t in brute_tiles(part, words, 4))
                if covered >= 0.5 * len(words):
                    want.add((i, tuple(words), covered))
    items = {}
    for item, words in read("benchmark", "item_id"):
        items[item] = tuple(words)
    got = {(r["doc_id"], items[r["item_id"]], r["tiled_words"]) for r in decontaminate.op8_decontaminate(spark, sf_dir).collect()}
    assert got == want and got


def brute_katz(rows, histories=300):
    tok = [(t or "").encode().lower().split() + [0] for _, t, _ in rows]
    train = [w for w, r in zip(tok, rows, strict=True) if r[2]]
    counts = {1: Counter(w for x in train for w in x), 2: Counter(p for x in train for p in zip([1, *x], x, strict=False)), 3: Counter(p for x in train for p in zip([1, *x], x, x[1:], strict=False))}
    c = counts[1]
    total = sum(c.values())

    def kept(counts):
        n = [sum(1 for v in counts.values() if v == r) for r in range(1, 7)]
        d = {}
        for r in range(1, 6):
            d[r] = (r - 0.5) / r
            if 0 not in n:
                a = 6 * n[5] / n[0]
                x = ((r + 1) * n[r] / (n[r - 1] * r) - a) / (1 - a) if a != 1 else 0
                d[r] = x if 0 < x < 1 else d[r]
        return lambda r: d[r] * r if r <= 5 else r - 0.5

    d = {k: kept(x) for k, x in counts.items()}
    left = (total - sum(map(d[1], c.values()))) / total if total else 1.0
    after, times = defaultdict(list), defaultdict(int)  # of each history
    for k in (2, 3):
        for g, n in counts[k].items():
            after[g[:-1]].append(g[-1])
            times[g[:-1]] += n
    known = {}

    def p(h, w):
        if not h:
            return d[1](c[w]) / total if w in c else left
        if h not in times:
            return p(h[1:], w)
        if (*h, w) in counts[len(h) + 1]:
            return d[len(h) + 1](counts[len(h) + 1][*h, w]) / times[h]
        if h not in known:
            known[h] = (1 - sum(p(h, x) for x in after[h])) / (1 - sum(p(h[1:], x) for x in after[h]))
        return known[h] * p(h[1:], w)

    for h in list(times)[:histories]:
        assert sum(p(h, w) for w in c) + p(h, "never") == pytest.approx(1)
    out = []
    for x, (i, _, _) in zip(tok, rows, strict=True):
        base = sum(math.log10((c.get(w, 0) + 1) / (total + len(c) + 1)) for w in x)
        score = sum(math.log10(p(tuple([1, *x[:j]][-2:]), w)) for j, w in enumerate(x))
        out.append((str(i), len(x), sum(w in c for w in x), total, pytest.approx(base), pytest.approx(score)))
    return sorted(out, key=lambda r: (r[0], r[1]))


def test_query_of_katz_against_brute_force(spark, sf_dir):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    rows = [(r["doc_id"], r["text"], not held(r["doc_id"])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op9_katz_backoff"](spark, sf_dir).collect()
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert sorted(((str(r["doc_id"]), *(r[n] for n in names)) for r in got), key=lambda r: (r[0], r[1])) == brute_katz(rows, 3)


@pytest.mark.parametrize("small", [True, False])
def test_katz_against_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(katz, "RANGE_KEYS", 50)
        monkeypatch.setattr(katz, "BATCH_TOKENS", 90)
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{min(rng.randrange(1, 60), rng.randrange(1, 60))}" for _ in range(rng.randrange(0, 40))), zlib.crc32(str(i).encode()) % 3 != 0) for i in range(120)]
    rows += [(500, None, True), (501, "", False), (None, "A a\tA", True), (502, "unseen words " * 3000, False), (503, "w1", True), (503, "w1", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").withColumn("score", F.lit("clash")).repartition(3)
    got = sorted(((str(r["doc_id"]), *[r[c] for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]) for r in katz.score_texts(df).collect()), key=lambda r: (r[0], r[1]))
    assert got == brute_katz(rows)


@pytest.mark.parametrize("small", [True, False])
def test_stored_katz_model_scores_as_one_that_is_trained_along(spark, tmp_path, monkeypatch, small):
    if small:
        monkeypatch.setattr(katz, "RANGE_KEYS", 50)
        monkeypatch.setattr(katz, "BATCH_TOKENS", 90)
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{min(rng.randrange(1, 60), rng.randrange(1, 60))}" for _ in range(rng.randrange(0, 40))), i % 3 != 0) for i in range(90)]
    rows += [(500, None, True), (501, "", False), (502, "unseen words " * 300, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    path = f"file://{tmp_path}/model"
    katz.train(df.filter("train"), path)
    got = sorted((r["doc_id"], *[r[c] for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]) for r in katz.score_with(df, path).collect())
    assert [(str(g[0]), *g[1:]) for g in sorted(got, key=lambda g: (str(g[0]), g[1]))] == brute_katz(rows)
    assert katz.score_with(df.limit(0), path).count() == 0


def test_katz_without_training_texts(spark):
    df = spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, train boolean")
    r = katz.score_texts(df).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)
    assert katz.score_texts(df.limit(0)).count() == 0


@needs_model
def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    left = {r["doc_id"] for r in docs.collect()}
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if n < 4:
            assert out.columns == docs.columns
            docs = corpus_pipeline.cut(out, f"test-{n}")
            now = {r["doc_id"] for r in docs.collect()}
            assert now < left or now == left
            left = now
        else:
            rows = out.collect()
            assert {r["doc_id"] for r in rows} == left and all(r["ids"] is not None for r in rows)
    good = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(i in left for i in good) > 0.6 * len(good)
    assert not any(labels[i]["quality"] == 0 for i in left if i in labels)
