"""WARC, nearest neighbours and the Jaccard join against brute force, with edge rows."""

import hashlib
import random
import uuid

import numpy as np
import pyarrow as pa
import pytest

from traceaudit.llm import components, jaccard_join, knn, warc
from traceaudit.llm.common import WordHashes


def brute_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_components(rows):
    sets = brute_sets(rows)
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed=1):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(3000))
    common = [word() for _ in range(30)]
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a b c d e"), (6, "a b c d f"), (7, " \t\n")]
    n = 8
    for size in (8, 30, 31, 200, 1500):
        base = [word() for _ in range(size)]
        for edits in (0, 0, 1, 2, 4, 8, 16, 30):
            w = list(base)
            for _ in range(min(edits, size // 3)):
                w[rng.randrange(size)] = word()
            rows.append((n, " ".join(w)))
            n += 1
        rows.append((n, " ".join(common + base[: size // 2])))
        n += 1
    chain = [word() for _ in range(300)]
    for step in range(12):  # neighbours link, ends do not
        rows.append((n, " ".join(chain)))
        n += 1
        chain = chain[12:] + [word() for _ in range(12)]
    return rows


def check_join(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n", "1 AS h", "2 AS component_id").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.component_table(df, **options).collect()}
    assert got == brute_components(rows)


def test_jaccard_join(spark):
    check_join(spark, near_copies())


def test_jaccard_join_in_small_chunks_without_frequent_shingles(spark):
    check_join(spark, near_copies(2), chunk=3, most=0)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.component_table(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = jaccard_join.component_table(spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in rows) == [("1", 1, 1), ("1", 1, 1), ("None", 1, None)]


def test_jaccard_join_of_ids_with_several_texts(spark):
    rng = random.Random(6)
    a, b, c = ([f"{x}{rng.randrange(500)}" for _ in range(60)] for x in "abc")
    near = lambda w: " ".join([*w[:-2], "other", "words"])
    rows = [(1, " ".join(a)), (3, " ".join(b)), (7, near(a)), (7, " ".join(b)), (7, near(c)), (9, " ".join(c)), (9, " ".join(c)), (12, " ".join(c[:30]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for options in ({}, {"chunk": 1, "most": 0}):
        got = sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.component_table(df, **options).collect())
        assert got == [(1, 1), (3, 1), (7, 1), (7, 1), (7, 1), (9, 1), (9, 1), (12, 12)]


def test_jaccard_join_of_a_large_component_and_stragglers(spark):
    rng = random.Random(8)
    base = ["w" + str(rng.randrange(3000)) for _ in range(60)]
    rows = []
    for i in range(120):  # most are copies with one edit near the end; some keep 70 to 80 percent
        w = list(base)
        for j in range(1 if i % 6 else 5 + i % 3):
            w[-1 - j * 2] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    check_join(spark, rows, chunk=2, most=0)
    check_join(spark, rows, chunk=2, most=50)


def test_signature_bound_never_prunes_a_link():
    rng = random.Random(3)
    for _ in range(300):
        a = np.array(sorted(rng.sample(range(10**6), rng.randrange(1, 400))), np.uint64)
        b = np.unique(np.concatenate([a[: rng.randrange(len(a) + 1)], np.array(rng.sample(range(10**6), rng.randrange(1, 60)), np.uint64)]))
        stats = [(bits, len(s), len(s), excess) for s in (a, b) for bits, excess in (jaccard_join.bitmap(s),)]
        if jaccard_join.linked(a, b):
            assert jaccard_join.possible(*stats)
    assert len(jaccard_join.set_of("a b c d e f a b c d e f", WordHashes())) == 6


def test_sets_of_many_texts_at_once():
    texts = ["skipped", None, "", " \t\n", "A  b", "a B", "a b c d e", "a b c d f", "a\x1cb c\x00 c d e", "a\x1cb c c d e", "é\u00a0x É\u2003y \x0bz\x0c q", "x" * 9, "x" * 10, "x" * 32, "x" * 33, "x" * 34 + " y", " ".join(f"w{i % 7}" for i in range(50)), "a b c d e f a b c d e f"]
    texts += [" ".join("v" * (1 + (i * j) % 41) for i in range(j)) for j in range(40)]
    plain, hashes = [jaccard_join.set_of(t, WordHashes()) for t in texts[1:]], {}
    for kind in (pa.string(), pa.large_string()):
        many = jaccard_join.sets_of(pa.array(texts, kind).slice(1))
        assert [len(s) for s in many] == [len(s) for s in plain]
        for a in range(len(plain)):
            assert np.array_equal(many[a], np.unique(many[a])) and np.array_equal(many[a], hashes.setdefault(a, many[a]))
            assert all(len(np.intersect1d(plain[a], plain[b])) == len(np.intersect1d(many[a], many[b])) for b in range(a))
    assert jaccard_join.sets_of(pa.array([], pa.string())) == [] and [len(s) for s in jaccard_join.sets_of(pa.array([None, ""], pa.string()))] == [0, 0]


def test_few_sets_meet_pair_by_pair_as_in_trees(monkeypatch):
    rng, rows = random.Random(4), []
    base = [np.array([rng.randrange(2**62) for _ in range(300)], np.uint64) for _ in range(6)]
    for h, size in enumerate((1, 2, 2, 3, 9, 30, 64, 70, 2, 40)):
        for i, j in ((0, 0), (0, 1)):
            for _ in range(size):
                s = base[rng.randrange(6)][: rng.randrange(1, 300)]
                bits, excess = jaccard_join.bitmap(s)
                marks, more = jaccard_join.bitmap(s[: rng.randrange(1, 20)])
                side = rng.randrange(2) if i != j else 0
                lows = rng.choice((None, [], [rng.randrange(9) for _ in range(rng.randrange(1, 4))]))
                rows.append((1, 0, h, 0, i, j, rng.randrange(10**6), side, rng.randrange(20), len(s), excess, bits.to_bytes(jaccard_join.BITS // 8, "little"), lows, marks.to_bytes(jaccard_join.BITS // 8, "little"), more))
    columns = [pa.array(c, pa.list_(pa.int64()) if k == 12 else None) for k, c in enumerate(zip(*rows, strict=True))]
    batch = pa.RecordBatch.from_arrays(columns, [str(k) for k in range(15)])
    found = []
    for paired, size in ((64, 500), (64, 7), (1, 500)):  # 1: trees alone
        monkeypatch.setattr(jaccard_join, "PAIRED", paired)
        got = jaccard_join.second_round(batch.slice(k, size) for k in range(0, len(rows), size))
        found.append(sorted({pair for x in got for pair in zip(*[c.to_pylist() for c in x.columns], strict=True)}))
    assert len(found[0]) > 20 and found[0] == found[1] == found[2]


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 1), (10, 1), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 1, 8: 8, 9: 8}
    assert components.components(links.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 300_000
    pages = [(1, "http://a/%0A", "é" * 60), (2, "http://a\r\nb", "é" * 60), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", big), (8, "u", big), (9, "http://c", "\r\n\r\nWARC/1.1\r\n" * 20)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    index = warc.write_archives(warc.plan_records(df), folder, file_bytes=1000)
    back = {r["page_id"]: r for r in warc.read_records(index, folder).collect()}
    assert len(back) == len(pages)
    for i, url, html in pages:
        data = (html or "").encode()
        assert back[i]["url"] == url and back[i]["payload_digest"] == hashlib.sha256(data).hexdigest()
        assert back[i]["payload"] == (b"" if back[i]["record_type"] == "revisit" else data)
    assert {i: r["refers_to"] for i, r in back.items() if r["record_type"] == "revisit"} == {2: 1, 8: 7}
    full = {r["page_id"]: r["payload_bytes"] for r in warc.resolve_revisits(warc.read_records(index, folder).drop("payload")).collect()}
    assert full == {i: len((h or "").encode()) for i, _, h in pages}
    picked = warc.read_records(index.filter("page_id IN (2, 7)"), folder)
    assert sorted(r["page_id"] for r in picked.collect()) == [2, 7]
    none = warc.write_archives(warc.plan_records(df.limit(0)), folder)
    assert warc.read_records(none, folder).count() == 0


def test_warc_of_repeated_rows_and_null_ids(spark, tmp_path):
    big, other = "y" * 200, "z" * 200
    pages = [(1, "u", big), (1, "u", big), (2, "u", big), (2, "u", big), (None, "u", big), (None, None, None), (5, "u", other), (5, "u", "short"), (6, "u", other), (None, "u", "n" * 200), (None, "u", "n" * 200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    index = warc.write_archives(warc.plan_records(df), folder)
    back = warc.resolve_revisits(warc.read_records(index, folder).drop("payload"))
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], str(r["refers_to"])) for r in back.collect())
    want = [("1", 200, "response", "None")] * 2 + [("2", 200, "revisit", "1")] * 2 + [("5", 5, "response", "None"), ("5", 200, "response", "None"), ("6", 200, "revisit", "5")]
    want += [("None", 0, "response", "None"), ("None", 200, "response", "None"), ("None", 200, "response", "None"), ("None", 200, "revisit", "1")]
    assert got == sorted(want)


def test_byte_ranges_cover_the_selection(spark):
    index = spark.createDataFrame([("f", 0, 10), ("f", 10, 5), ("f", 500, 5), ("g", 3, 4)], "file string, offset long, length long")
    got = sorted((r["file"], r["start"], r["stop"], len(r["spans"])) for r in warc.byte_ranges(index, gap=100).collect())
    assert got == [("f", 0, 15, 2), ("f", 500, 505, 1), ("g", 3, 7, 1)]


def brute_knn(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, np.float64)
    out = {}
    for q, a in ok.items():
        if q % 50 == 0:
            scored = sorted((-float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())), i) for i, b in ok.items() if i != q and len(b) == len(a))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(400)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1050, None), (1051, [0.0] * 8), (1052, [float("nan")] + [1.0] * 7), (1053, [None] + [1.0] * 7), (1100, [1.0, 2.0]), (1101, [2.0, 1.0]), (1200, []), (1250, [1e-3] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>").selectExpr("*", "'x' AS dim", "1 AS block").repartition(3)
    got = {}
    for r in knn.nearest(df, df.filter("id % 50 = 0"), query_rows=7, candidate_rows=50).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_knn(rows, 5)
    assert got.keys() == want.keys() and len(got[1100]) == 1
    for q, found in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in found], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in found], atol=1e-14)
    assert knn.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_neighbours_of_repeated_ids_and_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    one = [1.0, 2.0, 3.0, 4.0]
    rows += [(i, one) for i in range(60, 260)]  # ties by the hundred
    rows += [(0, rows[0][1]), (7, rows[7][1]), (7, [9.0, 9.0, 9.0, 9.0]), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    got = {}
    for r in knn.nearest(df, df.filter("id % 50 = 0"), query_rows=3, candidate_rows=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    kept = {}
    for i, v in rows:
        kept[i] = min(v, kept.get(i, v))
    want = brute_knn(list(kept.items()), 5)
    assert got == {q: [i for i, _ in found] for q, found in want.items()}
    assert got[100] == [60, 61, 62, 63, 64] and got[0][0] != got[0][1]


def test_query_of_neighbours_against_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {}
    for r in knn.op7_block_knn(spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], pytest.approx(r["score"], abs=1e-14)))
    assert got == {q: [(n + 1, i, s) for n, (i, s) in enumerate(found)] for q, found in brute_knn(rows, 5).items()}


def test_int8_bound_holds():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 64)), rng.normal(size=(60, 64)) * 10.0 ** rng.integers(-3, 3, (60, 1))
    (qc, qs, qr, qn), (cc, cs, cr, cn) = knn.quantise(x), knn.quantise(y)
    dots = knn.products(qc, cc) * qs[:, None] * cs[None]
    exact = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    assert (np.abs(dots - exact) <= qr[:, None] * (cn + cr)[None] + qn[:, None] * cr[None] + 1e-9).all()
