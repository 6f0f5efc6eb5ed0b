"""Edge rows and published values of the functions and operators."""

import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traceaudit.functions import scores as sc
from traceaudit.functions import similarity as sim
from traceaudit.functions import text as tx
from traceaudit.operators import claims as cl
from traceaudit.operators import cluster as cu
from traceaudit.operators import joins as jn
from traceaudit.operators import perturb as pb
from traceaudit.operators import prepare as pr
from traceaudit.operators import stats, windows

LEXICON = {"nitro": ("nitro",), "acid": ("carboxylic acid", "acid"), "amine": ("amine",)}


def values(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column, **fields):
    names = list(fields)
    schema = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for n, v in fields.items())
    return spark.createDataFrame([tuple(fields[n] for n in names)], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "answer", "trace"),
    [
        (None, None, None),
        ("", None, None),
        ("no tags", None, None),
        ("<think> a\nb </think><answer>draft</answer><answer> x\ny </answer>", "x\ny", "a\nb"),
        ("<|think_start|>t<|think_end|><|answer_start|> open", "open", "t"),
        ("because so <answer>z</answer>", "z", "because so"),
        ("<answer>z</answer>", "z", None),
        ("<think>only</think>", None, "only"),
    ],
)
def test_extract(spark, text, answer, trace):
    assert one(spark, tx.extract_answer(F.col("t")), t=text) == answer
    assert one(spark, tx.extract_reasoning(F.col("t")), t=text) == trace


def test_numeric_and_label(spark):
    assert one(spark, tx.extract_numeric(F.col("t")), t="<answer> 2.5 </answer> 7") == 2.5
    assert one(spark, tx.extract_numeric(F.col("t")), t="about 3 or -4.5") == -4.5
    assert one(spark, tx.extract_numeric(F.col("t")), t="none") is None
    assert one(spark, tx.extract_label(F.col("t")), t="<answer>Yes, it is</answer>") == "yes"
    assert one(spark, tx.extract_label(F.col("t")), t="yes") is None


def test_claims_are_whole_words(spark):
    rows = spark.createDataFrame([(1, "a nitrogen atom"), (2, "Nitro groups and  ACIDS"), (3, None), (4, "")], "id int, t string")
    got = {r["id"]: r["c"] for r in rows.select("id", cl.named_groups(F.col("t"), LEXICON).alias("c")).collect()}
    assert got == {1: [], 2: ["acid", "nitro"], 3: [], 4: []}


@pytest.mark.parametrize(("gap", "claimed"), [(60, []), (61, ["amine"])])
def test_derivation_window(spark, gap, claimed):
    text = "precursor" + " " + "x" * (gap - 11) + " amine"  # the phrase begins `gap` characters before the keyword
    df = spark.createDataFrame([(text,)], "t string")
    assert cl.named_groups_outside(df, "t", LEXICON).first()["claimed"] == claimed


def test_published_scores(spark):
    assert one(spark, sc.fabrication(F.lit(2), F.lit(2), F.lit(0)), a=1) == 75.0
    assert one(spark, sc.overall({"ir": F.lit(10.0), "io": F.lit(20.0), "er": F.lit(30.0), "eo": F.lit(40.0)}, {}), a=1) == pytest.approx(0.15 * 10 + 0.25 * 20 + 0.25 * 30 + 0.35 * 40)
    coupled = sc.grounded_reward(F.lit(0.0), F.lit(1.0), F.lit(100.0), F.lit(0.0), F.lit(5.0), True)
    assert one(spark, coupled, a=1) == 0.0
    assert one(spark, sc.grounded_reward(F.lit(0.0), F.lit(1.0), F.lit(100.0), F.lit(0.0), F.lit(5.0), False), a=1) == pytest.approx(0.4)


def test_audit_precision(spark):
    rows = [("fabricated", "claims")] * 126 + [("fabricated", "no_claim")] * 5 + [("verified", "claims")] * 123 + [("verified", "no_claim")] * 3
    r = stats.audit_precision(spark.createDataFrame(rows, "verdict string, label string"), []).first()
    assert (round(r["fabricated_precision"], 3), round(r["verified_agreement"], 3), round(r["pooled"], 3)) == (0.962, 0.976, 0.969)


def test_enrichment(spark):
    df = spark.createDataFrame([("a", 0.13356839, 440201), ("b", 0.8, 8159780 - 440201), ("c", 0.0, 0)], "cat string, share double, count long").withColumn("k", F.lit(1))
    got = {r["cat"]: r["enrichment"] for r in stats.enrichment(df, ["k"]).collect()}
    assert got["a"] == pytest.approx(2.476, abs=1e-3) and got["c"] == 0.0


def test_entropy(spark):
    rows = [(1, str(i)) for i in range(10)] + [(2, "a"), (3, None), (3, "b")]
    got = {r["k"]: r for r in cu.cluster_entropy(spark.createDataFrame(rows, "k int, c string"), "k", "c").collect()}
    assert got[1]["entropy"] == pytest.approx(math.log(10)) and got[1]["normalized"] == pytest.approx(1.0)
    assert (got[2]["entropy"], got[3]["entropy"], got[3]["n_samples"], got[3]["n_valid"]) == (0.0, 0.0, 2, 1)


def test_greedy_clusters_depend_on_order(spark):
    rows = [(1, 0, "a b c d"), (1, 1, "a b c e"), (1, 2, "x"), (1, 3, "a b c d"), (1, 4, None)]
    df = spark.createDataFrame(rows, "k int, pos int, v string")
    got = {r["pos"]: r["cluster"] for r in cu.greedy_clusters(df, "k", "pos", "v", threshold=0.6).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0}


def brute_bleu(ref, hyp, n):
    if not set(ref) & set(hyp):
        return 0.0
    total = 0.0
    for k in range(1, n + 1):
        a = Counter(tuple(hyp[i : i + k]) for i in range(len(hyp) - k + 1))
        b = Counter(tuple(ref[i : i + k]) for i in range(len(ref) - k + 1))
        total += math.log((sum((a & b).values()) or 0.1) / max(1, sum(a.values()))) / n
    return math.exp(total) * min(1.0, math.exp(1 - len(ref) / len(hyp)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=12), st.lists(st.sampled_from("abcd"), min_size=1, max_size=12))
def test_bleu(ref, hyp):
    assert sim.bleu_score(" ".join(ref), " ".join(hyp), 4) == pytest.approx(brute_bleu(ref, hyp, 4))


def test_similarity_edges(spark):
    df = spark.createDataFrame([([1, 2], [2, 3]), ([], [1]), (None, [1]), ([], [])], "a array<int>, b array<int>")
    assert [r["x"] for r in df.select(sim.tanimoto(F.col("a"), F.col("b")).alias("x")).collect()] == [pytest.approx(1 / 3), 0.0, None, 0.0]
    assert [r["x"] for r in df.select(sim.set_jaccard(F.col("a"), F.col("b")).alias("x")).collect()] == [pytest.approx(1 / 3), 0.0, 0.0, 0.0]


def test_diff_of_equal_records_passes(spark):
    a = spark.createDataFrame([("m", "1", None), ("m", "2", 3)], "model string, id string, x int")
    r = jn.diff_records(a, a, ["model", "id"], ["x"], ["model"]).first()
    assert (r["n_same"], r["n_differing"], r["passed"]) == (2, 0, True)
    assert jn.diff_records(a.limit(0), a.limit(0), ["model", "id"], ["x"], ["model"]).count() == 0


def test_contingency_and_strata(spark):
    df = spark.createDataFrame([(True, 0.0), (True, 5.0), (False, None)], "exact boolean, er double")
    cells = {(r["outcome"], r["trace"]): r["n"] for r in stats.contingency(df, []).collect()}
    assert cells == {("right", "faithful"): 1, ("right", "fabricating"): 1, ("right", "all"): 2, ("all", "faithful"): 1, ("all", "fabricating"): 1}
    for null_er, expected in (("drop", {"all": 3, "er0": 1, "erpos": 1}), ("clean", {"all": 3, "er0": 2, "erpos": 1}), ("erpos", {"all": 3, "er0": 1, "erpos": 2})):
        got = stats.stratified(df.withColumn("k", F.lit(1)), ["k"], "er", [F.count("*").alias("n")], null_er)
        assert {r["stratum"]: r["n"] for r in got.collect()} == expected


def test_constraints(spark):
    m = F.create_map(F.lit("c"), F.col("c"), F.lit("o"), F.col("o"))
    got = F.create_map(F.lit("c"), F.lit(2), F.lit("o"), F.lit(0))
    assert one(spark, sc.constraint_success(m, got), c="2", o="0") == 1
    assert one(spark, sc.constraint_success(m, got), c="2", o="") == one(spark, sc.constraint_success(m, got), c="2", o=None) == 1
    assert one(spark, sc.constraint_success(m, got), c="3", o="") == 0
    assert one(spark, sc.constraint_success(m, got), c="2", o="x") == 0
    assert one(spark, sc.constraint_deviation(m, got), c="4", o="x") == 50.0


def test_perturb(spark):
    assert one(spark, pb.replace_first(F.col("t"), F.lit("ABC"), F.lit("z")), t="x abc abc") == "x z abc"
    assert one(spark, pb.swap_trace(F.col("t"), F.lit("new")), t="<think>old</think>a") == "<think>new</think>a"
    assert one(spark, pb.mask_fragments(F.col("t"), F.array(F.lit("CC"), F.lit("CCO"))), t="CCO CC") == "[...] [...]"
    assert one(spark, pb.corrupt_all(F.col("t"), LEXICON, "xx"), t="An Acid and an amine, acid") == "An xx and an xx, acid"


def test_edit_instruction(spark):
    r = one(spark, tx.edit_instruction(F.col("t")), t="Please replace the hydroxyl groups with an amine")
    assert (r["removed"], r["added"]) == ("hydroxyl_group", "amine")
    for text, added, removed in (
        ("Add a nitro group to the molecule", "nitro_group", None),
        ("Please remove an amide groups from the molecule.", None, "amide_group"),
        ("Substitute the Benzene  rings with a hydroxyl", "hydroxyl", "benzene_ring"),
        ("Adding a fused benzene in the molecule", "benzene_ring", None),
        ("Please substitute a hydroxyl in the molecule CCO with a carboxyl.", "carboxyl", "hydroxyl"),
        ("Replace a halo in the molecule CCCl by a nitrile.", "nitrile", "halo"),
        ("Substitute a nitro into amine.", "amine", "nitro"),
        ("Modify CCO by replacing a thiol with C1CC1", None, "thiol"),
        ("Replace everything", None, None),
        ("Delete an aldehyde. Then stop", None, "aldehyde"),
        ("nothing here", None, None),
    ):
        r = one(spark, tx.edit_instruction(F.col("t")), t=text)
        assert (r["added"], r["removed"]) == (added, removed), text


def test_drafted_fragments(spark):
    df = spark.createDataFrame([(1, "first CC(=O)OC then CCCCCC, CC(=O)OC and C1=CC=CC=C1 or N=N"), (2, None), (3, "C(CO)N=O")], "id int, t string")
    facts = spark.createDataFrame([("CC(=O)OC", True, 5), ("C1=CC=CC=C1", True, 6), ("C(CO)N=O", True, 3), ("N=N", True, 9)], "key string, valid boolean, atoms int")
    got = {r["id"]: r["drafted"] for r in tx.drafted_fragments(df, facts, ["id"], "t").collect()}
    assert got == {1: ["CC(=O)OC", "C1=CC=CC=C1"], 2: [], 3: []}


def test_truth_in_json(spark):
    for text, want in (('{"smiles": "CC"}', "CC"), ("no json", ""), (None, ""), ('{"other": 1}', "")):
        assert one(spark, sc.truth_of(F.col("t"), "smiles"), t=text) == want


def test_caption_performance(spark):
    from traceaudit.operators.audit import caption_performance

    a, b = "the molecule is an acid with two rings", "x " * 400
    for answer, truth, want in ((f"<answer>{a}</answer>", a, 1.0), ("untagged", a, 0.0), (f"<answer>{a}</answer>", "", 0.0), (f"<answer>{b}</answer>", b[:500], 1.0)):
        assert one(spark, caption_performance(F.col("a"), F.col("t")), a=answer, t=truth) == pytest.approx(want)


def test_donor_needs_a_different_text(spark):
    df = spark.createDataFrame([("t", 1, "a"), ("t", 2, "a"), ("u", 3, "x"), ("u", 4, "y")], "task string, uid int, text string")
    got = {r["uid"]: r["donor_text"] for r in jn.pair_donor(df, "task", "uid", "text").collect()}
    assert got == {3: "y", 4: "x"}


def test_windows_and_splits(spark):
    df = spark.createDataFrame([(1, i, c, float(v)) for i, (c, v) in enumerate([("a", 0), ("a", 0), ("b", 0)])], "doc int, i int, cat string, v double")
    assert sorted(values(windows.category_runs(df, "doc", "i", "cat").select("cat", "start", "length"))) == [("a", 0, 2), ("b", 2, 1)]
    assert windows.hottest_window(df, "doc", "i", "v", F.col("cat") == "b", 4).count() == 0
    assert windows.hottest_window(df, "doc", "i", "v", F.col("cat") == "b", 2).first()["start"] == 0
    orders = spark.range(5).withColumnRenamed("id", "o")
    assert [r["split"] for r in pr.tail_split(orders, "o", 1).orderBy("o").collect()] == ["train", "train", "train", "valid", "test"]


def test_texts_are_lower_cased_once(spark):
    text, old = F.col("text"), F.col("old")
    assert one(spark, pb.replace_first(text, old, F.lit("X")), text="an Acid, acid", old="ACID") == "an X, acid"
    assert one(spark, pb.corrupt_all(text, LEXICON, "amine x"), text="Nitro, ACID, Amine, nitro") == "amine x x, amine x, Amine, nitro"
    assert one(spark, pb.corrupt_all(text, LEXICON, "x"), text=None) is None
    plan = spark.createDataFrame([("a", "b")], "text string, old string").select(pb.replace_first(text, old, F.lit("X")).alias("r"), pb.corrupt_all(text, LEXICON, "x").alias("c"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("lower(text") == 1


def test_routed_rows_stay_where_they_are(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2] if i else None) for i in range(20)], "i int, code string").repartition(5, "i")
    known, unknown = pr.route_tasks(rows, spark.createDataFrame([("a", "x")], "code string, family string"), "code")
    assert known.count() == 9 and unknown.count() == 11
    for df in (known, unknown):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning(code" not in plan


def test_self_contradiction_normalises_once_and_keeps_every_flip(spark):
    import itertools
    import re

    from traceaudit.functions.text import normalize_text

    flips = ["this is", "This  should\tbe", "the smiles is", "the\nmolecule should be", "the structure is", "this isnt", "athis is", "the smiles"]
    texts = [f" {a} the benzene ring; " * n + f"{b} an acid here." for a in flips for b in flips for n in (1, 4, 6)]
    texts += ["".join(x) + "tail" for x in itertools.product(("a", " ", "  ", "\t", "\n ", " \r\n", "\x0b\x0c", "\u00a0"), repeat=3)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize_text(F.col("t")).alias("n"), sc.self_contradiction(F.col("t")).cast("double").alias("ir"))
    pattern = re.compile(sc.FLIP, re.ASCII)
    for t, n, ir in df.collect():
        assert n == re.sub(r"[ \t\n\x0b\x0c\r]+", " ", t.lower()).strip(" ")
        count = len(pattern.findall(n))
        assert len(t) < 25 or ir == (5.0 * (count - 3) if count > 3 else 0.0)
    plan = df.select("ir")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
