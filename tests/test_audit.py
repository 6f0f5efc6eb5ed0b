"""The audit as a whole on edge rows, ranks by slices, and properties of set verification."""

import random

from pyspark.sql import functions as F

from traceaudit.operators import audit, perturb, ranks

LEXICON = {"ring": ("ring",), "acid": ("acid",), "amine": ("amine",)}
ROWS = [
    ("1", "<think>an acid and a ring</think><answer>acid</answer>", "an acid"),
    ("2", "", "x"),
    ("3", None, "x"),
    ("4", "no tags at all", "acid"),
    ("5", "<think>amines only</think><answer>amine</answer>", None),
]


def test_diagnose(spark):
    df = spark.createDataFrame(ROWS, "id string, answer string, gt string").withColumn("facts", F.array(F.lit("acid")))
    got = {r["id"]: r for r in audit.diagnose(df, LEXICON, ("ring",), F.col("facts")).collect()}
    assert sorted(got) == ["1", "4", "5"]
    assert (got["1"]["verified"], got["1"]["fabricated"], got["1"]["er"], got["1"]["n_fabricated"]) == (["acid"], ["ring"], 30.0, 0)
    assert (got["4"]["claimed"], got["4"]["er"], got["4"]["pred"], got["4"]["perf"]) == ([], 0.0, None, 0.0)
    assert (got["5"]["er"], got["5"]["perf"]) == (60.0, 0.0)
    assert all(0 <= r["overall"] <= 100 for r in got.values())


def test_grouped_rank_equals_a_window(spark):
    df = spark.range(0, 997).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.when(F.col("id") % 7 == 0, "b")).alias("g"), (F.col("id") * 37 % 997).alias("k"))
    rows = ranks.grouped_rank(df, "g", "k", "r", slices=8).collect()
    for g in ("hot", "b", None):
        assert [r["r"] for r in sorted((x for x in rows if x["g"] == g), key=lambda x: x["k"])] == list(range(1, 1 + sum(x["g"] == g for x in rows)))
    assert ranks.grouped_rank(df.limit(0), "g", "k", "r").count() == 0


def test_corrupt_fragments(spark):
    df = spark.createDataFrame([("1", "see CCO and CC"), ("2", "none"), ("3", None)], "id string, text string")
    pool = spark.createDataFrame([("NN",), ("OOO",)], "key string")
    got = {r["id"]: r["corrupted"] for r in perturb.corrupt_fragments(df, "id", "text", F.regexp_extract_all("text", F.lit("C[CO]+"), 0), pool).collect()}
    assert got["2"] == "none" and got["3"] is None
    assert "C" not in got["1"] and all(w in ("see", "and", "NN", "OOO") for w in got["1"].split())


def test_verified_and_fabricated_partition_the_claims(spark):
    from traceaudit.operators.claims import verify

    rng = random.Random(0)
    rows = [(rng.sample("abcdef", rng.randrange(6)), rng.sample("abcdef", rng.randrange(6))) for _ in range(60)]
    v, f = verify(F.col("c"), F.col("e"))
    for r in spark.createDataFrame(rows, "c array<string>, e array<string>").select("c", "e", v.alias("v"), f.alias("f")).collect():
        assert sorted(r["v"] + r["f"]) == sorted(r["c"]) and not set(r["v"]) & set(r["f"]) and set(r["v"]) <= set(r["e"])


def test_families_have_rules_of_their_own(spark):
    rows = [
        ("label", "label", "<think>an acid here</think><answer>Yes</answer>", "yes"),
        ("no label", "label", "<think>an acid here</think><answer>perhaps</answer>", "yes"),
        ("set", "set", "<think>nothing at all to say</think><answer>CC.XX</answer>", "CC"),
        ("structure", "structure", "<think>a ring, formed from the acid, is here</think><answer>CCO</answer>", "CC"),
        ("invalid", "structure", "<think>a ring is all that is here</think><answer>XX</answer>", "CC"),
        ("edit", "edit", "<think>as it was before, no change</think><answer>CC</answer>", "CC"),
        ("constraint", "constraint", "<think>as it was before, no change</think><answer>XX</answer>", "CC"),
        ("caption", "caption", "The molecule is an acid that was found in some plants.", "The molecule is an acid."),
    ]
    df = audit.extract(spark.createDataFrame(rows, "id string, family string, answer string, gt string"), family="family")
    df = audit.verify(df, LEXICON, F.array(F.lit("acid")), family="family")
    parts = F.split("pred", r"\.")
    valid = F.filter(parts, lambda p: p != "XX")
    measures = {
        "truth_label": F.col("gt"), "valid": F.col("pred") != "XX", "similarity": F.lit(0.5), "parts": F.size(parts), "valid_parts": F.size(valid), "pred_set": valid, "truth_set": F.array("gt"),
        "violations": F.lit(2), "wanted": F.array(F.lit("ring"), F.lit("acid")), "pred_groups": F.array(F.lit("acid")), "structure_similarity": F.lit(0.25), "unchanged": F.col("pred") == F.col("gt"), "has_source": F.lit(True), "success": F.lit(1),
    }
    got = {r["id"]: r for r in audit.score_by_family(df, (), "family", measures).collect()}
    of = lambda k: tuple(got[k][c] for c in ("io", "er", "eo", "pred_valid", "validity_issue", "perf"))
    assert of("label") == (0.0, 0.0, 0.0, True, None, 1.0)
    assert of("no label") == (70.0, 0.0, 0.0, False, "no_prediction", 0.0) and abs(got["no label"]["overall"] - 0.25 * 70 / 0.65) < 1e-9
    assert of("set") == (40.0, 0.0, 0.0, False, "invalid", 1.0)
    assert got["structure"]["claimed"] == [] and got["invalid"]["claimed"] == ["ring"]
    assert of("structure")[2:] == (75.0, True, None, 0.0)
    assert of("invalid") == (0.0, 75.0, 0.0, False, "invalid", 0.0) and abs(got["invalid"]["overall"] - 0.25 * 75 / 0.4) < 1e-9
    assert of("edit") == (0.0, 0.0, 60.0, True, None, 1.0)
    assert of("constraint") == (80.0, 0.0, 100.0, False, "invalid", 1.0)
    assert of("caption") == (0.0, 0.0, 50.0, True, None, 0.5)


def test_structure_validity_and_unknown_families(spark):
    import pytest

    from traceaudit.functions import scores as sc

    a = lambda *groups: F.array(*[F.lit(g) for g in groups]).cast("array<string>")
    one = lambda c: spark.range(1).select(c.alias("x")).head()["x"]
    assert one(sc.structure_validity(F.lit(2), a("ring", "acid"), a("ring"), a("acid"), F.lit(4), F.lit(3))) == 20 + 15 + 25 + 3.75
    assert one(sc.structure_validity(F.lit(9), a(), a("ring"), a(), F.lit(0), F.lit(0))) == 40.0
    df = audit.extract(spark.createDataFrame([("x", "<answer>y</answer>")], "family string, answer string"), family="family")
    with pytest.raises(Exception, match="Unknown task family: x"):
        audit.score_by_family(audit.verify(df, LEXICON, F.array(F.lit("acid")), family="family"), (), "family", {}).collect()


def test_caption_validity_reads_the_whole_answer(spark):
    from traceaudit.plans.scores import whole_caption_validity

    rows = [
        ("late", "<think>Hm. Well.</think><answer>Seen in plants. The molecule is an acid of low weight.</answer>"),
        ("short", "<think>The molecule is an acid that was found in some plants.</think><answer>acid</answer>"),
        ("bare", "Seen in plants. The molecule is an acid of low weight."),
    ]
    got = whole_caption_validity(spark.createDataFrame(rows, "id string, answer string"))
    assert {r["id"]: r["io"] for r in got.collect()} == {"late": 0.0, "short": 80.0, "bare": 0.0}


def test_substitutes_are_whole_facts(spark):
    from traceaudit.plans.outcomes import substitutes

    rows = [("the same beginning of all, one", True), ("the same beginning of all, two", True), ("not valid", False)]
    got = substitutes(spark.createDataFrame(rows, "canonical string, valid boolean")).collect()
    assert sorted(r["key"] for r in got) == [rows[0][0], rows[1][0]]
