"""JSON arrays of responses, completions and verdicts; an indented file as many tasks."""

import json

import pytest

from traceaudit.sources import records

NASTY = 'line\n  },\n  {"id": 1},  \\n  }, end'


def rows_of(n):
    return [{"id": i, "question": f"q{i}", "gt": "g", "answer": NASTY * (i % 4), "metadata": {"k": i, "list": [1, {"a": "}"}], "s": NASTY}} if i % 2 else {"id": str(i), "input": "old", "answer": None} for i in range(n)]


@pytest.mark.parametrize("wrapped", [False, True])
@pytest.mark.parametrize("step", [1, 2, 4])
def test_indented_equals_any_layout(spark, tmp_path, wrapped, step):
    (tmp_path / "m").mkdir()
    for name, data in (("t", rows_of(40)), ("empty", [])):
        (tmp_path / "m" / f"{name}.json").write_text(json.dumps({"n": 40, "results": data} if wrapped else data, indent=step))
    any_layout = records.read_responses(spark, f"{tmp_path}/m/t.json")
    indented = records.read_responses(spark, f"{tmp_path}/m/t.json" if wrapped else f"{tmp_path}/m/*.json", indent=step * (1 + wrapped))
    plain = lambda r: str({**r.asDict(), "metadata": r["metadata"] and {k: json.loads(v) if v[:1] == "[" else v for k, v in sorted(r["metadata"].items())}})  # noqa: E731  a nested value may keep its blanks
    got, want = (sorted(map(plain, df.collect())) for df in (indented, any_layout))
    assert got == want and len(got) == 40
    one = {r["id"]: r for r in indented.collect()}
    assert one["3"]["metadata"]["k"] == "3" and one["3"]["metadata"]["s"] == NASTY and one["2"]["metadata"] is None
    assert one["2"]["question"] == "old" and (one["2"]["model"], one["2"]["task"]) == ("m", "t")


def test_a_large_array_is_read_by_many_tasks(spark, tmp_path):
    with open(tmp_path / "big.json", "w") as f:
        json.dump([{"id": i, "answer": "x" * 5_000} for i in range(4_000)], f, indent=2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        df = records.read_responses(spark, f"{tmp_path}/big.json", indent=2)
        assert df.rdd.getNumPartitions() >= 8
        assert df.select("id").distinct().count() == df.count() == 4_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_another_layout_fails(spark, tmp_path):
    (tmp_path / "flat.json").write_text(json.dumps(rows_of(3)))
    with pytest.raises(Exception, match="no record at this indentation"):
        records.read_responses(spark, f"{tmp_path}/flat.json", indent=2).collect()


def test_completions(spark, tmp_path):
    (tmp_path / "m").mkdir()
    data = [{"id": "a", "input": "i", "gt": "g", "completions": ["x", "", "y"], "task": "t", "metadata": {}}, {"id": 7, "completions": []}]
    (tmp_path / "m" / "completions.json").write_text(json.dumps(data, indent=2))
    for indent in (None, 2):
        rows = records.read_completions(spark, f"{tmp_path}/m/completions.json", indent)
        assert sorted((r["id"], r["task"], r["model"], len(r["completions"])) for r in rows.collect()) == [("7", "completions", "m", 0), ("a", "t", "m", 3)]
        assert sorted((r["id"], r["position"], r["text"]) for r in records.samples_of(rows).collect()) == [("a", 0, "x"), ("a", 1, ""), ("a", 2, "y")]


def test_verdict_columns(spark, tmp_path):
    row = {"id": "1", "pred_reactants_canonical": ["C", "N"], "caption_jaccard": 0.5, "details": {"ER": {"wrong_classes": ["w"], "claimed_fgs": ["a"]}, "IR": {"phrases": ["x"]}, "EO": "none"}}
    (tmp_path / "v.jsonl").write_text(json.dumps(row) + "\n")
    (r,) = records.read_verdicts(spark, f"{tmp_path}/v.jsonl").collect()
    assert r["pred_reactants_canonical"] == ["C", "N"] and r["caption_jaccard"] == 0.5 and r["details"]["ER"]["wrong_classes"] == ["w"]
    assert json.loads(r["details"]["IR"]) == {"phrases": ["x"]} and r["details"]["EO"] == "none" and r["product_tanimoto"] is None
