"""Round trips through files, plain and compressed."""

import gzip
import json
import os

import pytest
from compare import differences
from pyspark.sql import functions as F

from traceaudit.plans import files
from traceaudit.plans.registry import ORACLE_SQL, QUERIES
from traceaudit.sources import records
from traceaudit.streaming import stream


def test_responses(spark, tmp_path):
    rows = [{"id": 1, "question": "q", "gt": "g", "answer": "a\nb"}, {"id": "2", "input": "old", "answer": None}]
    for model, data in (("m1", rows), ("m2", {"results": rows})):
        (tmp_path / model).mkdir()
        with gzip.open(tmp_path / model / "task1.json.gz", "wt") as f:
            json.dump(data, f)
    got = sorted(tuple(r) for r in records.read_responses(spark, f"{tmp_path}/*/*.json.gz").select("model", "task", "id", "question", "answer").collect())
    assert got == [(m, "task1", i, q, a) for m in ("m1", "m2") for i, q, a in (("1", "q", "a\nb"), ("2", "old", None))]


def test_verdicts_sidecar_tsv(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"id": "1", "task": "t", "model": "m", "exact_match": true, "hallucination_scores": {"ER": 5.0}}\n\n{"id": "2"}\n')
    v = records.read_verdicts(spark, f"{tmp_path}/v.jsonl")
    assert sorted((r["id"], r["exact_match"]) for r in v.collect()) == [("1", True), ("2", None)]
    (tmp_path / "side.json").write_text('{"1": {"a": "x"},\n "2": {}}')
    assert {r["id"]: r["metadata"] for r in records.read_sidecar(spark, f"{tmp_path}/side.json").collect()} == {"1": {"a": "x"}, "2": {}}
    (tmp_path / "p.tsv").write_text('CID\tSMILES\tdescription\n1\tCC\t"quoted\tand tab\n2\tC\n')
    assert [tuple(r) for r in records.read_pairs_tsv(spark, f"{tmp_path}/p.tsv").collect()] == [("1", "CC", '"quoted\tand tab')]
    for n, head in ((1, "CID\tSMILES\tdescription"), (2, "id\tstructure\ttext")):  # each file has a header of its own; a row may equal one
        (tmp_path / f"many{n}.tsv").write_text(f'{head}\n{n}\tCC\tfirst\nCID\tSMILES\tdescription\n\nshort\tline\n')
    got = sorted(tuple(r) for r in records.read_pairs_tsv(spark, f"{tmp_path}/many*.tsv").collect())
    assert got == [("1", "CC", "first"), ("2", "CC", "first"), ("CID", "SMILES", "description"), ("CID", "SMILES", "description")]
    (tmp_path / "c.csv").write_text('a,b\n1,"x\ny"\n')
    assert [tuple(r) for r in records.read_csv_rows(spark, f"{tmp_path}/c.csv").collect()] == [("1", "x\ny")]


def test_write_table_keeps_other_partitions(spark, tmp_path):
    out = f"{tmp_path}/out"
    df = spark.createDataFrame([("a", "t", 1), ("b", "t", 2)], "model string, task string, x int")
    records.write_table(df, out)
    records.write_table(df.filter("model = 'a'").withColumn("x", F.lit(9)), out)
    assert sorted((r["model"], r["x"]) for r in spark.read.parquet(out).collect()) == [("a", 9), ("b", 2)]


def test_stream_scores_each_key_once_and_resumes(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    score = lambda df: df.select("id", (F.col("x") * 2).alias("y"))
    spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "id int, x int").write.parquet(source)
    stream.score_stream(spark, source, "id int, x int", score, out, checkpoint, ["id"])
    spark.createDataFrame([(2, 2), (3, 3)], "id int, x int").write.mode("append").parquet(source)
    stream.score_stream(spark, source, "id int, x int", score, out, checkpoint, ["id"])
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, 2), (2, 4), (3, 6)]


def test_a_cluster_has_to_name_its_shared_folder(spark):
    from traceaudit import session

    class Context:
        master = "spark://host:7077"

    class Conf:
        found = None

        def get(self, key, default):
            return self.found

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.shared_dir(Session())
    Session.conf.found = "hdfs://x/y/"
    assert session.scratch_dir(Session(), "t").startswith("hdfs://x/y/t-")
    assert session.shared_dir(spark) and session.scratch_dir(spark, "t") != session.scratch_dir(spark, "t")


@pytest.mark.parametrize(("name", "least"), [("s1_read_indented", 200 // 40), ("s1_read_completions", 4)])
def test_arrays_hold_so_many_records_at_most(spark, sf_dir, tmp_path, monkeypatch, name, least):
    monkeypatch.setattr(files, "scratch_dir", lambda spark, name: f"{tmp_path}/arrays")
    monkeypatch.setattr(files, "ROWS", 40 if name == "s1_read_indented" else 5)
    diff, n = differences(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])
    assert n and not diff
    assert len([g for g in os.listdir(f"{tmp_path}/arrays") if g.startswith("g=")]) >= least
