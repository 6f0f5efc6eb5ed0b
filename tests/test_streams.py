"""Streams over restarts, late files and repeated batches."""

import os
import shutil
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from traceaudit.operators import stats
from traceaudit.plans import streams
from traceaudit.streaming import stream


def test_each_key_once_over_restarts_and_late_files(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    score = lambda df: df.select("id", (F.col("x") * 2).alias("y"))
    landed = [[(1, 1), (1, 1), (2, 2)], [(2, 2), (3, 3)], [(9, 9), (1, 1)], [(4, 4), (3, 3), (None, 7)]]
    for rows in landed:
        spark.createDataFrame(rows, "id int, x int").write.mode("append").parquet(source)
        stream.score_stream(spark, source, "id int, x int", score, out, checkpoint, ["id"], keep=timedelta(days=1))
    assert sorted(tuple(r) for r in spark.read.parquet(out).filter("id IS NOT NULL").collect()) == [(1, 2), (2, 4), (3, 6), (4, 8), (9, 18)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != stream.ROCKS


def test_rows_are_scored_before_the_keys_meet(spark, tmp_path, monkeypatch):
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "bb"), (3, None)], "id int, t string").write.parquet(source)
    kind = type(spark.range(1))
    met, plain = [], kind.dropDuplicatesWithinWatermark
    monkeypatch.setattr(kind, "dropDuplicatesWithinWatermark", lambda df, keys: (met.append([c for c in df.columns if not c.startswith("_")]), plain(df, keys))[1])
    stream.score_stream(spark, source, "id int, t string", lambda df: df.select("id", F.length("t").alias("n")), out, checkpoint, ["id"], keep=timedelta(days=1), by_row=True)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, 1), (2, 2), (3, None)]
    assert met == [["id", "n"]]  # no texts


def test_files_of_a_stream_grow_in_number(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "scratch_dir", lambda spark, name: f"{tmp_path}/home")
    monkeypatch.setattr(streams, "scan_parts", lambda *args: 12)
    rows = streams.r1_score_stream_kept(spark, sf_dir).count()
    sizes = [spark.read.parquet(f"{tmp_path}/home/in/{f}").count() for f in os.listdir(f"{tmp_path}/home/in") if f.endswith(".parquet")]
    assert len(sizes) == 18 and max(sizes) < rows / 4
    assert len([f for f in os.listdir(f"{tmp_path}/home/checkpoint/commits") if f.isdigit()]) == 3  # two batches with data, one that moves the watermark


def test_a_key_is_forgotten_after_a_while(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    for _ in range(4):
        spark.createDataFrame([(1, 1)], "id int, x int").write.mode("append").parquet(source)
        stream.score_stream(spark, source, "id int, x int", lambda df: df, out, checkpoint, ["id"], keep=timedelta(milliseconds=1))
    assert 1 < spark.read.parquet(out).count() < 5  # the state had an end


BY = ["model", "task"]


def scored(spark, n, start=0):
    rows = [("a" if i % 3 else "b", f"t{i % 2}", i / 50, None if i % 5 == 0 else float(i % 4), 1.0 * i, 0.5, 1.0, None if i % 2 else 2.0, i % 3, i % 2, 10 * i) for i in range(start, start + n)]
    return spark.createDataFrame(rows, "model string, task string, " + stats.TASK_ROW)


def same(spark, out, rows):
    got, want = ({(r["model"], r["task"]): tuple(r)[2:] for r in df.collect()} for df in (stream.current_stats(spark, out, BY, {"model": "string", "task": "string"}), stats.task_stats(rows, BY)))
    assert got.keys() == want.keys()
    for k, v in got.items():
        assert v == pytest.approx(want[k], nan_ok=True) if None not in v else [x is None for x in v] == [x is None for x in want[k]]


def test_running_stats(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    first, second = scored(spark, 40), scored(spark, 30, 40)
    first.repartition(3).write.parquet(source)
    stream.running_stats(spark, source, first.schema, BY, out, checkpoint, files=1)
    same(spark, out, first)
    second.coalesce(1).write.mode("append").parquet(source)
    stream.running_stats(spark, source, first.schema, BY, out, checkpoint)
    same(spark, out, first.union(second))
    stream.add_batch(second, 3, BY, out)  # the last batch again
    same(spark, out, first.union(second))
    shutil.copytree(f"{out}/version=4", f"{out}/version=5")
    parts = [f for f in os.listdir(f"{out}/version=5") if f.endswith(".parquet")]
    whole = spark.read.parquet(f"{out}/version=5")
    whole.limit(whole.count() - 1).write.parquet(f"{tmp_path}/torn")
    for f in parts:
        os.remove(f"{out}/version=5/{f}")
    for f in os.listdir(f"{tmp_path}/torn"):
        if f.endswith(".parquet"):
            shutil.copy(f"{tmp_path}/torn/{f}", f"{out}/version=5")
    same(spark, out, first.union(second))  # a version that is not whole does not count
