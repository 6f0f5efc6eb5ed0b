"""Borders of words beside letters outside ASCII, as SQL has them."""

import os

import pytest
from compare import TABLES, differences
from pyspark.sql import functions as F

from traceaudit.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["x13_family_flags", "x5_extract_label", "k1_self_contradiction", "a6_mechanism_ladder"])
def test_borders_beside_other_letters(spark, sf_dir, tmp_path, name):
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{sf_dir}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    more = ["und nichtä, äthat, theé", "waitä this is wrongé or noä, éactually it isn'tß", "thaté whichß, no more of it"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60")
    docs.withColumn("text", F.get(F.array(*[F.lit(t) for t in more]), F.col("doc_id") % 3)).coalesce(1).write.parquet(f"{tmp_path}/d")
    os.symlink(next(f"{tmp_path}/d/{f}" for f in os.listdir(f"{tmp_path}/d") if f.endswith(".parquet")), f"{tmp_path}/documents.parquet")
    diff, n = differences(spark, str(tmp_path), QUERIES[name], ORACLE_SQL[name])
    assert n and not diff
