"""Every query outside the text-corpus subpackage against its DuckDB SQL; those without SQL have to return rows."""

import pytest
from compare import differences

from traceaudit.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    if name in ORACLE_SQL:
        diff, n = differences(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])
        assert not diff
    else:
        n = QUERIES[name](spark, sf_dir).count()
    assert n > 0
    spark.catalog.clearCache()
