"""Groups outside phrases, native, against the plain version."""

import random

from traceaudit.operators import claims


def test_groups_outside_equals_the_plain_version(spark):
    rng = random.Random(6)
    lexicon = {"amine": ("amine", "amino"), "ring": ("benzene",), "acid": ("acid", "carboxylic acid")}
    words = ["amine", "amines", "amino", "aminox", "benzenes", "acid", "carboxylic acid", "derived from", "é", "x" * 25, "condens", "from the acid", ".", "漢字 "]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 14))) for _ in range(250)]
    texts += ["amine" + "x" * n + "derives" for n in range(50, 64)] + ["amine " + "y" * n + " derives" for n in range(48, 62)] + ["condens" + "-" * n + "acid" for n in range(50, 64)] + ["acid", "acid acid", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for window in (60, 0, 3):
        found = claims.named_groups_outside(df, "t", lexicon, window=window)
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
        for r in found.collect():
            assert r["claimed"] == claims.groups_outside(" ".join((r["t"] or "").lower().split()), lexicon, window=window), r
