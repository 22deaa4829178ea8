import random

import numpy as np

from loomspark.operators.quantiles import quantile, summary


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.5, 2.0, rng.random() * 9, rng.randrange(5) * 1.0])) for _ in range(3000)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r[0]: r[1] for r in quantile(df, ["g"], "v", q).collect()}
        assert got.keys() == by.keys() and all(abs(got[g] - np.quantile(vs, q)) < 1e-9 for g, vs in by.items())
    got = {r["g"]: r for r in summary(df, ["g"], "v").collect()}
    assert all((got[g]["count"], got[g]["min"], got[g]["max"]) == (len(vs), min(vs), max(vs)) and abs(got[g]["mean"] - np.mean(vs)) < 1e-9 for g, vs in by.items())


def test_no_groups_and_no_rows(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (None,)], "v double")
    assert [r[0] for r in quantile(df, [], "v").collect()] == [2.0]
    assert quantile(df.limit(0), [], "v").count() == 0 and quantile(df.filter("v is null"), [], "v").count() == 0
