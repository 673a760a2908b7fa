"""Nested splits: nothing that grows with the groups goes through the driver, nothing is copied for a set."""

import numpy as np
from pyspark.sql import functions as F

from cohortlift.operators import learners as lr
from cohortlift.operators import splits as sp
from cohortlift.operators import training as tr
from cohortlift.sources.tables import staged


def seeded(spark, n=40):
    groups = spark.range(n).select(F.col("id").alias("grp"), (F.col("id") % 7 + 1).alias("n"))
    outer = staged(sp.shuffled_folds(sp.with_seeds(groups, 42, 10000, 2), ["repeat"], 5), "outer")
    return groups, outer


def test_inner_groups_are_not_broadcast(spark):
    groups, outer = seeded(spark)
    inner = sp.inner_groups(outer, staged(groups, "groups"), 5, F.col("seed") + 1000 * F.col("outer_fold"))
    plan = inner._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and inner.count() == 40 * 2 * 4


def test_folds_of_several_seeds_are_those_of_each(spark):
    groups, outer = seeded(spark)
    keys = ["repeat", "outer_fold"]
    several = sp.shuffled_folds_of_seeds(sp.inner_groups(outer, groups, 5, F.col("seed") + 1000 * F.col("outer_fold")), keys, 4, [11, 61])
    for offset, got in zip((11, 61), several):
        want = sp.shuffled_folds(sp.inner_groups(outer, groups, 5, F.col("seed") + 1000 * F.col("outer_fold") + offset), keys, 4)
        names = [*keys, "grp", "seed", "fold"]
        assert sorted(got.select(*names).collect()) == sorted(want.select(*names).collect())


def test_nested_quantiles_are_those_of_the_sets(spark):
    rng = np.random.default_rng(4)
    groups, outer = seeded(spark)
    inner = sp.shuffled_folds(sp.inner_groups(outer, groups, 5, F.col("seed")), ["repeat", "outer_fold"], 4)
    inner = staged(inner.select("repeat", "outer_fold", "grp", F.col("fold").alias("inner_fold")), "inner")
    rows = [(int(g), None if v > 2 else float(np.round(v, 1)), float(rng.normal(1e6, 0.5))) for g, v in zip(rng.integers(0, 40, 500), rng.normal(size=500))]
    df = spark.createDataFrame(rows, "grp bigint, a double, b double")
    long = df.unpivot(["grp"], ["a", "b"], "_col", "_v")
    members = lr.set_numbers(inner, "grp", 5, 4)
    want = {(r["set"], r["_col"]): r["m"] for r in tr.training_quantile(long, members, "grp", ["_col"], "_v", 0.5, "m").collect()}
    placed = df.join(tr.fold_codes(inner, "grp", 5, 4, 2), "grp")
    got = {}
    for r in tr.nested_quantile(placed, "folds", ["a", "b"], 4, 0.5, "m").collect():
        whole, fold = divmod(r["set"], 5)
        got[((whole // 5 + 1) * 6 + whole % 5 + 1) * 5 + fold, "ab"[r["_col"]]] = r["m"]
    assert got == want and len(got) == 2 * 50
