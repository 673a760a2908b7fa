"""Trees from cells against Spark's trees on the rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortlift.operators import boosting as bo
from cohortlift.operators import learners as lr


def test_trees_from_cells_are_those_of_spark(spark):
    rng = np.random.default_rng(4)
    n = 1200
    pdf = pd.DataFrame({"row_id": range(n), "grp": np.arange(n) % 60, "a": rng.integers(0, 25, n) / 2.0,
                        "b": rng.integers(0, 4, n).astype(float), "k": rng.choice(["u", "v", "w"], n)})
    pdf["y"] = np.sin(pdf.a) + pdf.b * (pdf.k == "u") + rng.normal(size=n)
    df = spark.createDataFrame(pdf)
    folds = spark.createDataFrame([(g, g % 5 + 1) for g in range(60)], "grp long, fold int")
    grid = {"step": [0.08, 0.3], "leaves": [7]}
    got = bo.boosted_out_of_fold(df, folds, "row_id", "grp", "y", ["a", "b"], ["k"], grid, rounds=12).toPandas()
    assert len(got) == 2 * n and got.groupby(["row_id", "params"]).size().eq(1).all()
    assert (got.fold == got.grp % 5 + 1).all()
    placed = df.join(folds, "grp").withColumn("set", F.lit(2))
    train, held = placed.where("fold <> 2"), placed.where("fold = 2")
    fitted = lr.fit_preprocessing(train, ["set"], ["a", "b"], ["k"])
    made = [lr.apply_preprocessing(d, fitted, ["set"], ["a", "b"], ["k"]) for d in (train, held)]
    model = lr.fit_boosted(made[0].coalesce(1), "features", "y", 0.3, 7, rounds=12)
    want = lr.predict_value(model, made[1], "features").toPandas().set_index("row_id").y_pred
    own = got[(got.fold == 2) & got.params.str.contains("0.3")].set_index("row_id").pred
    np.testing.assert_allclose(own.loc[want.index], want, atol=1e-8)


def test_missing_and_unseen_values_are_scored(spark):
    rows = [(i, i % 10, float(i % 7) if i % 5 else None, "rare" if i % 10 == 3 else None if i % 3 else "x", float(i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, grp long, a double, k string, y double")
    folds = spark.createDataFrame([(g, g % 5 + 1) for g in range(10)], "grp long, fold int")
    got = bo.boosted_out_of_fold(df, folds, "row_id", "grp", "y", ["a"], ["k"], {"step": [0.1], "leaves": [7]}, rounds=5).toPandas()
    assert len(got) == 400 and got.pred.notna().all()


def test_too_many_cells_are_left_to_spark(spark, monkeypatch):
    monkeypatch.setattr(bo, "CELLS", 5)
    df = spark.range(100).selectExpr("id AS row_id", "id % 10 AS grp", "double(id) AS a", "double(id) AS y")
    folds = spark.createDataFrame([(g, g % 5 + 1) for g in range(10)], "grp long, fold int")
    assert bo.boosted_out_of_fold(df, folds, "row_id", "grp", "y", ["a"], []) is None
