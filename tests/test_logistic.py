"""All logistic models in the same passes against Spark's, one fit at a time."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortlift.operators import learners as lr
from cohortlift.operators import logistic as lo


def test_nested_logistic_against_single_fits(spark):
    rng = np.random.default_rng(6)
    n = 360
    pdf = pd.DataFrame({"row_id": range(n), "grp": np.arange(n) % 24, "a": rng.normal(50, 2, n), "b": rng.normal(size=n),
                        "k": rng.choice(["u", "v", "w"], n)})
    pdf["y"] = (pdf.a - 50 + pdf.b * (pdf.k == "u") + rng.normal(size=n) > 0.5).astype(float)
    df = spark.createDataFrame(pdf).withColumn("a", F.when(F.col("row_id") % 11 != 0, F.col("a")))
    groups = df.select("grp").distinct()
    outer = groups.select(F.lit(1).alias("repeat"), "grp", (F.col("grp") % 2 + 1).cast("int").alias("outer_fold"))
    inner = outer.withColumn("outer_fold", 3 - F.col("outer_fold")).withColumn(
        "inner_fold", (F.floor(F.col("grp") / 2) % 2 + 1).cast("int")
    )
    grid = {"penalty": ["l1"], "c": [0.1, 1.0]}
    got = lo.nested_logistic(df, outer, inner, "row_id", "grp", "y", ["a", "b"], {"k": ["u", "v", "w"]}, 2, 2, grid).toPandas()
    assert len(got) == n and got.row_id.is_unique and (got.outer_fold == got.grp % 2 + 1).all()

    def alone(train, test, penalty, c):
        train, test = (d.withColumn("set", F.lit(1)) for d in (train, test))
        fitted = lr.fit_preprocessing(train, ["set"], ["a", "b"], ["k"])
        made = [lr.apply_preprocessing(d, fitted, ["set"], ["a", "b"], ["k"]) for d in (train, test)]
        model = lr.fit_logistic(made[0].coalesce(1), "features", "y", penalty, c)
        return lr.predict_probability(model, made[1], "features").select("row_id", "y", "y_prob").toPandas().set_index("row_id")

    train = df.where("grp % 2 = 1")  # the groups held out in fold 1 have even numbers
    own = got[got.outer_fold == 1].set_index("row_id")
    assert own.params.nunique() == 1 and own.inner_score.between(0.3, 1).all()
    penalty, c = own.params.iloc[0].split('"')[-2], float(own.params.iloc[0].split('"c": ')[1].split(",")[0])
    want = alone(train, df.where("grp % 2 = 0"), penalty, c)
    np.testing.assert_allclose(own.pred.loc[want.index], want.y_prob, atol=0.03)  # Spark stops at a relative gain of 1e-6


def test_models_meet_the_conditions_of_a_minimum():
    rng = np.random.default_rng(9)
    n, kinds = 300, rng.integers(0, 3, 300)
    x = np.column_stack([rng.normal(size=n), rng.normal(size=n), *[(kinds == k).astype(float) for k in range(3)]])
    y = (x[:, 0] + (kinds == 1) + rng.normal(size=n) > 0.4).astype(float)
    z, v = (x - x.mean(0)) / x.std(0), np.column_stack([np.ones(n), x, np.zeros_like(x)])
    up = np.triu_indices(v.shape[1])
    for penalty in ("l1", "l2"):
        for c in (0.01, 0.1, 1.0, 10.0):
            m = lo.Model({"mean": x.mean(0), "scale": x.std(0), "fill": np.zeros(5)}, n, penalty, c)
            for _ in range(lo.STEPS):
                if m.done:
                    break
                eta = v @ m.raw()
                p = 1 / (1 + np.exp(-eta))
                curve = (v[:, up[0]] * v[:, up[1]]).T @ (p * (1 - p))
                m.advance(np.concatenate([[np.sum(np.logaddexp(0, eta) - y * eta)], v.T @ (p - y), curve]))
            assert m.done
            gap = 1 / (1 + np.exp(-(m.b[0] + z @ m.b[1:]))) - y
            slope = z.T @ gap / n + m.l2 * m.b[1:]
            assert abs(gap.mean()) < 1e-6
            zero = m.b[1:] == 0
            assert (np.abs(slope[zero]) <= m.l1 + 1e-6).all()
            np.testing.assert_allclose(slope[~zero], -m.l1 * np.sign(m.b[1:][~zero]), atol=1e-6)


def test_held_out_precision_of_packed_rows(spark, monkeypatch):
    """Shipped once a training set, in ranges of the score or whole, the rows rank as they do one by one."""
    from cohortlift.operators import metrics as mt

    rng = np.random.default_rng(17)
    n, weights = 3000, {(0, 1): rng.normal(size=(3, 3)), (1, 2): np.array([[0.2, 1.0, 0.0], [0.2, 1.0, 1e-9], [3.0, -9.0, 9.0]])}
    v = np.column_stack([np.ones(n), rng.integers(-4, 5, n) / 2, rng.normal(size=n)])
    folds, label = rng.integers(0, 3, (n, 2)), (rng.random(n) < 0.3).astype(float)
    rows = [(x.tolist(), float(y), f.tolist()) for x, y, f in zip(v, label, folds)]
    held = spark.createDataFrame(rows, "v array<double>, label double, folds array<smallint>").repartition(3)
    spread = {k: [(w[0], 1.0) for w in own] for k, own in weights.items()}
    got = lo.held_out_precision(held, weights, dict.fromkeys(weights, 1), spread)
    ranged = lo.held_out_precision(held, weights, dict.fromkeys(weights, 4), spread)
    flat = []
    for (place, fold), own in weights.items():
        mine = folds[:, place] == fold
        for i, w in enumerate(own):
            flat += [(place, i, float(y), float(p)) for y, p in zip(label[mine], lo.scores(v[mine].T, w))]
    each = spark.createDataFrame(flat, "place int, i int, y double, p double")
    for r in mt.ranking_metrics(each, ["place", "i"], "y", "p").collect():
        key = next(k for k in weights if k[0] == r["place"])
        np.testing.assert_allclose([got[key][r["i"]], ranged[key][r["i"]]], r["pr_auc"], rtol=1e-12)


def test_points_and_rows_shipped_do_not_grow_with_the_grid(spark, monkeypatch):
    """Where rows are many, candidates of a set stand together: they share points and one shipment of the rows."""
    rng = np.random.default_rng(3)
    n = 6000
    pdf = pd.DataFrame({"row_id": range(n), "grp": np.arange(n) % 24, "a": rng.normal(size=n)})
    pdf["y"] = (pdf.a + rng.normal(size=n) > 0.5).astype(float)
    df = spark.createDataFrame(pdf)
    outer = df.select("grp").distinct().select(F.lit(1).alias("repeat"), "grp", (F.col("grp") % 2 + 1).cast("int").alias("outer_fold"))
    inner = outer.withColumn("outer_fold", 3 - F.col("outer_fold")).withColumn(
        "inner_fold", (F.floor(F.col("grp") / 2) % 2 + 1).cast("int")
    )
    points, passed = [], lo.passed
    monkeypatch.setattr(lo, "passed", lambda held, weights, *a: points.append(len(weights)) or passed(held, weights, *a))
    grid = {"penalty": ["l2"], "c": [1e6, 1e7, 1e8, 1e9, 1e10, 1e11]}
    got = lo.nested_logistic(df, outer, inner, "row_id", "grp", "y", ["a"], {}, 2, 2, grid)
    assert got.count() == n
    assert max(points) <= 4  # sets, of which each has six candidates


def test_equal_rows_get_equal_scores():
    """A matrix product rounds a row by where it stands, which would take ties apart."""
    rng = np.random.default_rng(0)
    for n in (21, 134, 333):
        row, weights = np.append(1.0, rng.normal(size=14)), rng.normal(size=(8, 15)) * 0.1
        for w in weights:
            assert len(np.unique(lo.scores(np.tile(row, (n, 1)).T, w))) == 1
