"""Hand-worked metrics, split invariants, bootstrap arithmetic and brute-force learners."""

import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlift.operators import audits as au
from cohortlift.operators import increments as ic
from cohortlift.operators import learners as lr
from cohortlift.operators import metrics as mt
from cohortlift.operators import splits as sp


def test_balanced_regression_by_hand(spark):
    rows = [("a", 1.0, 2.0), ("a", 3.0, 3.0), ("b", 5.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, y double, p double").withColumn("k", F.lit(1))
    m = mt.regression_metrics(df, ["k"], "g", "y", "p").first()
    assert m.mae_pb == pytest.approx((0.5 + 4.0) / 2)
    assert m.rmse_pb == pytest.approx(np.sqrt((0.5 + 16.0) / 2))
    assert m.mae_rep == pytest.approx(5 / 3)
    assert m.r2_rep == pytest.approx(1 - 17 / 8)


def test_constant_outcome_has_no_r2(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 1.0)], "g string, y double, p double")
    assert mt.regression_metrics(df.withColumn("k", F.lit(1)), ["k"], "g", "y", "p").first().r2_rep is None


def brute_ranking(y, p):
    y, p = np.asarray(y), np.asarray(p)
    ap, seen = 0.0, 0.0
    for s in sorted(set(p), reverse=True):
        take = p >= s
        ap += (y[take].sum() - seen) / y.sum() * y[take].mean()
        seen = y[take].sum()
    diff = p[y == 1][:, None] - p[y == 0][None, :]
    return ap, (diff > 0).mean() + 0.5 * (diff == 0).mean()


def test_average_precision_and_auc_with_ties(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 200)
    p = np.round(rng.random(200), 1)
    df = spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(y, p)], "k int, y int, p double")
    got = mt.ranking_metrics(df, ["k"], "y", "p").first()
    want = brute_ranking(y, np.clip(p, 1e-6, 1 - 1e-6))
    assert (got.pr_auc, got.roc_auc) == pytest.approx(want)


def test_one_class_has_no_ranking_metric(spark):
    df = spark.createDataFrame([(1, 0, 0.2), (1, 0, 0.7)], "k int, y int, p double")
    got = mt.ranking_metrics(df, ["k"], "y", "p").first()
    assert got.pr_auc is None and got.roc_auc is None


def groups(spark, n=37):
    return spark.createDataFrame([(f"g{i}", 1 + (i * 7) % 13) for i in range(n)], "grp string, n bigint")


def test_folds_are_whole_and_balanced(spark):
    seeded = sp.with_seeds(groups(spark), 42, 10000, 3)
    folds = sp.shuffled_folds(seeded, ["repeat"], 5).toPandas()
    assert folds.groupby(["repeat", "grp"]).size().eq(1).all() and len(folds) == 37 * 3
    sizes = folds.groupby(["repeat", "fold"]).n.sum().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 13).all()
    assert sp.leakage(spark.createDataFrame(folds), ["repeat"]).where("NOT ok").count() == 0
    a, b = folds[folds.repeat == 1].set_index("grp").fold, folds[folds.repeat == 2].set_index("grp").fold
    assert (a != b.loc[a.index]).any()


def test_one_rule_at_every_number_of_groups(spark):
    seeded = sp.with_seeds(groups(spark, 6000), 42, 10000, 1)
    folds = sp.shuffled_folds(seeded, ["repeat"], 3).toPandas()
    assert len(folds) == 6000 and folds.groupby("fold").size().eq(2000).all()
    assert dealt_by_hand([(g, n) for g, n in zip(folds.grp, folds.n)], 42, 3) == dict(zip(folds.grp, folds.fold))


def dealt_by_hand(sizes, seed, k):
    digest = lambda *parts: hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    ranked = sorted(sizes, key=lambda r: (-r[1], digest(r[0]), r[0]))
    out = {}
    for run in range(0, len(ranked), k):
        drawn = sorted((digest(seed, run // k, g), g) for g, _ in ranked[run : run + k])
        out |= {g: i + 1 for i, (_, g) in enumerate(drawn)}
    return out


def test_repeats_differ_where_all_sizes_differ(spark):
    df = spark.createDataFrame([(f"g{i}", 10 + 3 * i) for i in range(40)], "grp string, n bigint")
    folds = sp.shuffled_folds(sp.with_seeds(df, 42, 10000, 5), ["repeat"], 5).toPandas()
    splits = {tuple(f.sort_values("grp").fold) for _, f in folds.groupby("repeat")}
    assert len(splits) == 5
    moved = folds.groupby("grp").fold.nunique()
    assert (moved > 1).mean() > 0.9
    sizes = folds.groupby(["repeat", "fold"]).n.sum().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 10 + 3 * 39).all()


def test_a_bad_first_seed_is_followed_by_a_good_one(spark):
    # a fold of g1 and g3 alone has no negatives, so about half of the seeds cannot be used
    rows = [("g1", 10, 10, 0), ("g2", 10, 9, 1), ("g3", 9, 8, 0), ("g4", 9, 7, 2)]
    df = spark.createDataFrame(rows, "grp string, n bigint, n_pos bigint, n_neg bigint")

    def good(seed):
        fold = dealt_by_hand([(g, p) for g, _, p, _ in rows], seed, 2)
        return fold["g1"] != fold["g3"]

    wanted = {}
    for base in range(1, 60):
        wanted[base] = next(a for a in range(500) if good(base + a))
    assert {0, 1, 2} <= set(wanted.values())
    one_each = [next(b for b, a in wanted.items() if a == k) for k in (0, 1, 2)]
    seeded = df.crossJoin(spark.createDataFrame([(b, b) for b in one_each], "repeat int, seed int"))
    folds = sp.stratified_folds(seeded, ["repeat"], 2, attempts=500).toPandas()
    assert len(folds) == 12 and folds.groupby(["repeat", "fold"]).n_neg.sum().gt(0).all()
    for b, own in folds.groupby("repeat"):
        assert set(own.attempt) == {wanted[b]}
        assert dict(zip(own.grp, own.fold)) == dealt_by_hand([(g, p) for g, _, p, _ in rows], b + wanted[b], 2)


def test_no_usable_seed_fails(spark):
    rows = [(f"g{i}", 10, 5 if i < 2 else 0, 5 if i < 2 else 10) for i in range(20)]
    df = spark.createDataFrame(rows, "grp string, n bigint, n_pos bigint, n_neg bigint")
    with pytest.raises(Exception, match="no usable seed"):
        sp.stratified_folds(sp.with_seeds(df, 1, 10, 1), ["repeat"], 3, attempts=4).collect()


def test_missing_predictions_fail(spark):
    for bad in (None, float("nan"), float("inf")):
        df = spark.createDataFrame([(1, "a", 1.0, 0.5), (1, "a", 0.0, bad)], "k int, g string, y double, p double")
        for metric in (mt.regression_metrics, mt.probability_metrics):
            with pytest.raises(Exception, match="missing or not finite"):
                metric(df, ["k"], "g", "y", "p").collect()


def test_r2_in_small_units(spark):
    rows = [(1, str(i), i * 1e-7, i * 1e-7 + (1e-8 if i % 2 else 0)) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, g string, y double, p double")
    assert mt.regression_metrics(df, ["k"], "g", "y", "p").first().r2_rep > 0.99
    same = spark.createDataFrame([(1, "a", 2.0, 1.0), (1, "b", 2.0, 3.0)], df.schema)
    assert mt.regression_metrics(same, ["k"], "g", "y", "p").first().r2_rep is None


def test_too_few_groups_fail(spark):
    seeded = sp.with_seeds(groups(spark, 3), 42, 10000, 1)
    with pytest.raises(Exception, match="need at least 5 groups"):
        sp.shuffled_folds(seeded, ["repeat"], 5).collect()


def test_stratified_folds_hold_both_classes(spark):
    rows = [(f"g{i}", 10, 2 if i < 8 else 0, 8 if i < 8 else 10) for i in range(30)]
    df = spark.createDataFrame(rows, "grp string, n bigint, n_pos bigint, n_neg bigint")
    folds = sp.stratified_folds(sp.with_seeds(df, 1, 10, 1), ["repeat"], 4, attempts=3).toPandas()
    assert (folds.groupby("fold").n_pos.sum() > 0).all() and len(folds) == 30


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": rng.integers(0, 9, 120).astype(str), "y": rng.normal(50, 9, 120)})
    pdf["pred_base"] = pdf.y + rng.normal(0, 6, 120)
    pdf["pred_comb"] = pdf.y + rng.normal(0, 4, 120)
    pdf["k"] = 1
    return spark.createDataFrame(pdf), pdf


def test_same_predictions_give_no_increment(pairs):
    df = pairs[0].withColumn("pred_comb", F.col("pred_base"))
    boot = ic.bootstrap_replicates(df, ["k"], "g", "y", 20, 5).toPandas()
    assert np.allclose(boot[list(ic.DELTAS)], 0)


def test_bootstrap_equals_concatenated_draws(pairs):
    df, pdf = pairs
    stats = ic.group_statistics(df, ["k"], "g", "y")
    index = {r["_idx"]: r["g"] for r in stats.collect()}
    draws = ic._draws(stats, ["k"], 6, 5).toPandas()
    assert draws.groupby("replicate").size().eq(len(index)).all()
    got = ic.replicates_from_statistics(stats, ["k"], 6, 5).toPandas().set_index("replicate")
    for b, part in draws.groupby("replicate"):
        z = pd.concat([pdf[pdf.g == index[i]].assign(d=n) for n, i in enumerate(part["_idx"])])

        def mae(c):
            return (z.y - z[c]).abs().groupby(z.d).mean().mean()

        def r2(c):
            return 1 - ((z.y - z[c]) ** 2).sum() / ((z.y - z.y.mean()) ** 2).sum()

        assert got.loc[b, "delta_mae_pb"] == pytest.approx(mae("pred_base") - mae("pred_comb"))
        assert got.loc[b, "delta_r2_rep"] == pytest.approx(r2("pred_comb") - r2("pred_base"))


def direct_elastic_net(x, y, alpha, l1):
    """Proximal gradient on the plain objective; a second way to the same optimum."""
    z, t = (x - x.mean(0)) / x.std(0), y - y.mean()
    b = np.zeros(x.shape[1])
    step = 1 / (np.linalg.eigvalsh(z.T @ z / len(t)).max() + alpha * (1 - l1))
    for _ in range(20000):
        b = b - step * (z.T @ (z @ b - t) / len(t) + alpha * (1 - l1) * b)
        b = np.sign(b) * np.maximum(np.abs(b) - step * alpha * l1, 0)
    return b / x.std(0), y.mean() - x.mean(0) @ (b / x.std(0))


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(23)
    n = 240
    pdf = pd.DataFrame({
        "row_id": np.arange(n), "grp": rng.integers(0, 12, n),
        "a": rng.normal(0, 3, n), "b": rng.normal(5, 1, n),
    })
    pdf["y"] = 2 * pdf.a - pdf.b + rng.normal(0, 2, n)
    pdf.loc[pdf.row_id % 9 == 0, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("a", F.nanvl("a", F.lit(None).cast("double")))
    return df, pdf


def test_nested_elastic_net_against_brute_force(spark, panel):
    df, pdf = panel
    outer = df.select("grp").distinct().select(
        F.lit(1).alias("repeat"), "grp", (F.col("grp") % 3 + 1).cast("int").alias("outer_fold")
    )
    train = outer.select("repeat", "grp", F.explode(
        F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda f: f != F.col("outer_fold"))
    ).alias("outer_fold"))
    inner = train.withColumn("inner_fold", (F.floor(F.col("grp") / 3) % 2 + 1).cast("int"))
    grid = {"alpha": [0.05, 1.0], "l1_ratio": [0.5]}
    fits, chosen, preds = lr.nested_elastic_net(
        df, outer, inner, "row_id", "grp", "y", ["a", "b"], {}, n_outer=3, n_inner=2, grid=grid
    )
    assert fits.count() == 3 * 2 * 2 + 3 and fits.where("NOT converged").count() == 0
    preds = preds.toPandas().set_index("row_id").y_pred
    chosen = chosen.toPandas().set_index("outer_fold").params
    pdf = pdf.assign(o=pdf.grp % 3 + 1, i=pdf.grp // 3 % 2 + 1)

    def fit_predict(tr, te, alpha):
        med = tr.a.median()
        x, t = tr.assign(a=tr.a.fillna(med)), te.assign(a=te.a.fillna(med))
        coef, b0 = direct_elastic_net(x[["a", "b"]].to_numpy(), x.y.to_numpy(), alpha, 0.5)
        return t[["a", "b"]].to_numpy() @ coef + b0

    for f in (1, 2, 3):
        tr, te = pdf[pdf.o != f], pdf[pdf.o == f]
        scores = {}
        for alpha in grid["alpha"]:
            folds = []
            for i in (1, 2):
                va = tr[tr.i == i]
                e = (va.y - fit_predict(tr[tr.i != i], va, alpha)).abs()
                folds.append(e.groupby(va.grp).mean().mean())
            scores[alpha] = np.mean(folds)
        best = min(scores, key=scores.get)
        assert json.loads(chosen[f])["alpha"] == best
        np.testing.assert_allclose(preds.loc[te.row_id], fit_predict(tr, te, best), atol=1e-5)


def test_residual_chain_against_brute_force(spark, panel):
    df, pdf = panel
    outer = df.select("grp").distinct().select(
        F.lit(1).alias("repeat"), "grp", (F.col("grp") % 3 + 1).cast("int").alias("outer_fold")
    )
    train = outer.select("repeat", "grp", F.explode(
        F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda f: f != F.col("outer_fold"))
    ).alias("outer_fold"))
    inner = train.withColumn("inner_fold", (F.floor(F.col("grp") / 3) % 2 + 1).cast("int"))
    cross = train.withColumn("inner_fold", (F.floor(F.col("grp") / 6) + 1).cast("int"))
    families, grid = {"A": ["a"], "Both": ["a", "b"]}, {"alpha": [0.05, 1.0], "l1_ratio": [0.5]}
    preds, training = lr.residual_chain(
        df, outer, inner, cross, dict.fromkeys(families, inner), "row_id", "grp", "y", ["b"], {}, families,
        n_outer=3, n_inner=2, grid=grid,
    )
    preds, training = preds.toPandas(), training.toPandas().set_index(["outer_fold", "row_id"])
    pdf = pdf.assign(o=pdf.grp % 3 + 1, i=pdf.grp // 3 % 2 + 1, c=pdf.grp // 6 + 1)

    def fit_predict(tr, te, y, cols, alpha):
        med = tr.a.median()
        x, t = tr.assign(a=tr.a.fillna(med)), te.assign(a=te.a.fillna(med))
        coef, b0 = direct_elastic_net(x[cols].to_numpy(), tr[y].to_numpy(), alpha, 0.5)
        return t[cols].to_numpy() @ coef + b0

    def tuned(tr, y, cols):
        scores = {}
        for alpha in grid["alpha"]:
            folds = [(va, (va[y] - fit_predict(tr[tr.i != i], va, y, cols, alpha)).abs()) for i in (1, 2) for va in [tr[tr.i == i]]]
            scores[alpha] = np.mean([e.groupby(va.grp).mean().mean() for va, e in folds])
        return min(scores, key=scores.get)

    assert set(preds.variant) == {"ContextOnly", "Residualized_A", "Residualized_Both"}
    for f in (1, 2, 3):
        tr, te = pdf[pdf.o != f].copy(), pdf[pdf.o == f]
        alpha = tuned(tr, "y", ["b"])
        base = fit_predict(tr, te, "y", ["b"], alpha)
        tr["left"] = 0.0
        for c in (1, 2):
            own = tr.c == c
            tr.loc[own, "left"] = tr[own].y - fit_predict(tr[~own], tr[own], "y", ["b"], alpha)
        got = training.loc[f]
        assert set(got.index) == set(tr.row_id)
        np.testing.assert_allclose(got.residual.loc[tr.row_id], tr.left, atol=1e-5)
        for variant, cols in (("ContextOnly", None), ("Residualized_A", ["a"]), ("Residualized_Both", ["a", "b"])):
            own = preds[(preds.variant == variant) & (preds.outer_fold == f)].set_index("row_id")
            want = base if cols is None else base + fit_predict(tr, te, "left", cols, tuned(tr, "left", cols))
            np.testing.assert_allclose(own.y_pred.loc[te.row_id], want, atol=1e-5)
            np.testing.assert_allclose(own.y_true.loc[te.row_id], te.y)


def test_spark_elastic_net_has_the_stated_objective(spark, panel):
    pdf = panel[1].dropna()
    x = pdf[["a", "b"]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    df = spark.createDataFrame(
        [(r.tolist(), float(v)) for r, v in zip(z, pdf.y)], "features array<double>, y double"
    )
    model, sigma, _ = lr.fit_elastic_net(df, "features", "y", 0.4, 0.5)
    want, _ = direct_elastic_net(z, pdf.y.to_numpy(), 0.4, 0.5)
    np.testing.assert_allclose(np.array(model.coefficients) * sigma, want, atol=1e-4)


def test_models_return_finite_predictions(spark, panel):
    df = spark.createDataFrame(panel[1].dropna()).withColumn("features", F.array("a", "b"))
    df = df.withColumn("label", (F.col("y") > -5).cast("double"))
    logit = lr.predict_probability(lr.fit_logistic(df, "features", "label", "l1", 1.0), df, "features")
    assert logit.where("y_prob > 0 AND y_prob < 1").count() == df.count()
    trees = lr.fit_boosted(df, "features", "label", 0.08, 7, rounds=3, binary=True)
    assert lr.predict_probability(trees, df, "features").where("y_prob IS NULL").count() == 0


def test_preprocessing_drops_constants_and_unknown_levels(spark):
    rows = [(1, 1.0, 7.0, "u"), (1, None, 7.0, "v"), (1, 3.0, 7.0, None)]
    train = spark.createDataFrame(rows, "s int, a double, c double, k string")
    fitted = lr.fit_preprocessing(train, ["s"], ["a", "c"], ["k"])
    test = spark.createDataFrame([(1, None, 7.0, "new")], "s int, a double, c double, k string")
    got = lr.apply_preprocessing(test, fitted, ["s"], ["a", "c"], ["k"]).first().features
    assert got == pytest.approx([0.0, 0.0, 0.0])


def test_recovery_keeps_converged_fits(spark):
    cols = "task int, fold int, score double, n_iter int, max_iter int, converged boolean"
    log = spark.createDataFrame([(1, 1, 2.0, 5, 10, True), (1, 2, 9.0, 10, 10, False)], cols)
    rerun = spark.createDataFrame([(1, 2, 1.0, 40, 100, True)], cols)
    merged = au.merge_recovery(log, rerun, ["task", "fold"])
    best = spark.createDataFrame([(1, 1.6)], "task int, selected_score double")
    row = au.recovery_against_selected(merged, best, ["task"], 2).first()
    assert (row.recovered_score, row.n_reruns, row.beats_selected, row.complete) == (1.5, 1, True, True)


def test_nested_logistic_resumes(spark, panel, tmp_path):
    from cohortlift.operators import nested as ns

    df = panel[0].withColumn("label", (F.col("y") > -5).cast("double"))
    outer = df.select("grp").distinct().select(
        F.lit(1).alias("repeat"), "grp", (F.col("grp") % 2 + 1).cast("int").alias("outer_fold")
    )
    inner = outer.withColumn("outer_fold", 3 - F.col("outer_fold")).withColumn(
        "inner_fold", (F.floor(F.col("grp") / 2) % 2 + 1).cast("int")
    )
    models = ns.logistic_candidates("label", {"penalty": ["l2"], "c": [0.01, 10.0]})
    path = str(tmp_path / "oof")

    def go(some):
        return ns.nested_models(
            df, some, inner, "row_id", "grp", "label", ["a", "b"], [], models,
            ns.average_precision, path, lower_is_better=False,
        )

    go(outer.where("outer_fold = 1"))
    done = go(outer).toPandas()
    assert len(done) == 240 and done.row_id.is_unique and set(done.outer_fold) == {1, 2}
    assert set(done.params) <= set(models) and done.pred.between(0, 1).all()
    auc = brute_ranking(done.label, done.pred)[1]
    assert auc > 0.7


def test_line_without_training_rows_is_missing(spark):
    from cohortlift.operators import linear as ln

    rows = [("t", 1, 1.0, 2.0), ("t", 2, 2.0, 4.0), ("t", 2, 3.0, 6.0), ("u", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "task string, fold int, x double, y double")
    got = {(r.task, r.fold): r for r in ln.leave_fold_out_line(df, ["task"], "fold", "x", "y").collect()}
    assert got["t", 1].slope == pytest.approx(2.0) and got["t", 1].mean_y == pytest.approx(5.0)
    assert got["u", 1].mean_y is None
