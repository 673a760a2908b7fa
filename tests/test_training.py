"""Training statistics, out-of-fold models and the ranking bootstrap against plain arithmetic."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlift.operators import increments as ic
from cohortlift.operators import learners as lr
from cohortlift.operators import linear as ln
from cohortlift.operators import nested as ns
from cohortlift.operators import profiling
from cohortlift.operators import training as tr


def test_statistics_of_overlapping_training_sets(spark):
    rng = np.random.default_rng(4)
    n = 1_500
    pdf = pd.DataFrame({"g": rng.integers(0, 14, n), "far": 1e6 + rng.normal(0, 0.5, n), "few": rng.integers(0, 4, n) * 1.0,
                        "same": np.where(rng.integers(0, 14, n) < 0, 1.0, 7.25)})
    pdf.loc[pdf.index % 9 == 0, "far"] = np.nan
    pdf.loc[pdf.index % 5 == 0, "few"] = np.nan
    pdf.loc[pdf.g == 3, "same"] = 9.5
    sets = {s: sorted(rng.choice(14, rng.integers(1, 12), replace=False).tolist()) for s in range(40)}
    sets[40] = [3]
    long = spark.createDataFrame(pdf).unpivot(["g"], ["far", "few", "same"], "c", "v")
    long = long.withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    members = [(g, [s for s, own in sets.items() if g in own]) for g in range(14)]
    got = tr.imputed_statistics(long, spark.createDataFrame(members, "g long, sets array<int>"), "g", ["c"], "v")
    got = {(r.set, r.c): r for r in got.collect()}
    assert len(got) == 41 * 3
    for s, own in sets.items():
        part = pdf[pdf.g.isin(own)]
        for c in ("far", "few", "same"):
            full = part[c].fillna(part[c].median())
            r = got[s, c]
            assert r.n == len(part) and r.median == part[c].median()
            assert r["mean"] == pytest.approx(full.mean(), rel=1e-12)
            assert r.sd == pytest.approx(full.std(ddof=0), rel=1e-7, abs=0)
            assert (r.sd == 0) == (full.min() == full.max())


def test_quantiles_where_all_values_share_a_bucket(spark):
    values = [1.0 + k * 1e-9 for k in range(101)] + [None, float("nan")]
    long = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "g int, v double")
    members = spark.createDataFrame([(0, [1, 2]), (1, [2]), (2, [2])], "g int, sets array<int>")
    got = {r.set: r.q for r in tr.training_quantile(long, members, "g", [], "v", 0.3, "q").collect()}
    own = [v for i, v in enumerate(values[:101]) if i % 3 == 0]
    assert got == {1: pytest.approx(np.quantile(own, 0.3), rel=1e-14), 2: pytest.approx(np.quantile(values[:101], 0.3), rel=1e-14)}


def test_slope_of_a_small_spread_far_from_zero(spark):
    rng = np.random.default_rng(6)
    x = 1e6 + rng.normal(0, 0.5, 400)
    pdf = pd.DataFrame({"t": "a", "fold": np.arange(400) % 4, "x": x, "y": 3 * (x - 1e6) + rng.normal(0, 0.1, 400)})
    flat = pd.DataFrame({"t": "flat", "fold": np.arange(8) % 4, "x": 5.5, "y": np.arange(8.0)})
    df = spark.createDataFrame(pd.concat([pdf, flat]))
    for r in ln.leave_fold_out_line(df, ["t"], "fold", "x", "y").collect():
        own = pdf[pdf.fold != r.fold]
        if r.t == "flat":
            assert r.slope == 0
        else:
            assert r.slope == pytest.approx(np.polyfit(own.x - 1e6, own.y, 1)[0], rel=1e-6)
            assert r.mean_x == pytest.approx(own.x.mean(), rel=1e-12) and r.mean_y == pytest.approx(own.y.mean())


def test_rows_of_equal_moments():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4))
    corr = np.corrcoef(x.T)
    z = lr.equal_moments(corr)
    assert z.shape == (5, 4)
    np.testing.assert_allclose(z.mean(0), 0, atol=1e-12)
    np.testing.assert_allclose(z.T @ z / 5, corr, atol=1e-12)


def test_thousands_of_candidates_are_one_job(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 3))
    y = x @ [1.0, -2.0, 0.0] + rng.normal(size=300)
    z, unit = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    corr = np.corrcoef(np.column_stack([z, unit]).T)
    rows = lr.equal_moments(corr)
    mean, scale = [*x.mean(0).tolist(), float(y.mean())], [*x.std(0).tolist(), float(y.std())]
    flat = [(s, mean, scale, [0.0] * 3, r[:3].tolist(), float(r[3])) for s in range(40) for r in rows]
    points = [(a, 0.5, f"p{i}") for i, a in enumerate(np.linspace(0.01, 3, 30).tolist())]
    same = spark.createDataFrame(flat, lr.SAME_ROWS)
    fits = lr.fit_sets(same, {s: points for s in range(40)}, 1000)
    assert fits.count() == 1200 and fits.where("NOT converged").count() == 0
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(z, y)], "f array<double>, y double").coalesce(1)
    for k in (3, 20):
        model, sigma, _ = lr.fit_elastic_net(df, "f", "y", points[k][0], 0.5)
        one = fits.where(f"set = 7 AND params = 'p{k}'").first()
        np.testing.assert_allclose(np.array(one.coef) * x.std(0), np.array(model.coefficients) * sigma, atol=1e-5)


def test_no_row_is_scored_by_a_model_that_saw_it(spark, tmp_path):
    # the label of a group is known to a model only if it saw the group: out of fold nothing is learnt
    rng = np.random.default_rng(2)
    rows = [(i, g := i % 20, float(g * 10 + rng.normal()), float(rng.normal()), float(g % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, grp long, a double, b double, y double")
    folds = spark.createDataFrame([(g, (g // 4) % 5 + 1) for g in range(20)], "grp long, fold int")
    models = ns.boosting_candidates("y", binary=False, rounds=3, grid={"step": [0.5], "leaves": [7, 15]})
    path = str(tmp_path / "oof")
    got = ns.out_of_fold(df, folds, "row_id", "grp", "y", ["a", "b"], [], models, path).toPandas()
    assert len(got) == 800 and got.groupby(["row_id", "params"]).size().eq(1).all()
    assert set(got.params) == set(models)
    fold = {g: (g // 4) % 5 + 1 for g in range(20)}
    assert (got.fold == got.grp.map(fold)).all()
    for text, (fit, predict) in models.items():
        part = got[(got.params == text) & (got.fold == 2)].set_index("row_id").pred
        placed = df.join(folds, "grp").withColumn("set", F.lit(1))
        train, held = placed.where("fold <> 2"), placed.where("fold = 2")
        fitted = lr.fit_preprocessing(train, ["set"], ["a", "b"], [])
        made = [lr.apply_preprocessing(d, fitted, ["set"], ["a", "b"], []) for d in (train, held)]
        alone = predict(fit(made[0].coalesce(1)), made[1], "p").toPandas().set_index("row_id").p
        np.testing.assert_allclose(part.loc[alone.index], alone, atol=1e-9)


def test_ranking_bootstrap_equals_concatenated_draws(spark, monkeypatch):
    monkeypatch.setattr(ic, "SCORES_A_CHUNK", 4)
    rng = np.random.default_rng(11)
    n = 160
    pdf = pd.DataFrame({"g": rng.integers(0, 7, n).astype(str), "y": rng.integers(0, 2, n)})
    pdf.loc[pdf.g == "0", "y"] = 0
    pdf["pred_base"] = np.round(rng.random(n), 1)
    pdf["pred_comb"] = np.round(np.clip(pdf.pred_base * 0.6 + 0.3 * pdf.y, 0, 1), 2)
    df = spark.createDataFrame(pdf).withColumn("k", F.lit("m"))
    got = ic.probability_bootstrap(df, ["k"], "g", "y", 12, 5).toPandas().set_index("replicate")
    groups = ic._indexed(df.select("k", "g").distinct(), ["k"], "g")
    index = {r["_idx"]: r["g"] for r in groups.collect()}
    draws = ic._draws(groups, ["k"], 12, 5).toPandas()

    def metrics(z, c):
        p, y = np.clip(z[c], 1e-6, 1 - 1e-6).to_numpy(), z.y.to_numpy()
        ap, seen = 0.0, 0.0
        for s in sorted(set(p), reverse=True):
            take = p >= s
            ap += (y[take].sum() - seen) / y.sum() * y[take].mean()
            seen = y[take].sum()
        diff = p[y == 1][:, None] - p[y == 0][None, :]
        brier = ((y - p) ** 2)
        return ap, (diff > 0).mean() + 0.5 * (diff == 0).mean(), pd.Series(brier).groupby(z.d.to_numpy()).mean().mean()

    assert len(got) == 12
    for b, part in draws.groupby("replicate"):
        z = pd.concat([pdf[pdf.g == index[i]].assign(d=j) for j, i in enumerate(part["_idx"])])
        base, comb = metrics(z, "pred_base"), metrics(z, "pred_comb")
        assert got.loc[b, "delta_pr_auc"] == pytest.approx(comb[0] - base[0])
        assert got.loc[b, "delta_roc_auc"] == pytest.approx(comb[1] - base[1])
        assert got.loc[b, "delta_brier_pb"] == pytest.approx(base[2] - comb[2])


def test_ranking_bootstrap_is_the_same_in_small_runs_chunks_and_slices(spark, monkeypatch):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"g": rng.integers(0, 23, 300).astype(str), "y": rng.integers(0, 2, 300)})
    pdf["pred_base"], pdf["pred_comb"] = np.round(rng.random(300), 2), rng.random(300)
    df = spark.createDataFrame(pdf).withColumn("k", F.when(F.col("g") < 5, "a").otherwise("b"))

    def boot():
        return ic.probability_bootstrap(df, ["k"], "g", "y", 11, 5).toPandas().sort_values(["k", "replicate"])

    whole = boot()
    small = {"GROUPS_A_BLOCK": 4, "DRAWS_A_BATCH": 30, "SCORES_A_CHUNK": 3, "CELLS_A_CHUNK": 70, "CELLS_A_PIECE": 20}
    for name, size in (small | {"WEIGHTS_A_SLICE": 80}).items():
        monkeypatch.setattr(ic, name, size)
    groups = ic._indexed(df.select("k", "g").distinct(), ["k"], "g")
    rows = ic.drawn_blocks(groups, ["k"], 11, 5).toPandas()
    assert sum(len(x) for x in rows["codes"]) == 4 * 11 * groups.count()
    pd.testing.assert_frame_equal(whole.reset_index(drop=True), boot().reset_index(drop=True))


def test_held_out_scale_works_on_classes_of_groups(spark, monkeypatch):
    """Groups that share their folds in all repeats are one cell, and the figures are those of the rows."""
    draw = np.random.default_rng(12)
    rows = [(f"f{i % 2}", int(draw.integers(0, 60)), None if i % 17 == 0 else float(draw.normal(3, 2))) for i in range(900)]
    fold = lambda g, r: (g * r + g // 30 * r + r) % 3 + 1
    folds = spark.createDataFrame([(r, g, fold(g, r)) for g in range(60) for r in (1, 2)], "repeat int, grp long, fold int")
    seen = []

    def spied(long, members, key, *rest):
        seen.append(members.count())
        return tr.imputed_statistics(long, members, key, *rest)

    monkeypatch.setattr(profiling, "imputed_statistics", spied)
    long = spark.createDataFrame(rows, "feature string, grp long, value double")
    got = profiling.held_out_scale(long, folds, ["feature"], "grp", 3).collect()
    assert len(got) == 12 and seen == [len({(fold(g, 1), fold(g, 2)) for g in range(60)})] and seen[0] < 10
    for r in got:
        mine = [(fold(g, r.repeat) == r.test_fold, v) for f, g, v in rows if f == r.feature]
        middle = np.median([v for t, v in mine if not t and v is not None])
        train = np.array([middle if v is None else v for t, v in mine if not t])
        test = np.array([middle if v is None else v for t, v in mine if t])
        assert r.train_std == pytest.approx(train.std())
        assert r.test_max_abs_z == pytest.approx(np.abs(test - train.mean()).max() / train.std())
        assert r.nonfinite_n == sum(t and v is None for t, v in mine)
