"""Ordered operators with chunks far smaller than the groups, against plain arithmetic."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlift.operators import ordered as od
from cohortlift.operators import signals as sg
from cohortlift.operators import windows as wn

CHUNK = "floor(pos / 4)"


@pytest.fixture(scope="module")
def hot(spark):
    """One group holds most rows; values have ties, gaps and missing cells."""
    rng = np.random.default_rng(5)
    n = 300
    pdf = pd.DataFrame({
        "g": np.where(np.arange(n) % 7 == 0, "small", "hot"),
        "pos": np.arange(n) * 2,
        "v": np.round(rng.normal(0, 30, n), 1),
    })
    pdf.loc[pdf.index % 11 == 0, "v"] = None
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    return df, pdf


def collect(df, *keys):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def test_positions_and_neighbours(hot):
    df, pdf = hot
    got = collect(od.positions(df, ["g"], ["pos"], CHUNK, "rn", "total"), "pos")
    by = pdf.groupby("g")["pos"]
    assert (got.rn == by.rank().astype(int)).all()
    assert (got.total == by.transform("size")).all()
    back = collect(od.with_previous(df, ["g"], ["pos"], CHUNK, ["v", "pos"]), "pos")
    pd.testing.assert_series_equal(back.prev_pos, by.shift(1), check_names=False)
    pd.testing.assert_series_equal(back.prev_v, pdf.groupby("g")["v"].shift(1), check_names=False)
    ahead = collect(od.with_next(df, ["g"], ["pos"], CHUNK, ["pos"]), "pos")
    pd.testing.assert_series_equal(ahead.next_pos, by.shift(-1), check_names=False)


def test_running_sums_and_forward_fill(hot):
    df, pdf = hot
    known = df.fillna(0.0, ["v"])
    got = collect(od.running_sums(known, ["g"], ["pos"], F.floor(F.col("pos") / 4), {"s": "v"}), "pos")
    want = pdf.fillna({"v": 0.0}).groupby("g")["v"].cumsum()
    np.testing.assert_allclose(got.s, want, atol=1e-9)
    sparse = df.withColumn("label", F.when(F.col("pos") % 26 == 0, F.col("pos")))
    filled = collect(od.forward_fill(sparse, ["g"], "pos", "label", "full", width=4), "pos")
    want = pdf["pos"].where(pdf["pos"] % 26 == 0).groupby(pdf["g"]).ffill()
    pd.testing.assert_series_equal(filled.full, want, check_names=False)


def test_exact_quantiles_of_hot_groups(hot):
    df, pdf = hot
    probs = {"p0": 0.0, "p05": 0.05, "p50": 0.5, "p999": 0.999, "p1": 1.0}
    got = collect(od.exact_quantiles(df, ["g"], "v", probs), "g").set_index("g")
    for g, part in pdf.dropna().groupby("g"):
        np.testing.assert_allclose(
            got.loc[g, list(probs)].astype(float), np.quantile(part.v, list(probs.values())), atol=1e-9
        )


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=40))
def test_quantiles_of_any_values(spark, values):
    df = spark.createDataFrame([(0, float(v)) for v in values], "k int, v double")
    got = od.exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.9}).first()
    np.testing.assert_allclose([got.a, got.b], np.quantile(values, [0.25, 0.9]), rtol=1e-9, atol=1e-9)


def test_value_bucket_is_monotone(spark):
    rng = np.random.default_rng(1)
    v = np.sort(np.concatenate([rng.normal(0, s, 500) for s in (1e-300, 1e-9, 1e-3, 1, 1e3, 1e12)] + [[0.0]]))
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    b = df.withColumn("b", od.value_bucket(F.col("v"))).toPandas().sort_values("v").b.to_numpy()
    assert (np.diff(b) >= 0).all() and len(set(b)) > 2000


def test_rank_slope_matches_definition(hot):
    df, pdf = hot
    got = collect(sg.rank_slope(df, ["g"], "v", ["pos"], CHUNK), "g").set_index("g").slope
    for g, part in pdf.dropna().groupby("g"):
        t = np.linspace(-0.5, 0.5, len(part))
        x = part.v.to_numpy()
        want = ((t - t.mean()) * (x - x.mean())).sum() / ((t - t.mean()) ** 2).sum()
        assert got[g] == pytest.approx(want, abs=1e-9)


def test_runs_cross_chunk_borders(spark):
    idx = [0, 1, 2, 3, 4, 5, 6, 9, 10, 20]
    df = spark.createDataFrame([("a", i) for i in idx], "g string, i bigint")
    got = collect(sg.contiguous_runs(df, ["g"], "i", width=3), "run_start")
    assert got[["run_start", "run_end", "run_length"]].values.tolist() == [
        [0, 6, 7], [9, 10, 2], [20, 20, 1]
    ]


def test_short_segments(spark):
    df = spark.createDataFrame(
        [("one", 0, 5.0), ("none", 0, None)], "g string, pos int, v double"
    )
    got = collect(sg.channel_summary(df, ["g"], "v", ["pos"], CHUNK), "g").set_index("g")
    assert got.loc["none", "valid_fraction"] == 0 and pd.isna(got.loc["none", "mean"])
    assert got.loc["one", "std"] == 0 and pd.isna(got.loc["one", "slope"])


def test_windows_meet_exactly_their_samples(spark):
    samples = spark.createDataFrame([("s", i) for i in range(40)], "k string, idx int")
    windows = spark.createDataFrame([("s", 1, 0, 10), ("s", 2, 7, 17), ("s", 3, 39, 40)], "k string, w int, a int, b int")
    got = wn.window_samples(windows, samples, ["k"], "idx", 10).groupBy("w").agg(
        F.count("*").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi")
    )
    assert collect(got, "w").values.tolist() == [[1, 10, 0, 9], [2, 10, 7, 16], [3, 1, 39, 39]]


def test_anchors_agree_when_length_matches(spark):
    trials = spark.createDataFrame([("s", 60.0, 60)], "k string, duration double, n bigint")
    times = F.sequence(F.lit(10), F.lit(60), F.lit(10))
    got = wn.candidate_windows(trials, times, 10, 1.0).toPandas()
    start = got[got.anchor == "START"].sort_values("t")[["a", "b"]].values
    end = got[got.anchor == "END"].sort_values("t")[["a", "b"]].values
    assert (start == end).all() and len(start) == 6


def test_bounds_round_half_to_even(spark):
    from cohortlift.functions.cleaning import start_bounds

    a, b = start_bounds(F.lit(2.5), 2.0, 1.0)
    assert tuple(spark.range(1).select(a, b).first()) == (0, 2)


def test_missing_keys_are_groups(spark):
    rows = [(None, i, float(i)) for i in range(5)] + [("a", i, float(10 * i)) for i in range(4)] + [("a", 9, float("nan"))]
    df = spark.createDataFrame(rows, "k string, t int, x double")
    where = od.chunk_of("t", 2)
    assert od.positions(df, ["k"], ["t"], where).count() == 10
    previous = od.with_previous(df, ["k"], ["t"], where, ["x"]).collect()
    assert len(previous) == 10 and sum(r.prev_x is None for r in previous) == 2
    assert od.running_sums(df, ["k"], ["t"], where, {"s": "x"}).count() == 10
    assert od.forward_fill(df, ["k"], "t", "x", "f", 2).count() == 10
    medians = {r.k: r.m for r in od.exact_median(df, ["k"], "x", "m").collect()}
    assert medians == {None: 2.0, "a": 15.0}


def test_thousands_of_sparse_chunks_of_one_key(spark, monkeypatch):
    """One key whose rows each lie in a chunk of their own, far apart: scanned in runs of chunks."""
    monkeypatch.setattr(od, "RUN", 50_000)
    rng = np.random.default_rng(8)
    pos = np.sort(rng.choice(10_000_000, 4_000, replace=False))
    pdf = pd.DataFrame({"g": "one", "pos": pos, "v": np.round(rng.normal(0, 9, len(pos)), 2)})
    df = spark.createDataFrame(pdf)
    per_run = pdf.groupby(pdf.pos // 4 // 50_000).size()
    assert len(per_run) < 60 and per_run.max() < 120  # rows of the largest windows, of 4,000
    got = collect(od.positions(df, ["g"], ["pos"], CHUNK, "rn", "total"), "pos")
    assert (got.rn == np.arange(1, 4_001)).all() and (got.total == 4_000).all()
    back = collect(od.with_previous(df, ["g"], ["pos"], CHUNK, ["v"], place="n"), "pos")
    pd.testing.assert_series_equal(back.prev_v, pdf.v.shift(1), check_names=False)
    assert (back.n == got.rn).all()
    ahead = collect(od.with_next(df, ["g"], ["pos"], CHUNK, ["v"]), "pos")
    pd.testing.assert_series_equal(ahead.next_v, pdf.v.shift(-1), check_names=False)
    sums = collect(od.running_sums(df, ["g"], ["pos"], F.floor(F.col("pos") / 4), {"s": "v"}), "pos")
    np.testing.assert_allclose(sums.s, pdf.v.cumsum(), atol=1e-6)
    marked = df.withColumn("m", F.when(F.col("pos") % 97 == 0, F.col("v")))
    filled = collect(od.forward_fill(marked, ["g"], "pos", "m", "full", width=4), "pos")
    pd.testing.assert_series_equal(filled.full, pdf.v.where(pdf.pos % 97 == 0).ffill(), check_names=False)
    slope = sg.rank_slope(df, ["g"], "v", ["pos"], CHUNK).first().slope
    assert slope == pytest.approx(np.polyfit(np.linspace(-0.5, 0.5, 4_000), pdf.v, 1)[0])
