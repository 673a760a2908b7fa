"""Embedding tables, residual representations and reproducibility audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlift.operators import audits as au
from cohortlift.operators import embeddings as em
from cohortlift.operators import linear as ln
from cohortlift.operators.ordered import exact_quantiles
from cohortlift.plans import fixtures as fx
from cohortlift.plans.registry import query

# Four vectors make a row's four locations; each vector is two channels of two 16-d patches.
PATCH_SQL = """pt AS (SELECT vec_id // 4 AS row_id, vec_id % 4 AS location, p // 2 AS channel, p % 2 AS patch,
    embedding[p * 16 + 1 : p * 16 + 16] AS v FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS p)
    WHERE vec_id % 11 <> 0),
  cell AS (SELECT row_id, location, channel, patch, unnest(v)::DOUBLE AS x, unnest(range(1, 17)) AS dim FROM pt)"""


def patches(spark, sf_dir):
    p = F.col("p")
    return (
        fx.table(spark, sf_dir, "embeddings")
        .where("vec_id % 11 <> 0")
        .withColumn("p", fx.explode_of(0, 1, 2, 3))
        .select(
            F.floor(F.col("vec_id") / 4).alias("row_id"),
            (F.col("vec_id") % 4).alias("location"),
            F.floor(p / 2).cast("int").alias("channel"),
            (p % 2).alias("patch"),
            F.slice("embedding", p * 16 + 1, 16).alias("v"),
        )
    )


LEVELS = [["row_id", "location", "channel"], ["row_id", "location"], ["row_id"]]


def cells(df):
    """Vector cells as rows, for comparison by value."""
    return df.select("row_id", F.posexplode("v").alias("dim", "x")).withColumn(
        "dim", F.col("dim") + 1
    )


def pooled_sql(where: str) -> str:
    return f"""WITH {PATCH_SQL}, a AS (SELECT row_id, location, channel, dim, avg(x) AS x FROM cell {where} GROUP BY ALL),
    b AS (SELECT row_id, location, dim, avg(x) AS x FROM a GROUP BY ALL)
    SELECT row_id, dim, avg(x) AS x FROM b GROUP BY ALL"""


@query("e1_mean_pooling", pooled_sql(""), rounded=["x"])
def e1(spark, sf_dir):
    """Patches, then channels, then the available locations pooled by mean."""
    return cells(em.pool(patches(spark, sf_dir), LEVELS, "v"))


@query("e2_first_patch_pooling", pooled_sql("WHERE patch = 0"), rounded=["x"])
def e2(spark, sf_dir):
    """The same with the first patch only."""
    return cells(em.first_patch_pool(patches(spark, sf_dir), "patch", LEVELS, "v"))


@query(
    "e3_weighted_chunk_mean",
    f"""WITH {PATCH_SQL} SELECT row_id, dim, sum(x * CASE patch WHEN 0 THEN 64 ELSE 61 END)
      / sum(CASE patch WHEN 0 THEN 64 ELSE 61 END)::DOUBLE AS x FROM cell GROUP BY ALL""",
    rounded=["x"],
)
def e3(spark, sf_dir):
    """Chunks weighted by their valid patches, 64 and 61."""
    # Valid patches of the two chunks of a window.
    weight = F.when(F.col("patch") == 0, F.lit(64.0)).otherwise(F.lit(61.0))
    return cells(em.weighted_pool(patches(spark, sf_dir).withColumn("w", weight), ["row_id"], "v", "w"))


@query(
    "e4_chunked_windows",
    """WITH s AS (SELECT participant, channel, row_number() OVER (PARTITION BY participant, channel ORDER BY pos) - 1
      AS idx, coalesce(value, 0) AS value FROM signals),
    n AS (SELECT participant, channel, count(*) AS n FROM s GROUP BY ALL),
    f AS (SELECT participant, channel, idx, value, true AS valid FROM s UNION ALL
      SELECT participant, channel, unnest(range(n, CASE WHEN n % 8 = 0 THEN n ELSE (n // 8 + 1) * 8 END)), 0.0, false FROM n)
    SELECT participant, channel, idx // 8 AS chunk, idx % 8 AS "offset", value, valid FROM f""",
    ["signals"],
)
def e4(spark, sf_dir):
    """Sample series cut into padded chunks of eight; every sample used once."""
    from cohortlift.operators.ordered import positions

    keys = ["participant", "channel"]
    placed = positions(fx.signals(spark, sf_dir), keys, ["pos"], "floor(pos / 65536)", out="place")
    samples = placed.select(
        *keys, (F.col("place") - 1).alias("idx"), F.coalesce("value", F.lit(0.0)).alias("value")
    )
    return em.chunk_windows(samples, keys, "idx", "value", 8)


COS_SQL = """cs AS (SELECT s.row_id, s.grp, list_cosine_similarity(s.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS cosine
    FROM representations s JOIN representations e ON s.row_id = e.row_id AND s.anchor = 'START' AND e.anchor = 'END')"""


@query(
    "e5_anchor_cosine",
    f"WITH {COS_SQL} SELECT row_id, cosine FROM cs",
    ["representations"],
    ["cosine"],
)
def e5(spark, sf_dir):
    """Cosine between the two anchors' vectors of a row."""
    return em.anchor_cosine(fx.representations(spark, sf_dir), "row_id", "embedding", ("START", "END"))


@query(
    "e5_cosine_summary",
    f"""WITH {COS_SQL} SELECT count(cosine) AS n, avg(cosine) AS mean, min(cosine) AS min, max(cosine) AS max,
      quantile_cont(cosine, 0.5) AS median FROM cs""",
    ["representations"],
    ["mean", "min", "max", "median"],
)
def e5_summary(spark, sf_dir):
    """Spread of the anchor cosine over rows."""
    cs = e5(spark, sf_dir).withColumn("one", F.lit(1))
    ends = cs.groupBy("one").agg(
        F.count("cosine").alias("n"), F.avg("cosine").alias("mean"),
        F.min("cosine").alias("min"), F.max("cosine").alias("max"),
    )
    return ends.join(exact_quantiles(cs, ["one"], "cosine", {"median": 0.5}), "one").drop("one")


@query(
    "e6_embedding_lock",
    """SELECT anchor, count(*) AS n_rows, count(DISTINCT row_id) AS n_ids,
      count(*) FILTER (WHERE len(embedding) <> 32) AS wrong_length, 0::BIGINT AS nonfinite, true AS ok
    FROM representations GROUP BY anchor""",
    ["representations"],
)
def e6(spark, sf_dir):
    """Length, finiteness and id checks of stored vectors."""
    return em.lock(fx.representations(spark, sf_dir), ["anchor"], "row_id", "embedding", 32)


@query(
    "e7_context_plus_embedding",
    """SELECT row_id, anchor, 34::BIGINT AS n_features, (row_id % 7)::DOUBLE AS first_value,
      embedding[32]::DOUBLE AS last_value FROM representations""",
    ["representations"],
    ["last_value"],
)
def e7(spark, sf_dir):
    """Context columns and vector as one feature array."""
    reps = fx.representations(spark, sf_dir)
    rows = reps.select("row_id", "grp").distinct().withColumn("c1", F.col("row_id") % 7)
    full = em.append_to_context(
        rows, reps.drop("grp"), ["row_id"], ["c1", "grp"], "embedding"
    )
    return full.select(
        "row_id", "anchor",
        F.size("features").cast("bigint").alias("n_features"),
        F.col("features")[0].alias("first_value"),
        F.element_at("features", -1).alias("last_value"),
    )


@query(
    "e7_embedding_columns",
    "SELECT row_id, grp, anchor, "
    + ", ".join(f"embedding[{i + 1}]::DOUBLE AS emb_{i:03d}" for i in range(32))
    + " FROM representations",
    ["representations"],
    [f"emb_{i:03d}" for i in range(32)],
)
def e7_columns(spark, sf_dir):
    """Every dimension as a named column."""
    return em.to_columns(fx.representations(spark, sf_dir), "embedding", 32)


# --- residual representation -------------------------------------------------------------------
RIDGE_SQL = """r AS (SELECT anchor, row_id, (row_id % 5 + 1)::INT AS fold, (row_id % 7)::DOUBLE AS x1, grp::DOUBLE AS x2,
    unnest(embedding)::DOUBLE AS e, unnest(range(1, 33)) AS dim FROM representations),
  tr AS (SELECT anchor, f AS fold, dim, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2,
    covar_pop(x1, x2) AS c12, avg(e) AS me, covar_pop(x1, e) AS c1e, covar_pop(x2, e) AS c2e
    FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS f) WHERE fold <> f GROUP BY anchor, f, dim),
  z AS (SELECT *, n + 1.0 AS a11, n * c12 / (s1 * s2) AS a12, n + 1.0 AS a22, n * c1e / s1 AS y1, n * c2e / s2 AS y2 FROM tr),
  b AS (SELECT anchor, fold, dim, m1, m2, me, (a22 * y1 - a12 * y2) / (a11 * a22 - a12 * a12) / s1 AS b1,
    (a11 * y2 - a12 * y1) / (a11 * a22 - a12 * a12) / s2 AS b2 FROM z),
  res AS (SELECT r.anchor, r.row_id, r.fold, r.dim, r.e, me + b1 * (x1 - m1) + b2 * (x2 - m2) AS predicted FROM r
    JOIN b ON r.fold = b.fold AND r.dim = b.dim AND r.anchor = b.anchor)"""


def contextual(spark, sf_dir):
    return (
        fx.representations(spark, sf_dir)
        .select(
            "anchor",
            "row_id",
            (F.col("row_id") % 5 + 1).cast("int").alias("fold"),
            (F.col("row_id") % 7).cast("double").alias("x1"),
            F.col("grp").cast("double").alias("x2"),
            "embedding",
        )
    )


@query(
    "l5_multi_output_ridge",
    f"WITH {RIDGE_SQL} SELECT anchor, fold, dim, me - m1 * b1 - m2 * b2 AS intercept, b1, b2 FROM b",
    ["representations"],
    ["intercept", "b1", "b2"],
)
def l5(spark, sf_dir):
    """Ridge of every vector dimension on two context columns, per held-out fold."""
    c = ln.ridge_coefficients(contextual(spark, sf_dir), "fold", ["x1", "x2"], "embedding", 1.0, ["anchor"])
    zipped = F.arrays_zip("intercept", F.col("coef")[0].alias("b1"), F.col("coef")[1].alias("b2"))
    return c.select("anchor", "fold", F.posexplode(zipped).alias("dim", "t")).select(
        "anchor", "fold", (F.col("dim") + 1).alias("dim"), "t.intercept", "t.b1", "t.b2"
    )


def residuals(spark, sf_dir):
    df = contextual(spark, sf_dir)
    coef = ln.ridge_coefficients(df, "fold", ["x1", "x2"], "embedding", 1.0, ["anchor"])
    return ln.residual_vectors(df, coef, "fold", ["x1", "x2"], "embedding", ["anchor"])


@query(
    "r4_residual_representation",
    f"WITH {RIDGE_SQL} SELECT anchor, row_id, fold, dim, e - predicted AS residual FROM res",
    ["representations"],
    ["residual"],
)
def r4(spark, sf_dir):
    """Vector minus what the context predicts of it out of fold."""
    df = residuals(spark, sf_dir).select("anchor", "row_id", "fold", F.posexplode("residual").alias("dim", "residual"))
    return df.withColumn("dim", F.col("dim") + 1)


@query(
    "r5_residual_diagnostics",
    f"""WITH {RIDGE_SQL} SELECT anchor, fold, 1 - avg((e - predicted) ** 2) / var_pop(e) AS context_explained_r2,
      sum((e - predicted) ** 2) / sum(e * e) AS residual_energy_ratio FROM res GROUP BY anchor, fold""",
    ["representations"],
    ["context_explained_r2", "residual_energy_ratio"],
)
def r5(spark, sf_dir):
    """How much of the vectors the context explains, per fold."""
    return ln.residual_diagnostics(residuals(spark, sf_dir), ["anchor", "fold"])


# --- audits --------------------------------------------------------------------------------------
TASK = ["anchor", "feature_set", "repeat", "outer_fold"]


@query(
    "v1_reproduction_audit",
    """SELECT anchor, feature_set, repeat, outer_fold, count(*) FILTER (WHERE row_id % 997 <> 0) AS n_compared,
      count(*) FILTER (WHERE row_id % 997 = 0) AS n_unmatched,
      max(CASE WHEN row_id % 499 = 0 AND row_id % 997 <> 0 THEN 1e-6 ELSE 0 END) AS max_abs_diff,
      count(*) FILTER (WHERE row_id % 997 = 0 OR row_id % 499 = 0) = 0 AS passes
    FROM predictions GROUP BY ALL""",
    ["predictions"],
    ["max_abs_diff"],
    digits=9,
)
def v1(spark, sf_dir):
    """Fresh predictions against stored ones, with a few lost and a few shifted rows."""
    stored = fx.predictions(spark, sf_dir)
    shift = F.when(F.col("row_id") % 499 == 0, 1e-6).otherwise(0.0)
    fresh = stored.where("row_id % 997 <> 0").withColumn("y_pred", F.col("y_pred") + shift)
    return au.reproduction(stored, fresh, TASK, "row_id", "y_pred", 1e-10)


LOG_SQL = """lg AS (SELECT anchor, feature_set, repeat, outer_fold, task AS inner_fold,
    '{"alpha": ' || (row_id % 4) || '}' AS params, avg(abs(y_true - y_pred)) AS score,
    (count(*) * 100 + max(row_id) % 300)::BIGINT AS n_iter, 2200::BIGINT AS max_iter,
    max(row_id) % 13 <> 0 AS converged FROM predictions GROUP BY ALL),
  cand AS (SELECT anchor, feature_set, repeat, outer_fold, params, avg(score) AS mean_score FROM lg GROUP BY ALL),
  sel AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY anchor, feature_set, repeat, outer_fold
    ORDER BY mean_score, params) = 1),
  mark AS (SELECT lg.*, sel.params IS NOT NULL AS selected FROM lg LEFT JOIN sel
    USING (anchor, feature_set, repeat, outer_fold, params))"""


def fit_log(spark, sf_dir):
    key = F.concat(F.lit('{"alpha": '), (F.col("row_id") % 4).cast("string"), F.lit("}"))
    return fx.predictions(spark, sf_dir).groupBy(
        *TASK, F.col("task").alias("inner_fold"), key.alias("params")
    ).agg(
        F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("score"),
        (F.count(F.lit(1)) * 100 + F.max("row_id") % 300).alias("n_iter"),
        F.lit(2200).cast("bigint").alias("max_iter"),
        (F.max("row_id") % 13 != 0).alias("converged"),
    )


def selected(log):
    from cohortlift.operators.sets import best_candidate

    means = log.groupBy(*TASK, "params").agg(F.avg("score").alias("mean_score"))
    return best_candidate(means, TASK, "mean_score", "params")


def marked(spark, sf_dir):
    log = fit_log(spark, sf_dir)
    chosen = selected(log).select(*TASK, "params").withColumn("selected", F.lit(True))
    return log.join(chosen, [*TASK, "params"], "left").fillna(False, ["selected"])


@query(
    "v1_selection_match",
    f"""WITH {LOG_SQL}, fr AS (SELECT anchor, feature_set, repeat, outer_fold, params,
      mean_score + CASE WHEN repeat = 3 THEN 1e-6 ELSE 0 END AS mean_score FROM sel WHERE outer_fold <> 5)
    SELECT sel.anchor, sel.feature_set, sel.repeat, sel.outer_fold, sel.params AS stored_params, fr.params AS fresh_params,
      fr.params IS NOT NULL AS params_match, abs(sel.mean_score - fr.mean_score) AS inner_score_diff,
      coalesce(abs(sel.mean_score - fr.mean_score) <= 1e-10, false) AS score_match
    FROM sel LEFT JOIN fr USING (anchor, feature_set, repeat, outer_fold)""",
    ["predictions"],
    ["inner_score_diff"],
    digits=8,
)
def v1_selection(spark, sf_dir):
    """Selected parameters and inner scores of two runs."""
    stored = selected(fit_log(spark, sf_dir))
    shift = F.when(F.col("repeat") == 3, 1e-6).otherwise(0.0)
    fresh = stored.where("outer_fold <> 5").withColumn("mean_score", F.col("mean_score") + shift)
    return au.selection_match(stored, fresh, TASK, "params", "mean_score", 1e-10)


@query(
    "v2_fit_log_rollup",
    f"""WITH {LOG_SQL} SELECT anchor, feature_set, params, count(*) AS n_fits,
      count(*) FILTER (WHERE NOT converged) AS n_not_converged,
      count(*) FILTER (WHERE n_iter >= max_iter) AS n_hit_max_iter, max(n_iter) AS max_n_iter
    FROM lg GROUP BY anchor, feature_set, params""",
    ["predictions"],
)
def v2(spark, sf_dir):
    """Convergence of the fits by candidate."""
    return au.fit_rollup(fit_log(spark, sf_dir), ["anchor", "feature_set", "params"])


@query(
    "v3_convergence_gates",
    f"""WITH {LOG_SQL} SELECT anchor, feature_set, repeat, CASE WHEN coalesce(bool_and(converged AND n_iter < max_iter)
        FILTER (WHERE selected), true) THEN 'PASS' ELSE 'FAIL' END AS selected_path,
      CASE WHEN bool_and(converged AND n_iter < max_iter) THEN 'PASS' ELSE 'FAIL' END AS full_grid,
      count(*) FILTER (WHERE selected) AS n_selected_fits, count(*) AS n_fits
    FROM mark GROUP BY anchor, feature_set, repeat""",
    ["predictions"],
)
def v3(spark, sf_dir):
    """Gate over the selected path and over the full grid."""
    return au.convergence_gates(marked(spark, sf_dir), ["anchor", "feature_set", "repeat"], "selected")


RECOVER_SQL = """bad AS (SELECT * FROM lg WHERE params = '{"alpha": 1}'),
  merged AS (SELECT anchor, feature_set, repeat, outer_fold, inner_fold, score, n_iter, converged, 'kept' AS source FROM bad
      WHERE converged AND n_iter < max_iter
    UNION ALL SELECT anchor, feature_set, repeat, outer_fold, inner_fold, score * 0.9::DOUBLE, n_iter * 2,
      true, 'rerun' FROM bad WHERE NOT (converged AND n_iter < max_iter))"""


def recovered(spark, sf_dir):
    log = fit_log(spark, sf_dir).where("params = '{\"alpha\": 1}'")
    rerun = (
        log.withColumn("score", F.col("score") * 0.9)
        .withColumn("n_iter", F.col("n_iter") * 2)
        .withColumn("max_iter", F.lit(1_000_000).cast("bigint"))
        .withColumn("converged", F.lit(True))
    )
    return au.merge_recovery(log, rerun, [*TASK, "inner_fold", "params"])


@query(
    "v4_targeted_recovery",
    f"""WITH {LOG_SQL}, {RECOVER_SQL} SELECT anchor, feature_set, repeat, outer_fold, avg(score) AS recovered_score,
      count(score) AS n_inner_folds, count(*) FILTER (WHERE source = 'rerun') AS n_reruns,
      count(*) FILTER (WHERE NOT converged) AS n_not_converged, max(n_iter) AS max_n_iter,
      any_value(mean_score) AS selected_score, avg(score) - any_value(mean_score) AS margin,
      avg(score) - any_value(mean_score) < -1e-12 AS beats_selected, count(score) = 5 AS complete
    FROM merged JOIN sel USING (anchor, feature_set, repeat, outer_fold) GROUP BY ALL""",
    ["predictions"],
    ["recovered_score", "selected_score", "margin"],
)
def v4(spark, sf_dir):
    """Failed fits of one candidate replaced and compared with the selected score."""
    chosen = selected(fit_log(spark, sf_dir)).withColumnRenamed("mean_score", "selected_score")
    return au.recovery_against_selected(recovered(spark, sf_dir), chosen, TASK, 5)


@query(
    "v5_locked_baseline_structure",
    """WITH l AS (SELECT anchor, count(DISTINCT (repeat, outer_fold)) AS folds, count(DISTINCT repeat) AS repeats,
      count(DISTINCT (row_id, repeat)) - count(*) + 1 AS r FROM predictions WHERE feature_set = 'base' GROUP BY anchor)
    SELECT anchor, 'folds' AS "check", folds AS found, 25::BIGINT AS expected, folds = 25 AS ok FROM l
    UNION ALL SELECT anchor, 'repeats', repeats, 5, repeats = 5 FROM l
    UNION ALL SELECT anchor, 'rows', count(*), 50000, count(*) = 50000 FROM predictions WHERE feature_set = 'base' GROUP BY anchor""",
    ["predictions"],
)
def v5(spark, sf_dir):
    """Folds, repeats and rows of a stored baseline against their locked values."""
    base = fx.predictions(spark, sf_dir).where("feature_set = 'base'")
    return au.structure(
        base, ["anchor"],
        {"folds": (("repeat", "outer_fold"), 25), "repeats": (("repeat",), 5), "rows": ((), 50000)},
    )


@query(
    "v6_completeness",
    f"""WITH {LOG_SQL} SELECT count(*) AS n_rows, count(*) AS n_keys, 0::BIGINT AS n_repeated,
      2000::BIGINT AS expected, count(*) = 2000 AS complete FROM lg""",
    ["predictions"],
)
def v6(spark, sf_dir):
    """Every expected fit key exactly once."""
    return au.completeness(fit_log(spark, sf_dir), [*TASK, "inner_fold", "params"], 2000)
