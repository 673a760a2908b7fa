"""Splits, metrics and increments over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlift.operators import increments as ic
from cohortlift.operators import joining as jn
from cohortlift.operators import metrics as mt
from cohortlift.operators import sets as st
from cohortlift.operators import splits as sp
from cohortlift.operators.joining import dealt
from cohortlift.plans import fixtures as fx
from cohortlift.plans.registry import query

SEED = 42
SEEDS = 500


# --- splits -----------------------------------------------------------------------------------
def dealt_sql(groups: str, keys: str, k: int) -> str:
    """SQL of the dealt split: ``groups`` is a CTE with keys, seed, grp, n."""
    return f"""ordered AS (SELECT {keys}, seed, grp, (row_number() OVER (PARTITION BY {keys}
      ORDER BY n DESC, md5(grp::VARCHAR), grp) - 1) // {k} AS run FROM {groups}),
    folds AS (SELECT {keys}, grp, row_number() OVER (PARTITION BY {keys}, run
      ORDER BY md5(seed || '|' || run || '|' || grp), grp)::INT AS fold FROM ordered)"""


GROUPS_SQL = """sizes AS (SELECT user_id AS grp, count(*) AS n FROM events GROUP BY user_id),
  seeded AS (SELECT repeat, 42 + (repeat - 1) * 10000 AS seed, grp, n FROM sizes,
    (SELECT unnest([1, 2, 3, 4, 5]) AS repeat))"""


def seeded_groups(spark, sf_dir, repeats=5):
    groups = sp.group_sizes(fx.table(spark, sf_dir, "events"), "user_id")
    return sp.with_seeds(groups, SEED, 10000, repeats)


def outer_folds(spark, sf_dir, repeats=5):
    return sp.shuffled_folds(seeded_groups(spark, sf_dir, repeats), ["repeat"], 5)


@query(
    "x1_shuffled_group_folds",
    f"""WITH sizes AS (SELECT user_id AS grp, count(*) AS n FROM events GROUP BY user_id),
    seeded AS (SELECT 1 AS repeat, 42 AS seed, grp, n FROM sizes),
    {dealt_sql("seeded", "repeat", 5)}
    SELECT grp, n, fold FROM folds JOIN sizes USING (grp)""",
    recursive=True,
)
def x1(spark, sf_dir):
    """Outcome-blind five-fold split of participants."""
    return outer_folds(spark, sf_dir, repeats=1).select("grp", "n", "fold")


@query(
    "x1_serpentine_folds",
    """SELECT grp, n, (CASE WHEN t < 5 THEN t ELSE 9 - t END + 1)::INT AS fold FROM (SELECT *,
      (row_number() OVER (ORDER BY n DESC, grp) - 1) % 10 AS t FROM
      (SELECT user_id AS grp, count(*) AS n FROM events GROUP BY user_id))""",
)
def x1_serpentine(spark, sf_dir):
    """Split without a sequential step: sizes dealt back and forth."""
    groups = sp.group_sizes(fx.table(spark, sf_dir, "events"), "user_id").withColumn("one", F.lit(1))
    folds = sp.serpentine_folds(groups, ["one"], 5, "floor(-ln(n) * 8)")
    return folds.select("grp", "n", "fold")


X2_SQL = f"""labelled AS (SELECT user_id AS grp, count(*) AS n,
    count(*) FILTER (WHERE value >= 150) AS n_pos, count(*) FILTER (WHERE value < 150) AS n_neg
    FROM events GROUP BY user_id),
  tries AS (SELECT repeat, attempt, 42 + (repeat - 1) * 10000 + attempt AS seed, grp, n, n_pos, n_neg
    FROM labelled, (SELECT unnest([1, 2, 3, 4, 5]) AS repeat), (SELECT unnest(range({SEEDS})) AS attempt)),
  turns AS (SELECT *, (row_number() OVER (PARTITION BY repeat, attempt, n_pos > 0
    ORDER BY CASE WHEN n_pos > 0 THEN n_pos ELSE n END DESC, md5(grp::VARCHAR), grp) - 1) // 5 AS run FROM tries),
  placed AS (SELECT repeat, attempt, grp, row_number() OVER (PARTITION BY repeat, attempt, n_pos > 0, run
    ORDER BY md5(seed || '|' || run || '|' || grp), grp)::INT AS fold, n, n_pos, n_neg FROM turns),
  inside AS (SELECT repeat, attempt, fold, sum(n_pos) AS p, sum(n_neg) AS q FROM placed GROUP BY ALL),
  usable AS (SELECT repeat, min(attempt) AS attempt FROM (SELECT repeat, attempt FROM inside
    GROUP BY repeat, attempt HAVING count(*) = 5 AND min(p) > 0 AND min(q) > 0 AND sum(p) > max(p)
    AND sum(q) > max(q)) GROUP BY repeat)"""


@query(
    "x2_stratified_group_folds",
    f"""WITH {X2_SQL} SELECT repeat, attempt, grp, fold, n, n_pos, n_neg FROM placed
    JOIN usable USING (repeat, attempt)""",
    recursive=True,
)
def x2(spark, sf_dir):
    """Five folds balanced on positives under the first usable seed."""
    ev = fx.table(spark, sf_dir, "events").withColumn("y", (F.col("value") >= 150).cast("int"))
    groups = sp.with_seeds(sp.group_sizes(ev, "user_id", "y"), SEED, 10000, 5)
    return sp.stratified_folds(groups, ["repeat"], 5, attempts=SEEDS).drop("seed")


@query(
    "x3_repeated_outer_splits",
    f"WITH {GROUPS_SQL}, {dealt_sql('seeded', 'repeat', 5)} SELECT repeat, grp, fold FROM folds",
    recursive=True,
)
def x3(spark, sf_dir):
    """Five repeats of the split, each under its own seed."""
    return outer_folds(spark, sf_dir).select("repeat", "grp", "fold")


@query(
    "x4_inner_folds",
    f"""WITH {GROUPS_SQL}, {dealt_sql("seeded", "repeat", 5)},
    inner_groups AS (SELECT f.repeat, o.outer_fold, f.grp, s.n,
      42 + (f.repeat - 1) * 10000 + 1000 * o.outer_fold + 11 AS seed FROM folds f
      JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS outer_fold) o ON o.outer_fold <> f.fold JOIN sizes s ON s.grp = f.grp),
    {dealt_sql("inner_groups", "repeat, outer_fold", 4).replace("ordered", "ordered2").replace("folds AS", "folds2 AS")}
    SELECT repeat, outer_fold, grp, fold AS inner_fold FROM folds2""",
    recursive=True,
)
def x4(spark, sf_dir):
    """Four inner folds of each outer training set."""
    outer = outer_folds(spark, sf_dir)
    groups = sp.group_sizes(fx.table(spark, sf_dir, "events"), "user_id")
    seed = F.col("seed") + 1000 * F.col("outer_fold") + 11
    inner = sp.inner_groups(outer, groups, 5, seed)
    folds = sp.shuffled_folds(inner, ["repeat", "outer_fold"], 4)
    return folds.select("repeat", "outer_fold", "grp", F.col("fold").alias("inner_fold"))


@query(
    "x5_leakage_check",
    """SELECT repeat, count(DISTINCT user_id) AS n_groups, 0::BIGINT AS n_leaking, 5::BIGINT AS n_folds, true AS ok
    FROM events, (SELECT unnest([1, 2, 3, 4, 5]) AS repeat) GROUP BY repeat""",
)
def x5(spark, sf_dir):
    """No participant in two folds of a repeat."""
    return sp.leakage(outer_folds(spark, sf_dir), ["repeat"])


@query(
    "x6_shared_fold_table",
    f"""WITH {GROUPS_SQL}, {dealt_sql("seeded", "repeat", 5)}
    SELECT repeat, fold AS outer_fold, event_type, count(*) AS n_rows, max(value) AS top FROM events
    JOIN folds ON grp = user_id GROUP BY ALL""",
    recursive=True,
)
def x6(spark, sf_dir):
    """Rows of every task under the one fold table."""
    rows = sp.attach_folds(
        fx.table(spark, sf_dir, "events").select("user_id", "event_type", "value"),
        outer_folds(spark, sf_dir), "user_id",
    )
    return rows.groupBy("repeat", "outer_fold", "event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("value").alias("top")
    )


@query(
    "x7_split_verification",
    """SELECT anchor, feature_set, repeat, ((user_id * 7 + repeat * 3) % 5 + 1)::INT AS outer_fold, 0::BIGINT AS only_first,
      count(*) FILTER (WHERE event_id % 601 = 0) AS only_second, count(*) AS n_keys,
      count(*) FILTER (WHERE event_id % 601 = 0) = 0 AS equal
    FROM events, (SELECT unnest([1, 2, 3, 4, 5]) AS repeat), (SELECT unnest(['START', 'END']) AS anchor),
      (SELECT unnest(['base', 'comb']) AS feature_set) GROUP BY ALL""",
)
def x7(spark, sf_dir):
    """Rebuilt test rows against the stored ones, per stored table, repeat and fold."""
    by = ["anchor", "feature_set", "repeat", "outer_fold"]
    stored = fx.predictions(spark, sf_dir).where("row_id % 601 <> 0").select(*by, "row_id")
    # dealt as the stored rows are, so that equal keys lie in the same task without moving the copies
    rows = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), "user_id")
    rebuilt = (
        dealt(rows, ["row_id"], fx.EVENTS_OF_TASK)
        .withColumn("repeat", fx.explode_of(1, 2, 3, 4, 5))
        .withColumn("anchor", fx.explode_of("START", "END"))
        .withColumn("feature_set", fx.explode_of("base", "comb"))
        .select(
            "anchor", "feature_set", "repeat",
            ((F.col("user_id") * 7 + F.col("repeat") * 3) % 5 + 1).cast("int").alias("outer_fold"),
            "row_id",
        )
    )
    return st.key_equality(stored, rebuilt, ["row_id"], by=by)


# --- metrics ----------------------------------------------------------------------------------
REG = ["mae_pb", "rmse_pb", "mae_rep", "rmse_rep", "r2_rep"]
PROB = ["brier_pb", "logloss_pb", "brier_rep", "logloss_rep"]


def reg_sql(src: str, by: str) -> str:
    """Balanced regression metrics of the rows of ``src`` by the listed columns."""
    return f"""SELECT {by}, sum(n)::BIGINT AS n_rows, count(*) AS n_groups, avg(ae / n) AS mae_pb,
      sqrt(avg(se / n)) AS rmse_pb, sum(ae) / sum(n) AS mae_rep, sqrt(sum(se) / sum(n)) AS rmse_rep,
      CASE WHEN any_value(sst) > 1e-12 THEN 1 - sum(se) / any_value(sst) END AS r2_rep
    FROM (SELECT {by}, grp, count(*) AS n, sum(abs(y_true - y_pred)) AS ae, sum((y_true - y_pred) ** 2) AS se
      FROM {src} GROUP BY ALL) JOIN (SELECT {by}, var_pop(y_true) * count(*) AS sst FROM {src} GROUP BY ALL)
      USING ({by}) GROUP BY {by}"""


@query(
    "m1_balanced_regression",
    reg_sql("predictions", "anchor, feature_set, repeat"),
    ["predictions"],
    REG,
)
def m1(spark, sf_dir):
    """Participant-balanced and pooled errors."""
    return mt.regression_metrics(
        fx.predictions(spark, sf_dir), ["anchor", "feature_set", "repeat"], "grp", "y_true", "y_pred"
    )


PROB_SQL = """clipped AS (SELECT *, greatest(least(y_prob, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) AS p FROM prob_predictions)"""


def prob_sql(src: str, by: str) -> str:
    return f"""SELECT {by}, sum(n)::BIGINT AS n_rows, count(*) AS n_groups, sum(pos)::BIGINT AS n_events,
      avg(br / n) AS brier_pb, avg(ll / n) AS logloss_pb, sum(br) / sum(n) AS brier_rep, sum(ll) / sum(n) AS logloss_rep
    FROM (SELECT {by}, grp, count(*) AS n, sum(y_true) AS pos, sum((y_true - p) ** 2) AS br,
      sum(-(y_true * ln(p) + (1 - y_true) * ln(1 - p))) AS ll FROM {src} GROUP BY ALL) GROUP BY {by}"""


def rank_sql(src: str, by: str) -> str:
    return f"""SELECT {by}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * tp / (tp + fp)) / sum(pos) END AS pr_auc,
      CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) END AS roc_auc
    FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (SELECT {by}, p,
      sum(y_true)::DOUBLE AS pos, sum(1 - y_true)::DOUBLE AS neg FROM {src} GROUP BY ALL)
      WINDOW w AS (PARTITION BY {by} ORDER BY p DESC)) GROUP BY {by}"""


@query(
    "m2_balanced_probability",
    f"WITH {PROB_SQL} " + prob_sql("clipped", "feature_set, repeat"),
    ["prob_predictions"],
    PROB,
)
def m2(spark, sf_dir):
    """Balanced and pooled Brier score and log loss."""
    return mt.probability_metrics(
        fx.prob_predictions(spark, sf_dir), ["feature_set", "repeat"], "grp", "y_true", "y_prob"
    )


@query(
    "m3_m4_average_precision_and_auc",
    f"WITH {PROB_SQL} " + rank_sql("clipped", "feature_set, repeat"),
    ["prob_predictions"],
    ["pr_auc", "roc_auc"],
)
def m3(spark, sf_dir):
    """Average precision and ROC-AUC with ties folded."""
    return mt.ranking_metrics(
        fx.prob_predictions(spark, sf_dir), ["feature_set", "repeat"], "y_true", "y_prob"
    )


@query(
    "w10_cumulative_true_false_positives",
    f"""WITH {PROB_SQL} SELECT feature_set, repeat, p AS score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
    FROM (SELECT feature_set, repeat, p, sum(y_true)::DOUBLE AS pos, sum(1 - y_true)::DOUBLE AS neg FROM clipped
      GROUP BY ALL) WINDOW w AS (PARTITION BY feature_set, repeat ORDER BY p DESC)""",
    ["prob_predictions"],
    ["score"],
    digits=9,
)
def w10(spark, sf_dir):
    """True and false positives by falling score."""
    counts = mt.score_counts(fx.prob_predictions(spark, sf_dir), ["feature_set", "repeat"], "y_true", "y_prob")
    return mt.cumulative_counts(counts, ["feature_set", "repeat"])


@query(
    "m5_fold_metrics",
    reg_sql("predictions", "anchor, feature_set, repeat, outer_fold"),
    ["predictions"],
    REG,
)
def m5(spark, sf_dir):
    """Errors and counts per fold."""
    return mt.regression_metrics(
        fx.predictions(spark, sf_dir), ["anchor", "feature_set", "repeat", "outer_fold"],
        "grp", "y_true", "y_pred",
    )


@query(
    "m5_fold_probability_metrics",
    f"""WITH {PROB_SQL}, a AS ({prob_sql("clipped", "feature_set, repeat, outer_fold")}),
    b AS ({rank_sql("clipped", "feature_set, repeat, outer_fold")})
    SELECT * FROM a JOIN b USING (feature_set, repeat, outer_fold)""",
    ["prob_predictions"],
    [*PROB, "pr_auc", "roc_auc"],
)
def m5_prob(spark, sf_dir):
    """Probability metrics and counts per fold."""
    df = fx.prob_predictions(spark, sf_dir)
    by = ["feature_set", "repeat", "outer_fold"]
    left = mt.probability_metrics(df, by, "grp", "y_true", "y_prob")
    return left.join(mt.ranking_metrics(df, by, "y_true", "y_prob"), by)


AVG_SQL = """oof AS (SELECT anchor, feature_set, row_id, any_value(grp) AS grp, any_value(task) AS task,
    any_value(y_true) AS y_true, avg(y_pred) AS y_pred, stddev_samp(y_pred) AS y_pred_sd, count(*) AS n
    FROM predictions GROUP BY anchor, feature_set, row_id)"""


def averaged(spark, sf_dir):
    return mt.average_predictions(
        fx.predictions(spark, sf_dir), ["anchor", "feature_set", "row_id"], "y_pred",
        ["grp", "task", "y_true"], fx.REPEATS,
    )


@query(
    "m6_scope_summary",
    f"""WITH {AVG_SQL}, sc AS (SELECT *, 'All' AS scope FROM oof UNION ALL SELECT *, task FROM oof)
    {reg_sql("sc", "anchor, feature_set, scope")}""",
    ["predictions"],
    REG,
)
def m6(spark, sf_dir):
    """Metrics of the averaged predictions, overall and per task."""
    return mt.regression_summary(
        averaged(spark, sf_dir), ["anchor", "feature_set"], "task", "grp", "y_true", "y_pred_avg"
    )


PROB_AVG_SQL = """poof AS (SELECT feature_set, row_id, any_value(grp) AS grp, any_value(task) AS task,
    any_value(y_true) AS y_true, round(avg(y_prob), 12) AS y_prob FROM prob_predictions GROUP BY feature_set, row_id),
  pc AS (SELECT *, greatest(least(y_prob, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) AS p FROM poof)"""


def averaged_prob(spark, sf_dir):
    df = mt.average_predictions(
        fx.prob_predictions(spark, sf_dir), ["feature_set", "row_id"], "y_prob",
        ["grp", "task", "y_true"], fx.REPEATS,
    )
    # averages of equal scores must tie whatever order they were added in
    return df.withColumn("y_prob_avg", F.round("y_pred_avg", 12))


@query(
    "m6_probability_scope_summary",
    f"""WITH {PROB_AVG_SQL}, sc AS (SELECT *, 'All' AS scope FROM pc UNION ALL SELECT *, task FROM pc),
    a AS ({prob_sql("sc", "feature_set, scope")}), b AS ({rank_sql("sc", "feature_set, scope")})
    SELECT * FROM a JOIN b USING (feature_set, scope)""",
    ["prob_predictions"],
    [*PROB, "pr_auc", "roc_auc"],
)
def m6_prob(spark, sf_dir):
    """Probability metrics of the averaged predictions, overall and per task."""
    return mt.probability_summary(
        averaged_prob(spark, sf_dir), ["feature_set"], "task", "grp", "y_true", "y_prob_avg"
    )


@query(
    "m7_averaged_predictions",
    f"""WITH {AVG_SQL} SELECT anchor, feature_set, row_id, y_pred AS y_pred_avg, y_pred_sd,
      n AS n_oof_predictions, grp, task, y_true FROM oof""",
    ["predictions"],
    ["y_pred_avg", "y_pred_sd"],
    digits=7,
)
def m7(spark, sf_dir):
    """Mean, spread and count of each row's repeated predictions."""
    return averaged(spark, sf_dir)


# --- increments -------------------------------------------------------------------------------
PAIR_SQL = f"""{AVG_SQL}, pairs AS (SELECT b.anchor, b.row_id, b.grp, b.task, b.y_true, b.y_pred AS pred_base,
    c.y_pred AS pred_comb FROM oof b JOIN oof c ON b.anchor = c.anchor AND b.row_id = c.row_id
    AND b.feature_set = 'base' AND c.feature_set = 'comb'),
  gs AS (SELECT anchor, grp, count(*)::DOUBLE AS n, avg(y_true) AS my, var_pop(y_true) AS vy,
    sum(abs(y_true - pred_base)) AS aeb, sum(abs(y_true - pred_comb)) AS aec,
    sum((y_true - pred_base) ** 2) AS seb, sum((y_true - pred_comb) ** 2) AS sec FROM pairs GROUP BY ALL)"""
DELTA_SQL = """sum(n)::BIGINT AS n_rows, count(*) AS n_groups, avg(aeb / n) - avg(aec / n) AS delta_mae_pb,
  sqrt(avg(seb / n)) - sqrt(avg(sec / n)) AS delta_rmse_pb,
  (sum(seb) - sum(sec)) / (sum(n * vy) + sum(n * my * my) - sum(n * my) ** 2 / sum(n)) AS delta_r2_rep"""


def boot_sql(replicates: int, seed: int) -> str:
    return f"""gi AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY md5(grp::VARCHAR), grp) - 1 AS idx,
      count(*) OVER (PARTITION BY anchor) AS g FROM gs),
    dr AS (SELECT anchor, b AS replicate, ('0x' || substr(md5('{seed}|' || b || '|' || idx), 1, 8))::BIGINT % g AS idx
      FROM gi, range(1, {replicates + 1}) t(b)),
    bt AS (SELECT dr.anchor, replicate, {DELTA_SQL} FROM dr JOIN gi ON dr.anchor = gi.anchor AND dr.idx = gi.idx
      GROUP BY dr.anchor, replicate)"""


DELTAS = list(ic.DELTAS)
CI_SQL = ", ".join(
    f"quantile_cont({d}, 0.025) AS {d}_ci_low, quantile_cont({d}, 0.975) AS {d}_ci_high, "
    f"avg(({d} > 0)::INT::DOUBLE) AS {d}_positive_share, count({d}) AS {d}_n"
    for d in DELTAS
)
CI_COLS = [f"{d}_{s}" for d in DELTAS for s in ("ci_low", "ci_high", "positive_share")]


def pairs_of(spark, sf_dir):
    return jn.paired_averages(
        fx.predictions(spark, sf_dir), ["anchor", "row_id"], "feature_set", "base", "comb",
        "y_pred", ["grp", "task", "y_true"], fx.REPEATS,
    )


@query(
    "i1_paired_deltas",
    f"WITH {PAIR_SQL} SELECT anchor, {DELTA_SQL} FROM gs GROUP BY anchor",
    ["predictions"],
    DELTAS,
)
def i1(spark, sf_dir):
    """Observed improvements of the combined prediction."""
    return ic.regression_increment(pairs_of(spark, sf_dir), ["anchor"], "grp", "y_true")


@query(
    "i2_bootstrap_replicates",
    f"WITH {PAIR_SQL}, {boot_sql(2000, 77)} SELECT anchor, replicate, {', '.join(DELTAS)} FROM bt",
    ["predictions"],
    DELTAS,
)
def i2(spark, sf_dir):
    """Deltas of each participant-cluster bootstrap replicate."""
    return ic.bootstrap_replicates(pairs_of(spark, sf_dir), ["anchor"], "grp", "y_true", 2000, 77)


@query(
    "i3_bootstrap_intervals",
    f"WITH {PAIR_SQL}, {boot_sql(2000, 78)} SELECT anchor, {CI_SQL} FROM bt GROUP BY anchor",
    ["predictions"],
    CI_COLS,
)
def i3(spark, sf_dir):
    """Percentile intervals out of two thousand replicates."""
    boot = ic.bootstrap_replicates(pairs_of(spark, sf_dir), ["anchor"], "grp", "y_true", 2000, 78)
    return ic.intervals(boot, ["anchor"], ic.DELTAS)


PPAIR_SQL = f"""{PROB_AVG_SQL}, sides AS (SELECT feature_set AS side, grp, y_true, p FROM pc)"""
PBOOT_SQL = """gi AS (SELECT grp, row_number() OVER (ORDER BY md5(grp::VARCHAR), grp) - 1 AS idx,
    count(*) OVER () AS g FROM (SELECT DISTINCT grp FROM sides)),
  wt AS (SELECT replicate, gi.grp, w FROM (SELECT b AS replicate, ('0x' || substr(md5('79|' || b || '|' || idx), 1, 8))::BIGINT % g
    AS pick, count(*) AS w FROM gi, range(1, 3001) t(b) GROUP BY ALL) JOIN gi ON pick = idx),
  ls AS (SELECT side, grp, avg((y_true - p) ** 2) AS br, avg(-(y_true * ln(p) + (1 - y_true) * ln(1 - p))) AS ll
    FROM sides GROUP BY ALL),
  bl AS (SELECT side, replicate, sum(w * br) / sum(w) AS brier_pb, sum(w * ll) / sum(w) AS logloss_pb
    FROM ls JOIN wt USING (grp) GROUP BY ALL),
  ct AS (SELECT side, replicate, p, sum(w * y_true)::DOUBLE AS pos, sum(w * (1 - y_true))::DOUBLE AS neg
    FROM sides JOIN wt USING (grp) GROUP BY ALL),
  rk AS (SELECT side, replicate, sum(pos * tp / (tp + fp)) / sum(pos) AS pr_auc,
    sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS roc_auc FROM (SELECT *, sum(pos) OVER w AS tp,
    sum(neg) OVER w AS fp FROM ct WINDOW w AS (PARTITION BY side, replicate ORDER BY p DESC)) GROUP BY ALL),
  bt AS (SELECT replicate, max(pr_auc) FILTER (WHERE side = 'comb') - max(pr_auc) FILTER (WHERE side = 'base') AS delta_pr_auc,
    max(roc_auc) FILTER (WHERE side = 'comb') - max(roc_auc) FILTER (WHERE side = 'base') AS delta_roc_auc,
    max(brier_pb) FILTER (WHERE side = 'base') - max(brier_pb) FILTER (WHERE side = 'comb') AS delta_brier_pb,
    max(logloss_pb) FILTER (WHERE side = 'base') - max(logloss_pb) FILTER (WHERE side = 'comb') AS delta_logloss_pb
    FROM bl JOIN rk USING (side, replicate) GROUP BY replicate)"""


def prob_pairs(spark, sf_dir):
    return jn.paired_sides(
        averaged_prob(spark, sf_dir), ["row_id"], "feature_set", "base", "comb", "y_prob_avg",
        ["grp", "task", "y_true"],
    )


@query(
    "i2_probability_bootstrap",
    f"WITH {PPAIR_SQL}, {PBOOT_SQL} SELECT * FROM bt",
    ["prob_predictions"],
    list(ic.RANK_DELTAS),
)
def i2_prob(spark, sf_dir):
    """Deltas of average precision, AUC, Brier score and log loss per replicate."""
    pairs = prob_pairs(spark, sf_dir).withColumn("model", F.lit("m"))
    return ic.probability_bootstrap(pairs, ["model"], "grp", "y_true", 3000, 79).drop("model")


@query(
    "i1_probability_deltas",
    f"""WITH {PPAIR_SQL}, sa AS (SELECT *, side AS feature_set FROM sides),
    a AS ({prob_sql("sa", "side")}), b AS ({rank_sql("sa", "side")}), m AS (SELECT * FROM a JOIN b USING (side))
    SELECT c.pr_auc - b.pr_auc AS delta_pr_auc, c.roc_auc - b.roc_auc AS delta_roc_auc,
      b.brier_pb - c.brier_pb AS delta_brier_pb, b.logloss_pb - c.logloss_pb AS delta_logloss_pb
    FROM m b JOIN m c ON b.side = 'base' AND c.side = 'comb'""",
    ["prob_predictions"],
    list(ic.RANK_DELTAS),
)
def i1_prob(spark, sf_dir):
    """Observed improvements on a binary outcome."""
    pairs = prob_pairs(spark, sf_dir).withColumn("model", F.lit("m"))
    return ic.probability_increment(pairs, ["model"], "grp", "y_true").drop("model")


FOLD_SQL = f"""fm AS ({reg_sql("predictions", "anchor, feature_set, repeat, outer_fold")}),
  fd AS (SELECT b.anchor, b.repeat, b.outer_fold, b.mae_pb - c.mae_pb AS mae_pb, c.r2_rep - b.r2_rep AS r2_rep
    FROM fm b JOIN fm c USING (anchor, repeat, outer_fold) WHERE b.feature_set = 'base' AND c.feature_set = 'comb'),
  fi AS (SELECT anchor, count(*) AS n_folds, avg(mae_pb) AS fold_delta_mae_pb_mean,
    stddev_samp(mae_pb) AS fold_delta_mae_pb_sd, avg((mae_pb > 0)::INT::DOUBLE) AS fold_delta_mae_pb_positive_fraction,
    avg(r2_rep) AS fold_delta_r2_rep_mean, stddev_samp(r2_rep) AS fold_delta_r2_rep_sd,
    avg((r2_rep > 0)::INT::DOUBLE) AS fold_delta_r2_rep_positive_fraction FROM fd GROUP BY anchor)"""
FOLD_COLS = [
    f"fold_delta_{m}_{s}" for m in ("mae_pb", "r2_rep") for s in ("mean", "sd", "positive_fraction")
]


def fold_increments(spark, sf_dir):
    return ic.fold_increments(
        m5(spark, sf_dir), ["anchor"], "feature_set", "base", "comb", ["mae_pb"], ["r2_rep"]
    )


@query("i4_fold_increments", f"WITH {FOLD_SQL} SELECT * FROM fi", ["predictions"], FOLD_COLS)
def i4(spark, sf_dir):
    """Mean, spread and positive share of fold-level deltas."""
    return fold_increments(spark, sf_dir)


INC_SQL = f"""{PAIR_SQL}, {boot_sql(2500, 80)}, ci AS (SELECT anchor, {CI_SQL} FROM bt GROUP BY anchor),
  ob AS (SELECT anchor, {DELTA_SQL} FROM gs GROUP BY anchor), inc AS (SELECT * FROM ob JOIN ci USING (anchor))"""


def increments(spark, sf_dir):
    return ic.regression_increment_table(
        pairs_of(spark, sf_dir), ["anchor"], "grp", "y_true", 2500, 80
    )


@query(
    "i5_increment_table",
    f"WITH {INC_SQL}, {FOLD_SQL} SELECT * FROM inc JOIN fi USING (anchor)",
    ["predictions"],
    [*DELTAS, *CI_COLS, *FOLD_COLS],
)
def i5(spark, sf_dir):
    """Observed deltas, intervals and fold descriptives per anchor."""
    return increments(spark, sf_dir).join(fold_increments(spark, sf_dir), "anchor")


def _robust_sql(d: str) -> str:
    return f"""s.{d} AS start_{d}, e.{d} AS end_{d}, sign(s.{d}) = sign(e.{d}) AS {d}_same_direction,
      s.{d} > 0 AND e.{d} > 0 AS {d}_both_positive, s.{d} < 0 AND e.{d} < 0 AS {d}_both_negative,
      s.{d}_ci_low > 0 AS start_{d}_above_zero, s.{d}_ci_high < 0 AS start_{d}_below_zero,
      e.{d}_ci_low > 0 AS end_{d}_above_zero, e.{d}_ci_high < 0 AS end_{d}_below_zero"""


@query(
    "i6_alignment_robustness",
    f"""WITH {INC_SQL} SELECT 'linear' AS model, {", ".join(_robust_sql(d) for d in ("delta_mae_pb", "delta_r2_rep"))}
    FROM inc s JOIN inc e ON s.anchor = 'START' AND e.anchor = 'END'""",
    ["predictions"],
    ["start_delta_mae_pb", "end_delta_mae_pb", "start_delta_r2_rep", "end_delta_r2_rep"],
)
def i6(spark, sf_dir):
    """Agreement of the increment between the two anchors."""
    inc = increments(spark, sf_dir).withColumn("model", F.lit("linear"))
    return ic.alignment_robustness(inc, ["model"], ["delta_mae_pb", "delta_r2_rep"])
