"""Participant-balanced metrics as two-level aggregations over sufficient statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlift.functions.cleaning import clip_probability, finite_or_fail
from cohortlift.operators.ordered import running_sums, value_bucket


def error_statistics(
    df: DataFrame, by: Sequence[str], group: str, y: str, preds: dict[str, str]
) -> DataFrame:
    """Per group: n, mean and sum of squares of y, absolute and squared error sums per prediction.

    ``preds`` maps a suffix to a prediction column. This is all any regression metric, scope or
    bootstrap needs; the rows are read once. A missing or non-finite outcome or prediction fails
    the job: left out, it would lower the error.
    """
    sums = [
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(y).alias("sy"),
        F.avg(y).alias("my"),
        F.var_pop(y).alias("vy"),
        F.min(y).alias("ylo"),
        F.max(y).alias("yhi"),
    ]
    for suffix, p in preds.items():
        e = finite_or_fail(y, "an outcome") - finite_or_fail(p, "a prediction")
        sums += [F.sum(F.abs(e)).alias(f"ae{suffix}"), F.sum(e * e).alias(f"se{suffix}")]
    return df.groupBy(*by, group).agg(*sums)


def total_squares() -> Column:
    """Sum of squared deviations of y over all groups, out of the groups' moments."""
    n, m = F.col("n"), F.col("my")
    grand = F.sum(n * m) / F.sum(n)
    return F.sum(n * F.col("vy")) + F.sum(n * m * m) - F.sum(n) * grand * grand


def regression_from_statistics(stats: DataFrame, by: Sequence[str], suffix: str = "") -> DataFrame:
    """Balanced and pooled errors; R2 is missing when y does not vary."""
    n, ae, se = F.col("n"), F.col(f"ae{suffix}"), F.col(f"se{suffix}")
    spread = total_squares()
    return stats.groupBy(*by).agg(
        F.sum("n").cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).alias("n_groups"),
        F.avg(ae / n).alias("mae_pb"),
        F.sqrt(F.avg(se / n)).alias("rmse_pb"),
        (F.sum(ae) / F.sum(n)).alias("mae_rep"),
        F.sqrt(F.sum(se) / F.sum(n)).alias("rmse_rep"),
        F.when(F.max("yhi") > F.min("ylo"), 1 - F.sum(se) / spread).alias("r2_rep"),
    )


def regression_metrics(
    df: DataFrame, by: Sequence[str], group: str, y: str, pred: str
) -> DataFrame:
    return regression_from_statistics(error_statistics(df, by, group, y, {"": pred}), by)


def probability_statistics(
    df: DataFrame, by: Sequence[str], group: str, y: str, prob: str
) -> DataFrame:
    """Per group: rows, positives, Brier and log-loss sums; missing values fail the job."""
    p, t = clip_probability(finite_or_fail(prob, "a probability")), finite_or_fail(y, "an outcome")
    return df.groupBy(*by, group).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(t).alias("pos"),
        F.sum((t - p) * (t - p)).alias("brier"),
        F.sum(-(t * F.log(p) + (1 - t) * F.log(1 - p))).alias("logloss"),
    )


def probability_from_statistics(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    n = F.col("n")
    return stats.groupBy(*by).agg(
        F.sum("n").cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("pos").cast("bigint").alias("n_events"),
        F.avg(F.col("brier") / n).alias("brier_pb"),
        F.avg(F.col("logloss") / n).alias("logloss_pb"),
        (F.sum("brier") / F.sum("n")).alias("brier_rep"),
        (F.sum("logloss") / F.sum("n")).alias("logloss_rep"),
    )


def probability_metrics(
    df: DataFrame, by: Sequence[str], group: str, y: str, prob: str
) -> DataFrame:
    return probability_from_statistics(probability_statistics(df, by, group, y, prob), by)


def score_counts(df: DataFrame, by: Sequence[str], y: str, prob: str) -> DataFrame:
    """Positives and negatives per distinct clipped score (ties fold before any ordering)."""
    t = finite_or_fail(F.col(y).cast("double"), "an outcome")
    score = clip_probability(finite_or_fail(prob, "a probability")).alias("score")
    return df.groupBy(*by, score).agg(
        F.sum(t).alias("pos"), F.sum(1 - t).alias("neg")
    )


def cumulative_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """True and false positives by falling score. Prefix sums run inside score chunks and are
    carried across, so one task never orders all scores."""
    falling = counts.withColumn("_f", -F.col("score"))
    out = running_sums(
        falling, by, ["_f"], value_bucket(F.col("_f"), 1 << 14), {"tp": "pos", "fp": "neg"}
    )
    return out.drop("_f")


def ranking_from_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Average precision (tie groups collapsed) and ROC-AUC (ties count half).

    Both are missing when a class is absent.
    """
    by = list(by)
    scoped = counts if by else counts.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    c = cumulative_counts(scoped, keys)
    pos, neg = F.col("pos"), F.col("neg")
    sums = c.groupBy(*keys).agg(
        F.sum(pos).alias("_p"),
        F.sum(neg).alias("_n"),
        F.sum(pos * F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0.0))).alias("_ap"),
        F.sum(neg * (F.col("tp") - pos / 2)).alias("_auc"),
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return sums.select(
        *by,
        F.when(both, F.col("_ap") / F.col("_p")).alias("pr_auc"),
        F.when(both, F.col("_auc") / (F.col("_p") * F.col("_n"))).alias("roc_auc"),
    )


def ranking_metrics(df: DataFrame, by: Sequence[str], y: str, prob: str) -> DataFrame:
    return ranking_from_counts(score_counts(df, by, y, prob), by)


def scoped(stats: DataFrame, task: str) -> DataFrame:
    """Each reduced row under scope 'All' and under its own task."""
    scope = F.explode(F.array(F.lit("All"), F.col(task).cast("string")))
    return stats.withColumn("scope", scope)


def regression_summary(
    df: DataFrame, by: Sequence[str], task: str, group: str, y: str, pred: str
) -> DataFrame:
    """Metrics over all rows and per task.

    Rows are reduced to (by, task, group) once; the scope is spread over those few rows and the
    task rows of a group are folded together for 'All'.
    """
    by = list(by)
    per_task = scoped(error_statistics(df, [*by, task], group, y, {"": pred}), task)
    n, m = F.col("n"), F.col("my")
    total = F.sum("n")
    mean = F.sum(n * m) / total
    merged = per_task.groupBy(*by, "scope", group).agg(
        total.alias("n"),
        mean.alias("my"),
        (F.sum(n * (F.col("vy") + m * m)) / total - mean * mean).alias("vy"),
        F.min("ylo").alias("ylo"),
        F.max("yhi").alias("yhi"),
        F.sum("ae").alias("ae"),
        F.sum("se").alias("se"),
    )
    return regression_from_statistics(merged, [*by, "scope"])


def probability_summary(
    df: DataFrame, by: Sequence[str], task: str, group: str, y: str, prob: str
) -> DataFrame:
    by = list(by)
    per_task = scoped(probability_statistics(df, [*by, task], group, y, prob), task)
    merged = per_task.groupBy(*by, "scope", group).agg(
        *[F.sum(c).alias(c) for c in ("n", "pos", "brier", "logloss")]
    )
    counts = scoped(score_counts(df, [*by, task], y, prob), task)
    counts = counts.groupBy(*by, "scope", "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    left = probability_from_statistics(merged, [*by, "scope"])
    return left.join(ranking_from_counts(counts, [*by, "scope"]), [*by, "scope"])


def average_predictions(
    df: DataFrame, keys: Sequence[str], pred: str, carry: Sequence[str], repeats: int
) -> DataFrame:
    """Mean, sample sd and count of a row's repeated out-of-fold predictions.

    A row without exactly ``repeats`` predictions fails the job.
    """
    out = df.groupBy(*keys).agg(
        F.avg(pred).alias("y_pred_avg"),
        F.stddev_samp(pred).alias("y_pred_sd"),
        F.count(pred).alias("n_oof_predictions"),
        *[F.any_value(c).alias(c) for c in carry],
    )
    n = F.col("n_oof_predictions")
    wrong = F.raise_error(F.lit(f"a row lacks its {repeats} out-of-fold predictions"))
    return out.withColumn("n_oof_predictions", F.when(n == repeats, n).otherwise(wrong))
