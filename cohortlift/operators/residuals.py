"""Outcome residualisation: what sensors explain beyond a cross-fitted context prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.operators.linear import training_sums
from cohortlift.sources.tables import staged


def outer_training_rows(df: DataFrame, fold: str, n_folds: int) -> DataFrame:
    """Each row under every outer fold it trains for (``outer_fold``)."""
    others = F.filter(F.sequence(F.lit(1), F.lit(n_folds)), lambda f: f != F.col(fold))
    return df.withColumn("outer_fold", F.explode(others))


def cross_fitted_context(
    train: DataFrame, by: Sequence[str], inner_fold: str, y: str
) -> DataFrame:
    """Context prediction of each training row from the rows outside its own inner fold.

    ``by`` names the training set and the context cell; the prediction is the cell's mean.
    """
    by = list(by)
    stats = train.groupBy(*by, inner_fold).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum(y).alias("_y")
    )
    means = training_sums(stats, by, inner_fold, ["_n", "_y"])
    means = means.select(
        *by, inner_fold, (F.col("_y") / F.nullif(F.col("_n"), F.lit(0.0))).alias("context_pred")
    )
    return train.join(staged(means, "context-means"), [*by, inner_fold])


def residual_target(df: DataFrame, y: str, context_pred: str = "context_pred") -> DataFrame:
    return df.withColumn("residual", F.col(y) - F.col(context_pred))


def residual_corrector(train: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Per training set and cell: mean of y (context model) and the line of the residual on x."""
    r, a = F.col("residual"), F.col(x)
    return train.groupBy(*by).agg(
        F.avg(y).alias("context_mean"),
        F.avg(r).alias("residual_mean"),
        F.avg(a).alias("x_mean"),
        F.when(F.max(a) > F.min(a), F.covar_pop(a, r) / F.var_pop(a)).otherwise(F.lit(0.0)).alias("residual_slope"),
    )


def corrected_predictions(
    test: DataFrame, corrector: DataFrame, by: Sequence[str], x: str
) -> DataFrame:
    """Context prediction of held-out rows plus the predicted residual."""
    out = test.join(corrector, list(by))
    shift = F.col("residual_mean") + F.col("residual_slope") * (F.col(x) - F.col("x_mean"))
    return out.withColumn("pred_base", F.col("context_mean")).withColumn(
        "pred_comb", F.col("context_mean") + shift
    ).drop("context_mean", "residual_mean", "x_mean", "residual_slope")
