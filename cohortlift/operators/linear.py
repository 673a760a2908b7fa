"""Closed-form linear models out of per-fold sufficient statistics.

A training set is everything outside a fold, so its sums are the total minus the fold's own
sums. Rows are read once however many folds and repeats there are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlift.operators.embeddings import doubles, sum_vector


def _times(c: Column):
    return lambda v: v * c


def _plus_times(c: Column):
    return lambda a, b: a + c * b


def training_sums(stats: DataFrame, by: Sequence[str], fold: str, sums: Sequence[str]) -> DataFrame:
    """Sums over all other folds, for every fold. ``stats``: by, fold, sums (one row per fold)."""
    by = list(by)
    total = stats.groupBy(*by).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    joined = stats.join(total, by)
    return joined.select(*by, fold, *[(F.col(f"_t_{s}") - F.col(s)).alias(s) for s in sums])


def leave_fold_out_line(
    df: DataFrame, by: Sequence[str], fold: str, x: str, y: str
) -> DataFrame:
    """Mean of y and of x, and the slope of y on x, over the rows outside each fold.

    Moments are taken around each fold's own means and put together around a common middle, so a
    small spread far from zero keeps its slope; it is 0 only where all training values of x are
    equal. Output: by, fold, mean_y, mean_x, slope.
    """
    by = list(by)
    a, b = F.col(x), F.col(y)
    n = F.col("_n")
    stats = df.groupBy(*by, fold).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.avg(a).alias("_mx"), F.avg(b).alias("_my"),
        F.var_pop(a).alias("_vx"), F.covar_pop(a, b).alias("_cxy"),
        F.struct(F.min(a).alias("lo"), F.max(a).alias("hi")).alias("_ends"),
    )
    all_folds = W.partitionBy(*by)  # a row per fold
    for c in ("_mx", "_my"):
        middle = F.sum(n * F.col(c)).over(all_folds) / F.sum(n).over(all_folds)
        stats = stats.withColumn(f"{c}0", middle).withColumn(c, F.col(c) - F.col(f"{c}0"))
    sums = {
        "_sn": n, "_sx": n * F.col("_mx"), "_sy": n * F.col("_my"),
        "_sxx": n * (F.col("_vx") + F.col("_mx") * F.col("_mx")),
        "_sxy": n * (F.col("_cxy") + F.col("_mx") * F.col("_my")),
    }
    # the total without the fold's own part
    t = stats.select(
        *by, fold, "_mx0", "_my0",
        *[(F.sum(s).over(all_folds) - s).alias(k) for k, s in sums.items()],
        F.filter(
            F.collect_list(F.struct(F.col(fold).alias("fold"), F.col("_ends"))).over(all_folds),
            lambda e: ~e["fold"].eqNullSafe(F.col(fold)),
        ).alias("_others"),
    )
    lo = F.array_min(F.transform("_others", lambda e: e["_ends"]["lo"]))
    hi = F.array_max(F.transform("_others", lambda e: e["_ends"]["hi"]))
    # a cell that one fold holds alone has no training rows: its line is missing
    m = F.when(F.size("_others") > 0, F.col("_sn"))
    mx, my = F.col("_sx") / m, F.col("_sy") / m
    sxx, sxy = F.col("_sxx") - m * mx * mx, F.col("_sxy") - m * mx * my
    return t.select(
        *by, fold,
        (F.col("_my0") + my).alias("mean_y"),
        (F.col("_mx0") + mx).alias("mean_x"),
        F.when(hi > lo, sxy / sxx).otherwise(F.lit(0.0)).alias("slope"),
    )


def ridge_coefficients(
    df: DataFrame, fold: str, context: Sequence[str], vector: str, alpha: float, by: Sequence[str] = ()
) -> DataFrame:
    """Ridge of every vector dimension on the standardised context, per held-out fold.

    One pass gives n, sum x, sum x x' and, per context column, the vector sum of x * e. What is
    solved per fold is as small as the context is wide; all dimensions share it. Output: by, fold,
    intercept (vector) and coef (one vector per context column, on the raw scale).
    """
    p = len(context)
    cols = [F.col(c).cast("double") for c in context]
    e = doubles(vector)
    gram = [
        F.sum(cols[i] * cols[j]).alias(f"xx_{i}_{j}") for i in range(p) for j in range(i, p)
    ]
    cross = [
        sum_vector(F.transform(e, _times(c))).alias(f"xe_{i}") for i, c in enumerate(cols)
    ]
    by = list(by)
    stats = df.groupBy(*by, fold).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(c).alias(f"x_{i}") for i, c in enumerate(cols)],
        *gram,
        sum_vector(e).alias("e"),
        *cross,
    )
    names = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in [*by, fold])
    schema = f"{names}, intercept array<double>, coef array<array<double>>"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        def vec(c):
            return np.array(pdf[c].tolist())

        def held_out(total, own):
            return total.sum(axis=0) - own

        out = []
        for r in range(len(pdf)):
            n = held_out(vec("n"), vec("n")[r])
            mean = np.array([held_out(vec(f"x_{i}"), vec(f"x_{i}")[r]) for i in range(p)]) / n
            xx = np.zeros((p, p))
            for i in range(p):
                for j in range(i, p):
                    s = vec(f"xx_{i}_{j}")
                    xx[i, j] = xx[j, i] = held_out(s, s[r]) - n * mean[i] * mean[j]
            me = held_out(vec("e"), vec("e")[r]) / n
            xe = np.array([held_out(vec(f"xe_{i}"), vec(f"xe_{i}")[r]) for i in range(p)])
            xe = xe - n * np.outer(mean, me)
            sd = np.sqrt(np.maximum(np.diag(xx) / n, 0.0))
            sd = np.where(sd > 0, sd, 1.0)
            z = np.linalg.solve(xx / np.outer(sd, sd) + alpha * np.eye(p), xe / sd[:, None])
            coef = z / sd[:, None]
            own = [pdf[c].iloc[r] for c in [*by, fold]]
            out.append((*own, me - mean @ coef, [c.tolist() for c in coef]))
        return pd.DataFrame(out, columns=[*by, fold, "intercept", "coef"])

    # one row per fold, so a group is as small as the split
    return stats.withColumn("_one", F.lit(0)).groupBy("_one", *by).applyInPandas(solve, schema)


def residual_vectors(
    df: DataFrame, coefficients: DataFrame, fold: str, context: Sequence[str], vector: str, by: Sequence[str] = ()
) -> DataFrame:
    """Vector minus its context prediction under the coefficients of the row's held-out fold."""
    # one row per fold
    joined = df.join(F.broadcast(coefficients), [*by, fold])
    pred = F.col("intercept")
    for i, c in enumerate(context):
        x = F.col(c).cast("double")
        pred = F.zip_with(pred, F.col("coef")[i], _plus_times(x))
    out = joined.withColumn("predicted", pred)
    return out.withColumn(
        "residual", F.zip_with(doubles(vector), "predicted", lambda a, b: a - b)
    ).drop("intercept", "coef")


def residual_diagnostics(
    df: DataFrame, by: Sequence[str], vector: str = "embedding"
) -> DataFrame:
    """Context-explained R2 (pooled over rows and dimensions) and residual energy ratio."""
    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda s, v: s + v)

    def squares(c):
        return F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)

    e = doubles(vector)
    sums = df.groupBy(*by).agg(
        F.sum(F.size(e)).cast("double").alias("_n"),
        F.sum(total(e)).alias("_s"),
        F.sum(squares(e)).alias("_q"),
        F.sum(squares(F.col("residual"))).alias("_r"),
    )
    n = F.col("_n")
    var = F.col("_q") / n - (F.col("_s") / n) * (F.col("_s") / n)
    return sums.select(
        *by,
        F.when(var > 0, 1 - F.col("_r") / n / var).alias("context_explained_r2"),
        (F.col("_r") / F.nullif(F.col("_q"), F.lit(0.0))).alias("residual_energy_ratio"),
    )


__all__ = [
    "leave_fold_out_line", "residual_diagnostics", "residual_vectors", "ridge_coefficients",
    "training_sums",
]
