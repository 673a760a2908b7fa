"""Reproducibility audits: stored runs against fresh ones, and logs of many fits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reproduction(
    stored: DataFrame, fresh: DataFrame, task: Sequence[str], row_id: str, value: str, tolerance: float
) -> DataFrame:
    """Per task: rows in both runs, rows in one only, largest difference, and PASS within tolerance.

    The runs are stacked and grouped once by task and row.
    """
    task = list(task)
    both = stored.select(*task, row_id, F.col(value).alias("_a"), F.lit(None).cast("double").alias("_b"))
    both = both.unionAll(
        fresh.select(*task, row_id, F.lit(None).cast("double").alias("_a"), F.col(value).alias("_b"))
    )
    per = both.groupBy(*task, row_id).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    gap = F.abs(F.col("_a") - F.col("_b"))
    out = per.groupBy(*task).agg(
        F.count(gap).alias("n_compared"),
        F.count_if(gap.isNull()).alias("n_unmatched"),
        F.max(gap).alias("max_abs_diff"),
    )
    fine = (F.col("n_unmatched") == 0) & (F.coalesce("max_abs_diff", F.lit(0.0)) <= tolerance)
    return out.withColumn("passes", fine)


def selection_match(
    stored: DataFrame, fresh: DataFrame, task: Sequence[str], params: str, score: str, tolerance: float
) -> DataFrame:
    """Whether the same parameters were selected, and how far the inner scores lie apart."""
    a = stored.select(*task, F.col(params).alias("stored_params"), F.col(score).alias("_a"))
    b = fresh.select(*task, F.col(params).alias("fresh_params"), F.col(score).alias("_b"))
    gap = F.abs(F.col("_a") - F.col("_b"))
    return a.join(b, list(task), "full_outer").select(
        *task,
        "stored_params",
        "fresh_params",
        F.col("stored_params").eqNullSafe(F.col("fresh_params")).alias("params_match"),
        gap.alias("inner_score_diff"),
        F.coalesce(gap <= tolerance, F.lit(False)).alias("score_match"),
    )


def fit_rollup(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fits, those that did not converge, those at the iteration ceiling, and the longest.

    ``log``: converged, n_iter, max_iter.
    """
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_fits"),
        F.count_if(~F.col("converged")).alias("n_not_converged"),
        F.count_if(F.col("n_iter") >= F.col("max_iter")).alias("n_hit_max_iter"),
        F.max("n_iter").alias("max_n_iter"),
    )


def convergence_gates(log: DataFrame, by: Sequence[str], selected: str) -> DataFrame:
    """Verdict over the selected path alone and over the full grid."""
    good = F.col("converged") & (F.col("n_iter") < F.col("max_iter"))

    def verdict(c):
        return F.when(F.coalesce(c, F.lit(True)), F.lit("PASS")).otherwise(F.lit("FAIL"))

    return log.groupBy(*by).agg(
        verdict(F.bool_and(F.when(F.col(selected), good))).alias("selected_path"),
        verdict(F.bool_and(good)).alias("full_grid"),
        F.count_if(selected).alias("n_selected_fits"),
        F.count(F.lit(1)).alias("n_fits"),
    )


def merge_recovery(log: DataFrame, rerun: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Converged fits as they were, failed ones replaced by their rerun (missing if there is none)."""
    keys = list(keys)
    failed = ~F.col("converged") | (F.col("n_iter") >= F.col("max_iter"))
    kept = log.where(~failed).withColumn("source", F.lit("kept"))
    again = log.where(failed).select(*keys).join(rerun, keys, "left")
    return kept.unionByName(
        again.withColumn("source", F.lit("rerun")).select(*log.columns, "source")
    )


def recovery_against_selected(
    merged: DataFrame, selected: DataFrame, task: Sequence[str], folds: int
) -> DataFrame:
    """Recovered candidate means beside the selected scores, and which of them would now win.

    ``selected``: task, selected_score.
    """
    task = list(task)
    per = merged.groupBy(*task).agg(
        F.avg("score").alias("recovered_score"),
        F.count("score").alias("n_inner_folds"),
        F.count_if(F.col("source") == "rerun").alias("n_reruns"),
        F.count_if(~F.col("converged")).alias("n_not_converged"),
        F.max("n_iter").alias("max_n_iter"),
    )
    margin = F.col("recovered_score") - F.col("selected_score")
    return (
        per.join(selected.select(*task, "selected_score"), task)
        .withColumn("margin", margin)
        .withColumn("beats_selected", margin < -1e-12)
        .withColumn("complete", F.col("n_inner_folds") == folds)
    )


def structure(df: DataFrame, by: Sequence[str], expected: Mapping[str, tuple]) -> DataFrame:
    """Counts per ``by`` against expected values. ``expected``: name -> (distinct columns, value).

    An empty tuple of columns counts rows.
    """
    by = list(by)
    found = df.groupBy(*by).agg(
        *[
            (F.count_distinct(*cols) if cols else F.count(F.lit(1))).alias(name)
            for name, (cols, _) in expected.items()
        ]
    )
    long = found.unpivot(by, list(expected), "check", "found")
    pairs = [F.lit(x) for name, (_, value) in expected.items() for x in (name, value)]
    want = F.element_at(F.create_map(*pairs), F.col("check")).cast("bigint")
    return long.withColumn("expected", want).withColumn("ok", F.col("found") == F.col("expected"))


def completeness(df: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """Rows, repeated keys, and whether the table holds each expected key exactly once."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = per.agg(
        F.sum("_n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("_n") > 1).alias("n_repeated"),
    )
    fine = (F.col("n_keys") == expected) & (F.col("n_repeated") == 0)
    return out.withColumn("expected", F.lit(expected).cast("bigint")).withColumn("complete", fine)
