"""Contract checks as data: every guard is a lazy table, ``enforce`` turns one into a failure."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlift.functions.cleaning import is_finite


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Schema check, on the driver and before any job."""
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise ValueError(f"missing columns: {absent}")
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("duplicate column names")


def contract(df: DataFrame, key: Sequence[str], not_null: Sequence[str]) -> DataFrame:
    """One row: rows, repeated keys, and NULLs in columns that must be filled."""
    require_columns(df, [*key, *not_null])
    per_key = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in not_null]
    )
    nulls = [F.sum(f"_{c}").alias(f"null_{c}") for c in not_null]
    out = per_key.agg(F.sum("_n").alias("n_rows"), F.count_if(F.col("_n") > 1).alias("repeated_keys"), *nulls)
    fine = F.col("repeated_keys") == 0
    for c in not_null:
        fine = fine & (F.col(f"null_{c}") == 0)
    return out.withColumn("ok", fine)


def enforce(check: DataFrame, message: str, flag: str = "ok") -> DataFrame:
    """The check table itself, failing the job that reads a row whose flag is not true."""
    failing = F.when(~F.coalesce(F.col(flag), F.lit(False)), F.raise_error(F.lit(message)))
    return check.withColumn(flag, F.coalesce(failing.cast("boolean"), F.col(flag)))


def pairing(
    start: DataFrame, end: DataFrame, key: str, same: Sequence[str], atol: float = 1e-8
) -> DataFrame:
    """Whether two anchors describe the same rows: ids on one side only, and unequal columns."""
    left = start.select(key, *[F.col(c).alias(f"_s_{c}") for c in same], F.lit(True).alias("_ls"))
    right = end.select(key, *[F.col(c).alias(f"_e_{c}") for c in same], F.lit(True).alias("_rs"))
    both = left.join(right, key, "full_outer")
    met = F.col("_ls") & F.col("_rs")
    types = dict(start.dtypes)

    def unequal(c: str) -> Column:
        a, b = F.col(f"_s_{c}"), F.col(f"_e_{c}")
        if types[c] in ("double", "float"):
            agree = (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= atol, F.lit(False))
        else:
            agree = a.eqNullSafe(b)
        return F.count_if(met & ~agree).alias(f"unequal_{c}")

    out = both.agg(
        F.count_if(met).alias("n_paired"),
        F.count_if(F.col("_rs").isNull()).alias("start_only"),
        F.count_if(F.col("_ls").isNull()).alias("end_only"),
        *[unequal(c) for c in same],
    )
    fine = (F.col("start_only") == 0) & (F.col("end_only") == 0)
    for c in same:
        fine = fine & (F.col(f"unequal_{c}") == 0)
    return out.withColumn("ok", fine)


def cohort_lock(df: DataFrame, group: str, expected: dict[str, int]) -> DataFrame:
    """Rows, participants and column counts against their locked values, one row per check."""
    found = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(group).alias("participants"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
    )
    long = found.unpivot([], list(expected), "check", "found")
    want = F.element_at(
        F.create_map(*[F.lit(x) for kv in expected.items() for x in kv]), F.col("check")
    ).cast("bigint")
    return long.withColumn("expected", want).withColumn("ok", F.col("found") == F.col("expected"))


def finite_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing or non-finite cells per column."""
    out = df.groupBy(*by).agg(*[F.count_if(~is_finite(c)).alias(f"bad_{c}") for c in columns])
    fine = reduce(lambda a, b: a & b, [F.col(f"bad_{c}") == 0 for c in columns])
    return out.withColumn("ok", fine)


def decision(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """PASS when every named check holds. ``checks``: check, ok."""
    return checks.groupBy(*by).agg(
        F.when(F.bool_and(F.coalesce(F.col("ok"), F.lit(False))), F.lit("PASS"))
        .otherwise(F.lit("FAIL"))
        .alias("decision"),
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if(~F.coalesce(F.col("ok"), F.lit(False))).alias("n_failed"),
    )
