"""Joins with their cardinality stated and enforced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlift.functions.cleaning import near


def unique_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same table; a repeated key fails the job that meets it.

    The grouping uses the key the following join needs, so it adds no shuffle of its own.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest)).alias("_row")
    )
    twice = F.raise_error(F.concat_ws(" ", F.lit("key repeated:"), *keys))
    row = F.when(F.col("_n") == 1, F.col("_row")).otherwise(twice)
    return one.withColumn("_row", row).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def spread_side(df: DataFrame) -> DataFrame:
    """A side multiplied by explode: never broadcast, its size estimate is that of its source.

    Sort-merge keeps the runtime skew splitting and spills.
    """
    return df.hint("merge")


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """The rows of a stored table by ``keys``, in tasks of about ``rows`` rows at every size of the table.

    What then multiplies, groups or joins the rows by these keys, or by these and more, needs no
    other shuffle, and a task's memory does not follow the file's splits or a fixed number of
    shuffle partitions. For keys of which none holds many rows. Files answer the count by
    themselves.
    """
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def one_to_one_left(
    left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str]
) -> DataFrame:
    """Left join of two tables keyed alike; shared names get the suffixes."""
    keys = list(keys)
    shared = (set(left.columns) & set(right.columns)) - set(keys)

    def renamed(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(*[F.col(c).alias(c + suffix if c in shared else c) for c in df.columns])

    a = renamed(unique_rows(left, keys), suffixes[0])
    return a.join(renamed(unique_rows(right, keys), suffixes[1]), keys, "left")


def many_to_one_left(left: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dimension lookup. No broadcast hint: the planner decides from the measured size."""
    return left.join(unique_rows(dimension, keys), list(keys), "left")


def paired_sides(
    predictions: DataFrame,
    keys: Sequence[str],
    side: str,
    base: str,
    combined: str,
    value: str,
    carry: Sequence[str],
) -> DataFrame:
    """Baseline and combined prediction of the same row side by side, in one pass.

    Conditional aggregation on the row key takes the place of a self-join; rows that lack a
    side are left out, as an inner join would. Two predictions of one side fail the job.
    """
    two = predictions.where(F.col(side).isin(base, combined))
    wide = two.groupBy(*keys).agg(
        _only(side, base, value).alias("pred_base"),
        _only(side, combined, value).alias("pred_comb"),
        *[F.any_value(c).alias(c) for c in carry],
    )
    return wide.where("pred_base IS NOT NULL AND pred_comb IS NOT NULL")


def _only(side: str, name: str, value: str) -> Column:
    """The one value of a side within a group, or an error if it has several."""
    mine = F.col(side) == name
    twice = F.raise_error(F.lit(f"key repeated: two predictions of side {name}"))
    return F.when(F.count_if(mine) <= 1, F.max(F.when(mine, F.col(value)))).otherwise(twice)


def paired_averages(
    predictions: DataFrame,
    keys: Sequence[str],
    side: str,
    base: str,
    combined: str,
    value: str,
    carry: Sequence[str],
    repeats: int,
) -> DataFrame:
    """Repeated predictions averaged and both sides paired in one grouping of the rows.

    A side that is there at all must hold exactly ``repeats`` predictions, or the job fails.
    """
    def average(name: str) -> Column:
        mine = F.when(F.col(side) == name, F.col(value))
        n = F.count(mine)
        wrong = F.raise_error(F.lit(f"a row lacks its {repeats} out-of-fold predictions"))
        return F.when((n == repeats) | (n == 0), F.avg(mine)).otherwise(wrong)

    wide = predictions.where(F.col(side).isin(base, combined)).groupBy(*keys).agg(
        average(base).alias("pred_base"),
        average(combined).alias("pred_comb"),
        *[F.any_value(c).alias(c) for c in carry],
    )
    return wide.where("pred_base IS NOT NULL AND pred_comb IS NOT NULL")


def paired_with_stored(
    stored: DataFrame, fresh: DataFrame, keys: Sequence[str], value: str
) -> DataFrame:
    """Stored baseline predictions beside freshly fitted ones; both sides unique on the key."""
    old = unique_rows(stored.withColumnRenamed(value, "pred_base"), keys)
    new = fresh.select(*keys, F.col(value).alias("pred_comb"))
    return old.join(unique_rows(new, keys), list(keys))


def agreement(
    left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], atol: float = 1e-8
) -> DataFrame:
    """How often each field agrees between a long-table summary and the short table."""
    r = right.select(key, *[F.col(f).alias(f"_r_{f}") for f in fields])
    both = left.join(r, key, "left")
    types = dict(left.dtypes)
    counts = []
    for f in fields:
        a, b = F.col(f), F.col(f"_r_{f}")
        same = near(a, b, atol) if types[f] in ("double", "float") else (a == b)
        counts.append(F.count_if(same).alias(f))
    one = both.agg(F.count(F.lit(1)).alias("n"), *counts)
    return one.unpivot(["n"], list(fields), "field", "agree_n")
