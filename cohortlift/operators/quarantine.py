"""Taking rows and channels out, and proving that the right ones went."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mask_channels(
    df: DataFrame, mask: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """NULL the columns of every (trial, channel) in ``mask``; rows are kept."""
    keys = list(keys)
    hit = mask.select(*keys).distinct().withColumn("_masked", F.lit(True))
    out = df.join(hit, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("_masked").isNull(), F.col(c)))
    return out.select(*df.columns)


def drop_rows(df: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Remove every row whose key is listed under any anchor (the union of all of them)."""
    return df.join(manifest.select(key).distinct(), key, "left_anti")


def before_and_after(
    before: DataFrame, after: DataFrame, manifest: DataFrame, key: str
) -> DataFrame:
    """One row: listed ids, how many were present before, how many are left after.

    The rows stream past the listed ids; the planner must not broadcast them on an estimate
    that does not see an explosion.
    """
    listed = manifest.select(key).distinct()

    def found(rows: DataFrame, check: str) -> DataFrame:
        return rows.select(key).join(listed, key, "left_semi").distinct().select(F.lit(check).alias("check"))

    present, left = found(before, "present_before"), found(after, "left_after")
    total = listed.select(F.lit("listed").alias("check"))
    counts = total.unionAll(present).unionAll(left).groupBy().agg(
        F.count_if(F.col("check") == "listed").alias("n_listed"),
        F.count_if(F.col("check") == "present_before").alias("n_present_before"),
        F.count_if(F.col("check") == "left_after").alias("n_left_after"),
    )
    return counts.withColumn(
        "ok", (F.col("n_present_before") == F.col("n_listed")) & (F.col("n_left_after") == 0)
    )
