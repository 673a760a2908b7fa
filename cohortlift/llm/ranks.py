"""Places of rows in sorted groups of any size, and sums up to a place.

Rows are dealt by ranges of (group, order), so a hot group spreads over as many tasks as it needs;
a row's place is its place in its range plus the rows of its group in the ranges before. Only one
row for each (range, group) crosses ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlift.sources.tables import staged

RANGE_ROWS = 200_000
BLOCK = 4_096


def ranked(df: DataFrame, group: str, order: Sequence[str], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``pos``, the place from 0 of each row in its group along ``order`` (nulls
    first), and ``n``, the rows of the group. The group must not be null. Rows equal in ``order``
    stand in the order in which they were read, which is settled once."""
    base = staged(df.withColumn("_tie", F.monotonically_increasing_id()), name)
    parts = max(1, -(-base.count() // range_rows))
    along = [group, *order, "_tie"]
    # after the sort the id is (range << 33) + place in the range
    laid = base.repartitionByRange(parts, *along).sortWithinPartitions(*along)
    laid = staged(laid.withColumn("_at", F.monotonically_increasing_id()).drop("_tie"), f"{name}-laid")
    laid = laid.withColumn("_range", F.shiftright("_at", 33))
    spans = laid.groupBy("_range", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select(
        "_range",
        group,
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(W.partitionBy(group)).alias("n"),
    )
    placed = laid.join(staged(spans, f"{name}-spans"), ["_range", group])
    return placed.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def sums_before(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` of one group with dense ``pos`` and, for each column, ``before_<column>``: its sum
    over all earlier places. Summed in blocks of places; one row a block is summed across."""
    blocks = df.withColumn("_block", F.expr(f"pos div {BLOCK}"))
    totals = blocks.groupBy("_block").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    earlier = W.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_block", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in columns])
    inside = W.partitionBy("_block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    local = blocks.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{c}") for c in columns])
    return local.join(totals, "_block").select(
        *df.columns, *[(F.col(f"_l_{c}") + F.col(f"_b_{c}")).alias(f"before_{c}") for c in columns]
    )
