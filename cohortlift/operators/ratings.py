"""Rating series read from a wide grid whose headers name the second."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.functions.parsing import squeeze_name

# Header formats of the rating grid.
TIME_HEADER = re.compile(r"(\d+)_sec")


def time_columns(df: DataFrame) -> dict[int, str]:
    """Second -> column, from the headers."""
    found = {c: TIME_HEADER.fullmatch(squeeze_name(c)) for c in df.columns}
    return {int(m.group(1)): c for c, m in found.items() if m}


def grid_to_long(
    df: DataFrame, ids: Sequence[str], time: str = "t", value: str = "v"
) -> DataFrame:
    """One row per filled cell."""
    cols = list(time_columns(df).values())
    long = df.unpivot(list(ids), cols, "_name", value).where(F.col(value).isNotNull())
    second = F.regexp_extract("_name", r"(\d+)", 1).cast("bigint")
    return long.select(*ids, second.alias(time), value)


def series_with_end(
    df: DataFrame, ids: Sequence[str], duration: str = "length_of_trial",
    end: str = "end_of_trial", step: float = 10.0,
) -> DataFrame:
    """Grid ratings plus the end rating where the duration lies on the grid (it wins a tie)."""
    regular = grid_to_long(df, ids).withColumn("_p", F.lit(0))
    regular = regular.withColumn("t", F.col("t").cast("double"))
    on_grid = F.abs(F.col(duration) % step) <= 1e-9
    last = df.where(on_grid & F.col(end).isNotNull()).select(
        *ids, F.col(duration).alias("t"), F.col(end).alias("v"), F.lit(1).alias("_p")
    )
    return regular.unionByName(last).groupBy(*ids, "t").agg(F.max_by("v", "_p").alias("v"))


def internal_gaps(long: DataFrame, key: str, time: str, step: int) -> DataFrame:
    """Expected grid times up to the last one seen that carry no rating."""
    last = long.groupBy(key).agg(F.max(time).alias("_last"))
    grid = last.select(
        key, F.explode(F.sequence(F.lit(step), F.col("_last"), F.lit(step))).alias(time)
    )
    return grid.join(long, [key, time], "left_anti")


def series_quality(df: DataFrame, key: str, horizon: float) -> DataFrame:
    """Quality facts of each rating series.

    A grid row holds its whole series, so everything is arithmetic on one array per row: no
    shuffle at all, however many trials there are.
    """
    grid = time_columns(df)
    times = sorted(grid)
    cells = F.array(
        *[F.struct(F.lit(float(t)).alias("t"), F.col(grid[t]).alias("v")) for t in times]
    )
    d = F.col("length_of_trial")
    expected = F.filter(F.array(*[F.lit(float(t)) for t in times]), lambda t: t < d - 1e-9)
    seen = F.filter(cells, lambda c: c["v"].isNotNull())
    before = F.array(F.struct(F.lit(0.0).alias("t"), F.col("before_task").alias("v")))
    after = F.array(F.struct(d.alias("t"), F.col("end_of_trial").alias("v")))
    series = F.array_sort(
        F.filter(F.concat(before, F.col("_seen"), after), lambda c: c["t"].isNotNull() & c["v"].isNotNull())
    )
    earlier = F.slice("_series", 1, F.size("_series") - 1)
    later = F.slice("_series", 2, F.size("_series"))
    pairs = F.zip_with(earlier, later, lambda a, b: b["v"] < a["v"] - 1e-12)
    at = F.transform("_series", lambda c: c["t"])
    targets = F.filter(
        F.array_distinct(at), lambda t: (t >= 10) & F.array_contains(at, t + horizon)
    )

    def many(c):
        return F.size(c).cast("bigint")

    t = df.withColumn("_seen", seen).withColumn("_series", series).withColumn("_expected", expected)
    seen_times = F.transform("_seen", lambda c: c["t"])
    top = F.array_max(seen_times)
    return t.select(
        key,
        many("_seen").alias("n_regular"),
        top.cast("bigint").alias("max_time"),
        many("_expected").alias("expected_count"),
        (F.size(F.array_except("_expected", seen_times)) == 0).alias("expected_complete"),
        many(F.filter("_seen", lambda c: c["t"] >= d - 1e-9)).alias("at_or_after_end"),
        F.coalesce(F.floor(top / 10) - F.size("_seen"), F.lit(0)).cast("bigint").alias("internal_gaps"),
        many(F.filter(pairs, lambda b: b)).alias("monotonic_violations"),
        many(targets).alias("n_exact_targets"),
    )
