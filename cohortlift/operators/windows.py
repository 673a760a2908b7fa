"""Prediction windows: exact-horizon pairs, lagged intervals and window-to-sample matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlift.operators.joining import spread_side
from cohortlift.operators.ordered import with_next, with_previous


def exact_horizon_pairs(
    ratings: DataFrame, keys: Sequence[str], time: str, value: str, horizon: float,
    earliest: float,
) -> DataFrame:
    """Rows whose value is also known exactly ``horizon`` later (never the next one at hand)."""
    keys = list(keys)
    now = ratings.where((F.col(time) >= earliest) & F.col(value).isNotNull())
    later = ratings.where(F.col(value).isNotNull()).select(
        *keys, (F.col(time) - horizon).alias(time), F.col(value).alias(f"target_{value}")
    )
    return now.join(later, [*keys, time]).withColumn("target_time", F.col(time) + horizon)


def lag_one_interval(
    intervals: DataFrame,
    trial: str,
    order: Sequence[str],
    chunk: Column | str,
    features: Sequence[str],
    prefix: str = "lag1_",
) -> DataFrame:
    """Target of interval k with the features of interval k-1; the first interval has none.

    Adds ``interval_index``, the 1-based place of interval k in its trial.
    """
    lagged = with_previous(
        intervals, [trial], order, chunk, features, prefix=prefix, place="interval_index"
    )
    return lagged.where(F.col("interval_index") > 1)


def connectedness(
    intervals: DataFrame, keys: Sequence[str], start: str, stop: str, chunk: Column | str,
    atol: float = 1e-9,
) -> DataFrame:
    """Whether every interval begins where the one before it stopped."""
    ahead = with_next(intervals, keys, [start, stop], chunk, [start])
    gap = F.abs(F.col(stop) - F.col(f"next_{start}")) <= atol
    return ahead.groupBy(*keys).agg(
        F.coalesce(F.bool_and(gap), F.lit(True)).alias("intervals_connected")
    )


def candidate_windows(
    trials: DataFrame, times: Column, window: float, rate: float, t: str = "t"
) -> DataFrame:
    """One row per trial, prediction time and anchor with its sample bounds.

    ``trials`` holds trial keys, ``duration`` and the channel's sample count ``n``. Only windows
    that fit under both anchors stay, so both anchors describe the same rows.
    """
    from cohortlift.functions.cleaning import bounds_valid, end_bounds, start_bounds

    at = trials.withColumn(t, F.explode(times))
    sa, sb = start_bounds(F.col(t), window, rate)
    ea, eb = end_bounds(F.col(t), F.col("duration"), F.col("n"), window, rate)
    both = at.withColumn("_s", F.struct(F.lit("START").alias("anchor"), sa.alias("a"), sb.alias("b")))
    both = both.withColumn("_e", F.struct(F.lit("END").alias("anchor"), ea.alias("a"), eb.alias("b")))
    n = F.col("n")
    both = both.where(
        bounds_valid(F.col("_s.a"), F.col("_s.b"), n) & bounds_valid(F.col("_e.a"), F.col("_e.b"), n)
    )
    return both.select(*trials.columns, t, F.inline(F.array("_s", "_e")))


def window_samples(
    windows: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    index: str,
    width: int,
) -> DataFrame:
    """Every sample that falls in every window: a <= index < b.

    Windows are spread over the index buckets they touch (two at most for windows no longer
    than ``width``), so the match is an equi-join on (keys, bucket) plus a residual range test;
    a trial of any length is split over its buckets and nothing is compared across buckets.
    Windows without samples are not emitted.
    """
    keys = list(keys)
    first = F.floor(F.col("a") / width)
    last = F.floor((F.col("b") - 1) / width)
    spread = windows.withColumn("_bucket", F.explode(F.sequence(first, last)))
    placed = samples.withColumn("_bucket", F.floor(F.col(index) / width))
    met = spread_side(spread).join(placed, [*keys, "_bucket"])
    return met.where((F.col(index) >= F.col("a")) & (F.col(index) < F.col("b"))).drop("_bucket")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a stated order, as an aggregate (partial results before the shuffle)."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """k first rows per group; the rank filter prunes inside each task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
