"""Per-channel statistics of sensor segments, in long form (keys, order, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlift.operators.ordered import (
    across_chunks,
    chunk_of,
    exact_quantiles,
    with_chunk,
    with_previous,
)
from cohortlift.sources.tables import staged

FULL_QUANTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75, "p05": 0.05, "p95": 0.95}
COMPACT_QUANTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75}


def chunk_moments(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], chunk: Column | str
) -> DataFrame:
    """Mean, population std, rms, range, rank slope and valid share of groups of any size.

    One pass: inside a chunk of the order column every valid sample gets its local rank, the
    chunk is reduced to one row, and the chunk rows of a group are folded together.

    The slope is the trend over the rank of the valid samples spread evenly on [-0.5, 0.5]. With
    t = rank/(n-1) - 0.5 the mean of t is zero, so it is sum(x t) / sum(t^2), and sum(x t) only
    needs, per chunk, n, sum(x) and sum(x * local rank). The variance is folded from chunk means
    and variances, not from raw squares.
    """
    keys = list(keys)
    x = F.col(value)
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    rank = F.count(x).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - 1
    parts = (
        with_chunk(df, chunk)
        .withColumn("_r", rank)
        .groupBy(*keys, "_chunk")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.count(x).alias("_n"),
            F.avg(x).alias("_avg"),
            F.var_pop(x).alias("_var"),
            F.sum(x * x).alias("_sq"),
            F.min(x).alias("_min"),
            F.max(x).alias("_max"),
            F.sum(x).alias("_sx"),
            F.sum(x * F.col("_r")).alias("_sxr"),
        )
    )
    parts = across_chunks(parts, keys, {"_off": "_n"}, {"_tx": "_sx", "_tn": "_n"})
    parts = parts.withColumn("_mean", F.col("_tx") / F.nullif(F.col("_tn"), F.lit(0)))
    gap = F.col("_avg") - F.col("_mean")
    total = parts.groupBy(*keys).agg(
        F.sum("_n").cast("double").alias("_n"),
        F.sum("_rows").alias("_rows"),
        F.any_value("_mean").alias("_mean"),
        F.sum(F.col("_n") * (F.col("_var") + gap * gap)).alias("_ss"),
        F.sum("_sq").alias("_sq"),
        (F.max("_max") - F.min("_min")).alias("range"),
        F.sum("_sx").alias("_sx"),
        F.sum(F.col("_sxr") + F.col("_off") * F.col("_sx")).alias("_sxr"),
    )
    n = F.col("_n")
    known = F.nullif(n, F.lit(0.0))
    numerator = F.col("_sxr") / (n - 1) - F.col("_sx") * 0.5
    spread = n * (n + 1) / (12 * (n - 1))
    return total.select(
        *keys,
        F.col("_mean").alias("mean"),
        F.sqrt(F.col("_ss") / known).alias("std"),
        F.sqrt(F.col("_sq") / known).alias("rms"),
        "range",
        F.when(n > 1, numerator / spread).alias("slope"),
        (n / F.col("_rows")).alias("valid_fraction"),
    )


def rank_slope(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], chunk: Column | str,
    out: str = "slope",
) -> DataFrame:
    """The rank slope alone, of groups with a valid sample."""
    moments = chunk_moments(df, keys, value, order, chunk).where("valid_fraction > 0")
    return moments.select(*keys, F.col("slope").alias(out))


def channel_summary(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], chunk: Column | str
) -> DataFrame:
    """Mean, population std, five quantiles, rms, range, rank slope and valid share per group.

    A group without a valid sample keeps its row: statistics NULL, valid share 0.
    """
    moments = chunk_moments(df, keys, value, order, chunk)
    return moments.join(exact_quantiles(df, keys, value, FULL_QUANTILES), list(keys), "left")


def compact_summary(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], chunk: Column | str
) -> DataFrame:
    """The seven-statistic variant: quartiles folded to the interquartile range."""
    keys = list(keys)
    moments = chunk_moments(df, keys, value, order, chunk).drop("valid_fraction")
    quantiles = exact_quantiles(df, keys, value, COMPACT_QUANTILES).select(
        *keys, "median", (F.col("q75") - F.col("q25")).alias("iqr")
    )
    return moments.join(quantiles, keys, "left")


def muscle_extras(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], chunk: Column | str
) -> DataFrame:
    """Mean absolute value, mean absolute step and zero-crossing rate over valid samples."""
    valid = df.where(F.col(value).isNotNull())
    stepped = with_previous(valid, keys, order, chunk, [value])
    before = F.col(f"prev_{value}")
    crossed = (F.col(value) * before < 0).cast("double")
    return stepped.groupBy(*keys).agg(
        F.avg(F.abs(value)).alias("mav"),
        F.avg(F.abs(F.col(value) - before)).alias("waveform_length_norm"),
        F.avg(crossed).alias("zero_cross_rate"),
    )


def magnitude_area(df: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Mean of |x|+|y|+|z| over samples with every axis present."""
    total = sum((F.abs(a) for a in axes[1:]), F.abs(axes[0]))
    return df.groupBy(*keys).agg(F.avg(total).alias("signal_magnitude_area"))


def time_quality(
    df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], chunk: Column | str
) -> DataFrame:
    """First, last and median positive step of the time column in source order."""
    keys = list(keys)
    stepped = with_previous(df.where(F.col(time).isNotNull()), keys, order, chunk, [time])
    steps = stepped.withColumn("_dt", (F.col(time) - F.col(f"prev_{time}")).cast("double"))
    ends = df.groupBy(*keys).agg(F.min(time).alias("time_min"), F.max(time).alias("time_max"))
    middle = exact_quantiles(steps.where("_dt > 0"), keys, "_dt", {"median_time_step": 0.5})
    return ends.join(middle, keys, "left")


def tail_multiples(
    df: DataFrame, keys: Sequence[str], value: str, multiples: Sequence[float]
) -> DataFrame:
    """Samples beyond k times the channel's own 99.9 % level of |x|.

    A zero level falls back to the median of |x|, then to 1e-12.
    """
    keys = list(keys)
    sized = df.withColumn("_a", F.abs(F.col(value)))
    levels = exact_quantiles(sized, keys, "_a", {"abs_q999": 0.999, "abs_q50": 0.5})
    base = F.when(F.col("abs_q999") > 0, F.col("abs_q999")).otherwise(
        F.greatest(F.col("abs_q50"), F.lit(1e-12))
    )
    levels = staged(levels.withColumn("_base", base), "tail-levels")
    counts = sized.join(levels, keys).groupBy(
        *keys, "abs_q999", "_base"
    ).agg(*[F.count_if(F.col("_a") > F.col("_base") * m).alias(f"_m{i}") for i, m in enumerate(multiples)])
    rows = F.array(
        *[
            F.struct(
                F.lit(float(m)).alias("multiple"),
                (F.col("_base") * m).alias("threshold"),
                F.col(f"_m{i}").alias("n_beyond"),
            )
            for i, m in enumerate(multiples)
        ]
    )
    return counts.select(*keys, "abs_q999", F.inline(rows))


def contiguous_runs(
    df: DataFrame, keys: Sequence[str], index: str, width: float = 65_536
) -> DataFrame:
    """Runs of consecutive index values: start, end and length of each.

    ``index`` must be unique in its group. Runs are found inside chunks of the index; a run
    that reaches a chunk border is joined to its neighbours there. Only those pieces, two per
    chunk at most, are ever ordered over the whole group.
    """
    keys = list(keys)
    base = with_chunk(df, chunk_of(index, width))
    inside = W.partitionBy(*keys, "_chunk").orderBy(index)
    pieces = (
        base.withColumn("_island", F.col(index) - F.row_number().over(inside))
        .groupBy(*keys, "_chunk", "_island")
        .agg(F.min(index).alias("_s"), F.max(index).alias("_e"))
    )
    first = F.col("_chunk") * int(width)
    at_border = (F.col("_s") == first) | (F.col("_e") == first + int(width) - 1)
    inner = pieces.where(~at_border).select(
        *keys, F.col("_s").alias("run_start"), F.col("_e").alias("run_end")
    )
    pieces = pieces.where(at_border)
    whole = W.partitionBy(*keys).orderBy("_s")
    fresh = F.coalesce((F.col("_s") != F.lag("_e").over(whole) + 1).cast("int"), F.lit(1))
    runs = pieces.withColumn("_fresh", fresh).withColumn(
        "_run", F.sum("_fresh").over(whole.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    out = runs.groupBy(*keys, "_run").agg(
        F.min("_s").alias("run_start"), F.max("_e").alias("run_end")
    )
    return out.drop("_run").unionByName(inner).select(
        *keys,
        "run_start",
        "run_end",
        (F.col("run_end") - F.col("run_start") + 1).alias("run_length"),
    )
