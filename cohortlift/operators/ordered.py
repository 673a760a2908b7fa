"""Ordered work on groups of any size.

A plain ``Window.partitionBy(key)`` or ``percentile`` puts a whole group into one task. One
participant or one channel may own a third of all samples, so the operators here cut each
group into *chunks* (runs of the order column), do the ordered work inside the chunk, reduce
each chunk to one row, and carry the chunk rows across in two levels. The chunk column must be a
monotone, deterministic function of the order column, so lost executors recompute the same cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlift.functions.cleaning import is_finite

CHUNK_WIDTH = 65_536
RUN = 1_024


def chunk_of(order: Column | str, width: float = CHUNK_WIDTH) -> Column:
    """Chunk number for an integer-like order column."""
    c = F.col(order) if isinstance(order, str) else order
    return F.floor(c / F.lit(width)).cast("bigint")


def value_bucket(x: Column, resolution: int = 1 << 18) -> Column:
    """Monotone bucket of a double, logarithmic in size: microvolts and megapascals alike fall
    into buckets of the same relative width (1 / resolution); zero has a bucket of its own."""
    # ln of the smallest positive double is above -746, so the bracket is always positive
    scaled = F.signum(x) * (F.ln(F.abs(x)) + F.lit(746.0)) * F.lit(resolution)
    return F.coalesce(F.floor(scaled), F.lit(0)).cast("bigint")


def with_chunk(df: DataFrame, chunk: Column | str) -> DataFrame:
    """Add ``_chunk``; the chunk is a column or an SQL expression."""
    return df.withColumn("_chunk", F.expr(chunk) if isinstance(chunk, str) else chunk)


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which a missing key matches a missing key, as it does in a window."""
    other = right.select(*[F.col(c).alias(f"_key_{c}" if c in keys else c) for c in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return left.join(other, same).drop(*[f"_key_{k}" for k in keys])


def across_chunks(
    parts: DataFrame,
    keys: Sequence[str],
    sums: Mapping[str, str] = {},
    totals: Mapping[str, str] = {},
    nearest: Mapping[str, str] = {},
    forward: bool = False,
) -> DataFrame:
    """``parts`` (one row per keys and _chunk) with what lies beyond each chunk.

    ``sums``: new column -> column summed over all earlier chunks; ``totals``: over all chunks;
    ``nearest``: new column -> last value of the earlier chunks that is not missing (first of the
    later ones if ``forward``). Chunks are scanned inside runs of ``RUN`` chunk numbers, and runs,
    a row each, across the group: however many chunks a hot group has, no window holds them all.
    """
    keys = list(keys)
    run = [*keys, "_run"]
    parts = parts.withColumn("_run", F.floor(F.col("_chunk") / RUN))

    def towards(c: str) -> Column:
        return F.col(c).desc() if forward else F.col(c).asc()

    inner = W.partitionBy(*run).orderBy(towards("_chunk")).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*keys).orderBy(towards("_run")).rowsBetween(W.unboundedPreceding, -1)
    near = F.min_by if forward else F.max_by
    runs = parts.groupBy(*run).agg(
        *[F.sum(c).alias(f"_rs_{o}") for o, c in {**sums, **totals}.items()],
        *[near(c, F.when(F.col(c).isNotNull(), F.col("_chunk"))).alias(f"_rn_{o}") for o, c in nearest.items()],
    )
    runs = runs.select(
        *run,
        *[F.coalesce(F.sum(f"_rs_{o}").over(outer), F.lit(0)).alias(f"_us_{o}") for o in sums],
        *[F.sum(f"_rs_{o}").over(W.partitionBy(*keys)).alias(o) for o in totals],
        *[F.last(f"_rn_{o}", ignorenulls=True).over(outer).alias(f"_un_{o}") for o in nearest],
    )
    local = parts.select(
        "*",
        *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_ls_{o}") for o, c in sums.items()],
        *[F.last(c, ignorenulls=True).over(inner).alias(f"_ln_{o}") for o, c in nearest.items()],
    )
    return join_on_keys(local, runs, run).select(
        *[c for c in parts.columns if c != "_run"],
        *[(F.col(f"_ls_{o}") + F.col(f"_us_{o}")).alias(o) for o in sums],
        *totals,
        *[F.coalesce(f"_ln_{o}", f"_un_{o}").alias(o) for o in nearest],
    )


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | str,
    out: str = "position",
    total: str | None = None,
) -> DataFrame:
    """1-based row number of every row in its group, and the group size if asked for."""
    keys = list(keys)
    base = with_chunk(df, chunk)
    per_chunk = base.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = across_chunks(per_chunk, keys, {"_before": "_n"}, {"_total": "_n"} if total else {}).drop("_n")
    local = F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(*order))
    ranked = join_on_keys(base.withColumn("_local", local), offsets, [*keys, "_chunk"])
    ranked = ranked.withColumn(out, (F.col("_local") + F.col("_before")).cast("bigint"))
    if total:
        ranked = ranked.withColumn(total, F.col("_total").cast("bigint"))
    return ranked.drop("_chunk", "_local", "_before", "_total")


def _neighbour(df, keys, order, chunk, columns, prefix, forward, place=None) -> DataFrame:
    keys = list(keys)
    base = with_chunk(df, chunk)
    record = F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in columns])
    rank = F.struct(*order)
    edge = F.min_by(record, rank) if forward else F.max_by(record, rank)
    edges = base.groupBy(*keys, "_chunk").agg(edge.alias("_edge"), F.count(F.lit(1)).alias("_n"))
    shift = F.lead if forward else F.lag
    sums = {"_before": "_n"} if place else {}
    edges = across_chunks(edges, keys, sums, nearest={"_carried": "_edge"}, forward=forward).drop("_edge", "_n")
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    out = base.withColumn("_rec", record).withColumn("_near", shift("_rec").over(inside))
    extra = []
    if place:
        out = out.withColumn("_local", F.row_number().over(inside))
        extra = [(F.col("_local") + F.col("_before")).cast("bigint").alias(place)]
    out = join_on_keys(out, edges, [*keys, "_chunk"])
    picked = F.coalesce(F.col("_near"), F.col("_carried"))
    return out.withColumn("_pick", picked).select(
        *df.columns,
        *[F.col(f"_pick.{prefix}{c}").alias(f"{prefix}{c}") for c in columns],
        *extra,
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | str,
    columns: Sequence[str],
    prefix: str = "prev_",
    place: str | None = None,
) -> DataFrame:
    """Attach the previous row's columns (NULL on the first row of the group).

    ``place`` names a column for the 1-based row number, which the same sort gives.
    """
    return _neighbour(df, keys, order, chunk, columns, prefix, False, place)


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | str,
    columns: Sequence[str],
    prefix: str = "next_",
) -> DataFrame:
    """Attach the next row's columns (NULL on the last row of the group)."""
    return _neighbour(df, keys, order, chunk, columns, prefix, forward=True)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    chunk: Column | str,
    sums: dict[str, str],
) -> DataFrame:
    """Running totals including the current row; ``chunk`` must rise along ``order``.

    Rows must be unique on keys + order, or the running value of tied rows is arbitrary.
    """
    keys = list(keys)
    base = with_chunk(df, chunk)
    per_chunk = base.groupBy(*keys, "_chunk").agg(
        *[F.sum(src).alias(f"_s_{out}") for out, src in sums.items()]
    )
    per_chunk = across_chunks(per_chunk, keys, {f"_b_{o}": f"_s_{o}" for o in sums}).drop(*[f"_s_{o}" for o in sums])
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    inside = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = base
    for name, src in sums.items():
        out = out.withColumn(f"_l_{name}", F.sum(src).over(inside))
    out = join_on_keys(out, per_chunk, [*keys, "_chunk"])
    return out.select(
        *df.columns, *[(F.col(f"_l_{o}") + F.col(f"_b_{o}")).alias(o) for o in sums]
    )


def forward_fill(
    df: DataFrame, keys: Sequence[str], position: str, column: str, out: str,
    width: float = CHUNK_WIDTH,
) -> DataFrame:
    """Carry the last non-NULL value forward in the stated source order."""
    keys = list(keys)
    base = with_chunk(df, chunk_of(position, width))
    known = F.col(column).isNotNull()
    tails = base.groupBy(*keys, "_chunk").agg(
        F.max_by(column, F.when(known, F.col(position))).alias("_tail")
    )
    tails = across_chunks(tails, keys, nearest={"_carried": "_tail"}).drop("_tail")
    inside = W.partitionBy(*keys, "_chunk").orderBy(position)
    inside = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = F.last(column, ignorenulls=True).over(inside)
    filled = join_on_keys(base.withColumn("_local", local), tails, [*keys, "_chunk"])
    return filled.withColumn(out, F.coalesce("_local", "_carried")).drop(
        "_chunk", "_local", "_carried"
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles of groups of any size, one row per group.

    Rows are first folded to (value, count) with map-side combine, so ties cost nothing.
    Counts per value bucket tell which bucket holds each wanted rank; only those buckets are
    ordered. No task ever holds a group, at most one bucket of it. Values that are missing or not
    finite are left out; groups without values give no row; a missing key is a group.
    """
    keys = list(keys)
    base = df.where(is_finite(value)).select(*keys, F.col(value).alias("_x"))
    if not keys:
        keys = ["_all"]
        base = base.withColumn("_all", F.lit(0))
    counts = (
        base.withColumn("_b", value_bucket(F.col("_x")))
        .groupBy(*keys, "_b", "_x")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    buckets = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    ordered = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.select(
        *keys,
        "_b",
        "_n",
        F.coalesce(F.sum("_n").over(ordered), F.lit(0)).alias("_off"),
        F.sum("_n").over(W.partitionBy(*keys)).alias("_total"),
    )
    wanted = []
    for i, p in enumerate(probs.values()):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        low = F.floor(at)
        part = at - low
        wanted.append(F.struct(F.lit(i).alias("p"), low.alias("rank"), (1 - part).alias("w")))
        wanted.append(F.struct(F.lit(i).alias("p"), (low + 1).alias("rank"), part.alias("w")))
    held = F.filter(
        F.array(*wanted),
        lambda t: (t["w"] > 0)
        & (t["rank"] >= F.col("_off"))
        & (t["rank"] < F.col("_off") + F.col("_n")),
    )
    targets = buckets.withColumn("_t", held).where(F.size("_t") > 0).select(
        *keys, "_b", "_off", "_t"
    )
    below = F.sum("_c").over(
        W.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(W.unboundedPreceding, -1)
    )
    # join before the window: only buckets that hold a wanted rank are ordered at all
    hits = (
        join_on_keys(counts, targets, [*keys, "_b"])
        .withColumn("_lo", F.col("_off") + F.coalesce(below, F.lit(0)))
        .withColumn("_t", F.explode("_t"))
        .where((F.col("_t.rank") >= F.col("_lo")) & (F.col("_t.rank") < F.col("_lo") + F.col("_c")))
    )
    out = hits.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("_t.p") == i, F.col("_x") * F.col("_t.w"))).alias(name)
            for i, name in enumerate(probs)
        ]
    )
    return out.drop("_all")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {out: 0.5})
