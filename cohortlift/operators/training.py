"""Statistics of many training sets out of one read of the rows.

A training set is named by the keys (folds, participants) that belong to it. Rows are folded to one
cell per key, or per key and value bucket, and only these cells are spread over the sets: no row
is copied however many repeats, outer and inner folds there are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlift.functions.cleaning import is_finite
from cohortlift.operators.embeddings import sum_vector
from cohortlift.operators.joining import spread_side
from cohortlift.operators.ordered import join_on_keys, value_bucket
from cohortlift.sources.tables import staged

#: value buckets of each round of a search, coarse to fine; what is left is compared exactly
RESOLUTIONS = (1 << 6, 1 << 12, 1 << 18)


def others(fold: str, n_folds: int) -> Column:
    """All folds but one's own: the training sets that a fold's rows belong to."""
    return F.filter(F.sequence(F.lit(1), F.lit(n_folds)), lambda f: f != F.col(fold))


def _per_set(cells: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Cells of a key beside every set (``set``) that the key belongs to."""
    spread = members.select(key, F.explode("sets").alias("set"))
    return cells.join(spread_side(spread), key)


def training_quantile(
    long: DataFrame, members: DataFrame, key: str, cells: Sequence[str], value: str, prob: float, out: str
) -> DataFrame:
    """Exact interpolated quantile of every (set, cells): set, cells, ``out``.

    ``long``: key, cells, value, one row a value; ``members``: key, sets (array of set numbers).
    Counts per value bucket are added up for every set; the bucket that holds a wanted rank is
    split anew at the next resolution, and in the end by value. Values that are missing or not
    finite are left out; a set without values gives no row.
    """
    cells = list(cells)

    def counted(kept: DataFrame) -> DataFrame:
        counts = kept.groupBy(key, *cells, "_in", "_part").agg(F.count(F.lit(1)).alias("_c"))
        return _per_set(counts, members, key)

    return _searched(long.select(key, *cells, value), cells, value, prob, out, counted)


def _searched(
    long: DataFrame, cells: Sequence[str], value: str, prob: float, out: str, counted: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``counted`` gives (set, cells, _in, _part, _c), the counts of every part in every set."""
    by = ["set", *cells, "_in"]
    kept = long.where(is_finite(value)).withColumn("_in", F.lit(0.0)).withColumnRenamed(value, "_x")
    wanted = None
    for resolution in (*RESOLUTIONS, None):
        part = F.col("_x") if resolution is None else value_bucket(F.col("_x"), resolution).cast("double")
        kept = kept.withColumn("_part", part)
        counts = counted(kept)
        if wanted is not None:
            counts = join_on_keys(counts, wanted.select(*by).distinct(), by)
        counts = counts.groupBy(*by, "_part").agg(F.sum("_c").alias("_c"))
        whole = W.partitionBy(*by)
        before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        placed = counts.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        if wanted is None:
            placed = placed.withColumn("_total", F.sum("_c").over(whole))
            at = F.lit(float(prob)) * (F.col("_total") - 1)
            low = F.floor(at)
            both = F.array(
                F.struct(low.alias("rank"), (1 - (at - low)).alias("w")),
                F.struct((low + 1).alias("rank"), (at - low).alias("w")),
            )
            placed = placed.withColumn("_t", F.explode(both)).select("*", "_t.rank", "_t.w").where("w > 0")
        else:
            placed = join_on_keys(placed, wanted, by)
        hit = placed.where((F.col("rank") >= F.col("_off")) & (F.col("rank") < F.col("_off") + F.col("_c")))
        if resolution is None:
            return hit.groupBy("set", *cells).agg(F.sum(F.col("_part") * F.col("w")).alias(out))
        # the next round looks into the buckets found, and only at rows that lie in one of them
        found = hit.select("set", *cells, F.col("_part").alias("_in"), (F.col("rank") - F.col("_off")).alias("rank"), "w")
        wanted = staged(found, "wanted-ranks")
        inside = wanted.select(*cells, "_in").distinct()
        kept = join_on_keys(kept.drop("_in").withColumnRenamed("_part", "_in"), inside, [*cells, "_in"])


def imputed_statistics(
    long: DataFrame, members: DataFrame, key: str, cells: Sequence[str], value: str
) -> DataFrame:
    """Training statistics of every (set, cells): set, cells, n, median, mean, sd.

    ``long`` holds missing values as well. Mean and population deviation are those after the median
    has been put in for missing values; the deviation is 0 exactly where all values are equal. A set
    without any value has median and mean 0. Moments are taken around a common middle, so a small
    spread far from zero is not lost.
    """
    cells = list(cells)
    x = F.when(is_finite(value), F.col(value))
    own = long.groupBy(key, *cells).agg(
        F.count(F.lit(1)).alias("_n"), F.count(x).alias("_m"), F.avg(x).alias("_avg"), F.var_pop(x).alias("_var"),
        F.min(x).alias("_lo"), F.max(x).alias("_hi"),
    )
    own = staged(own, "key-moments")
    middle = own.groupBy(*cells).agg((F.sum(F.col("_m") * F.col("_avg")) / F.sum("_m")).alias("_mid"))
    m, off = F.col("_m"), F.col("_avg") - F.col("_mid")
    sums = _per_set(join_on_keys(own, middle, cells), members, key).groupBy("set", *cells).agg(
        F.sum("_n").alias("n"), F.sum("_m").alias("_m"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
        F.sum(m * off).alias("_s"), F.sum(m * (F.col("_var") + off * off)).alias("_ss"), F.first("_mid").alias("_mid"),
    )
    medians = training_quantile(long, members, key, cells, value, 0.5, "median")
    by = ["set", *cells]
    joined = sums.join(medians.withColumnsRenamed({c: f"_k_{c}" for c in by}),
                       [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by], "left")
    share, mean = m / F.col("n"), F.col("_s") / m
    gap = mean - (F.col("median") - F.col("_mid"))
    var = F.greatest(F.col("_ss") / m - mean * mean, F.lit(0.0))
    # where values are missing the median stands among the values
    lo = F.when(m < F.col("n"), F.least("_lo", "median")).otherwise(F.col("_lo"))
    hi = F.when(m < F.col("n"), F.greatest("_hi", "median")).otherwise(F.col("_hi"))
    sd = F.when(hi > lo, F.sqrt(share * var + share * (1 - share) * gap * gap))
    return joined.select(
        *by, "n",
        F.coalesce("median", F.lit(0.0)).alias("median"),
        F.coalesce(F.col("median") + share * gap, F.lit(0.0)).alias("mean"),
        F.coalesce(sd, F.lit(0.0)).alias("sd"),
    )


def level_counts(long: DataFrame, members: DataFrame, key: str, cells: Sequence[str], value: str) -> DataFrame:
    """Rows of every (set, cells, value), missing values left out."""
    own = long.where(F.col(value).isNotNull()).groupBy(key, *cells, value).agg(F.count(F.lit(1)).alias("_n"))
    return _per_set(own, members, key).groupBy("set", *cells, value).agg(F.sum("_n").alias("n"))


# --- sets of a nested split, as one matrix -----------------------------------------------------------
ROWS_A_PRODUCT = 5_000
CELLS_A_BATCH = 20_000


def fold_codes(inner: DataFrame, group: str, n_outer: int, n_inner: int, repeats: int) -> DataFrame:
    """(group, folds): the inner fold of a group for every place (repeat - 1) * n_outer + outer_fold - 1,
    0 where it does not train. A few bytes a group tell all training sets that it belongs to."""
    place = (F.col("repeat") - 1) * n_outer + F.col("outer_fold") - 1
    entry = F.struct(place.cast("int").alias("place"), F.col("inner_fold").cast("smallint").alias("fold"))
    held = inner.groupBy(group).agg(F.map_from_entries(F.collect_list(entry)).alias("_held"))
    none = F.lit(0).cast("smallint")
    folds = F.transform(F.sequence(F.lit(0), F.lit(repeats * n_outer - 1)), lambda i: F.coalesce(F.col("_held")[i], none))
    return held.select(group, folds.alias("folds"))


def inside_sets(folds: np.ndarray, n_inner: int) -> np.ndarray:
    """Which rows are in which training sets: place by place the whole set, then it without each inner fold."""
    f = folds[:, :, None]
    return ((f != 0) & (f != np.arange(n_inner + 1))).reshape(len(folds), -1)


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An array column, all of one length, as a matrix; a missing number is not a number."""
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def pieces(batches, rows: int):
    """Batches cut to at most so many rows, empty ones left out."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def nested_quantile(rows: DataFrame, folds: str, columns: Sequence[str], n_inner: int, prob: float, out: str) -> DataFrame:
    """``training_quantile`` of every column (``_col``: its place) in all sets of a nested split; ``set``
    is the place of a set in ``inside_sets``. Counts are added up for all sets at once in the tasks,
    however many groups there are."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_col"), F.col(c).alias("_v")) for i, c in enumerate(columns)]))
    long = rows.select(F.col(folds).alias("folds"), each.alias("_e")).select("folds", "_e._col", "_e._v")
    keys = ["_col", "_in", "_part"]

    def fold(batches):
        found, size = [], 0
        for batch in pieces(batches, ROWS_A_PRODUCT):
            inside = inside_sets(matrix(batch, "folds"), n_inner).astype(np.int64)
            cells = pd.DataFrame({k: batch.column(k).to_numpy() for k in keys})
            number = cells.groupby(keys, sort=False).ngroup().to_numpy()
            order = np.argsort(number, kind="stable")
            starts = np.flatnonzero(np.diff(number[order], prepend=-1))
            found.append((cells.iloc[order[starts]], np.add.reduceat(inside[order], starts)))
            size += len(starts)
            if size > CELLS_A_BATCH:
                found, size = [merged(found)], 0
                if len(found[0][0]) > CELLS_A_BATCH // 2:
                    yield packed(*found.pop())
        if found:
            yield packed(*merged(found))

    def merged(found):
        cells, sums = pd.concat([c for c, _ in found]), np.concatenate([s for _, s in found])
        number = cells.groupby(keys, sort=False).ngroup().to_numpy()
        order = np.argsort(number, kind="stable")
        starts = np.flatnonzero(np.diff(number[order], prepend=-1))
        return cells.iloc[order[starts]], np.add.reduceat(sums[order], starts)

    def packed(cells, sums):
        flat = pa.array(sums.astype(float).ravel())
        ends = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1])
        return pa.RecordBatch.from_arrays(
            [pa.array(cells["_col"].to_numpy(np.int32)), pa.array(cells["_in"].to_numpy(float)), pa.array(cells["_part"].to_numpy(float)),
             pa.ListArray.from_arrays(ends, flat)], [*keys, "sums"],
        )

    def counted(kept: DataFrame) -> DataFrame:
        parts = kept.select("folds", *keys).mapInArrow(fold, "_col int, _in double, _part double, sums array<double>")
        sums = parts.groupBy(*keys).agg(sum_vector(F.col("sums")).alias("sums"))
        return sums.select(*keys, F.posexplode("sums").alias("set", "_c")).where("_c > 0")

    return _searched(long, ["_col"], "_v", prob, out, counted)
