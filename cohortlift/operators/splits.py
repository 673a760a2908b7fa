"""Group-aware splits on tables with one row per group, never on the rows themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlift.operators.joining import spread_side
from cohortlift.operators.ordered import positions
from cohortlift.sources.tables import staged


def group_sizes(df: DataFrame, group: str, outcome: str | None = None) -> DataFrame:
    """One row per group: rows, and for a 0/1 outcome its positives and negatives."""
    counts = [F.count(F.lit(1)).alias("n")]
    if outcome:
        positive = F.count_if(F.col(outcome) == 1)
        counts += [positive.alias("n_pos"), (F.count(F.lit(1)) - positive).alias("n_neg")]
    return df.groupBy(F.col(group).alias("grp")).agg(*counts)


def with_seeds(groups: DataFrame, base_seed: int, step: int, repeats: int) -> DataFrame:
    """Repeat and its seed for every group: base + step * (repeat - 1)."""
    spread = groups.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return spread.withColumn("seed", F.lit(base_seed) + (F.col("repeat") - 1) * step)


def _placed(groups: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Place of every group by falling ``size`` and the number of groups; no seed takes part."""
    sized = groups.withColumn("_big", -F.col(size)).withColumn("_h", F.md5(F.col("grp").cast("string")))
    # the chunk rises along (size, hash): groups of one size are spread over 256 of them
    chunk = F.col("_big") * 256 + F.conv(F.substring("_h", 1, 2), 16, 10).cast("bigint")
    placed = positions(sized, list(keys), ["_big", "_h", "grp"], chunk, out="_place", total="_groups")
    return placed.drop("_big", "_h")


def _dealt(placed: DataFrame, keys: Sequence[str], n_folds: int) -> DataFrame:
    """Fold of every placed group: each run of ``n_folds`` groups of like size gives one group to
    every fold, in an order drawn by the seed. Runs do not depend on each other, so one rule holds
    at every number of groups, and another seed deals every run anew."""
    runs = placed.withColumn("_run", F.floor((F.col("_place") - 1) / n_folds))
    text = [F.col(c).cast("string") for c in ("seed", "_run", "grp")]
    runs = runs.withColumn("_draw", F.md5(F.concat_ws("|", *text)))
    fold = F.row_number().over(W.partitionBy(*keys, "_run").orderBy("_draw", "grp"))
    return runs.withColumn("fold", fold).drop("_place", "_run", "_draw")


def shuffled_folds(groups: DataFrame, keys: Sequence[str], n_folds: int) -> DataFrame:
    """Outcome-blind k-fold of groups, balanced on rows and dealt by the seed.

    ``groups``: keys, seed, grp, n. A split with fewer groups than folds fails the job.
    """
    return _enough(_dealt(_placed(groups, keys, "n"), keys, n_folds), n_folds)


def _enough(dealt: DataFrame, n_folds: int) -> DataFrame:
    few = F.raise_error(F.concat(F.lit(f"need at least {n_folds} groups, found "), F.col("_groups").cast("string")))
    return dealt.withColumn("fold", F.when(F.col("_groups") >= n_folds, F.col("fold")).otherwise(few)).drop("_groups")


def shuffled_folds_of_seeds(groups: DataFrame, keys: Sequence[str], n_folds: int, offsets: Sequence[int]) -> list[DataFrame]:
    """``shuffled_folds`` for several seeds, each ``seed`` plus an offset: groups are ranked once."""
    placed = staged(_placed(groups, keys, "n"), "placed-groups")
    return [_enough(_dealt(placed.withColumn("seed", F.col("seed") + o), keys, n_folds), n_folds) for o in offsets]


def stratified_folds(groups: DataFrame, keys: Sequence[str], n_folds: int, attempts: int) -> DataFrame:
    """k-fold of groups balanced on positives, under the first seed whose folds are usable.

    Candidate seeds seed, seed+1, … are judged side by side, ten times as many in each round until
    every split has one; a seed is usable when every fold holds both classes inside and outside.
    Groups with positives are dealt by their number of positives, groups without by their rows; a
    split without a usable seed fails the job.
    """
    keys = list(keys)
    strata = groups.withColumn("_some", F.col("n_pos") > 0)
    load = F.when(F.col("_some"), F.col("n_pos")).otherwise(F.col("n"))
    placed = _placed(strata.withColumn("_load", load), [*keys, "_some"], "_load")
    placed = staged(placed.drop("_load", "_groups"), "strata")
    todo, done, low, high = placed, None, 0, 1
    while True:
        spread = todo.withColumn("attempt", F.explode(F.sequence(F.lit(low), F.lit(min(high, attempts) - 1))))
        tried = _dealt(spread.withColumn("seed", F.col("seed") + F.col("attempt")), [*keys, "attempt", "_some"], n_folds)
        tried = staged(tried.drop("_some"), "seeds-tried")
        first = _usable(tried, keys, n_folds)
        found = tried.join(first, [*keys, "attempt"])
        done = found if done is None else done.unionByName(found)
        todo = todo.join(first, keys, "left_anti")
        if todo.isEmpty():
            return done
        if high >= attempts:
            raise ValueError(f"no usable seed among {attempts}")
        low, high = high, high * 10


def _usable(folds: DataFrame, keys: Sequence[str], n_folds: int) -> DataFrame:
    """(keys, attempt): the first usable attempt of each split that has one."""
    inside = folds.groupBy(*keys, "attempt", "fold").agg(F.sum("n_pos").alias("p"), F.sum("n_neg").alias("q"))
    good = inside.groupBy(*keys, "attempt").agg(
        (
            (F.count(F.lit(1)) == n_folds)
            & (F.min("p") > 0)
            & (F.min("q") > 0)
            & (F.sum("p") - F.max("p") > 0)
            & (F.sum("q") - F.max("q") > 0)
        ).alias("usable")
    )
    return good.where("usable").groupBy(*keys).agg(F.min("attempt").alias("attempt"))


def serpentine_folds(
    groups: DataFrame, keys: Sequence[str], n_folds: int, chunk: Column | str
) -> DataFrame:
    """A split without any sequential step: groups by falling size, dealt back and forth."""
    sized = groups.withColumn("_size", -F.col("n"))
    placed = positions(sized, keys, ["_size", "grp"], chunk, out="_place")
    turn = (F.col("_place") - 1) % (2 * n_folds)
    fold = F.when(turn < n_folds, turn).otherwise(2 * n_folds - 1 - turn)
    return placed.withColumn("fold", (fold + 1).cast("int")).drop("_size", "_place")


def inner_groups(
    outer: DataFrame, groups: DataFrame, n_outer: int, seed_of: Column
) -> DataFrame:
    """Training groups of every (repeat, outer_fold) with the seed of their inner split.

    ``outer``: repeat, seed, grp, fold. A group trains for every outer fold but its own.
    ``seed_of`` may use repeat, seed and outer_fold. The file of ``outer`` is far smaller than its
    exploded rows in memory: neither side is broadcast.
    """
    train = outer.select(
        "repeat",
        "seed",
        "grp",
        F.explode(
            F.filter(F.sequence(F.lit(1), F.lit(n_outer)), lambda f: f != F.col("fold"))
        ).alias("outer_fold"),
    )
    seeded = train.withColumn("seed", seed_of)
    return spread_side(seeded).join(groups.select("grp", "n"), "grp")


def leakage(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups that sit in more than one fold of a split, and folds in use."""
    per = folds.groupBy(*keys, "grp").agg(F.count_distinct("fold").alias("_f"))
    used = folds.groupBy(*keys).agg(F.count_distinct("fold").alias("n_folds"))
    bad = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("_f") > 1).alias("n_leaking")
    )
    return bad.join(used, list(keys)).withColumn("ok", F.col("n_leaking") == 0)


def attach_folds(rows: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """The one fold table, joined by group; every model and feature set reuses it."""
    table = folds.select(F.col("grp").alias(group), "repeat", F.col("fold").alias("outer_fold"))
    return rows.join(table, group)
