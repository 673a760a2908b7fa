"""Boosted regression trees out of fold, from cells of the binned rows.

A tree sees a row only through the bins of its features, so rows of the same bins share every
split and prediction. Spark bins the rows and folds them to one cell a combination, with its count
and sum of outcomes; a fit of hundreds of rounds then costs the same at any number of rows, and
every (training set, candidate) is a group of its own. Trees are those of Spark ML: at most 32
bins, squared error, first tree unshrunk, later ones fitted to twice the residual.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.operators import learners as lr
from cohortlift.operators.ordered import exact_quantiles
from cohortlift.operators.training import others
from cohortlift.sources.tables import staged

BINS = 32
CELLS = 100_000  # a training set of more cells is left to Spark's own trees, which need no cells


def boosted(
    codes: np.ndarray, n: np.ndarray, total: np.ndarray, step: float, depth: int, min_leaf: int, rounds: int
) -> np.ndarray:
    """Prediction of every cell. ``codes``: bin of each cell and feature; ``n`` and ``total``: its
    training rows and their summed outcomes (cells without any are only predicted)."""
    cells, d = codes.shape
    slot = np.arange(d) * BINS + codes
    score, at = np.zeros(cells), np.arange(cells)
    for r in range(rounds):
        target = total if r == 0 else 2 * (total - n * score)
        node = np.zeros(cells, dtype=np.int64)
        for level in range(depth):
            shape = (1 << level, d, BINS)
            place = (node[:, None] * (d * BINS) + slot).ravel()
            size = int(np.prod(shape))
            left_n = np.bincount(place, np.repeat(n, d), size).reshape(shape).cumsum(2)
            left_t = np.bincount(place, np.repeat(target, d), size).reshape(shape).cumsum(2)
            right_n, right_t = left_n[:, :, -1:] - left_n, left_t[:, :, -1:] - left_t
            whole_n, whole_t = left_n[:, :1, -1:], left_t[:, :1, -1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left_t**2 / left_n + right_t**2 / right_n - whole_t**2 / whole_n
                floor = 1e-12 * np.nan_to_num(whole_t**2 / whole_n)
            gain = np.where((left_n >= min_leaf) & (right_n >= min_leaf) & (gain > floor), gain, -1.0).reshape(1 << level, -1)
            best = gain.argmax(1)
            feature, cut = np.divmod(best, BINS)
            # a node without a split keeps its cells on the left, down to its leaf
            split = gain[np.arange(1 << level), best] > 0
            node = 2 * node + (split[node] & (codes[at, feature[node]] > cut[node]))
        leaf_n = np.bincount(node, n, 1 << depth)
        leaf = np.bincount(node, target, 1 << depth) / np.where(leaf_n > 0, leaf_n, 1.0)
        score = score + (1.0 if r == 0 else step) * leaf[node]
    return score


def bin_edges(rows: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict[int, dict[str, list[float]]]:
    """Inner bounds of the bins of every ``set``: half way between the values where they are few,
    else exact quantiles. One short list a set and column reaches the driver."""
    edges: dict[int, dict[str, list[float]]] = {}
    for c in columns:
        if rows.select(c).distinct().limit(bins + 1).count() <= bins:
            found = rows.groupBy("set").agg(F.array_sort(F.collect_set(c)).alias("v")).collect()
            cuts = {r["set"]: [(a + b) / 2 for a, b in zip(r["v"], r["v"][1:])] for r in found}
        else:
            names = {f"q{k}": k / bins for k in range(1, bins)}
            found = exact_quantiles(rows.select("set", c), ["set"], c, names).collect()
            cuts = {r["set"]: sorted({r[name] for name in names}) for r in found}
        for s, cut in cuts.items():
            edges.setdefault(s, {})[c] = cut
    return edges


def boosted_out_of_fold(
    rows: DataFrame, folds: DataFrame, row_id: str, group: str, y: str, numeric: Sequence[str],
    categorical: Sequence[str], grid: Mapping[str, Sequence] = lr.BOOSTING_GRID, min_leaf: int = 10,
    rounds: int = lr.BOOSTING_ROUNDS, n_folds: int = 5,
) -> DataFrame | None:
    """(row_id, group, y, params, pred, fold): each row scored by every candidate, fitted on the
    other folds' groups only, with medians, modes and bins learnt there too. ``folds``: group, fold.

    None where the bins combine to more than ``CELLS`` cells a set; Spark's trees take over then.
    """
    numeric, categorical = list(numeric), list(categorical)
    placed = staged(rows.join(folds.select(group, "fold"), group), "placed-rows")
    members = folds.select("fold").distinct().withColumn("sets", others("fold", n_folds))
    fitted = {r["set"]: r for r in lr.fit_training_sets(placed, members, "fold", numeric, categorical).collect()}

    def per_set(value):  # a literal for each of the few sets
        out = F.lit(None)
        for s, r in fitted.items():
            out = F.when(F.col("set") == s, value(r)).otherwise(out)
        return out

    spread = placed.withColumn("set", F.explode(F.sequence(F.lit(1), F.lit(n_folds))))
    filled = {c: F.coalesce(F.col(c).cast("double"), per_set(lambda r, c=c: F.lit(r[f"_num_{c}"]["median"]))) for c in numeric}
    modes = {c: F.coalesce(F.col(c), per_set(lambda r, c=c: F.lit(r[f"_mode_{c}"]))) for c in categorical}
    own = F.col("fold") == F.col("set")
    edges = bin_edges(spread.where(~own).select("set", *[filled[c].alias(c) for c in numeric]), numeric)
    # the place of a value is the number of bounds below it
    binned = [
        per_set(lambda r, c=c: sum([(filled[c] > e).cast("int") for e in edges[r["set"]][c]], F.lit(0))).alias(f"_b{i}")
        for i, c in enumerate(numeric)
    ]
    level = [
        per_set(lambda r, c=c: F.array_position(F.array(*[F.lit(v) for v in r[f"_cat_{c}"]]), modes[c]).cast("int")
                if r[f"_cat_{c}"] else F.lit(0)).alias(f"_c{i}")
        for i, c in enumerate(categorical)
    ]
    keys = [*[f"_b{i}" for i in range(len(numeric))], *[f"_c{i}" for i in range(len(categorical))]]
    seen = spread.select("set", own.alias("_own"), F.col(y).cast("double").alias("_y"), *binned, *level)
    cells = staged(seen.groupBy("set", *keys).agg(
        F.sum((~F.col("_own")).cast("double")).alias("_n"), F.sum(F.when(F.col("_own"), 0.0).otherwise(F.col("_y"))).alias("_t"),
    ), "cells")
    if (cells.groupBy("set").count().agg(F.max("count")).first()[0] or 0) > CELLS:
        return None
    levels = {s: [len(r[f"_cat_{c}"] or ()) for c in categorical] for s, r in fitted.items()}
    n_numeric = len(numeric)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        point = json.loads(pdf["params"].iloc[0])
        codes = [pdf[k].to_numpy() for k in keys[:n_numeric]]
        for k, many in zip(keys[n_numeric:], levels[int(pdf["set"].iloc[0])]):
            codes += [(pdf[k] == v).to_numpy() for v in range(1, many + 1)]
        pred = boosted(
            np.column_stack(codes).astype(np.int64), pdf["_n"].to_numpy(), pdf["_t"].to_numpy(), point["step"],
            lr.tree_depth(point["leaves"]), min_leaf, rounds,
        )
        return pdf[["set", *keys, "params"]].assign(pred=pred)

    points = [f'{{"leaves": {v}, "step": {s}}}' for s in grid["step"] for v in grid["leaves"]]
    each = cells.withColumn("params", F.explode(F.array(*[F.lit(p) for p in points])))
    schema = "set int, " + "".join(f"{k} int, " for k in keys) + "params string, pred double"
    each = each.repartition(n_folds * len(points), "set", "params")
    scored = staged(each.groupBy("set", "params").applyInPandas(fit, schema), "cell-predictions")
    options = scored.groupBy("set", *keys).agg(F.array_sort(F.collect_list(F.struct("params", "pred"))).alias("_e"))
    held = placed.withColumn("set", F.col("fold").cast("int")).select(row_id, group, y, "set", *binned, *level)
    met = held.join(options, ["set", *keys]).select(row_id, group, y, F.col("set").alias("fold"), F.explode("_e").alias("_e"))
    return met.select(row_id, group, y, "_e.params", "_e.pred", "fold")
