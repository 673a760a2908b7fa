"""Learners: fold-local preprocessing and Spark ML models, also many at once.

Nested cross-validation asks for thousands of linear fits. The rows are folded to sums of products
per group; a training set is a sum over its groups, and a task fits all its candidates from those
moments, so a fit costs the same at any number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlift.functions.cleaning import is_finite
from cohortlift.operators.embeddings import dot, sum_vector
from cohortlift.operators.joining import spread_side
from cohortlift.operators.sets import best_candidate
from cohortlift.operators.training import (
    ROWS_A_PRODUCT, fold_codes, imputed_statistics, inside_sets, level_counts, matrix, nested_quantile, pieces,
)
from cohortlift.sources.tables import staged

# Search grids and budgets.
ELASTIC_GRID = {"alpha": [0.01, 0.1, 1.0, 10.0], "l1_ratio": [0.1, 0.5, 0.9]}
LOGISTIC_GRID = {"penalty": ["l1", "l2"], "c": [0.01, 0.1, 1.0, 10.0]}
BOOSTING_GRID = {"step": [0.03, 0.08], "leaves": [7, 15]}
BOOSTING_ROUNDS = 250
ELASTIC_ITERATIONS = 30_000
LOGISTIC_ITERATIONS = 10_000


def task_grid(units: DataFrame, *axes: Mapping[str, Sequence]) -> DataFrame:
    """Every unit under every combination of literal axis values, spread without a join."""
    out = units
    for axis in axes:
        for name, values in axis.items():
            out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


# --- fold-local preprocessing -------------------------------------------------------------------
def fit_training_sets(
    rows: DataFrame, members: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """Medians, means and population deviations after imputation, modes and categories per set.

    ``members``: key, sets (the training sets that the key's rows belong to). One output row per
    set, numbered ``set``; the rows are read once, whatever the number of sets.
    """
    long = rows.unpivot([key], list(numeric), "_col", "_v")
    stats = imputed_statistics(long, members, key, ["_col"], "_v")
    wide = stats.groupBy("set").agg(
        *[F.max(F.when(F.col("_col") == c, F.struct("median", "mean", "sd"))).alias(f"_num_{c}") for c in numeric]
    )
    if not categorical:
        return wide
    counts = level_counts(rows.unpivot([key], list(categorical), "_col", "_v"), members, key, ["_col"], "_v")
    # categories are few by nature; counts have one row per category
    levels = counts.groupBy("set").agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("_col") == c, F.col("_v")))).alias(f"_cat_{c}")
            for c in categorical
        ],
        *[
            F.min(F.when(F.col("_col") == c, F.struct((-F.col("n")).alias("n"), F.col("_v"))))["_v"].alias(f"_mode_{c}")
            for c in categorical
        ],
    )
    return wide.join(levels, "set", "left")


def fit_preprocessing(
    train: DataFrame, sets: Sequence[str], numeric: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """The same where ``sets`` names the one training set of each row. One output row per set."""
    keyed = train.withColumn("_key", F.struct(*sets))
    members = keyed.select("_key").distinct().withColumn("sets", F.array("_key"))
    fitted = fit_training_sets(keyed, members, "_key", numeric, categorical).withColumnRenamed("set", "_set")
    return fitted.select("_set.*", "*").drop("_set")


def apply_preprocessing(
    rows: DataFrame,
    fitted: DataFrame,
    sets: Sequence[str],
    numeric: Sequence[str],
    categorical: Sequence[str],
    out: str = "features",
) -> DataFrame:
    """Imputed and standardised numbers, then one-hot categories; constant features left out.

    A category unseen in training gives zeros.
    """
    # one row per training set
    joined = rows.join(F.broadcast(fitted), list(sets))
    parts = []
    for c in numeric:
        s = F.col(f"_num_{c}")
        z = (F.coalesce(F.col(c).cast("double"), s["median"]) - s["mean"]) / s["sd"]
        parts.append(F.when(s["sd"] > 0, F.array(z)).otherwise(F.array().cast("array<double>")))
    for c in categorical:
        parts.append(_one_hot(F.col(f"_cat_{c}"), F.coalesce(F.col(c), F.col(f"_mode_{c}"))))
    made = joined.withColumn(out, F.concat(*parts))
    return made.select(*rows.columns, out)


def _one_hot(levels: Column, value: Column) -> Column:
    hot = F.transform(levels, lambda k: F.coalesce((k == value).cast("double"), F.lit(0.0)))
    return F.when(F.size(levels) > 1, hot).otherwise(F.array().cast("array<double>"))


# --- Spark ML models ------------------------------------------------------------------------------
def _assembled(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("_vec", array_to_vector(F.col(features)))


def _elastic_model(df: DataFrame, sigma: float, alpha: float, l1_ratio: float, max_iter: int):
    """Spark's elastic net of ``_y`` (unit deviation; sigma is what it had) on ``_vec``."""
    reg = alpha * l1_ratio / sigma + alpha * (1 - l1_ratio)
    return LinearRegression(
        featuresCol="_vec", labelCol="_y", predictionCol="_p", standardization=False, solver="normal",
        regParam=reg, elasticNetParam=(alpha * l1_ratio / sigma) / reg, maxIter=max_iter, tol=1e-10,
    ).fit(df)


def fit_elastic_net(df: DataFrame, features: str, label: str, alpha: float, l1_ratio: float):
    """Elastic net with the objective mse/2 + alpha*(l1*|b| + (1-l1)/2*b^2) on features as given.

    Spark divides only the quadratic part by the label's deviation, so the label is scaled to
    unit deviation and the two penalties are rebalanced; returns (model, sigma, mean), and
    predictions are sigma * model + mean.
    """
    row = df.agg(F.stddev_pop(label).alias("s"), F.avg(label).alias("m")).first()
    sigma, mean = row.s or 1.0, row.m
    scaled = _assembled(df, features).withColumn("_y", (F.col(label) - mean) / sigma)
    return _elastic_model(scaled, sigma, alpha, l1_ratio, ELASTIC_ITERATIONS), sigma, mean


def predict_elastic_net(fitted, df: DataFrame, features: str, out: str = "y_pred") -> DataFrame:
    model, sigma, mean = fitted
    scored = model.transform(_assembled(df, features))
    return scored.withColumn(out, F.col("_p") * sigma + mean).drop("_vec", "_p")


def logistic_params(penalty: str, c: float, n_rows: int) -> dict:
    """Inverse strength C of a summed loss as Spark's penalty of a mean loss."""
    return {"regParam": 1.0 / (c * n_rows), "elasticNetParam": 1.0 if penalty == "l1" else 0.0}


def fit_logistic(df: DataFrame, features: str, label: str, penalty: str, c: float):
    n = df.count()
    return LogisticRegression(
        featuresCol="_vec", labelCol=label, standardization=False, maxIter=LOGISTIC_ITERATIONS,
        predictionCol="_p", probabilityCol="_prob", rawPredictionCol="_raw",
        **logistic_params(penalty, c, n),
    ).fit(_assembled(df, features))


def predict_probability(model, df: DataFrame, features: str, out: str = "y_prob") -> DataFrame:
    scored = model.transform(_assembled(df, features))
    made = [model.getProbabilityCol(), model.getRawPredictionCol(), model.getPredictionCol()]
    return scored.withColumn(out, vector_to_array(made[0])[1]).drop("_vec", *made)


def tree_depth(leaves: int) -> int:
    """Depth of a full tree with at least as many leaves."""
    return max(1, (leaves).bit_length())


def fit_boosted(
    df: DataFrame, features: str, label: str, step: float, leaves: int, min_leaf: int = 10,
    rounds: int = BOOSTING_ROUNDS, binary: bool = False, seed: int = 42,
):
    """Gradient-boosted trees; depth stands in for the leaf count."""
    kind = GBTClassifier if binary else GBTRegressor
    return kind(
        featuresCol="_vec", labelCol=label, predictionCol="_p", maxIter=rounds, stepSize=step,
        maxDepth=tree_depth(leaves), minInstancesPerNode=min_leaf, seed=seed,
        checkpointInterval=10,
    ).fit(_assembled(df, features))


def predict_value(model, df: DataFrame, features: str, out: str = "y_pred") -> DataFrame:
    return model.transform(_assembled(df, features)).withColumnRenamed("_p", out).drop("_vec")


# --- tuning ---------------------------------------------------------------------------------------
def select_candidates(
    fold_scores: DataFrame, task: Sequence[str], params: str, score: str, lower_is_better: bool = True
) -> DataFrame:
    """Mean score of every candidate over the inner folds, then the best one per task."""
    task = list(task)
    means = fold_scores.groupBy(*task, params).agg(
        F.avg(score).alias("inner_score"), F.count(score).alias("n_inner_folds")
    )
    return best_candidate(means, task, "inner_score", params, lower_is_better)


# --- nested elastic net ---------------------------------------------------------------------------
def candidates(grid: Mapping[str, Sequence] = ELASTIC_GRID) -> list[tuple[float, float, str]]:
    """(alpha, l1_ratio, sorted-key JSON text) of every grid point."""
    return [
        (a, r, f'{{"alpha": {a}, "l1_ratio": {r}}}')
        for a in grid["alpha"]
        for r in grid["l1_ratio"]
    ]


def design(df: DataFrame, numeric: Sequence[str], categorical: Mapping[str, Sequence[str]]) -> DataFrame:
    """Observed values and missing marks as two arrays of one length (``obs``, ``miss``).

    A missing number is 0 with mark 1; the median of whatever training set is in force is put in
    later, by algebra. A category is one indicator per level, all marked when it is missing.
    """
    obs, miss = [], []
    for c in numeric:
        obs.append(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
        miss.append(F.col(c).isNull().cast("double"))
    for c, levels in categorical.items():
        for level in levels:
            obs.append(F.coalesce((F.col(c) == level).cast("double"), F.lit(0.0)))
            miss.append(F.col(c).isNull().cast("double"))
    return df.withColumn("obs", F.array(*obs)).withColumn("miss", F.array(*miss))


def set_numbers(inner: DataFrame, group: str, n_outer: int, n_inner: int) -> DataFrame:
    """(group, sets): the numbers of the training sets that each group belongs to.

    A training set is (repeat, outer_fold, inner_fold): the groups that train for the outer fold
    without that inner fold, or all of them for inner_fold 0.
    """
    number = (F.col("repeat") * (n_outer + 1) + F.col("outer_fold")) * (n_inner + 1)
    sets = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(n_inner)), lambda f: f != F.col("inner_fold")), lambda f: number + f
    )
    return inner.groupBy(group).agg(F.flatten(F.collect_list(sets)).alias("sets"))


def set_parts(number: Column, n_outer: int, n_inner: int) -> list[Column]:
    """repeat, outer_fold and inner_fold of a set number."""
    whole = F.floor(number / (n_inner + 1))
    return [
        F.floor(whole / (n_outer + 1)).cast("int").alias("repeat"),
        (whole % (n_outer + 1)).cast("int").alias("outer_fold"),
        (number % (n_inner + 1)).cast("int").alias("inner_fold"),
    ]


def placed_rows(
    rows: DataFrame, outer: DataFrame, splits: Mapping[str, DataFrame], group: str, n_outer: int, n_inner: int
) -> DataFrame:
    """The rows with their group's size (``_n``), its outer fold in every repeat (``_outer``, 0 for none) and its
    inner folds under every split (by name; see ``fold_codes``), written once in even tasks."""
    repeats = outer.agg(F.max("repeat")).first()[0] or 1
    entry = F.struct(F.col("repeat").cast("int").alias("repeat"), F.col("outer_fold").cast("smallint").alias("fold"))
    held = outer.groupBy(group).agg(F.map_from_entries(F.collect_list(entry)).alias("_held"))
    none = F.lit(0).cast("smallint")
    by_repeat = F.transform(F.sequence(F.lit(1), F.lit(repeats)), lambda r: F.coalesce(F.col("_held")[r], none))
    tables = {"_outer": (held.select(group, by_repeat.alias("_outer")), repeats)}
    for name, inner in splits.items():
        codes = fold_codes(inner, group, n_outer, n_inner, repeats).withColumnRenamed("folds", name)
        tables[name] = codes, repeats * n_outer
    groups = rows.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    for table, _ in tables.values():
        groups = groups.join(spread_side(table), group, "left")  # folds are far smaller as files than in memory
    groups = groups.withColumns({c: F.coalesce(c, F.array_repeat(none, n)) for c, (_, n) in tables.items()})
    # few bytes but much work a row: not to be drawn together into few tasks
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(rows.join(spread_side(groups), group).repartition(tasks), "placed-rows")


def under_outer_folds(x: DataFrame, *keep: str) -> DataFrame:
    """``keep`` of every row under each repeat, with the outer fold that holds the row out."""
    spread = x.select(*keep, F.posexplode("_outer").alias("_at", "_fold")).where("_fold > 0")
    return spread.select(*keep, (F.col("_at") + 1).alias("repeat"), F.col("_fold").cast("int").alias("outer_fold"))


def set_products(x: DataFrame, folds: str, numeric: int, categorical: Sequence[str], n_inner: int, each: bool) -> DataFrame:
    """For every training set (its place in ``inside_sets``) what its rows add up to, out of one read.

    A row without ``name``: the sums of v v', v = (1, obs, miss), of v y and of y y, with the least and the
    largest value seen of each of the first ``numeric`` columns; and the rows of every level (``value``)
    of a category ``name``. With ``each`` a set has the outcome of its own place in ``_ys``. Added up for
    all sets at once as matrix products: neither a row nor a group is copied for a set.
    """

    def fold(batches):
        total, lo, hi, levels = 0.0, np.inf, -np.inf, {}
        for batch in pieces(batches, ROWS_A_PRODUCT):
            inside = inside_sets(matrix(batch, "folds"), n_inner)
            obs, miss, y = (matrix(batch, c) for c in ("obs", "miss", "_ys"))
            weight, v = inside.astype(float), np.column_stack([np.ones(len(obs)), obs, miss])
            up = np.triu_indices(v.shape[1])
            at = np.repeat(np.arange(y.shape[1]), n_inner + 1) if each else np.zeros(inside.shape[1], dtype=int)
            own = np.where(inside, y[:, at], 0.0)
            total = total + np.vstack([(v[:, up[0]] * v[:, up[1]]).T @ weight, v.T @ own, (own * own).sum(0)])
            seen = [(obs[:, [j]], inside & (miss[:, [j]] == 0)) for j in range(numeric)]
            lo = np.minimum(lo, np.array([np.where(k, c, np.inf).min(0) for c, k in seen]))
            hi = np.maximum(hi, np.array([np.where(k, c, -np.inf).max(0) for c, k in seen]))
            for c in categorical:
                codes, names = pd.factorize(batch.column(c).to_pandas())
                hot = (codes == np.arange(len(names))[:, None]).astype(float)
                for name, n in zip(names, hot @ weight):
                    levels[c, name] = levels.get((c, name), 0.0) + n
        if not np.isscalar(total):
            n = total.shape[1]
            yield records(range(n), [None] * n, [None] * n, list(lo.T) if numeric else [[]] * n, list(hi.T) if numeric else [[]] * n, list(total.T))
        for (c, name), counts in levels.items():
            n = len(counts)
            yield records(range(n), [c] * n, [name] * n, [None] * n, [None] * n, [[k] for k in counts])

    types = [pa.int32(), pa.string(), pa.string(), *[pa.list_(pa.float64())] * 3]

    def records(*columns):
        arrays = [pa.array(list(c), type=t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays(arrays, ["set", "name", "value", "lo", "hi", "sums"])

    made = x.select(F.col(folds).alias("folds"), "obs", "miss", "_ys", *categorical)
    parts = made.mapInArrow(fold, "set int, name string, value string, lo array<double>, hi array<double>, sums array<double>")
    none = F.array().cast("array<double>")
    ends = [F.array(*[f(F.col(c)[j]) for j in range(numeric)]) if numeric else F.first(none) for f, c in ((F.min, "lo"), (F.max, "hi"))]
    return parts.groupBy("set", "name", "value").agg(sum_vector(F.col("sums")).alias("sums"), ends[0].alias("lo"), ends[1].alias("hi"))


def standardised_moments(products: np.ndarray, fill: np.ndarray, vary: np.ndarray, target: int = 0):
    """Means and scales of the imputed features and of one target, and their joint correlations."""
    p, width = len(fill), int(round(len(products) ** 0.5))
    take = np.zeros((p + 2, width))
    take[0, 0] = take[p + 1, 2 * p + 1 + target] = 1.0
    for j in range(p):
        take[j + 1, 1 + j], take[j + 1, 1 + p + j] = 1.0, fill[j]
    g = take @ products.reshape(width, width) @ take.T
    mean = g[0, 1:] / g[0, 0]
    cov = g[1:, 1:] / g[0, 0] - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    live = np.append(vary, True) & (sd > 0)
    scale = np.where(live, sd, 1.0)
    return mean, scale, cov / np.outer(scale, scale) * np.outer(live, live)


def equal_moments(corr: np.ndarray) -> np.ndarray:
    """As few rows as can be (one more than columns) with mean 0 and these second moments.

    Corners of a regular simplex, stretched by a root of the matrix. A squared-error model depends
    on its rows only through these moments, so it fits these rows as it would the training set.
    """
    m = len(corr)
    values, vectors = np.linalg.eigh(corr)
    root = vectors * np.sqrt(np.maximum(values, 0.0))
    steps = np.arange(1, m + 1)
    simplex = np.tril(np.ones((m, m + 1)))  # Helmert rows: orthonormal, each of sum 0
    simplex[np.arange(m), steps] = -steps
    simplex /= np.sqrt(steps * (steps + 1))[:, None]
    return np.sqrt(m + 1) * simplex.T @ root.T


SAME_ROWS = "set bigint, mean array<double>, scale array<double>, fill array<double>, z array<double>, y double"


def coordinate_descent(corr: np.ndarray, alpha: float, l1_ratio: float, sd_y: float, max_iter: int):
    """Elastic net on standardised features, from their correlations with one another and with the
    label in the last place: coefficients for the unit label, sweeps, and whether they settled."""
    c, own = corr[:-1, :-1], corr[:-1, -1]
    l1, l2 = alpha * l1_ratio / sd_y, alpha * (1 - l1_ratio)
    coef, pull = np.zeros(len(own)), np.zeros(len(own))  # pull = c @ coef
    live = [j for j in range(len(own)) if c[j, j] > 0]
    for sweep in range(1, max_iter + 1):
        most = 0.0
        for j in live:
            left = own[j] - pull[j] + c[j, j] * coef[j]
            new = np.sign(left) * max(abs(left) - l1, 0.0) / (c[j, j] + l2)
            if new != coef[j]:
                most = max(most, abs(new - coef[j]))
                pull += c[:, j] * (new - coef[j])
                coef[j] = new
        if most <= 1e-12:
            return coef, sweep, True
    return coef, max_iter, False


def fit_sets(same: DataFrame, wanted: Mapping[int, Sequence[tuple[float, float, str]]], max_iter: int) -> DataFrame:
    """``FITS`` of every candidate wanted of a set: one task a set, from the moments of its few rows."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        number, first = int(pdf["set"].iloc[0]), pdf.iloc[0]
        mean, scale = np.asarray(first["mean"]), np.asarray(first["scale"])
        rows = np.column_stack([np.stack(pdf["z"]), pdf["y"]])
        corr, out = rows.T @ rows / len(rows), []
        corr[np.abs(corr) < 1e-14] = 0.0
        for alpha, l1_ratio, text in wanted.get(number, ()):
            unit, sweeps, settled = coordinate_descent(corr, alpha, l1_ratio, scale[-1], max_iter)
            coef = unit * scale[-1] / scale[:-1]
            intercept = mean[-1] - coef @ mean[:-1]
            out.append((number, text, float(intercept), coef, first["fill"], sweeps, settled))
        return pd.DataFrame(out, columns=["set", "params", "intercept", "coef", "fill", "n_iter", "converged"])

    # a few kilobytes, but seconds of work: a task a set
    own = same.where(F.col("set").isin(list(wanted))).repartition(max(1, len(wanted)), "set")
    return own.groupBy("set").applyInPandas(fit, FITS)


FITS = "set bigint, params string, intercept double, coef array<double>, fill array<double>, n_iter int, converged boolean"


def imputed(fill: Column) -> Column:
    """obs with the fill value wherever miss is marked."""
    return F.zip_with("obs", F.zip_with("miss", fill, lambda m, f: m * f), lambda a, b: a + b)


def linear_weights(fit, middle: float = 0.0) -> np.ndarray:
    """A fit as weights of (1, obs, miss)."""
    coef = np.asarray(fit["coef"])
    return np.concatenate([[fit["intercept"] + middle], coef, coef * np.asarray(fit["fill"])])


def design_rows(batch: pa.RecordBatch, obs: str = "obs", miss: str = "miss") -> np.ndarray:
    o = matrix(batch, obs)
    return np.column_stack([np.ones(len(o)), o, matrix(batch, miss)])


class TrainingSets:
    """Rows folded for every training set of a split, ready for any number of linear fits.

    ``rows``: from ``placed_rows``; ``folds`` names the split. ``y`` is a number, or an array with an outcome
    for every outer training set, by (repeat - 1) * n_outer + outer_fold - 1.
    """

    def __init__(self, rows, folds, y, numeric, categorical, n_outer, n_inner):
        self.folds, self.n_outer, self.n_inner = folds, n_outer, n_inner
        self.each = rows.schema[y].dataType.typeName() == "array"
        known = {c: F.when(is_finite(c), F.col(c).cast("double")) for c in [*numeric, *([] if self.each else [y])]}
        # numbers around their middle, so that products keep a small spread far from zero
        middle = rows.agg(*[F.avg(v).alias(c) for c, v in known.items()]).first().asDict()
        middle = {c: v if v is not None else 0.0 for c, v in middle.items()}
        self.middle = middle.get(y, 0.0)
        targets = F.col(y) if self.each else F.array(F.col(y).cast("double") - self.middle)
        self.numeric, self.categorical = [f"_x{i}" for i in range(len(numeric))], categorical
        rows = rows.withColumns({x: known[c] - F.lit(middle[c]) for x, c in zip(self.numeric, numeric)})
        self.x = design(rows.withColumn("_ys", targets), self.numeric, categorical)
        # the same out of the rows as they were given
        own = [known[c] - F.lit(middle[c]) for c in numeric]
        obs, miss = [F.coalesce(v, F.lit(0.0)) for v in own], [v.isNull().cast("double") for v in own]
        self.columns = F.array(*obs), F.array(*miss)

    def place(self, repeat: int, outer_fold: int) -> int:
        return (repeat - 1) * self.n_outer + outer_fold - 1

    def moments(self, folds: str = "") -> dict[int, dict]:
        """n, used, mean, scale, fill and corr (see ``standardised_moments``) of every training set with rows, by its
        number. What the driver holds is a row per training set."""
        folds, parts = folds or self.folds, self.n_inner + 1
        sums = set_products(self.x, folds, len(self.numeric), list(self.categorical), self.n_inner, self.each).collect()
        found = nested_quantile(self.x, folds, self.numeric, self.n_inner, 0.5, "median").collect() if self.numeric else []
        median, levels, out = {(r["set"], r["_col"]): r["median"] for r in found}, {}, {}
        for r in sums:
            if r["name"] is not None and r["sums"][0] > 0:
                levels.setdefault((r["set"], r["name"]), {})[r["value"]] = r["sums"][0]
        for r in sums:
            if r["name"] is not None or r["sums"][0] == 0:
                continue
            fill = [median.get((r["set"], j), 0.0) for j in range(len(self.numeric))]
            vary = [hi > lo for lo, hi in zip(r["lo"], r["hi"])]
            for c, names in self.categorical.items():
                seen = levels.get((r["set"], c), {})
                mode = min(seen, key=lambda k: (-seen[k], k), default=None)
                fill += [float(mode == k) for k in names]
                vary += [k in seen and len(seen) > 1 for k in names]
            p, flat = len(fill), np.asarray(r["sums"])
            up, products = np.triu_indices(2 * p + 1), np.zeros((2 * p + 2, 2 * p + 2))
            products[up], products[:-1, -1] = flat[: len(up[0])], flat[len(up[0]) : -1]
            products += np.triu(products, 1).T
            products[-1, -1] = flat[-1]
            mean, scale, corr = standardised_moments(products.ravel(), np.array(fill), np.array(vary, dtype=bool))
            whole, inner_fold = divmod(r["set"], parts)
            repeat, fold = whole // self.n_outer + 1, whole % self.n_outer + 1
            number = (repeat * (self.n_outer + 1) + fold) * parts + inner_fold
            used = np.diag(products)[:-1] > 0  # columns of (1, obs, miss) that are not zero in all rows
            out[number] = {"n": int(flat[0]), "mean": mean, "scale": scale, "fill": fill, "corr": corr, "used": used}
        return dict(sorted(out.items()))

    def same(self, moments: Mapping[int, Mapping]) -> DataFrame:
        """Few rows with the moments of every training set."""
        rows = []
        for number, m in moments.items():
            head = number, m["mean"].tolist(), m["scale"].tolist(), m["fill"]
            rows += [(*head, z[:-1].tolist(), float(z[-1])) for z in equal_moments(m["corr"])]
        return staged(self.x.sparkSession.createDataFrame(rows, SAME_ROWS), "same-moments")

    def fitted(self, same: DataFrame, wanted: Mapping[int, Sequence], max_iter: int) -> DataFrame:
        log = fit_sets(same, wanted, max_iter)
        return staged(log.select(*set_parts(F.col("set"), self.n_outer, self.n_inner), *log.columns[1:]), "fits")

    def number(self, inner_fold: int = 0) -> Column:
        return (F.col("repeat") * (self.n_outer + 1) + F.col("outer_fold")) * (self.n_inner + 1) + inner_fold


def inner_scores(sets: TrainingSets, fits: DataFrame) -> DataFrame:
    """Balanced MAE of every candidate on every inner fold.

    All candidates of all folds are one matrix, as large as the design asks; the rows of a batch that an
    inner fold holds out meet its candidates in one product, and a row's errors count by one over the
    rows of its group. A task yields one row of sums: no row is copied for a fold or a candidate.
    """
    spark, folds, each = sets.x.sparkSession, ["repeat", "outer_fold", "inner_fold"], sets.each
    log = fits.where("inner_fold > 0").orderBy(*folds, "params").collect()
    spans: dict[tuple, list[int]] = {}
    for i, r in enumerate(log):
        spans.setdefault((sets.place(r["repeat"], r["outer_fold"]), r["inner_fold"]), []).append(i)
    context = spark.sparkContext.broadcast((np.array([linear_weights(r) for r in log]).T, spans))

    def errors(batches):
        weights, of = context.value
        total, groups = np.zeros(weights.shape[-1]), np.zeros(weights.shape[-1])
        for batch in pieces(batches, ROWS_A_PRODUCT):
            x, y, share = design_rows(batch), matrix(batch, "_ys"), 1.0 / batch.column("_n").to_numpy()
            own = matrix(batch, "folds")
            for (place, fold), span in of.items():
                at = np.flatnonzero(own[:, place] == fold)
                error = np.abs(y[at, place if each else 0][:, None] - x[at] @ weights[:, span[0] : span[-1] + 1])
                total[span] += share[at] @ error
                groups[span] += share[at].sum()
        ks = pa.array(np.arange(len(total)))
        yield pa.RecordBatch.from_arrays([ks, pa.array(total), pa.array(groups)], ["_k", "_e", "_g"])

    held = sets.x.select(F.col(sets.folds).alias("folds"), "_ys", "obs", "miss", "_n")
    sums = held.mapInArrow(errors, "_k bigint, _e double, _g double").groupBy("_k").agg(F.sum("_e").alias("_e"), F.sum("_g").alias("_g"))
    scored = [(*(log[r["_k"]][c] for c in [*folds, "params"]), r["_e"] / round(r["_g"])) for r in sums.collect() if round(r["_g"])]
    return spark.createDataFrame(scored, "repeat int, outer_fold int, inner_fold int, params string, mae_pb double")


def nested_elastic_net(
    rows: DataFrame,
    outer: DataFrame,
    inner: DataFrame,
    row_id: str,
    group: str,
    y: str,
    numeric: Sequence[str],
    categorical: Mapping[str, Sequence[str]],
    n_outer: int = 5,
    n_inner: int = 4,
    grid: Mapping[str, Sequence] = ELASTIC_GRID,
    max_iter: int = ELASTIC_ITERATIONS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tune on outer-training groups, refit, predict the held-out groups.

    ``outer``: repeat, group, outer_fold; ``inner``: repeat, outer_fold, group, inner_fold (the groups that
    train for that outer fold). ``y``: see ``TrainingSets``. Returns (fit log, selected parameters,
    predictions). The rows are read for their statistics, for the scores and for the predictions,
    however many fits there are: a task fits a training set's candidates from its moments.
    """
    placed = placed_rows(rows, outer, {"_folds": inner}, group, n_outer, n_inner)
    sets = TrainingSets(placed, "_folds", y, numeric, categorical, n_outer, n_inner)
    tuned, chosen, final = _tuned(sets, grid, max_iter)
    task = ["repeat", "outer_fold"]
    test = under_outer_folds(sets.x, row_id, group, y, "obs", "miss")
    scored = test.join(F.broadcast(final.select(*task, "params", "intercept", "coef", "fill")), task)  # a row per outer fold
    pred = F.col("intercept") + dot(imputed(F.col("fill")), F.col("coef")) + sets.middle
    predictions = scored.select(*task, row_id, group, y, "params", pred.alias("y_pred"))
    return tuned.unionByName(final), chosen, predictions


def _tuned(sets: TrainingSets, grid: Mapping[str, Sequence], max_iter: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All fits of the inner folds, the parameters chosen, and their fits to the whole training sets."""
    task, points, moments = ["repeat", "outer_fold"], candidates(grid), sets.moments()
    same = sets.same(moments)
    tuned = sets.fitted(same, {n: points for n in moments if n % (sets.n_inner + 1)}, max_iter)
    chosen = staged(select_candidates(inner_scores(sets, tuned), task, "params", "mae_pb"), "chosen")
    by_text = {text: (a, r, text) for a, r, text in points}
    refit = {r["set"]: [by_text[r.params]] for r in chosen.select(sets.number().alias("set"), "params").collect()}
    return tuned, chosen, sets.fitted(same, refit, max_iter)


# --- residual correctors ---------------------------------------------------------------------------
def listed(values: np.ndarray, known: np.ndarray) -> pa.Array:
    """A matrix as an array column, missing where not known."""
    ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(values.ravel(), mask=~known.ravel()))


def cross_fitted(
    sets: TrainingSets, cross: str, chosen: DataFrame, final: DataFrame, keep: Sequence[str],
    grid: Mapping[str, Sequence], max_iter: int,
) -> DataFrame:
    """``keep`` of the rows with ``context_preds``: for every outer training set, by the place of its target, the
    prediction of a model fitted to the other cross folds with the parameters chosen there; missing
    where the row's group is held out. ``cross`` names a split like that of ``sets``. ``_context``: for every
    repeat the prediction of the model (``final``) of the outer fold that holds the row out."""
    by_text = {text: (a, r, text) for a, r, text in candidates(grid)}
    each = chosen.select("params", F.explode(F.array(*[sets.number(f) for f in range(1, sets.n_inner + 1)])).alias("set"))
    moments = sets.moments(cross)
    wanted = {r["set"]: [by_text[r.params]] for r in each.collect() if r["set"] in moments}
    fits = sets.fitted(sets.same(moments), wanted, max_iter).collect()
    weights = {(sets.place(r["repeat"], r["outer_fold"]), r["inner_fold"]): linear_weights(r, sets.middle) for r in fits}
    whole = {(r["repeat"], r["outer_fold"]): linear_weights(r, sets.middle) for r in final.collect()}

    def predicted(batches):
        for batch in pieces(batches, ROWS_A_PRODUCT):
            x, folds, outer = design_rows(batch), matrix(batch, "_folds"), matrix(batch, "_fold")
            inside, inside_known = np.zeros(folds.shape), np.zeros(folds.shape, dtype=bool)
            for (place, fold), w in weights.items():
                at = np.flatnonzero(folds[:, place] == fold)
                inside[at, place], inside_known[at, place] = x[at] @ w, True
            held, held_known = np.zeros(outer.shape), np.zeros(outer.shape, dtype=bool)
            for (repeat, fold), w in whole.items():
                at = np.flatnonzero(outer[:, repeat - 1] == fold)
                held[at, repeat - 1], held_known[at, repeat - 1] = x[at] @ w, True
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, listed(inside, inside_known), listed(held, held_known)], names=names)

    names = [*keep, "context_preds", "_context"]
    schema = T.StructType([sets.x.schema[c] for c in keep])
    for c in names[len(keep) :]:
        schema = schema.add(c, T.ArrayType(T.DoubleType()))
    # under names of their own, since folds may be among the columns kept
    made = sets.x.select(*keep, "obs", "miss", F.col(cross).alias("_folds"), F.col("_outer").alias("_fold"))
    return made.mapInArrow(predicted, schema)


def residual_chain(
    rows: DataFrame,
    outer: DataFrame,
    inner: DataFrame,
    cross: DataFrame,
    family_inner: Mapping[str, DataFrame],
    row_id: str,
    group: str,
    y: str,
    numeric: Sequence[str],
    categorical: Mapping[str, Sequence[str]],
    families: Mapping[str, Sequence[str]],
    n_outer: int = 5,
    n_inner: int = 4,
    grid: Mapping[str, Sequence] = ELASTIC_GRID,
    max_iter: int = ELASTIC_ITERATIONS,
) -> tuple[DataFrame, DataFrame]:
    """What each family of sensors explains beyond the context, out of fold.

    A context model is tuned per outer training set; its predictions inside that set are
    cross-fitted with the parameters chosen, and each family's corrector is tuned and fitted to what
    they leave (``family_inner``: its inner folds). A held-out row gets the context prediction plus
    the residual its sensors predict. Row ids must be unique. Returns (repeat, outer_fold, row_id, group, variant, params,
    y_true, y_pred) and the training rows' (row_id, repeat, outer_fold, context_pred, residual).
    """
    splits = {"_inner": inner, "_cross": cross, **{f"_own{i}": family_inner[f] for i, f in enumerate(families)}}
    placed = placed_rows(rows, outer, splits, group, n_outer, n_inner)
    sets = TrainingSets(placed, "_inner", y, numeric, categorical, n_outer, n_inner)
    _, chosen, final = _tuned(sets, grid, max_iter)
    columns = dict.fromkeys(c for own in families.values() for c in own)
    keep = list(dict.fromkeys([row_id, group, y, *columns, "_n", "_outer", *list(splits)[2:]]))
    placed = cross_fitted(sets, "_cross", chosen, final, keep, grid, max_iter)
    left = F.transform("context_preds", lambda p: F.coalesce(F.col(y) - p, F.lit(0.0)))
    placed = staged(placed.withColumn("_left", left), "residual-rows")
    models, test = [(final.collect(), sets.middle)], placed
    for i, own in enumerate(families.values()):
        sets = TrainingSets(placed, f"_own{i}", "_left", own, {}, n_outer, n_inner)
        models.append((_tuned(sets, grid, max_iter)[2].collect(), 0.0))
        made = {c: e for c, e in zip(("obs", "miss"), sets.columns)}
        test = test.withColumns({f"_{c}{i}": e for c, e in made.items()})
    predictions = corrected(test, models, ["ContextOnly", *[f"Residualized_{f}" for f in families]], row_id, group, y)
    training = placed.select(row_id, y, F.posexplode("context_preds").alias("_at", "context_pred")).where("context_pred IS NOT NULL")
    training = training.select(
        row_id, (F.floor(F.col("_at") / n_outer) + 1).cast("int").alias("repeat"),
        (F.col("_at") % n_outer + 1).cast("int").alias("outer_fold"), "context_pred",
        (F.col(y) - F.col("context_pred")).alias("residual"),
    )
    return predictions, training


def corrected(test: DataFrame, models: Sequence, variants: Sequence[str], row_id: str, group: str, y: str) -> DataFrame:
    """Every row under every repeat and variant: its context prediction, and that plus each family's residual.

    ``test``: ``_context``, ``_outer`` and the families' columns as ``_obs0``, ``_miss0``, …; ``models``: fits of the
    context and of every family. A row's predictions are made side by side, so nothing is joined by row."""
    spark, n = test.sparkSession, len(variants)
    weights = [{(r["repeat"], r["outer_fold"]): linear_weights(r, middle) for r in fits} for fits, middle in models]

    def predicted(batches):
        for batch in pieces(batches, ROWS_A_PRODUCT):
            base, outer = matrix(batch, "_context"), matrix(batch, "_outer")
            known = np.stack([outer > 0] * n, axis=2)
            values = np.stack([base] * n, axis=2)
            for i, own in enumerate(weights[1:]):
                x, trained, done = design_rows(batch, f"_obs{i}", f"_miss{i}"), matrix(batch, "_trained")[:, 0] > 0, np.zeros(outer.shape, dtype=bool)
                for (repeat, fold), w in own.items():
                    at = np.flatnonzero((outer[:, repeat - 1] == fold) & trained)
                    values[at, repeat - 1, i + 1] += x[at] @ w
                    done[at, repeat - 1] = True
                known[:, :, i + 1] &= done
            for (repeat, fold) in {(r + 1, f) for r in range(outer.shape[1]) for f in np.unique(outer[:, r])} - set(weights[0]):
                known[outer[:, repeat - 1] == fold, repeat - 1] = False
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, listed(values.reshape(len(outer), -1), known.reshape(len(outer), -1))], names=[*keep, "_preds"])

    keep = list(dict.fromkeys([row_id, group, y, "_outer"]))
    schema = T.StructType([test.schema[c] for c in keep]).add("_preds", T.ArrayType(T.DoubleType()))
    trained = F.array(F.exists("context_preds", lambda p: p.isNotNull()).cast("int")).alias("_trained")
    made = [f"_{c}{i}" for i in range(n - 1) for c in ("obs", "miss")]
    rows = test.select(*keep, "_context", trained, *made).mapInArrow(predicted, schema)
    rows = rows.select(*keep, F.posexplode("_preds").alias("_at", "y_pred")).where("y_pred IS NOT NULL")
    repeat = F.floor(F.col("_at") / n).cast("int")
    rows = rows.select(
        (repeat + 1).alias("repeat"), F.col("_outer")[repeat].cast("int").alias("outer_fold"), (F.col("_at") % n).alias("_v"),
        *keep[:-1], "y_pred",
    )
    names = [(r["repeat"], r["outer_fold"], v, variants[v], r["params"]) for v, (fits, _) in enumerate(models) for r in fits]
    names = spark.createDataFrame(names, "repeat int, outer_fold int, _v int, variant string, params string")
    task = ["repeat", "outer_fold"]
    rows = rows.join(F.broadcast(names), [*task, "_v"])  # a row per outer fold and variant
    return rows.select(*task, row_id, group, F.col(y).alias("y_true"), "params", "y_pred", "variant")
