"""Cross-validation of Spark ML models out of fold, one resumable part per fold.

Nested linear models go through ``learners.nested_elastic_net``, which fits everything from group
sums. Models that need the rows (logistic, boosted trees) are fitted here, one distributed fit
after the other; folds may run side by side, as Spark's own cross-validator does.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.operators import learners as lr
from cohortlift.operators import metrics as mt
from cohortlift.operators.training import others
from cohortlift.sources.tables import remaining, staged, stored

ROWS_A_TASK = 100_000
#: fit (rows with ``features``) -> model, and predict (model, rows, name of the new column)
Model = tuple[Callable[[DataFrame], object], Callable[[object, DataFrame, str], DataFrame]]


def logistic_candidates(y: str, grid: Mapping[str, Sequence] = lr.LOGISTIC_GRID) -> dict[str, Model]:
    """Parameter text -> (fit, predict) for every logistic grid point."""
    def one(penalty: str, c: float) -> Model:
        return (
            lambda df: lr.fit_logistic(df, "features", y, penalty, c),
            lambda m, df, out: lr.predict_probability(m, df, "features", out),
        )

    return {
        f'{{"c": {c}, "penalty": "{p}"}}': one(p, c) for p in grid["penalty"] for c in grid["c"]
    }


def boosting_candidates(
    y: str, binary: bool, min_leaf: int = 10, rounds: int = lr.BOOSTING_ROUNDS,
    grid: Mapping[str, Sequence] = lr.BOOSTING_GRID,
) -> dict[str, Model]:
    """Parameter text -> (fit, predict) for every boosting grid point."""
    def predict(m, df, out):
        scored = lr.predict_probability if binary else lr.predict_value
        return scored(m, df, "features", out)

    def one(step: float, leaves: int) -> Model:
        return (
            lambda df: lr.fit_boosted(df, "features", y, step, leaves, min_leaf, rounds, binary),
            predict,
        )

    return {
        f'{{"leaves": {v}, "step": {s}}}': one(s, v) for s in grid["step"] for v in grid["leaves"]
    }


def balanced_mae(df: DataFrame, by: Sequence[str], group: str, y: str) -> DataFrame:
    return mt.regression_metrics(df, by, group, y, "pred").select(*by, F.col("mae_pb").alias("score"))


def average_precision(df: DataFrame, by: Sequence[str], group: str, y: str) -> DataFrame:
    return mt.ranking_metrics(df, by, y, "pred").select(*by, F.col("pr_auc").alias("score"))


def elastic_candidates(y: str, grid: Mapping[str, Sequence] = lr.ELASTIC_GRID) -> dict[str, Model]:
    """Parameter text -> (fit, predict) for every elastic-net grid point."""
    def one(alpha: float, l1_ratio: float) -> Model:
        return (
            lambda df: lr.fit_elastic_net(df, "features", y, alpha, l1_ratio),
            lambda m, df, out: lr.predict_elastic_net(m, df, "features", out),
        )

    return {text: one(a, r) for a, r, text in lr.candidates(grid)}


def _predicted(models: Mapping[str, Model], fitted: Mapping[str, object], held: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep, params, pred): every held-out row once per candidate, all candidates in one read."""
    names = {f"_p{k}": text for k, text in enumerate(fitted)}
    for column, text in names.items():
        held = models[text][1](fitted[text], held, column)
    each = F.array(*[F.struct(F.lit(text).alias("params"), F.col(c).alias("pred")) for c, text in names.items()])
    return held.select(*keep, F.explode(each).alias("_e")).select(*keep, "_e.params", "_e.pred")


def _finish(spark, grid: DataFrame, path: str, keys: Sequence[str], run: Callable, side_by_side: int) -> DataFrame:
    """Run the parts of ``grid`` that are not stored yet, some side by side; all parts' rows."""
    done = stored(spark, path)
    grid = grid if done is None else remaining(grid, done, keys)
    todo = [tuple(r) for r in grid.select(*keys).collect()]  # as many as there are folds
    if todo:
        # wrapped one by one: parts that share their local properties would mix up their jobs
        parts = [inheritable_thread_target(spark)(partial(run, *part)) for part in todo]
        with ThreadPool(min(side_by_side, len(todo))) as pool:
            pool.map(lambda part: part(), parts)
    return spark.read.parquet(path)


def _tasks(rows: DataFrame) -> int:
    """Tasks of a fit: an iterative fit pays for each in every step, so small tables have one."""
    return max(1, -(-rows.count() // ROWS_A_TASK))


def out_of_fold(
    rows: DataFrame,
    folds: DataFrame,
    row_id: str,
    group: str,
    y: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    models: Mapping[str, Model],
    path: str,
    n_folds: int = 5,
    side_by_side: int = 5,
) -> DataFrame:
    """(fold, row_id, group, y, params, pred): each row scored by every candidate, fitted on the
    other folds' groups only, with preprocessing learnt there too.

    ``folds``: group, fold. The rows are written once with their fold; a training set is a filter
    on it. A finished fold is kept below ``path``; a rerun does the rest.
    """
    spark = rows.sparkSession
    placed = staged(rows.join(folds.select(group, "fold"), group), "placed-rows")
    tasks = _tasks(placed)
    members = folds.select("fold").distinct().withColumn("sets", others("fold", n_folds))
    fitted = staged(lr.fit_training_sets(placed, members, "fold", numeric, categorical), "preprocessing")

    def run(fold: int) -> None:
        def made(d: DataFrame) -> DataFrame:
            one = fitted.where(F.col("set") == fold)
            return lr.apply_preprocessing(d.withColumn("set", F.lit(fold)), one, ["set"], numeric, categorical)

        train = made(placed.where(F.col("fold") != fold)).select("features", y).coalesce(tasks).persist()
        found = {text: fit(train) for text, (fit, _) in models.items()}
        held = made(placed.where(F.col("fold") == fold)).select(row_id, group, y, "features")
        _predicted(models, found, held, [row_id, group, y]).write.mode("overwrite").parquet(f"{path}/fold={fold}")
        train.unpersist()

    return _finish(spark, folds.select("fold").distinct(), path, ["fold"], run, side_by_side)


def nested_models(
    rows: DataFrame,
    outer: DataFrame,
    inner: DataFrame,
    row_id: str,
    group: str,
    y: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    models: Mapping[str, Model],
    score: Callable[..., DataFrame],
    path: str,
    lower_is_better: bool = True,
    side_by_side: int = 8,
) -> DataFrame:
    """Out-of-fold predictions with the selected parameters and inner score of their fold.

    The rows are written once with the folds they are in, under every split; a training set is a
    filter on them and statistics of all training sets come out of one read. Results of an outer
    fold are written below ``path`` when it is done; a rerun does the rest.
    """
    spark = rows.sparkSession
    task = ["repeat", "outer_fold"]
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in task])
    held_in = outer.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("repeat", "outer_fold"))).alias("_outer"))
    trains = inner.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct(name, "inner_fold"))).alias("_inner"))
    placed = staged(rows.join(held_in, group, "left").join(trains, group, "left"), "placed-rows")
    tasks = _tasks(placed)
    n_outer, n_inner = inner.agg(F.max("outer_fold"), F.max("inner_fold")).first()
    members = lr.set_numbers(inner, group, n_outer, n_inner)
    fitted = staged(lr.fit_training_sets(placed, members, group, numeric, categorical), "preprocessing")

    def run(repeat: int, fold: int) -> None:
        own = F.col("_inner")[f"{repeat}|{fold}"]  # missing where the group is held out
        first = (repeat * (n_outer + 1) + fold) * (n_inner + 1)

        def made(d: DataFrame, inner_fold: int) -> DataFrame:
            number = first + inner_fold
            one = fitted.where(F.col("set") == number)
            d = d.withColumn("set", F.lit(number).cast("bigint"))
            return lr.apply_preprocessing(d, one, ["set"], numeric, categorical)

        scored = []
        for f in range(1, n_inner + 1):
            train = made(placed.where(own != f), f).select("features", y).coalesce(tasks).persist()
            found = {text: fit(train) for text, (fit, _) in models.items()}
            held = made(placed.where(own == f), f).select(group, y, "features")
            scored.append(_predicted(models, found, held, [group, y]).withColumn("inner_fold", F.lit(f)))
            train.unpersist()
        folds_scored = score(reduce(DataFrame.unionByName, scored), ["params", "inner_fold"], group, y)
        chosen = lr.select_candidates(
            folds_scored.withColumn("_t", F.lit(0)), ["_t"], "params", "score", lower_is_better
        ).first()
        train = made(placed.where(own.isNotNull()), 0).select("features", y).coalesce(tasks).persist()
        found = {chosen.params: models[chosen.params][0](train)}
        held = made(placed.where(F.col("_outer")[repeat] == fold), 0).select(row_id, group, y, "features")
        pred = _predicted(models, found, held, [row_id, group, y]).withColumn("inner_score", F.lit(chosen.inner_score))
        # a folder per fold: folds that finish together never share a commit
        pred.write.mode("overwrite").parquet(f"{path}/repeat={repeat}/outer_fold={fold}")
        train.unpersist()

    return _finish(spark, outer.select(*task).distinct(), path, task, run, side_by_side)
