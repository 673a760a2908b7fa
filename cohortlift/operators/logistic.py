"""Nested logistic models: every training set and candidate in the same passes over the rows.

A pass adds up gradient and curvature at points of all training sets as matrix products, batch by batch;
a Newton step of a model is then a small problem with its penalty, solved by coordinates. All models
begin where one model of the largest set ends, and models of a set that stand close together share a
point: the more rows, the fewer points. A model that has settled leaves the passes.

Held-out rows are shipped once a training set, not once a candidate, and ranked there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.operators import learners as lr
from cohortlift.operators.embeddings import dot, sum_vector
from cohortlift.operators.training import inside_sets, matrix, pieces
from cohortlift.sources.tables import staged

STEPS = 100
ROWS_A_PRODUCT = 500
#: root mean square change of the log odds below which a Newton step ends the fit of a candidate: what is
#: left is of the order of its square. Sums over many rows are not exact enough to see a gain of 1e-14
NEAR = 1e-4
NEAR_FINAL = 1e-6
ROWS_A_SHIPMENT = 100_000
#: held-out rows of a training set that a task ranks; more are cut into ranges of the score
ROWS_A_RANGE = 1_000_000
SLICES = 1_024
LEAST = 1e-6  # probabilities are kept off zero and one, as in the metrics


def newton_step(b: np.ndarray, g: np.ndarray, h: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Minimum of g d + d h d / 2 + the penalty of b + d; the first coefficient is free.

    Without l1 one linear system. With it sweeps by coordinates find who is zero, and a linear system
    the others; more sweeps where that breaks a sign or a bound. Who was zero before is tried first.
    """
    h = h + 1e-12 * np.eye(len(b))
    h[1:, 1:] += l2 * np.eye(len(b) - 1)
    slope = g + np.append(0.0, l2 * b[1:])  # of the smooth part at b
    if l1 == 0:
        return b - np.linalg.solve(h, slope)
    new, free = b.copy(), np.arange(len(b)) == 0
    for attempt in range(21):
        for _ in range(10 if attempt else 0):
            for j in range(len(b)):
                if h[j, j] > 2e-12:
                    at = new[j] - (slope[j] + h[j] @ (new - b)) / h[j, j]
                    new[j] = at if j == 0 else np.sign(at) * max(abs(at) - l1 / h[j, j], 0.0)
        on = free | (new != 0)
        to, sign = np.zeros(len(b)), np.where(free, 0.0, np.sign(new))
        to[on] = np.linalg.solve(h[np.ix_(on, on)], (h @ b - slope - l1 * sign)[on])
        left = slope + h @ (to - b)
        if (to * sign >= 0).all() and (np.abs(left[~on]) <= l1 * (1 + 1e-9)).all():
            return to
    return new


class Model:
    """One candidate on one training set, in standardised features (the intercept comes first)."""

    def __init__(self, shape, n: int, penalty: str, c: float, near: float = 0.0):
        self.mean, self.scale, fill = (np.asarray(shape[k]) for k in ("mean", "scale", "fill"))
        p = len(fill)
        self.take = np.zeros((p + 1, 2 * p + 1))
        self.take[0, 0] = 1.0
        for j in range(p):
            self.take[j + 1, [0, 1 + j, 1 + p + j]] = np.array([-self.mean[j], 1.0, fill[j]]) / self.scale[j]
        self.corr = np.asarray(shape["corr"])[:p, :p] if "corr" in shape else np.eye(p)
        self.n, self.near, reg = n, near, 1.0 / (c * n)
        self.l1, self.l2 = (reg, 0.0) if penalty == "l1" else (0.0, reg)
        self.b = np.zeros(p + 1)
        self.last, self.done = None, False

    def begin(self, other: Model) -> None:
        """Take over the point of a model of another training set."""
        p = len(self.b) - 1
        coef = other.b[1:] / other.scale[:p]
        self.b = np.append(other.b[0] + coef @ (self.mean[:p] - other.mean[:p]), coef * self.scale[:p])
        self.b[1:][np.diag(self.corr) == 0] = 0.0

    def moved(self, b: np.ndarray) -> float:
        """Root mean square change of the log odds from b to the present point."""
        step = self.b - b
        return float(np.sqrt(step[0] ** 2 + max(step[1:] @ self.corr @ step[1:], 0.0)))

    def raw(self) -> np.ndarray:
        return self.b @ self.take

    def advance(self, sums: np.ndarray) -> None:
        """Go on from the sums (loss, gradient, curvature) taken at the present point."""
        width = self.take.shape[1]
        loss = sums[0] / self.n + self.l1 * np.abs(self.b[1:]).sum() + self.l2 / 2 * (self.b[1:] ** 2).sum()
        if self.last is not None and loss > self.last[0] + 1e-13 * abs(self.last[0]):
            if np.abs(self.b - self.last[1]).max() < 1e-7:
                self.b, self.done = self.last[1], True
            else:
                self.b = (self.b + self.last[1]) / 2  # too far: half the way
            return
        gain = np.inf if self.last is None else self.last[0] - loss
        g = self.take @ sums[1 : 1 + width] / self.n
        h = self.take @ unpacked(sums[1 + width :], width) @ self.take.T / self.n
        self.last, self.b = (loss, self.b), newton_step(self.b, g, h, self.l1, self.l2)
        if np.abs(self.b - self.last[1]).max() < 1e-7 or gain <= 1e-14 * abs(loss) or self.moved(self.last[1]) < self.near:
            self.done = True


def unpacked(upper: np.ndarray, width: int) -> np.ndarray:
    h = np.zeros((width, width))
    h[np.triu_indices(width)] = upper
    return h + np.triu(h, 1).T


def passed(held: DataFrame, weights: np.ndarray, place: np.ndarray, n_inner: int) -> dict[int, np.ndarray]:
    """Loss, gradient and curvature (upper triangle) at every point (``weights``), added up over the rows of the
    training set at its ``place`` in ``inside_sets``.

    ``held``: v, label, folds."""
    context = held.sparkSession.sparkContext.broadcast((weights, place))

    def add(batches):
        w, at = context.value
        up, total = np.triu_indices(w.shape[1]), 0.0
        for batch in pieces(batches, ROWS_A_PRODUCT):
            v = matrix(batch, "v")
            inside = inside_sets(matrix(batch, "folds"), n_inner)[:, at].astype(float)
            y, across = batch.column("label").to_numpy(zero_copy_only=False)[:, None], np.ascontiguousarray(v.T)
            eta = v @ w.T
            small = np.exp(-np.abs(eta))
            prob = np.where(eta >= 0, 1.0, small) / (1.0 + small)
            loss = np.log1p(small) + np.maximum(eta, 0.0) - y * eta
            curve = (across[up[0]] * across[up[1]]) @ (prob * (1 - prob) * inside)
            total = total + np.vstack([(loss * inside).sum(0), across @ ((prob - y) * inside), curve])
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at))), pa.array(list(total.T))], ["_k", "sums"])

    parts = held.select("v", "label", "folds").mapInArrow(add, "_k bigint, sums array<double>")
    return {r["_k"]: np.array(r["sums"]) for r in parts.groupBy("_k").agg(sum_vector(F.col("sums")).alias("sums")).collect()}


def fit_all(held: DataFrame, models: Sequence[tuple[int, Model]], used: np.ndarray, n_inner: int) -> None:
    """Fit models (place of the training set, model) side by side until every one has settled; ``used``: which
    of (1, obs, miss) v holds. Models of a set that are closer than half of NEAR go on from one point."""
    for _ in range(STEPS):
        points: dict[int, list[tuple[int, Model]]] = {}
        todo, first = [], []
        for s, m in models:
            if m.done:
                continue
            for k, other in points.setdefault(s, []):
                if np.array_equal(m.b, other.b):
                    break
                if m.moved(other.b) < m.near / 2:
                    m.b, m.last = other.b, None
                    break
            else:
                k = len(first)
                points[s].append((k, m))
                first.append((s, m))
            todo.append((k, m))
        if not todo:
            return
        sums = passed(held, np.array([m.raw()[used] for _, m in first]), np.array([s for s, _ in first]), n_inner)
        for k, m in todo:
            m.advance(widened(sums[k], used, m.take.shape[1]))


def widened(sums: np.ndarray, used: np.ndarray, width: int) -> np.ndarray:
    """Sums over the columns in use as sums over all; the others are zero in every row."""
    g, h = np.zeros(width), np.zeros((width, width))
    g[used] = sums[1 : 1 + len(used)]
    h[np.ix_(used, used)] = unpacked(sums[1 + len(used) :], len(used))
    return np.concatenate([sums[:1], g, h[np.triu_indices(width)]])


# --- held-out ranking ------------------------------------------------------------------------------
def scores(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Clipped probabilities of rows (columns of ``v``), in a fixed order of operations: equal rows get equal
    scores, and a row gets the same one wherever it is scored."""
    eta = w[0] * v[0]
    for j in range(1, len(w)):
        eta = eta + w[j] * v[j]
    prob = 1.0 / (1.0 + np.exp(-eta))
    if not np.isfinite(prob).all():
        raise ValueError("a probability is missing or not finite")
    return np.clip(prob, LEAST, 1.0 - LEAST)


def precision_part(score: np.ndarray, y: np.ndarray, above: tuple[float, float]) -> float:
    """What the rows of a range of scores add to (average precision x positives), ties collapsed;
    ``above``: positives and negatives of the higher ranges."""
    order = np.argsort(-score, kind="stable")
    score, y = score[order], y[order]
    ends = np.append(np.flatnonzero(np.diff(score)), len(score) - 1)
    tp, fp = np.cumsum(y)[ends], np.cumsum(1.0 - y)[ends]
    pos, tp, fp = np.diff(tp, prepend=0.0), tp + above[0], fp + above[1]
    some = tp + fp > 0
    return float((pos[some] * tp[some] / (tp[some] + fp[some])).sum())


def cut_points(held: DataFrame, weights: Mapping, ranges: Mapping, spread: Mapping) -> dict:
    """(place, fold) -> for each candidate the scores at which its held-out rows are cut into about even ranges, and
    the positives and negatives above each range, from the counts of ``SLICES`` slices of the log odds
    (``spread``: their middle and deviation by candidate)."""
    wanted = {key: weights[key] for key, n in ranges.items() if n > 1}
    if not wanted:
        return {}
    context = held.sparkSession.sparkContext.broadcast((wanted, spread))

    def edges(middle, deviation):
        return middle + deviation * (np.arange(1, SLICES) - SLICES // 2) / (SLICES // 16)

    def count(batches):
        of, around = context.value
        cuts = {key: [scores(edges(*a)[None, :], np.ones(1)) for a in around[key]] for key in of}
        total = {key: np.zeros((len(w), 2 * SLICES)) for key, w in of.items()}
        for batch in pieces(batches, ROWS_A_PRODUCT):
            v, folds, label = matrix(batch, "v").T, matrix(batch, "folds"), batch.column("label").to_numpy(zero_copy_only=False)
            for (place, fold), w in of.items():
                own = folds[:, place] == fold
                mine, y = v[:, own], label[own]
                for i in range(len(w)):
                    at = np.searchsorted(cuts[place, fold][i], scores(mine, w[i]), "right")
                    total[place, fold][i, :SLICES] += np.bincount(at, y, SLICES)
                    total[place, fold][i, SLICES:] += np.bincount(at, 1.0 - y, SLICES)
        for (place, fold), rows in total.items():
            n = len(rows)
            columns = [pa.array([place] * n, pa.int32()), pa.array([fold] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(list(rows))]
            yield pa.RecordBatch.from_arrays(columns, ["place", "fold", "i", "counts"])

    parts = held.select("v", "label", "folds").mapInArrow(count, "place int, fold int, i int, counts array<double>")
    out: dict = {}
    for r in parts.groupBy("place", "fold", "i").agg(sum_vector(F.col("counts")).alias("counts")).orderBy("place", "fold", "i").collect():
        key = r["place"], r["fold"]
        upto = np.cumsum(np.reshape(r["counts"], (2, SLICES)), axis=1)
        below = upto.sum(0)
        at = np.minimum(np.searchsorted(below[:-1], below[-1] * np.arange(1, ranges[key]) / ranges[key]), SLICES - 2)
        cuts = scores(edges(*spread[key][r["i"]])[None, :], np.ones(1))
        out.setdefault(key, []).append((cuts[at], upto[:, -1:] - upto[:, np.append(at, SLICES - 1)]))
    return out


def held_out_precision(held: DataFrame, weights: Mapping, ranges: Mapping, spread: Mapping) -> dict:
    """(place, fold) -> average precision of every candidate (rows of ``weights``) on the rows that the inner fold
    holds out; missing where a class is absent.

    Rows go once to the task of their training set, packed column by column, and not once a candidate. A
    set of many rows is cut into ranges of the score: a row goes to the ranges that its candidates put it in,
    which are the same for like candidates."""
    cuts = cut_points(held, weights, ranges, spread)
    context = held.sparkSession.sparkContext.broadcast((weights, cuts))

    def shipped(batches):
        of, at = context.value
        for table in gathered(batches, ROWS_A_SHIPMENT):
            v, folds = matrix(table, "v").T, matrix(table, "folds")
            label = table.column("label").to_numpy(zero_copy_only=False)
            if not np.isfinite(label).all():
                raise ValueError("an outcome is missing or not finite")
            for (place, fold), w in of.items():
                mine = np.flatnonzero(folds[:, place] == fold)
                if not len(mine):
                    continue
                x, y = v[:, mine], label[mine]
                if (place, fold) not in at:
                    yield shipment(place, fold, 0, x, y, np.ones((len(w), len(y)), dtype=bool))
                    continue
                into = np.array([np.searchsorted(c, scores(x, one), "right") for (c, _), one in zip(at[place, fold], w)])
                for r in np.unique(into):
                    own = into == r
                    some = own.any(0)
                    yield shipment(place, fold, int(r), x[:, some], y[some], own[:, some])

    def shipment(place, fold, r, x, y, own):
        packed = [np.ascontiguousarray(x).tobytes(), y.tobytes(), b"" if own.all() else own.tobytes()]
        columns = [*[pa.array([k], pa.int32()) for k in (place, fold, r)], *[pa.array([k], pa.binary()) for k in packed]]
        return pa.RecordBatch.from_arrays(columns, [*key, "v", "y", "own"])

    key = ["place", "fold", "range"]
    ready = held.select("v", "label", "folds").mapInArrow(shipped, "place int, fold int, range int, v binary, y binary, own binary")

    def ranked(pdf: pd.DataFrame) -> pd.DataFrame:
        place, fold, r = (int(pdf[c].iloc[0]) for c in key)
        w, at = context.value[0][place, fold], context.value[1].get((place, fold))
        y = [np.frombuffer(b) for b in pdf["y"]]
        x = np.concatenate([np.frombuffer(b).reshape(-1, len(n)) for b, n in zip(pdf["v"], y)], axis=1)
        own = [np.frombuffer(b, dtype=bool).reshape(len(w), -1) if b else np.ones((len(w), len(n)), dtype=bool) for b, n in zip(pdf["own"], y)]
        y, own = np.concatenate(y), np.concatenate(own, axis=1)
        parts = np.zeros((len(w), 3))
        for i, one in enumerate(w):
            mine = slice(None) if own[i].all() else own[i]
            if own[i].any():
                above = at[i][1][:, r] if at else (0.0, 0.0)
                parts[i] = precision_part(scores(x[:, mine], one), y[mine], above), y[mine].sum(), (1.0 - y[mine]).sum()
        return pd.DataFrame({"place": place, "fold": fold, "parts": [parts.ravel()]})

    out = ready.groupBy(*key).applyInPandas(ranked, "place int, fold int, parts array<double>")
    sums: dict = {}
    for r in out.collect():
        sums[r["place"], r["fold"]] = sums.get((r["place"], r["fold"]), 0.0) + np.reshape(r["parts"], (-1, 3))
    return {k: [float(a / p) if p > 0 and n > 0 else None for a, p, n in own] for k, own in sums.items()}


def gathered(batches, rows: int):
    """Batches put together until they have so many rows."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            some, n = [], 0
    if n:
        yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]


def nested_logistic(
    rows: DataFrame, outer: DataFrame, inner: DataFrame, row_id: str, group: str, y: str, numeric: Sequence[str],
    categorical: Mapping[str, Sequence[str]], n_outer: int = 5, n_inner: int = 4,
    grid: Mapping[str, Sequence] = lr.LOGISTIC_GRID,
) -> DataFrame:
    """(row_id, group, y, params, pred, inner_score, repeat, outer_fold): held-out probabilities of the
    candidate with the best mean average precision over the inner folds. ``outer``, ``inner``: as in
    ``learners.nested_elastic_net``. What the driver holds is a row per training set and candidate."""
    spark, task = rows.sparkSession, ["repeat", "outer_fold"]
    placed = lr.placed_rows(rows, outer, {"_folds": inner}, group, n_outer, n_inner)
    sets = lr.TrainingSets(placed, "_folds", y, numeric, categorical, n_outer, n_inner)
    shapes = sets.moments()
    if not shapes:
        raise ValueError("no training rows")
    # columns that are zero in all rows, as most marks of missing values are, take no part
    used = np.flatnonzero(np.any([shape["used"] for shape in shapes.values()], axis=0))
    p = len(next(iter(shapes.values()))["fill"])
    column = [F.lit(1.0), *[F.col(c)[j] for c in ("obs", "miss") for j in range(p)]]
    label = F.col(y).cast("double")
    held = staged(sets.x.select(F.array(*[column[j] for j in used]).alias("v"), label.alias("label"), F.col("_folds").alias("folds")), "logistic-rows")
    at = {s: sets.place(*divmod(s // (n_inner + 1), n_outer + 1)) * (n_inner + 1) + s % (n_inner + 1) for s in shapes}
    points = {f'{{"c": {c}, "penalty": "{p}"}}': (p, c) for p in grid["penalty"] for c in grid["c"]}
    largest = max(shapes, key=lambda s: (shapes[s]["n"], -s))
    pilot = Model(shapes[largest], shapes[largest]["n"], "l2", 1.0, NEAR)
    fit_all(held, [(at[largest], pilot)], used, n_inner)

    def fitted(wanted: Sequence[tuple[int, str]], near: float) -> list[Model]:
        models = [Model(shapes[s], shapes[s]["n"], *points[text], near) for s, text in wanted]
        for m in models:
            m.begin(pilot)
        fit_all(held, [(at[s], m) for (s, _), m in zip(wanted, models)], used, n_inner)
        return models

    tuned = [(s, text) for s in shapes if s % (n_inner + 1) for text in points]
    weights, spread, sizes, names = {}, {}, {}, {}
    for (s, text), m in zip(tuned, fitted(tuned, NEAR)):
        whole, fold = s - s % (n_inner + 1), s % (n_inner + 1)
        key = at[whole] // (n_inner + 1), fold
        weights.setdefault(key, []).append(m.raw()[used])
        spread.setdefault(key, []).append((m.b[0], max(m.moved(np.append(m.b[0], np.zeros(p))), 1e-9)))
        names.setdefault(key, []).append((*divmod(s // (n_inner + 1), n_outer + 1), fold, text))
        sizes[key] = -(-(shapes[whole]["n"] - shapes[s]["n"]) // ROWS_A_RANGE)
    found = held_out_precision(held, {k: np.array(w) for k, w in weights.items()}, sizes, spread)
    scored = [(*name, score) for key, own in found.items() for name, score in zip(names[key], own)]
    scored = spark.createDataFrame(scored, "repeat int, outer_fold int, inner_fold int, params string, score double")
    chosen = staged(lr.select_candidates(scored, task, "params", "score", False), "chosen")
    final = [(r["set"], r) for r in chosen.select(sets.number().cast("bigint").alias("set"), "*").collect()]
    refit = fitted([(s, r["params"]) for s, r in final], NEAR_FINAL)
    fits = [
        (r["repeat"], r["outer_fold"], r["params"], r["inner_score"], float(m.raw()[0]), m.raw()[1 : p + 1].tolist(), list(shapes[s]["fill"]))
        for (s, r), m in zip(final, refit)
    ]
    fitted_rows = spark.createDataFrame(fits, "repeat int, outer_fold int, params string, inner_score double, b double, coef array<double>, fill array<double>")
    test = lr.under_outer_folds(sets.x, row_id, group, y, "obs", "miss").join(F.broadcast(fitted_rows), task)
    eta = F.col("b") + dot(lr.imputed(F.col("fill")), F.col("coef"))
    return test.select(row_id, group, y, "params", (1 / (1 + F.exp(-eta))).alias("pred"), "inner_score", *task)
