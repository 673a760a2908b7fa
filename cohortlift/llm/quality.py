"""Quality scores by a regularised quadratic discriminant (operator 1).

Every document becomes a short vector of transformed statistics of its text. For each class the
mean and the covariance of the labelled vectors are folded in one pass; covariances are shrunk
towards the pooled one and towards their diagonals, so that their Cholesky factors exist. A score
is the difference of the two Mahalanobis log-densities, put on the scale of a probability by a
monotone fit on the labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.scan import ALNUM, NONBLANK, Words, byte_class, slices
from cohortlift.llm.toxicity import monotone_fit
from cohortlift.sources.tables import staged

SHRINK_POOLED, SHRINK_DIAGONAL = 0.05, 0.05
BINS, BIN_SPAN = 400, 40.0  # log-density differences are counted in bins for the monotone fit
UPPER = byte_class((0x41, 0x5A))
DIGIT = byte_class((0x30, 0x39))
SIGN = byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
STOP = byte_class((0x2C, 0x2C), (0x2E, 0x2E))
LINE = byte_class((0x0A, 0x0A))
FEATURES = [
    "words", "word_bytes", "word_spread", "short_words", "upper", "digits", "signs", "odd_signs", "sign_runs",
    "words_a_line", "words_a_stop", "distinct", "echo", "commonest", "ends_with_sign", "wide_bytes",
]


def statistics(column: pa.Array) -> np.ndarray:
    """Transformed statistics of every text, one row each; texts without words get finite ones too."""
    words = Words(column, NONBLANK)
    n = len(words.at) - 1
    at, raw = words.at, words.raw

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[at[1:]] - total[at[:-1]]

    def of_words(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
        return total[words.first[1:]] - total[words.first[:-1]]

    size = np.diff(at).astype(float)
    count = np.diff(words.first).astype(float)
    length = (words.ends - words.starts).astype(float)
    text = np.repeat(np.arange(n), np.diff(words.first))
    sign = SIGN[raw]
    twin = np.zeros(len(raw), bool)
    twin[1:] = sign[1:] & (raw[1:] == raw[:-1])
    letters = per_text(ALNUM[raw]).astype(float)
    hashes = words.hashes
    echo = np.zeros(len(hashes), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, len(h)))
    distinct = np.bincount(t[begin], minlength=n).astype(float)
    commonest = np.zeros(n)
    np.maximum.at(commonest, t[begin], run)
    last = raw[words.ends - 1] if len(raw) else raw
    odd_end = SIGN[last] & ~STOP[last]
    share = lambda k, of, a=0.5: np.log((k + a) / (of + 2 * a))
    mean = np.divide(of_words(length), count, out=np.zeros(n), where=count > 0)
    spread = np.divide(of_words(length**2), count, out=np.zeros(n), where=count > 0) - mean**2
    return np.stack(
        [
            np.log1p(count),
            np.log1p(mean),
            np.log1p(np.maximum(spread, 0)),
            share(of_words(length <= 3), count),
            share(per_text(UPPER[raw]), letters),
            share(per_text(DIGIT[raw]), letters),
            share(per_text(sign), size),
            share(per_text(sign & ~STOP[raw]), size),
            share(per_text(twin), size),
            np.log((count + 1) / (per_text(LINE[raw]) + 1)),
            np.log((count + 1) / (per_text(STOP[raw]) + 1)),
            np.log((distinct + 1) / (np.sqrt(count) + 1)),
            share(of_words(echo), count),
            share(commonest, count),
            share(of_words(odd_end), count),
            share(per_text(raw >= 0x80), size),
        ],
        axis=1,
    )


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the classes, and the scale."""

    means: list
    factors: list  # inverse of the lower Cholesky factor of each covariance
    offsets: list
    knots: np.ndarray
    scores: np.ndarray

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        density = [
            o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets)
        ]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(np.clip(self.difference(x), -BIN_SPAN, BIN_SPAN), self.knots, self.scores)


def fit_moments(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """The discriminant of each class's (rows, sum, sum of outer products); no scale yet."""
    total = sum(s[0] for s in sums.values())
    covariances = {}
    for y, (n, s, ss) in sums.items():
        mean = s / n
        covariances[y] = ss / n - np.outer(mean, mean)
    pooled = sum(sums[y][0] * c for y, c in covariances.items()) / total
    means, factors, offsets = [], [], []
    for y in (0, 1):
        n, s, _ = sums[y]
        c = (1 - SHRINK_POOLED) * covariances[y] + SHRINK_POOLED * pooled
        c = (1 - SHRINK_DIAGONAL) * c + SHRINK_DIAGONAL * np.diag(np.diag(c))
        c += np.eye(len(c)) * (1e-6 + 1e-4 * np.trace(pooled) / len(c))
        lower = np.linalg.cholesky(c)
        means.append(s / n)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(n / total) - np.log(np.diag(lower)).sum())
    return Discriminant(means, factors, offsets, np.array([-1.0, 1.0]), np.array([0.0, 1.0]))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>) of each document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text"):
            x = statistics(batch.column("text"))
            offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["id", "x"]
            )

    return rows.mapInArrow(run, f"id {kind}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Rows, sums and sums of outer products of each class, folded in tasks, then by place."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.concatenate([np.ones((batch.num_rows, 1)), _matrix(batch.column("x"))], axis=1)
            label = batch.column("label").to_numpy()
            for y in (0, 1):
                own = x[label == y]
                held[y] = held.get(y, 0) + own.T @ own
        for y, m in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([y], pa.int32()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["label", "m"]
            )

    parts = labelled.select("label", "x").mapInArrow(run, "label int, m array<double>")
    cells = parts.select("label", F.posexplode("m")).groupBy("label", "pos").agg(F.sum("col").alias("v")).collect()
    out = {}
    for y in (0, 1):
        own = sorted((r.pos, r.v) for r in cells if r.label == y)
        if own:
            m = np.array([v for _, v in own]).reshape(int(len(own) ** 0.5), -1)
            if m[0, 0] > 0:
                out[y] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    held_out=None,
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``docs``; higher means label 1 is likelier.

    ``held_out`` is a condition on ``labels`` whose rows are not learnt from; null labels and ids
    are not either. Null and empty texts are scored by the statistics of an empty text. Without
    labels of both classes every score is the rate of the one there is, 0.5 if there is none.
    Repeated rows each give a row, further columns are ignored whatever their names.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if held_out is not None:
        known = known.where(~held_out)
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    rows = staged(features(docs, id_col, text_col), "quality-features")
    labelled = staged(rows.join(known, "id"), "quality-labelled")
    sums = _moments(labelled)
    spark = docs.sparkSession
    if len(sums) < 2:
        only = float(next(iter(sums))) if sums else 0.5
        return rows.select(
            F.col("id").alias(id_col), F.lit(only).alias("score"), F.lit(int(only >= threshold)).alias("predicted")
        )
    model = fit_moments(sums)
    shared = spark.sparkContext.broadcast(model)

    def bins(batches):
        for batch in batches:
            if batch.num_rows:
                d = np.clip(shared.value.difference(_matrix(batch.column("x"))), -BIN_SPAN, BIN_SPAN)
                place = np.round((d + BIN_SPAN) / (2 * BIN_SPAN) * BINS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("label")], names=["bin", "label"])

    counted = labelled.select("x", "label").mapInArrow(bins, "bin int, label int")
    counted = counted.groupBy("bin").agg(F.avg("label").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    knots = np.array([r.bin for r in counted]) / BINS * 2 * BIN_SPAN - BIN_SPAN
    model.knots, model.scores = monotone_fit(knots, np.array([r.y for r in counted]), np.array([r.n for r in counted], float))
    scaled = spark.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = np.clip(scaled.value.score(_matrix(batch.column("x"))), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    names=[id_col, "score", "predicted"],
                )

    return rows.mapInArrow(run, f"{id_col} {kind}, score double, predicted int")
