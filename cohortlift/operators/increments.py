"""Paired increments of the combined over the baseline prediction, with cluster bootstrap."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlift.functions.cleaning import hash_int
from cohortlift.operators.metrics import (
    error_statistics,
    probability_statistics,
    score_counts,
    total_squares,
)
from cohortlift.operators.ordered import positions, running_sums, value_bucket
from cohortlift.sources.tables import staged

PREDS = {"_base": "pred_base", "_comb": "pred_comb"}


def _improvements() -> list[Column]:
    """Deltas signed so that positive means the combined prediction is better."""
    n, spread = F.col("n"), total_squares()

    def mae(s):
        return F.avg(F.col(f"ae{s}") / n)

    def rmse(s):
        return F.sqrt(F.avg(F.col(f"se{s}") / n))

    gain = (F.sum("se_base") - F.sum("se_comb")) / spread
    return [
        (mae("_base") - mae("_comb")).alias("delta_mae_pb"),
        (rmse("_base") - rmse("_comb")).alias("delta_rmse_pb"),
        F.when(F.max("yhi") > F.min("ylo"), gain).alias("delta_r2_rep"),
    ]


DELTAS = ("delta_mae_pb", "delta_rmse_pb", "delta_r2_rep")


def observed_from_statistics(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    return stats.groupBy(*by).agg(
        F.sum("n").cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).alias("n_groups"),
        *_improvements(),
    )


def regression_increment(pairs: DataFrame, by: Sequence[str], group: str, y: str) -> DataFrame:
    """Observed deltas. ``pairs``: by, group, y, pred_base, pred_comb."""
    return observed_from_statistics(error_statistics(pairs, by, group, y, PREDS), by)


def _indexed(stats: DataFrame, by: Sequence[str], group: str) -> DataFrame:
    """0-based place of each group among its comparison's groups, in md5 order, and their number."""
    by = list(by)
    h = F.md5(F.col(group).cast("string"))
    prefix = F.conv(F.substring(F.col("_h"), 1, 3), 16, 10).cast("bigint")
    placed = positions(
        stats.withColumn("_h", h), by, ["_h", group], prefix, out="_place", total="_groups"
    )
    return placed.withColumn("_idx", F.col("_place") - 1).drop("_h", "_place")


def _draws(indexed: DataFrame, by: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """G draws with replacement per replicate: by, replicate, _idx of the drawn group.

    Draw j of replicate b is hash(seed, b, j) mod G: any task can make it, and a lost task makes
    the same one again. The group table is small, so it is spread over all tasks first.
    """
    tasks = int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seats = indexed.select(*by, F.col("_idx").alias("_j"), "_groups")
    spread = seats.repartition(tasks, *by, "_j").withColumn(
        "replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    )
    pick = F.pmod(hash_int(F.lit(seed), "replicate", "_j"), F.col("_groups"))
    return spread.select(*by, "replicate", pick.alias("_idx"))


def group_statistics(pairs: DataFrame, by: Sequence[str], group: str, y: str) -> DataFrame:
    """Per comparison and group: error statistics of both sides and the group's draw index.

    The only pass over the rows; written once, since the observed deltas and the draws both
    start from it.
    """
    return staged(_indexed(error_statistics(pairs, by, group, y, PREDS), by, group), "group-stats")


GROUPS_A_BLOCK = 1024
DRAWS_A_BATCH = 2_000_000


def drawn_blocks(indexed: DataFrame, by: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """by, _block, codes: the draws (``_draws``) of each run of ``GROUPS_A_BLOCK`` groups, packed as 32-bit
    numbers (place in the run * replicates + replicate - 1).

    Draws are made and dealt to the runs in one task, so what is shuffled is four bytes a draw in
    rows of many draws, not a row a draw; a seat's hash is taken once for all comparisons.
    """
    by, block, at_once = list(by), GROUPS_A_BLOCK, max(1, DRAWS_A_BATCH // replicates)
    tasks = int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seats = indexed.select(*by, F.col("_idx").alias("_j"), "_groups").repartition(tasks, "_j").sortWithinPartitions("_j")
    known = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seats.select(*by).schema)

    def packed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                yield from dealt(batch.slice(at, at_once))

    def dealt(rows):
        js, which = np.unique(rows.column("_j").to_numpy(zero_copy_only=False), return_inverse=True)
        texts, groups = [b"%d" % j for j in js], rows.column("_groups").to_numpy(zero_copy_only=False)
        drawn = np.empty((replicates, len(js)), np.uint32)
        for b in range(replicates):
            head = b"%d|%d|" % (seed, b + 1)
            digests = b"".join([md5(head + j).digest() for j in texts])
            drawn[b] = np.frombuffer(digests, ">u4")[::4]
        pick = drawn[:, which] % groups
        code = (pick % block * replicates + np.arange(replicates)[:, None]).astype(np.int32).ravel()
        own = np.zeros(rows.num_rows, np.int64)
        for c in by:  # a number for each combination of the keys
            column = rows.column(c).dictionary_encode(null_encoding="encode")
            own = own * len(column.dictionary) + column.indices.to_numpy(zero_copy_only=False)
        runs = int(pick.max()) // block + 1
        place = (own * runs + pick // block).ravel()
        order = np.argsort(place, kind="stable")
        starts = np.flatnonzero(np.diff(place[order], prepend=-1))
        parts = [x.tobytes() for x in np.split(code[order], starts[1:])]
        first = order[starts]
        seat = pa.array(first % rows.num_rows)
        yield pa.RecordBatch.from_arrays(
            [
                *[rows.column(c).take(seat) for c in by],
                pa.array(place[first] % runs, pa.int32()),
                pa.array(parts, pa.binary()),
            ],
            names=[*by, "_block", "codes"],
        )

    return seats.mapInArrow(packed, f"{known}, _block int, codes binary")


def _weights(pieces: pd.Series, block: int, replicates: int) -> np.ndarray:
    """How often each group of a run was drawn: groups by replicates."""
    codes = [np.frombuffer(x, np.int32) for x in pieces]
    codes = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    return np.bincount(codes, minlength=block * replicates).reshape(block, replicates)


def drawn_sums(
    rows: DataFrame, blocks: DataFrame, by: Sequence[str], within: Sequence[str], replicates: int,
    sums: Sequence[str], lows: Sequence[str] = (), highs: Sequence[str] = (),
) -> DataFrame:
    """by, within, replicate: columns of ``rows`` (a row per by, within, _idx) added up over the draws,
    or their extremes over the drawn groups.

    A run of groups meets its draws in one task, as a matrix product.
    """
    at, block = [*by, *within], GROUPS_A_BLOCK
    cells = rows.select(
        *at, F.floor(F.col("_idx") / block).cast("int").alias("_block"),
        F.pmod("_idx", F.lit(block)).cast("int").alias("_place"),
        *[F.col(c).cast("double").alias(c) for c in [*sums, *lows, *highs]],
    )
    names = [*sums, *lows, *highs]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*at).schema)

    def one_run(mine: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame(columns=[*at, "replicate", *names])
        weights = _weights(pieces["codes"], block, replicates)
        out = []
        for _, part in mine.groupby(list(within), dropna=False, sort=False) if within else [((), mine)]:
            w = weights[part["_place"].to_numpy()]
            done = {c: [part[c].iloc[0]] * replicates for c in at} | {"replicate": np.arange(1, replicates + 1)}
            added = w.T.astype(float) @ part[list(sums)].to_numpy()
            done |= {c: added[:, i] for i, c in enumerate(sums)}
            for c in lows:
                done[c] = np.where(w > 0, part[c].to_numpy()[:, None], np.inf).min(0)
            for c in highs:
                done[c] = np.where(w > 0, part[c].to_numpy()[:, None], -np.inf).max(0)
            out.append(pd.DataFrame(done))
        return pd.concat(out)[[*at, "replicate", *names]]

    keys = [*by, "_block"]
    partial = cells.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(
        one_run, f"{schema}, replicate int, " + ", ".join(f"`{c}` double" for c in names)
    )
    return partial.groupBy(*at, "replicate").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs]
    )


def replicates_from_statistics(
    stats: DataFrame, by: Sequence[str], replicates: int, seed: int
) -> DataFrame:
    """Deltas of every participant-cluster bootstrap replicate.

    A group drawn twice counts as two groups. Outcomes are taken around the mean of all rows.
    """
    by, n = list(by), F.col("n")
    centre = stats.groupBy(*by).agg((F.sum(n * F.col("my")) / F.sum("n")).alias("_centre"))
    d = F.col("my") - F.col("_centre")
    terms = {"_k": F.lit(1.0), "n": n, "_s1": n * d, "_s2": n * (d * d + F.col("vy"))}
    for s in PREDS:
        terms |= {f"_ae{s}": F.col(f"ae{s}") / n, f"_ms{s}": F.col(f"se{s}") / n, f"se{s}": F.col(f"se{s}")}
    rows = stats.join(centre, by).select(*by, "_idx", "ylo", "yhi", *[e.alias(c) for c, e in terms.items()])
    sums = drawn_sums(rows, drawn_blocks(stats, by, replicates, seed), by, [], replicates, list(terms), ["ylo"], ["yhi"])
    mae = (F.col("_ae_base") - F.col("_ae_comb")) / F.col("_k")
    rmse = F.sqrt(F.col("_ms_base") / F.col("_k")) - F.sqrt(F.col("_ms_comb") / F.col("_k"))
    gain = (F.col("se_base") - F.col("se_comb")) / (F.col("_s2") - F.col("_s1") * F.col("_s1") / n)
    return sums.select(
        *by, "replicate", mae.alias("delta_mae_pb"), rmse.alias("delta_rmse_pb"),
        F.when(F.col("yhi") > F.col("ylo"), gain).alias("delta_r2_rep"),
    )


def bootstrap_replicates(
    pairs: DataFrame, by: Sequence[str], group: str, y: str, replicates: int, seed: int
) -> DataFrame:
    return replicates_from_statistics(group_statistics(pairs, by, group, y), by, replicates, seed)


def intervals(replicates: DataFrame, by: Sequence[str], deltas: Sequence[str]) -> DataFrame:
    """Percentile interval, share above zero and number of usable replicates per delta.

    A comparison has as many rows as replicates were asked for, so ``percentile`` is bounded.
    """
    out = []
    for d in deltas:
        out += [
            F.percentile(d, 0.025).alias(f"{d}_ci_low"),
            F.percentile(d, 0.975).alias(f"{d}_ci_high"),
            F.avg((F.col(d) > 0).cast("double")).alias(f"{d}_positive_share"),
            F.count(d).alias(f"{d}_n"),
        ]
    return replicates.groupBy(*by).agg(*out)


def regression_increment_table(
    pairs: DataFrame, by: Sequence[str], group: str, y: str, replicates: int, seed: int
) -> DataFrame:
    """Observed deltas beside their bootstrap intervals."""
    by = list(by)
    stats = group_statistics(pairs, by, group, y)
    boot = replicates_from_statistics(stats, by, replicates, seed)
    return observed_from_statistics(stats, by).join(intervals(boot, by, DELTAS), by)


# --- probability outcomes ---------------------------------------------------------------------
RANK_DELTAS = ("delta_pr_auc", "delta_roc_auc", "delta_brier_pb", "delta_logloss_pb")


def probability_sides(pairs: DataFrame) -> DataFrame:
    """Both sides stacked: side, prob."""
    sides = F.array(
        F.struct(F.lit("base").alias("side"), F.col("pred_base").alias("prob")),
        F.struct(F.lit("comb").alias("side"), F.col("pred_comb").alias("prob")),
    )
    return pairs.withColumn("_s", F.explode(sides)).select(
        *[c for c in pairs.columns if c not in ("pred_base", "pred_comb")], "_s.side", "_s.prob"
    )


def _probability_deltas(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    def side(metric, s):
        return F.max(F.when(F.col("side") == s, F.col(metric)))

    return metrics.groupBy(*by).agg(
        (side("pr_auc", "comb") - side("pr_auc", "base")).alias("delta_pr_auc"),
        (side("roc_auc", "comb") - side("roc_auc", "base")).alias("delta_roc_auc"),
        (side("brier_pb", "base") - side("brier_pb", "comb")).alias("delta_brier_pb"),
        (side("logloss_pb", "base") - side("logloss_pb", "comb")).alias("delta_logloss_pb"),
    )


def probability_increment(pairs: DataFrame, by: Sequence[str], group: str, y: str) -> DataFrame:
    from cohortlift.operators.metrics import probability_metrics, ranking_metrics

    by = list(by)
    both = probability_sides(pairs)
    keys = [*by, "side"]
    m = probability_metrics(both, keys, group, y, "prob").join(
        ranking_metrics(both, keys, y, "prob"), keys
    )
    return _probability_deltas(m, by)


def probability_bootstrap(
    pairs: DataFrame, by: Sequence[str], group: str, y: str, replicates: int, seed: int
) -> DataFrame:
    """Deltas of AP, AUC, Brier and log loss per replicate.

    Losses are added up per replicate like the regression statistics. Ranking metrics need the
    scores: an ordered pass over all of them serves all replicates at once (``weighted_ranking``).
    A replicate with one class only has missing ranking deltas.
    """
    by = list(by)
    both = probability_sides(pairs)
    keys = [*by, "side"]
    losses = staged(probability_statistics(both, keys, group, y, "prob"), "group-losses")
    groups = staged(_indexed(losses.select(*by, group).distinct(), by, group), "group-index")
    blocks = staged(drawn_blocks(groups, by, replicates, seed), "draws")
    index = groups.select(*by, group, "_idx")
    n = F.col("n")
    rows = losses.join(index, [*by, group]).select(
        *keys, "_idx", F.lit(1.0).alias("_k"), (F.col("brier") / n).alias("_b"), (F.col("logloss") / n).alias("_l")
    )
    added = drawn_sums(rows, blocks, by, ["side"], replicates, ["_k", "_b", "_l"])
    balanced = added.select(
        *keys, "replicate", (F.col("_b") / F.col("_k")).alias("brier_pb"), (F.col("_l") / F.col("_k")).alias("logloss_pb")
    )
    counts = score_counts(both, [*keys, group], y, "prob").join(index, [*by, group]).drop(group)
    n_groups = groups.agg(F.max("_groups")).first()[0] or 1
    ranked = weighted_ranking(counts, blocks, keys, by, n_groups, replicates)
    return _probability_deltas(balanced.join(ranked, [*keys, "replicate"]), [*by, "replicate"])


SCORES_A_CHUNK = 256
CELLS_A_CHUNK = 2_000_000
CELLS_A_PIECE = 100_000
WEIGHTS_A_SLICE = 96_000_000
# How the counts of a chunk are packed.
COUNTS = {"score": np.float64, "_idx": np.int32, "pos": np.float64, "neg": np.float64}


def weighted_ranking(
    counts: DataFrame, blocks: DataFrame, keys: Sequence[str], by: Sequence[str], n_groups: int, replicates: int
) -> DataFrame:
    """Average precision and ROC-AUC of every replicate: keys, replicate, pr_auc, roc_auc.

    ``counts``: keys, _idx, score, pos, neg. ``blocks``: by, _block, codes (``drawn_blocks``). Scores
    are cut into chunks of like many counts in falling order, replicates into slices. The chunks'
    totals come from ``drawn_sums`` and are carried across, replicate by replicate; then the task of
    a chunk and slice, which holds the slice's weights of all groups as one number each, turns
    counts per (score, group) into weighted counts per score and replicate and adds its part. What
    is shuffled is every count once a slice and every weight once a chunk.
    """
    keys, at, block = list(keys), [*keys, "_chunk"], GROUPS_A_BLOCK
    within = [c for c in at if c not in by]
    width = int(min(replicates, max(1, WEIGHTS_A_SLICE // max(n_groups, block))))
    slices = -(-replicates // width)
    step, batch = SCORES_A_CHUNK, 4096
    scores = counts.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("_cells")).withColumn("_f", -F.col("score"))
    scores = running_sums(scores, keys, ["_f"], value_bucket(F.col("_f"), 1 << 14), {"_upto": "_cells"})
    scores = scores.select(*keys, "score", F.floor((F.col("_upto") - F.col("_cells")) / CELLS_A_CHUNK).alias("_chunk"))
    cells = staged(counts.join(scores, [*keys, "score"]).select(*at, "_idx", "score", "pos", "neg"), "score-cells")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*at).schema)

    per_group = cells.groupBy(*at, "_idx").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    own = staged(drawn_sums(per_group, blocks, by, within, replicates, ["pos", "neg"]), "chunk-totals")
    earlier = W.partitionBy(*keys, "replicate").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = own.select(
        *at, "replicate", F.floor((F.col("replicate") - 1) / width).cast("int").alias("_slice"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(c) for c in ("pos", "neg")],
    )
    one = F.array_sort(F.collect_list(F.struct("replicate", "pos", "neg"))).alias("carried")  # as many as replicates
    carried = carried.groupBy(*at, "_slice").agg(one)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("score", ascending=False)
        first = {c: [rows[c].iloc[0]] for c in at}
        values = {c: [rows[c].to_numpy().astype(kind).tobytes()] for c, kind in COUNTS.items()}
        return pd.DataFrame(first | values)

    parts_of = 1 + CELLS_A_CHUNK // CELLS_A_PIECE
    packed = cells.groupBy(*at, F.pmod(F.hash("_idx", "score"), F.lit(parts_of)).alias("_piece")).applyInPandas(
        pack, f"{shape}, " + ", ".join(f"{c} binary" for c in COUNTS)
    )
    packed = packed.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        w = _weights(rows["codes"], block, replicates)
        w = w.astype(np.uint8 if w.max() < 256 else np.uint32)
        first = {c: [rows[c].iloc[0]] * slices for c in [*by, "_block"]}
        own = [np.ascontiguousarray(w[:, i * width : (i + 1) * width]).tobytes() for i in range(slices)]
        return pd.DataFrame(first | {"_slice": range(slices), "weights": own})

    known = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*by).schema)
    weights = blocks.groupBy(*by, "_block").applyInPandas(cut, f"{known}, _block int, _slice int, weights binary")
    weights = staged(weights, "weights").join(F.broadcast(cells.select(*at).distinct()), list(by))  # a row per chunk
    side = weights.select(*at, "_slice", "_block", "weights").unionByName(carried, allowMissingColumns=True)

    def parts(pieces: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        head = side["carried"].notna()
        before = side.loc[head, "carried"].iloc[0]
        replicate = np.array([r["replicate"] for r in before])
        tp, fp = (np.array([r[c] for r in before]) for c in ("pos", "neg"))
        mine, wide = side[~head], len(replicate)
        large = any(len(x) > block * wide for x in mine["weights"])
        w = np.zeros((block * (1 + int(mine["_block"].max() if len(mine) else 0)), wide), np.uint32 if large else np.uint8)
        for at_block, raw in zip(mine["_block"].astype(int), mine["weights"]):
            kind = np.uint32 if len(raw) > block * wide else np.uint8
            w[at_block * block : (at_block + 1) * block] = np.frombuffer(raw, kind).reshape(block, wide)
        rows = {c: np.concatenate([np.frombuffer(x, kind) for x in pieces[c]]) for c, kind in COUNTS.items()}
        order = np.argsort(-rows["score"], kind="stable")
        rows = {c: v[order] for c, v in rows.items()}
        place = np.cumsum(np.diff(rows["score"], prepend=rows["score"][0]) != 0)
        kept = rows["_idx"] < len(w)  # a group never drawn weighs 0
        columns = []
        for c in ("pos", "neg"):
            some = np.flatnonzero(kept & (rows[c] != 0))
            columns.append((place[some], rows["_idx"][some], rows[c][some]))
        sums = np.zeros((4, wide))
        for a in range(0, int(place[-1]) + 1, step):
            n, counted = min(step, int(place[-1]) + 1 - a), []
            for score, who, times in columns:
                m = np.zeros((n, wide))
                low, high = np.searchsorted(score, [a, a + n])
                for i in range(low, high, batch):
                    j = min(i + batch, high)
                    s = score[i:j] - a
                    first = np.flatnonzero(np.diff(s, prepend=-1))
                    m[s[first]] += np.add.reduceat(w[who[i:j]] * times[i:j, None], first, axis=0)
                counted.append(m)
            pos, neg = counted
            up, down = tp + pos.cumsum(0), fp + neg.cumsum(0)
            seen = up + down
            ap = np.divide(pos * up, seen, out=np.zeros_like(pos), where=seen > 0).sum(0)
            sums += np.array([pos.sum(0), neg.sum(0), ap, (neg * (up - pos / 2)).sum(0)])
            tp, fp = up[-1], down[-1]
        first = {c: [side[c].iloc[0]] * wide for c in at}
        return pd.DataFrame(first | {"replicate": replicate} | dict(zip(("pos", "neg", "ap", "auc"), sums)))

    tile = [*at, "_slice"]
    done = packed.groupBy(*tile).cogroup(side.groupBy(*tile)).applyInPandas(
        parts, f"{shape}, replicate int, pos double, neg double, ap double, auc double"
    )
    sums = done.groupBy(*keys, "replicate").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "ap", "auc")])
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return sums.select(
        *keys, "replicate",
        F.when(both, F.col("ap") / F.col("pos")).alias("pr_auc"),
        F.when(both, F.col("auc") / (F.col("pos") * F.col("neg"))).alias("roc_auc"),
    )


# --- folds and anchors ------------------------------------------------------------------------
def fold_increments(
    fold_metrics: DataFrame, by: Sequence[str], side: str, base: str, comb: str,
    lower_better: Sequence[str], higher_better: Sequence[str],
) -> DataFrame:
    """Mean, sample sd and positive share of paired fold deltas.

    ``fold_metrics``: by, repeat, outer_fold, side, metrics.
    """
    by = list(by)

    def value(m, s):
        return F.max(F.when(F.col(side) == s, F.col(m)))

    signed = {m: 1 for m in lower_better} | {m: -1 for m in higher_better}
    paired = fold_metrics.groupBy(*by, "repeat", "outer_fold").agg(
        *[((value(m, base) - value(m, comb)) * s).alias(m) for m, s in signed.items()]
    )
    out = [F.count(F.lit(1)).alias("n_folds")]
    for m in signed:
        out += [
            F.avg(m).alias(f"fold_delta_{m}_mean"),
            F.stddev_samp(m).alias(f"fold_delta_{m}_sd"),
            F.avg((F.col(m) > 0).cast("double")).alias(f"fold_delta_{m}_positive_fraction"),
        ]
    return paired.groupBy(*by).agg(*out)


def alignment_robustness(
    increments: DataFrame, by: Sequence[str], deltas: Sequence[str],
    anchors: tuple[str, str] = ("START", "END"),
) -> DataFrame:
    """Whether an increment has the same sign, and an interval off zero, under both anchors."""
    a, b = anchors

    def at(column, anchor):
        return F.max(F.when(F.col("anchor") == anchor, F.col(column)))

    out = []
    for d in deltas:
        x, y = at(d, a), at(d, b)
        out += [
            x.alias(f"{a.lower()}_{d}"),
            y.alias(f"{b.lower()}_{d}"),
            (F.signum(x) == F.signum(y)).alias(f"{d}_same_direction"),
            ((x > 0) & (y > 0)).alias(f"{d}_both_positive"),
            ((x < 0) & (y < 0)).alias(f"{d}_both_negative"),
        ]
        for anchor in anchors:
            out += [
                (at(f"{d}_ci_low", anchor) > 0).alias(f"{anchor.lower()}_{d}_above_zero"),
                (at(f"{d}_ci_high", anchor) < 0).alias(f"{anchor.lower()}_{d}_below_zero"),
            ]
    both = F.count_distinct("anchor")
    return increments.groupBy(*by).agg(both.alias("_n"), *out).where("_n = 2").drop("_n")
