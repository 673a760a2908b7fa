"""Audits of raw and modeling tables as grouped plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlift.functions.cleaning import near
from cohortlift.operators.joining import spread_side
from cohortlift.operators.ordered import exact_quantiles, positions
from cohortlift.operators.training import imputed_statistics, others
from cohortlift.sources.tables import staged


def constant_profile(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]
) -> DataFrame:
    """First value in source order, mean, range, distinct count and missing share per file."""
    x = F.col(value)
    return df.groupBy(*keys).agg(
        F.min_by(x, F.when(x.isNotNull(), F.struct(*order))).alias("first"),
        F.avg(x).alias("mean"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.count_distinct(x).alias("nunique"),
        F.avg(x.isNull().cast("double")).alias("missing_rate"),
    )


def missing_and_sentinel(
    df: DataFrame, keys: Sequence[str], value: str, sentinel: float
) -> DataFrame:
    """Missing share of all cells, sentinel share of the present ones."""
    x = F.col(value)
    return df.groupBy(*keys).agg(
        (F.count_if(x.isNull()) / F.count(F.lit(1))).alias("sensor_missing_rate"),
        (F.count_if(x == sentinel) / F.greatest(F.count(x), F.lit(1))).alias("sensor_sentinel_rate"),
    )


def axis_duplication(
    df: DataFrame, keys: Sequence[str], axes: Sequence[str], atol: float = 1e-12,
    flag_at: float = 0.99,
) -> DataFrame:
    """Share of rows in which two axes are equal, for each pair, and a flag at ``flag_at``."""
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i + 1 :]]

    def share(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return F.avg(F.when(both, near(a, b, atol).cast("double")))

    out = df.groupBy(*keys).agg(*[share(a, b).alias(f"{a}{b}_equal") for a, b in pairs])
    names = [f"{a}{b}_equal" for a, b in pairs]
    known = F.lit(True)
    high = F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull()
        high = high & (F.col(n) >= flag_at)
    return out.withColumn("all_duplicated", F.when(known, high))


def duplication_rollup(
    shares: DataFrame, keys: Sequence[str], columns: Sequence[str], flag_at: float = 0.99
) -> DataFrame:
    """Mean, median and flagged count of each pair over segments, by device."""
    long = shares.unpivot(list(keys), list(columns), "pair", "share")
    by = [*keys, "pair"]
    sums = long.groupBy(*by).agg(
        F.avg("share").alias("mean"),
        F.count_if(F.col("share") >= flag_at).alias("flagged_n"),
        F.count("share").alias("known_n"),
    )
    return sums.join(exact_quantiles(long, by, "share", {"median": 0.5}), by, "left")


def column_missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing share per column, ranked; one aggregation row turned on its side."""
    one = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    long = one.unpivot(["_n"], list(columns), "column", "missing_n")
    rated = long.select("column", "missing_n", (F.col("missing_n") / F.col("_n")).alias("missing_rate"))
    place = W.orderBy(F.col("missing_rate").desc(), F.col("column"))
    return rated.withColumn("rank", F.row_number().over(place).cast("bigint"))


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with at most one distinct value, found from their range (no distinct needed)."""
    one = df.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "is_constant")


def numeric_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    x = F.col(value)
    ends = df.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.avg(x.isNull().cast("double")).alias("missing_rate"),
        F.count_distinct(x).alias("nunique"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    return ends.join(exact_quantiles(df, keys, value, {"median": 0.5}), list(keys), "left")


def low_cardinality(df: DataFrame, columns: Sequence[str], at_most: int) -> DataFrame:
    """Columns with 1..at_most distinct values and those values, joined in text order.

    Distinct pairs are counted first, so a value list is only built for columns known to be
    short.
    """
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    pairs = text.unpivot([], list(columns), "column", "val").where("val IS NOT NULL").distinct()
    sizes = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("nunique"))
    short = sizes.where(F.col("nunique") <= at_most)
    return pairs.join(short, "column").groupBy("column", "nunique").agg(
        F.array_join(F.array_sort(F.collect_list("val")), ",").alias("vals")
    )


def group_counts(df: DataFrame, keys: Sequence[str], participant: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(participant).alias("n_participants")
    )


def spread_of_group_sizes(df: DataFrame, participant: str) -> DataFrame:
    """Smallest, median and largest number of rows per participant."""
    sizes = df.groupBy(participant).agg(F.count(F.lit(1)).cast("double").alias("n"))
    ends = sizes.agg(F.min("n").alias("min"), F.max("n").alias("max"), F.count("n").alias("groups"))
    middle = exact_quantiles(sizes.withColumn("one", F.lit(1)), ["one"], "n", {"median": 0.5})
    return ends.withColumn("one", F.lit(1)).join(middle, "one").drop("one")


def repetition_completeness(
    df: DataFrame, keys: Sequence[str], repetition: str, expected: int
) -> DataFrame:
    r = F.col(repetition)
    return df.groupBy(*keys).agg(
        F.count(r).alias("n_rep"),
        F.count_distinct(r).alias("n_unique_reps"),
        F.min(r).alias("min_rep"),
        F.max(r).alias("max_rep"),
    ).withColumn(
        "complete",
        (F.col("n_unique_reps") == expected)
        & (F.col("min_rep") == 1)
        & (F.col("max_rep") == expected),
    )


def ambiguous_ids(df: DataFrame, key: str, targets: Sequence[str]) -> DataFrame:
    """How many ids map to more than one value of each target column."""
    long = df.select(F.col(key), *[F.col(t).cast("string").alias(t) for t in targets])
    pairs = long.unpivot([key], list(targets), "target", "val").distinct()
    per_id = pairs.groupBy("target", key).agg(F.count("val").alias("n"))
    return per_id.groupBy("target").agg(
        F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("n") > 1).alias("n_ambiguous")
    )


def coverage(df: DataFrame, participant: str, task: str) -> DataFrame:
    """Distinct tasks per participant, counted and joined in text order."""
    pairs = df.select(participant, task).distinct()
    return pairs.groupBy(participant).agg(
        F.count(task).alias("n_tasks"),
        F.array_join(F.array_sort(F.collect_list(task)), ",").alias("tasks"),
    )


def id_blocks(
    df: DataFrame, participant: str, id_column: str, chunk: Column | str, block: int = 1000
) -> DataFrame:
    """Sorted id lists per participant, at most ``block`` ids to a row, nothing left out."""
    ids = df.select(participant, id_column).distinct()
    placed = positions(ids, [participant], [id_column], chunk, out="_place")
    placed = placed.withColumn("block", F.floor((F.col("_place") - 1) / block).cast("bigint"))
    return placed.groupBy(participant, "block").agg(
        F.count(F.lit(1)).alias("n_ids"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(id_column)), lambda v: v.cast("string")), ","
        ).alias("ids"),
    )


def content_fingerprint(
    df: DataFrame, keys: Sequence[str], id_column: str, chunk: Column | str, block: int = 4096
) -> DataFrame:
    """SHA-256 of the newline-joined sorted ids, one digest per block of ``block`` ids.

    A table no longer than a block has one digest; longer ones are compared block by block.
    """
    placed = positions(df, keys, [id_column], chunk, out="_place")
    placed = placed.withColumn("block", F.floor((F.col("_place") - 1) / block).cast("bigint"))
    ids = F.transform(F.array_sort(F.collect_list(id_column)), lambda v: v.cast("string"))
    return placed.groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("n_ids"), F.sha2(F.array_join(ids, "\n"), 256).alias("digest")
    )


def trial_quality(
    intervals: DataFrame, trials: DataFrame, chunk: Column | str, atol: float = 1e-9
) -> DataFrame:
    """Eight coded checks of each trial against its short record, and the quarantine verdict.

    ``intervals``: trial, worker, task, time1, time2, state. ``trials``: trial, worker, task,
    total_time, fatigue (one row per trial).
    """
    from cohortlift.operators.windows import connectedness

    first = F.struct("time1", "time2")
    event_at = F.when(F.col("state") == 1, first)
    long = intervals.groupBy("trial").agg(
        F.min_by("worker", first).alias("worker"),
        F.min_by("task", first).alias("task"),
        F.count(F.lit(1)).alias("n_intervals"),
        F.count_if(F.col("state") == 1).alias("event_count"),
        F.max("time2").alias("last_time2"),
        F.max(first).alias("_last"),
        F.max(event_at).alias("_event"),
    )
    joined = connectedness(intervals, ["trial"], "time1", "time2", chunk, atol)
    short = trials.select(
        "trial",
        F.col("worker").alias("_worker"),
        F.col("task").alias("_task"),
        F.col("total_time").alias("_time"),
        F.col("fatigue").alias("_fatigue"),
        F.lit(True).alias("_found"),
    )
    t = long.join(joined, "trial").join(short, "trial", "left")
    found = F.col("_found").isNotNull()
    events = F.col("event_count")

    def true(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    # Reason codes, in report order.
    on_last = (events == 0) | ((events == 1) & (F.col("_event") == F.col("_last")))
    checks = [
        ("missing_short_record", found),
        ("index_mismatch", true(F.col("_worker") == F.col("worker"))),
        ("task_mismatch", true(F.col("_task") == F.col("task"))),
        ("long_short_time_mismatch", near("_time", "last_time2", atol)),
        ("long_short_event_mismatch", true(F.col("_fatigue") == (events > 0).cast("int"))),
        ("disconnected_intervals", F.col("intervals_connected")),
        ("multiple_state_events", events <= 1),
        ("event_not_last_interval", on_last),
    ]
    reasons = F.array_compact(F.array(*[F.when(~ok, F.lit(code)) for code, ok in checks]))
    return (
        t.withColumn("_reasons", reasons)
        .withColumn("event_on_last_interval", on_last)
        .select(
            "trial", "worker", "task", "n_intervals", "event_count", "last_time2",
            "intervals_connected", "event_on_last_interval",
            (F.size("_reasons") > 0).alias("quarantine"),
            F.array_join("_reasons", ";").alias("quarantine_reason"),
        )
    )


def event_sequences(
    intervals: DataFrame, keys: Sequence[str], chunk: Column | str, atol: float = 1e-9
) -> DataFrame:
    """First event, its place, connectedness and flag range of each interval sequence."""
    from cohortlift.operators.windows import connectedness

    place = F.struct("time1", "time2")
    event = F.when(F.col("state") == 1, place)
    seq = intervals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(event).alias("event_count"),
        F.min(event).alias("_first"),
        F.max(place).alias("_last"),
        F.max("state").cast("bigint").alias("state_max"),
        F.min("time1").alias("first_time1"),
        F.max("time2").alias("last_time2"),
    )
    out = seq.join(connectedness(intervals, keys, "time1", "time2", chunk, atol), list(keys))
    return out.select(
        *keys, "n_rows", "event_count",
        F.col("_first.time1").alias("event_time1"),
        F.col("_first.time2").alias("event_time2"),
        (F.col("_first") == F.col("_last")).alias("event_is_last_row"),
        "state_max", "intervals_connected", "first_time1", "last_time2",
    )


def modal_irregularities(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Cells that differ from their column's mode (smallest value on ties)."""
    long = df.select(key, *[F.col(c).cast("bigint").alias(c) for c in columns]).unpivot(
        [key], list(columns), "column", "val"
    )
    freq = long.groupBy("column", "val").agg(F.count(F.lit(1)).alias("n"))
    mode = freq.groupBy("column").agg(
        F.max_by("val", F.struct("n", -F.col("val"))).alias("modal_value")
    )
    # one row per column of the table
    return long.join(F.broadcast(mode), "column").where(F.col("val") != F.col("modal_value"))


def schema_inventory(df: DataFrame, key: str, columns: Sequence[str], examples: int) -> DataFrame:
    """Distinct sets of present columns, how many records have each, and first examples."""
    names = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns]))
    tagged = df.select(F.col(key), F.array_join(names, ",").alias("columns"))
    counts = tagged.groupBy("columns").agg(F.count(F.lit(1)).alias("n_records"))
    w = W.partitionBy("columns").orderBy(key)
    first = tagged.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= examples)
    shown = first.groupBy("columns").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(key)), lambda v: v.cast("string")), ","
        ).alias("examples")
    )
    return counts.join(shown, "columns").withColumn("schema_id", F.sha2("columns", 256))


def sampling_rates(
    trials: DataFrame, keys: Sequence[str], rows: str, duration: str,
    tolerances: Sequence[float],
) -> DataFrame:
    """Effective rate (median of rows/duration), nearest integer and duration errors by stream.

    ``trials`` has one row per stream key and trial.
    """
    ratio = trials.withColumn("_ratio", F.try_divide(rows, duration))
    usable = ratio.where(F.col("_ratio") > 0)
    rate = exact_quantiles(usable, keys, "_ratio", {"rate": 0.5})
    rate = rate.withColumn("rate_int", F.bround("rate").cast("bigint"))
    err = F.col(rows) / F.nullif(F.col("rate_int"), F.lit(0)) - F.col(duration)
    timed = ratio.join(staged(rate, "rates"), list(keys)).withColumn("_err", err)
    return timed.groupBy(*keys, "rate", "rate_int").agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.min("_err").alias("error_min"),
        F.max("_err").alias("error_max"),
        *[
            F.count_if(F.abs("_err") <= t).alias(f"within_{str(t).replace('.', '_')}")
            for t in tolerances
        ],
    )


def length_consistency(df: DataFrame, trial: Sequence[str], channel: str) -> DataFrame:
    """Whether all channels of a trial hold the same number of samples."""
    sizes = df.groupBy(*trial, channel).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.groupBy(*trial).agg(
        F.count(F.lit(1)).alias("n_channels"),
        F.min("_n").alias("rows_min"),
        F.max("_n").alias("rows_max"),
        (F.min("_n") == F.max("_n")).alias("all_equal"),
    )


def presence(df: DataFrame, name: str, trial: str) -> DataFrame:
    return df.select(name, trial).distinct().groupBy(name).agg(F.count(trial).alias("n_trials"))


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each distinct combination."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        F.sum("_n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        (F.sum("_n") - F.count(F.lit(1))).alias("n_duplicates"),
        F.count_if(F.col("_n") > 1).alias("n_repeated_combinations"),
    )


def anchor_feature_profile(long: DataFrame, anchors: Sequence[str]) -> DataFrame:
    """Size quantiles of each feature under both anchors side by side, and their ratios.

    ``long``: anchor, feature, value.
    """
    sized = long.withColumn("_a", F.abs("value"))
    keys = ["anchor", "feature"]
    probs = {"abs_q50": 0.5, "abs_q95": 0.95, "abs_q99": 0.99}
    ends = sized.groupBy(*keys).agg(
        F.max("_a").alias("abs_max"),
        F.count_if(F.col("_a").isNull()).alias("nonfinite_n"),
    )
    stats = ends.join(exact_quantiles(sized, keys, "_a", probs), keys, "left")
    measures = [*probs, "abs_max", "nonfinite_n"]
    wide = stats.groupBy("feature").agg(
        *[
            F.max(F.when(F.col("anchor") == a, F.col(m))).alias(f"{a.lower()}_{m}")
            for a in anchors
            for m in measures
        ]
    )
    a, b = (x.lower() for x in anchors)
    return (
        wide.withColumn(f"{a}_over_{b}_max_ratio", F.try_divide(f"{a}_abs_max", f"{b}_abs_max"))
        .withColumn(f"{a}_max_over_q99", F.try_divide(f"{a}_abs_max", f"{a}_abs_q99"))
        .withColumn(f"{b}_max_over_q99", F.try_divide(f"{b}_abs_max", f"{b}_abs_q99"))
    )


def row_anomaly_flags(
    long: DataFrame, keys: Sequence[str], thresholds: dict[str, Sequence[float]], top: int
) -> DataFrame:
    """Rows whose largest |value| in a family passes a threshold, with their top features.

    ``long``: keys, family, feature, value. One output row per flagged row and ranked feature.
    """
    keys = list(keys)
    sized = long.where(F.col("value").isNotNull()).withColumn("_a", F.abs("value"))
    flags = []
    for fam, levels in thresholds.items():
        for level in levels:
            hit = (F.col("family") == fam) & (F.col("_a") > level)
            flags.append(F.max(hit.cast("int")).alias(f"{fam}_gt_{level:g}"))
    names = [f"{fam}_gt_{lv:g}" for fam, lvs in thresholds.items() for lv in lvs]
    flagged = sized.groupBy(*keys).agg(*flags).where(" OR ".join(f"`{n}` = 1" for n in names))
    w = W.partitionBy(*keys).orderBy(F.col("_a").desc(), F.col("feature"))
    best = sized.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return best.join(flagged, keys).drop("_a")


def continuity(
    df: DataFrame, keys: Sequence[str], order: str, initial: str, final: str,
    chunk: Column | str,
) -> DataFrame:
    """|next initial - previous final| over repetitions: median, largest, share of exact zeros."""
    from cohortlift.operators.ordered import with_previous

    back = with_previous(df, keys, [order], chunk, [final])
    jump = F.abs(F.col(initial) - F.col(f"prev_{final}"))
    jumps = back.select(F.lit(1).alias("one"), jump.alias("jump")).where("jump IS NOT NULL")
    sums = jumps.groupBy("one").agg(
        F.max("jump").alias("max_jump"),
        F.avg((F.col("jump") == 0).cast("double")).alias("zero_fraction"),
        F.count("jump").alias("n_jumps"),
    )
    return sums.join(exact_quantiles(jumps, ["one"], "jump", {"median_jump": 0.5}), "one").drop("one")


def varying_sequences(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """How many sequences hold more than one value."""
    per = df.groupBy(*keys).agg((F.min(value) != F.max(value)).alias("_varies"))
    return per.agg(F.count_if("_varies").alias("n_varying"), F.count(F.lit(1)).alias("n_sequences"))


def held_out_scale(
    long: DataFrame, folds: DataFrame, keys: Sequence[str], group: str, n_folds: int,
    tiny: float = 1e-10,
) -> DataFrame:
    """Largest |z| of held-out rows under their training fold's median-imputed mean and std.

    ``long``: keys (e.g. anchor, feature), ``group``, value. ``folds``: repeat, group, fold.
    Training statistics of a fold are taken over the rows of all other folds; rows are folded to
    one cell per group before anything is spread over folds.
    """
    keys = list(keys)
    by = ["repeat", "test_fold", *keys]
    # a training set is a (repeat, held-out fold); a group belongs to all of a repeat but its own
    number = F.transform(others("fold", n_folds), lambda f: F.col("repeat") * (n_folds + 1) + f)
    members = folds.groupBy(group).agg(F.sort_array(F.flatten(F.collect_list(number))).alias("sets"))
    # groups that lie in the same folds of all repeats are one cell; there are only so many such classes
    classes = staged(members.groupBy("sets").agg(F.min(group).alias("_class")), "fold-classes")
    placed = staged(members.join(classes, "sets").select(group, "_class"), "classes-of-groups")
    long = long.join(placed, group).select("_class", *keys, "value")
    folds = folds.join(placed, group).select("repeat", "_class", "fold").distinct()
    members, group = classes, "_class"
    stats = imputed_statistics(long, members, group, keys, "value")
    stats = stats.select(
        F.floor(F.col("set") / (n_folds + 1)).cast("int").alias("repeat"),
        (F.col("set") % (n_folds + 1)).alias("test_fold"),
        *keys, "median", F.col("mean").alias("train_mean"), F.col("sd").alias("train_std"),
    )
    own = long.groupBy(group, *keys).agg(
        F.max("value").alias("_max"), F.min("value").alias("_min"), F.count_if(F.col("value").isNull()).alias("_null")
    )
    placed = own.join(spread_side(folds), group)
    test = placed.groupBy("repeat", F.col("fold").alias("test_fold"), *keys).agg(
        F.max("_max").alias("_max"), F.min("_min").alias("_min"), F.sum("_null").alias("nonfinite_n")
    )
    joined = test.join(stats, by)
    filled = F.when(F.col("nonfinite_n") > 0, F.col("median"))
    hi = F.greatest(F.col("_max"), filled)
    lo = F.least(F.col("_min"), filled)
    reach = F.greatest(F.abs(hi - F.col("train_mean")), F.abs(lo - F.col("train_mean")))
    return joined.select(
        *by,
        "train_std",
        F.when(F.col("train_std") > 0, reach / F.col("train_std")).alias("test_max_abs_z"),
        F.greatest(F.abs(hi), F.abs(lo)).alias("test_max_abs_raw"),
        "nonfinite_n",
        ((F.col("train_std") > 0) & (F.col("train_std") < tiny)).alias("tiny_train_std"),
    )


def path_anomalies(files: DataFrame, path: str, folder: str, name: str) -> DataFrame:
    """One row per file and failed naming rule, with the disagreeing parts spelled out."""
    from cohortlift.functions.parsing import expected_code, identity, task_from_path

    t = files.withColumn("_f", identity(F.col(folder))).withColumn("_n", identity(F.col(name)))
    t = t.withColumn("_task", task_from_path(F.col(path)))
    t = t.withColumn("_code", expected_code(F.col("_task")))
    chosen = F.when(F.col("_n.participant").isNotNull(), F.col("_n")).otherwise(F.col("_f"))
    t = t.withColumn("_who", chosen)

    def differ(a: str, b: str) -> Column:
        return F.coalesce(F.col(a) != F.col(b), F.lit(False))

    who = F.col("_who.participant")
    # Anomaly codes and their wording.
    found = [
        ("folder_task_code_mismatch", differ("_f.code", "_code"),
         F.concat(F.lit("directory task="), F.col("_task"), F.lit(", folder code="), F.col("_f.code"))),
        ("filename_task_code_mismatch", differ("_n.code", "_code"),
         F.concat(F.lit("directory task="), F.col("_task"), F.lit(", filename code="), F.col("_n.code"))),
        ("participant_folder_filename_mismatch", differ("_f.participant", "_n.participant"),
         F.concat(F.lit("folder="), F.col("_f.participant"), F.lit(" filename="), F.col("_n.participant"))),
        ("session_folder_filename_mismatch", differ("_f.session", "_n.session"),
         F.concat(F.lit("folder S"), F.col("_f.session"), F.lit(" filename S"), F.col("_n.session"))),
        ("participant_unparsed", who.isNull(),
         F.lit("No participant identifier could be parsed")),
        ("nonstandard_participant_id", who.isNotNull() & ~F.col("_who.standard"), who),
    ]
    rows = F.array_compact(
        F.array(*[
            F.when(hit, F.struct(F.lit(code).alias("type"), detail.alias("detail")))
            for code, hit, detail in found
        ])
    )
    return t.select(*files.columns, F.explode(rows).alias("_r")).select(*files.columns, "_r.*")


def cross_task_differences(
    df: DataFrame, participant: str, task: str, fields: Sequence[str], first: str, second: str,
    atol: float = 1e-9,
) -> DataFrame:
    """Participants whose median of a field differs between two named tasks."""
    two = df.where(F.col(task).isin(first, second))
    long = two.unpivot([participant, task], list(fields), "field", "val")
    med = exact_quantiles(long, [participant, task, "field"], "val", {"median": 0.5})
    wide = med.groupBy(participant, "field").agg(
        F.max(F.when(F.col(task) == first, F.col("median"))).alias("first_median"),
        F.max(F.when(F.col(task) == second, F.col("median"))).alias("second_median"),
    )
    known = F.col("first_median").isNotNull() & F.col("second_median").isNotNull()
    return wide.where(known & ~near("first_median", "second_median", atol))
