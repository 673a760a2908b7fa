"""Audit and profile plans over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlift.operators import profiling as pf
from cohortlift.operators import windows as wn
from cohortlift.operators.ordered import exact_quantiles, with_previous
from cohortlift.plans import fixtures as fx
from cohortlift.plans.registry import query
from cohortlift.sources.tables import staged

POS = "floor(pos / 65536)"
TIME = "floor(time1 / 655360)"


@query(
    "a7_constant_profile",
    """SELECT participant, day, arg_min(value, pos) FILTER (WHERE value IS NOT NULL) AS first,
      avg(value) AS mean, min(value) AS min, max(value) AS max, count(DISTINCT value) AS nunique,
      avg((value IS NULL)::INT::DOUBLE) AS missing_rate FROM signals GROUP BY participant, day""",
    ["signals"],
    ["mean", "missing_rate"],
)
def a7(spark, sf_dir):
    """First value, range, distinct count and missing share per participant-day."""
    return pf.constant_profile(fx.signals(spark, sf_dir), ["participant", "day"], "value", ["pos"])


@query(
    "a8_missing_and_sentinel_rates",
    """SELECT participant, count(*) FILTER (WHERE value IS NULL) / count(*)::DOUBLE
        AS sensor_missing_rate,
      count(*) FILTER (WHERE value = -2) / greatest(count(value), 1)::DOUBLE
        AS sensor_sentinel_rate FROM signals GROUP BY participant""",
    ["signals"],
    ["sensor_missing_rate", "sensor_sentinel_rate"],
)
def a8(spark, sf_dir):
    """Missing share of cells and sentinel share of present cells."""
    return pf.missing_and_sentinel(fx.signals(spark, sf_dir), ["participant"], "value", -2.0)


DUP_SQL = """dup AS (SELECT channel,
    avg(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN (abs(x - y) <= 1e-12)::INT::DOUBLE END) AS xy_equal,
    avg(CASE WHEN x IS NOT NULL AND z IS NOT NULL THEN (abs(x - z) <= 1e-12)::INT::DOUBLE END) AS xz_equal,
    avg(CASE WHEN y IS NOT NULL AND z IS NOT NULL THEN (abs(y - z) <= 1e-12)::INT::DOUBLE END) AS yz_equal
    FROM axes GROUP BY channel)"""


@query(
    "a9_axis_duplication",
    f"""WITH {DUP_SQL} SELECT *, CASE WHEN xy_equal IS NOT NULL AND xz_equal IS NOT NULL
      AND yz_equal IS NOT NULL THEN xy_equal >= 0.99 AND xz_equal >= 0.99 AND yz_equal >= 0.99 END
      AS all_duplicated FROM dup""",
    ["axes"],
    ["xy_equal", "xz_equal", "yz_equal"],
)
def a9(spark, sf_dir):
    """Share of equal axis pairs per channel."""
    return pf.axis_duplication(fx.axes(spark, sf_dir), ["channel"], ["x", "y", "z"])


@query(
    "a9_duplication_rollup",
    f"""WITH {DUP_SQL}, long AS (SELECT channel % 5 AS device, pair, share FROM
      dup UNPIVOT INCLUDE NULLS (share FOR pair IN (xy_equal, xz_equal, yz_equal)))
    SELECT device, pair, avg(share) AS mean, quantile_cont(share, 0.5) AS median,
      count(*) FILTER (WHERE share >= 0.99) AS flagged_n, count(share) AS known_n
    FROM long GROUP BY device, pair""",
    ["axes"],
    ["mean", "median"],
)
def a9_rollup(spark, sf_dir):
    """Pair shares rolled up per device."""
    shares = pf.axis_duplication(fx.axes(spark, sf_dir), ["channel"], ["x", "y", "z"])
    shares = shares.withColumn("device", F.col("channel") % 5)
    return pf.duplication_rollup(shares, ["device"], ["xy_equal", "xz_equal", "yz_equal"])


MISS_SQL = """miss AS (SELECT "column", missing_n, missing_n / n::DOUBLE AS missing_rate FROM (
    SELECT 'x' AS "column", count(*) - count(x) AS missing_n, count(*) AS n FROM axes
    UNION ALL SELECT 'y', count(*) - count(y), count(*) FROM axes
    UNION ALL SELECT 'z', count(*) - count(z), count(*) FROM axes))"""


@query(
    "a10_missingness_ranking",
    f"""WITH {MISS_SQL} SELECT *, row_number() OVER (ORDER BY missing_rate DESC, "column") AS rank
    FROM miss""",
    ["axes"],
    ["missing_rate"],
)
def a10(spark, sf_dir):
    """Columns ranked by missing share."""
    return pf.column_missingness(fx.axes(spark, sf_dir), ["x", "y", "z"])


GRID_COLS = [f"{i * 10}_sec" for i in fx.GRID_LINES]


@query(
    "a10_missingness_shares",
    "WITH one AS (SELECT "
    + ", ".join(f'1 - count("{c}") / count(*)::DOUBLE AS "{c}"' for c in GRID_COLS)
    + """ FROM rating_grid), long AS (UNPIVOT one ON COLUMNS(*) INTO NAME c VALUE r)
    SELECT count(*) AS n_columns, count(*) FILTER (WHERE r > 0.2) AS over_20_percent,
      count(*) FILTER (WHERE r >= 1) AS all_missing FROM long""",
    ["rating_grid"],
)
def a10_shares(spark, sf_dir):
    """How many grid columns are more than a fifth, or wholly, missing."""
    rates = pf.column_missingness(fx.rating_grid(spark, sf_dir), GRID_COLS)
    return rates.agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.count_if(F.col("missing_rate") > 0.2).alias("over_20_percent"),
        F.count_if(F.col("missing_rate") >= 1).alias("all_missing"),
    )


@query(
    "a11_constant_columns",
    """SELECT 'end_of_trial' AS "column", count(DISTINCT end_of_trial) <= 1 AS is_constant FROM rating_grid
    UNION ALL SELECT 'before_task', count(DISTINCT before_task) <= 1 FROM rating_grid
    UNION ALL SELECT 'length_of_trial', count(DISTINCT length_of_trial) <= 1 FROM rating_grid""",
    ["rating_grid"],
)
def a11(spark, sf_dir):
    """Columns that never change."""
    return pf.constant_columns(
        fx.rating_grid(spark, sf_dir), ["end_of_trial", "before_task", "length_of_trial"]
    )


@query(
    "a12_numeric_summary",
    """SELECT channel, count(value) AS n, avg((value IS NULL)::INT::DOUBLE) AS missing_rate,
      count(DISTINCT value) AS nunique, min(value) AS min, max(value) AS max,
      quantile_cont(value, 0.5) AS median FROM signals GROUP BY channel""",
    ["signals"],
    ["missing_rate", "median"],
)
def a12(spark, sf_dir):
    """Count, missing share, distinct count, range and median per channel."""
    return pf.numeric_summary(fx.signals(spark, sf_dir), ["channel"], "value")


@query(
    "a13_low_cardinality",
    """WITH long AS (SELECT DISTINCT 'o_orderstatus' AS "column", o_orderstatus AS val FROM orders
      UNION SELECT 'o_orderpriority', o_orderpriority FROM orders
      UNION SELECT 'o_custkey', o_custkey::VARCHAR FROM orders)
    SELECT "column", count(*) AS nunique, string_agg(val, ',' ORDER BY val) AS vals
    FROM long GROUP BY "column" HAVING count(*) BETWEEN 1 AND 30""",
)
def a13(spark, sf_dir):
    """Columns with at most thirty values, and the values."""
    return pf.low_cardinality(
        fx.table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"], 30
    )


@query(
    "a14_group_counts",
    """SELECT channel, day, count(*) AS n_rows, count(DISTINCT participant) AS n_participants
    FROM signals GROUP BY channel, day""",
    ["signals"],
)
def a14(spark, sf_dir):
    """Rows and distinct participants per task and day."""
    return pf.group_counts(fx.signals(spark, sf_dir), ["channel", "day"], "participant")


@query(
    "a15_rows_per_participant",
    """SELECT min(n) AS min, max(n) AS max, count(*) AS groups, quantile_cont(n, 0.5) AS median
    FROM (SELECT count(*)::DOUBLE AS n FROM signals GROUP BY participant)""",
    ["signals"],
)
def a15(spark, sf_dir):
    """Spread of rows per participant."""
    return pf.spread_of_group_sizes(fx.signals(spark, sf_dir), "participant")


@query(
    "a16_repetition_completeness",
    """SELECT trial, count(line) AS n_rep, count(DISTINCT line) AS n_unique_reps,
      min(line) AS min_rep, max(line) AS max_rep,
      count(DISTINCT line) = 5 AND min(line) = 1 AND max(line) = 5 AS complete
    FROM axes GROUP BY trial""",
    ["axes"],
)
def a16(spark, sf_dir):
    """Complete sequences hold repetitions one to five."""
    return pf.repetition_completeness(fx.axes(spark, sf_dir), ["trial"], "line", 5)


QC_SQL = """g AS (SELECT trial, arg_min(worker, time1) AS worker, arg_min(task, time1) AS task,
    count(*) AS n_intervals, count(*) FILTER (WHERE state = 1) AS event_count,
    max(time2) AS last_time2, max(time1) AS lt1, max(CASE WHEN state = 1 THEN time1 END) AS et1
    FROM intervals GROUP BY trial),
  c AS (SELECT trial, coalesce(bool_and(abs(time2 - nxt) <= 1e-9), true) AS intervals_connected
    FROM (SELECT *, lead(time1) OVER (PARTITION BY trial ORDER BY time1, time2) AS nxt FROM intervals)
    GROUP BY trial),
  qc0 AS (SELECT g.*, c.intervals_connected, s.trial IS NOT NULL AS found,
    coalesce(s.worker = g.worker, false) AS im, coalesce(s.task = g.task, false) AS tm,
    coalesce(abs(s.total_time - last_time2) <= 1e-9, false) AS tim,
    coalesce(s.fatigue = (event_count > 0)::INT, false) AS em,
    event_count = 0 OR (event_count = 1 AND et1 = lt1) AS event_on_last_interval
    FROM g JOIN c USING (trial) LEFT JOIN trials s ON s.trial = g.trial),
  qc AS (SELECT trial, worker, task, n_intervals, event_count, last_time2, intervals_connected,
    event_on_last_interval,
    NOT (found AND im AND tm AND tim AND em AND intervals_connected AND event_count <= 1
      AND event_on_last_interval) AS quarantine,
    concat_ws(';', CASE WHEN NOT found THEN 'missing_short_record' END,
      CASE WHEN NOT im THEN 'index_mismatch' END, CASE WHEN NOT tm THEN 'task_mismatch' END,
      CASE WHEN NOT tim THEN 'long_short_time_mismatch' END,
      CASE WHEN NOT em THEN 'long_short_event_mismatch' END,
      CASE WHEN NOT intervals_connected THEN 'disconnected_intervals' END,
      CASE WHEN event_count > 1 THEN 'multiple_state_events' END,
      CASE WHEN NOT event_on_last_interval THEN 'event_not_last_interval' END) AS quarantine_reason
    FROM qc0)"""


def quality(spark, sf_dir):
    """The intervals, put together once for every check, and the verdict on each trial."""
    rows = staged(fx.intervals(spark, sf_dir), "intervals")
    return rows, pf.trial_quality(rows, fx.trials(spark, sf_dir, rows), TIME)


@query("a17_trial_quality", f"WITH {QC_SQL} SELECT * FROM qc", ["trials"])
def a17(spark, sf_dir):
    """Eight coded checks per trial with the quarantine verdict."""
    return quality(spark, sf_dir)[1]


SEQ_SQL = """seq AS (SELECT i.trial, i.worker, i.task, count(*) AS n_rows,
    count(*) FILTER (WHERE state = 1) AS event_count,
    min(time1) FILTER (WHERE state = 1) AS event_time1,
    min(time2) FILTER (WHERE state = 1) AS event_time2,
    min(time1) FILTER (WHERE state = 1) = max(time1) AS event_is_last_row,
    max(state)::BIGINT AS state_max,
    coalesce(bool_and(abs(time2 - nxt) <= 1e-9), true) AS intervals_connected,
    min(time1) AS first_time1, max(time2) AS last_time2
    FROM (SELECT *, lead(time1) OVER (PARTITION BY trial ORDER BY time1) AS nxt FROM intervals) i
    GROUP BY ALL)"""


def sequences(spark, sf_dir):
    return pf.event_sequences(fx.intervals(spark, sf_dir), ["trial", "worker", "task"], TIME)


@query("a18_event_sequences", f"WITH {SEQ_SQL} SELECT * FROM seq", ["intervals"])
def a18(spark, sf_dir):
    """First event and connectedness of each interval sequence."""
    return sequences(spark, sf_dir)


@query(
    "a19_ambiguous_ids",
    """SELECT 'l_suppkey' AS target, count(*) AS n_ids, count(*) FILTER (WHERE n > 1) AS n_ambiguous
      FROM (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey)
    UNION ALL SELECT 'l_linestatus', count(*), count(*) FILTER (WHERE n > 1)
      FROM (SELECT count(DISTINCT l_linestatus) AS n FROM lineitem GROUP BY l_partkey)""",
)
def a19(spark, sf_dir):
    """Ids that map to more than one value of a column that should depend on them."""
    return pf.ambiguous_ids(
        fx.table(spark, sf_dir, "lineitem"), "l_partkey", ["l_suppkey", "l_linestatus"]
    )


@query(
    "a20_task_coverage",
    """SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_tasks,
      string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS tasks
    FROM orders GROUP BY o_custkey""",
)
def a20(spark, sf_dir):
    """Distinct tasks of each participant."""
    return pf.coverage(fx.table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query(
    "a20_trial_id_lists",
    """SELECT o_custkey, (rn - 1) // 1000 AS block, count(*) AS n_ids,
      string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids
    FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)
      AS rn FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)) GROUP BY ALL""",
)
def a20_ids(spark, sf_dir):
    """Sorted trial ids of each participant, a thousand to a row."""
    return pf.id_blocks(
        fx.table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "floor(o_orderkey / 1000000)"
    )


@query(
    "a21_event_time_summary",
    f"""WITH {SEQ_SQL} SELECT count(event_time2) AS n_events, min(event_time2) AS min,
      quantile_cont(event_time2, 0.5) AS median, max(event_time2) AS max FROM seq""",
    ["intervals"],
)
def a21(spark, sf_dir):
    """Range and median of first-event times."""
    seq = sequences(spark, sf_dir).withColumn("one", F.lit(1))
    ends = seq.groupBy("one").agg(
        F.count("event_time2").alias("n_events"),
        F.min("event_time2").alias("min"),
        F.max("event_time2").alias("max"),
    )
    return ends.join(exact_quantiles(seq, ["one"], "event_time2", {"median": 0.5}), "one").drop("one")


@query(
    "a21_event_time_counts",
    f"""WITH {SEQ_SQL} SELECT event_time2, count(*) AS n FROM seq WHERE event_time2 IS NOT NULL
    GROUP BY event_time2""",
    ["intervals"],
)
def a21_counts(spark, sf_dir):
    """How many sequences have their first event at each time."""
    seq = sequences(spark, sf_dir).where("event_time2 IS NOT NULL")
    return seq.groupBy("event_time2").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a23_sampling_rates",
    """WITH t AS (SELECT channel, participant, count(*) AS n,
      (max(t_us) - min(t_us)) / 86400000000.0::DOUBLE AS dur FROM signals GROUP BY ALL),
    r AS (SELECT channel, quantile_cont(n / dur, 0.5) AS rate FROM t WHERE n / dur > 0 GROUP BY channel),
    e AS (SELECT channel, rate, round_even(rate, 0)::BIGINT AS rate_int,
      n / nullif(round_even(rate, 0), 0) - dur AS err FROM t JOIN r USING (channel))
    SELECT channel, rate, rate_int, count(*) AS n_trials, min(err) AS error_min, max(err) AS error_max,
      count(*) FILTER (WHERE abs(err) <= 0.5) AS within_0_5,
      count(*) FILTER (WHERE abs(err) <= 2) AS within_2,
      count(*) FILTER (WHERE abs(err) <= 5) AS within_5 FROM e GROUP BY channel, rate, rate_int""",
    ["signals"],
    ["rate", "error_min", "error_max"],
)
def a23(spark, sf_dir):
    """Samples per day of each channel, nearest integer and the duration it implies."""
    trials = fx.signals(spark, sf_dir).groupBy("channel", "participant").agg(
        F.count(F.lit(1)).alias("n"),
        ((F.max("t_us") - F.min("t_us")) / 86_400_000_000.0).alias("dur"),
    )
    return pf.sampling_rates(trials, ["channel"], "n", "dur", [0.5, 2, 5])


@query(
    "a24_length_consistency",
    """SELECT participant, count(*) AS n_channels, min(n) AS rows_min, max(n) AS rows_max,
      min(n) = max(n) AS all_equal FROM (SELECT participant, channel, count(*) AS n FROM signals
      GROUP BY ALL) GROUP BY participant""",
    ["signals"],
)
def a24(spark, sf_dir):
    """Sample counts of a participant's channels compared."""
    return pf.length_consistency(fx.signals(spark, sf_dir), ["participant"], "channel")


@query(
    "a25_modal_irregularities",
    """WITH t AS (SELECT trial, count(*) AS n_rows, count(DISTINCT line) AS n_lines FROM axes GROUP BY trial),
    long AS (SELECT trial, "column", val FROM (UNPIVOT t ON n_rows, n_lines INTO NAME "column" VALUE val)),
    freq AS (SELECT "column", val, count(*) AS n FROM long GROUP BY ALL),
    mode AS (SELECT "column", val AS modal_value FROM freq
      QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, val) = 1)
    SELECT long."column", trial, val, modal_value FROM long JOIN mode USING ("column")
    WHERE val <> modal_value""",
    ["axes"],
)
def a25(spark, sf_dir):
    """Trials whose structure differs from the most common one."""
    t = fx.axes(spark, sf_dir).groupBy("trial").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("line").alias("n_lines")
    )
    return pf.modal_irregularities(t, "trial", ["n_rows", "n_lines"])


@query(
    "a26_presence_counts",
    "SELECT channel, count(DISTINCT trial) AS n_trials FROM axes GROUP BY channel",
    ["axes"],
)
def a26(spark, sf_dir):
    """In how many trials each channel occurs."""
    return pf.presence(fx.axes(spark, sf_dir), "channel", "trial")


@query(
    "a27_schema_inventory",
    "WITH t AS (SELECT pos, concat_ws(',', "
    + ", ".join(f"CASE WHEN \"{c}\" IS NOT NULL THEN '{c}' END" for c in ["subject", *GRID_COLS])
    + """) AS columns FROM rating_grid),
    r AS (SELECT *, row_number() OVER (PARTITION BY columns ORDER BY pos) AS rn FROM t)
    SELECT columns, count(*) AS n_records,
      string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (WHERE rn <= 5) AS examples,
      sha256(columns) AS schema_id FROM r GROUP BY columns""",
    ["rating_grid"],
)
def a27(spark, sf_dir):
    """Distinct sets of filled columns with five example records each."""
    return pf.schema_inventory(
        fx.rating_grid(spark, sf_dir), "pos", ["subject", *GRID_COLS], 5
    )


@query(
    "a28_inventory_by_extension",
    """SELECT regexp_extract(url, '\\.([a-z]+)/', 1) AS ext, count(*) AS n_files,
      sum(strlen(html))::BIGINT AS total_bytes, max(strlen(html))::BIGINT AS largest FROM pages GROUP BY ext""",
)
def a28(spark, sf_dir):
    """Items and bytes by suffix."""
    return fx.table(spark, sf_dir, "pages").groupBy(
        F.regexp_extract("url", r"\.([a-z]+)/", 1).alias("ext")
    ).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum(F.octet_length("html")).cast("bigint").alias("total_bytes"),
        F.max(F.octet_length("html")).cast("bigint").alias("largest"),
    )


@query(
    "a29_duplicate_rows",
    """SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, (sum(n) - count(*))::BIGINT AS n_duplicates,
      count(*) FILTER (WHERE n > 1) AS n_repeated_combinations
    FROM (SELECT count(*) AS n FROM axes GROUP BY trial, line)""",
    ["axes"],
)
def a29(spark, sf_dir):
    """Rows that repeat a (trial, line) pair."""
    return pf.duplicate_rows(fx.axes(spark, sf_dir), ["trial", "line"])


LONG_SQL = """lng AS (SELECT anchor, task || '__' || feature_set || '__' || repeat AS feature,
    task IN ('view', 'click') AS motion, row_id, grp, CASE WHEN row_id % 97 = 0 THEN NULL ELSE y_pred END AS value
    FROM predictions)"""


def anchored(spark, sf_dir):
    """Every stored prediction as a feature of its row: task, feature set and repeat name it."""
    return fx.predictions(spark, sf_dir).select(
        "anchor",
        F.concat_ws("__", "task", "feature_set", F.col("repeat").cast("string")).alias("feature"),
        F.col("task").isin("view", "click").alias("motion"),
        "row_id",
        "grp",
        F.when(F.col("row_id") % 97 != 0, F.col("y_pred")).alias("value"),
    )


@query(
    "a30_anchor_feature_profile",
    f"""WITH {LONG_SQL}, s AS (SELECT anchor, feature, quantile_cont(abs(value), 0.5) AS q50,
      quantile_cont(abs(value), 0.95) AS q95, quantile_cont(abs(value), 0.99) AS q99,
      max(abs(value)) AS mx, count(*) - count(value) AS nf FROM lng GROUP BY ALL)
    SELECT a.feature, a.q50 AS start_abs_q50, a.q95 AS start_abs_q95, a.q99 AS start_abs_q99,
      a.mx AS start_abs_max, a.nf AS start_nonfinite_n, b.q50 AS end_abs_q50, b.q95 AS end_abs_q95,
      b.q99 AS end_abs_q99, b.mx AS end_abs_max, b.nf AS end_nonfinite_n,
      a.mx / nullif(b.mx, 0) AS start_over_end_max_ratio, a.mx / nullif(a.q99, 0) AS start_max_over_q99,
      b.mx / nullif(b.q99, 0) AS end_max_over_q99
    FROM s a JOIN s b ON a.feature = b.feature AND a.anchor = 'START' AND b.anchor = 'END'""",
    ["predictions"],
    [
        f"{a}_{m}" for a in ("start", "end") for m in ("abs_q50", "abs_q95", "abs_q99", "abs_max")
    ] + ["start_over_end_max_ratio", "start_max_over_q99", "end_max_over_q99"],
)
def a30(spark, sf_dir):
    """Feature size quantiles under both anchors and their ratios."""
    return pf.anchor_feature_profile(
        anchored(spark, sf_dir).select("anchor", "feature", "value"), ["START", "END"]
    )


FLAG_SQL = """m AS (SELECT anchor, grp, CASE WHEN motion THEN 'motion' ELSE 'other' END AS family,
    feature, row_id, value FROM lng WHERE value IS NOT NULL),
  f AS (SELECT anchor, grp, max((family = 'motion' AND abs(value) > 150)::INT) AS motion_gt_150,
      max((family = 'motion' AND abs(value) > 200)::INT) AS motion_gt_200,
      max((family = 'other' AND abs(value) > 160)::INT) AS other_gt_160 FROM m GROUP BY ALL),
  hit AS (SELECT * FROM f WHERE motion_gt_150 = 1 OR motion_gt_200 = 1 OR other_gt_160 = 1)"""
THRESHOLDS = {"motion": [150.0, 200.0], "other": [160.0]}


def flagged(spark, sf_dir):
    df = anchored(spark, sf_dir).select(
        "anchor", "grp",
        F.when(F.col("motion"), F.lit("motion")).otherwise(F.lit("other")).alias("family"),
        F.concat_ws("__", "feature", F.lpad(F.col("row_id").cast("string"), 12, "0")).alias("feature"),
        "value",
    )
    return pf.row_anomaly_flags(df, ["anchor", "grp"], THRESHOLDS, 10)


@query(
    "a31_row_anomaly_flags",
    f"""WITH {LONG_SQL}, {FLAG_SQL},
    r AS (SELECT anchor, grp, family, feature || '__' || lpad(row_id::VARCHAR, 12, '0') AS feature, value,
      row_number() OVER (PARTITION BY anchor, grp ORDER BY abs(value) DESC,
        feature || '__' || lpad(row_id::VARCHAR, 12, '0')) AS rank FROM m)
    SELECT r.*, motion_gt_150, motion_gt_200, other_gt_160 FROM r JOIN hit USING (anchor, grp)
    WHERE rank <= 10""",
    ["predictions"],
    ["value"],
)
def a31(spark, sf_dir):
    """Units past a gross threshold with their ten largest features."""
    return flagged(spark, sf_dir)


@query(
    "a32_flag_concentration",
    f"""WITH {LONG_SQL}, {FLAG_SQL}
    SELECT grp, count(*) AS n_flagged, sum(motion_gt_150)::BIGINT AS motion_flags,
      sum(other_gt_160)::BIGINT AS other_flags FROM hit GROUP BY grp""",
    ["predictions"],
)
def a32(spark, sf_dir):
    """Where the flagged units concentrate."""
    df = flagged(spark, sf_dir).where("rank = 1")
    return df.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_flagged"),
        F.sum("motion_gt_150").alias("motion_flags"),
        F.sum("other_gt_160").alias("other_flags"),
    ).orderBy(F.col("n_flagged").desc(), "grp")


@query(
    "a39_prediction_stability",
    """WITH f AS (SELECT anchor, feature_set, repeat, outer_fold, max(abs(y_pred)) AS m
      FROM predictions GROUP BY ALL)
    SELECT anchor, feature_set, max(m) AS max_abs, quantile_cont(m, 0.5) AS median_abs,
      count(*) AS n_folds FROM f GROUP BY anchor, feature_set""",
    ["predictions"],
    ["max_abs", "median_abs"],
)
def a39(spark, sf_dir):
    """Largest and median of the folds' largest predictions (one value per fold)."""
    folds = fx.predictions(spark, sf_dir).groupBy(
        "anchor", "feature_set", "repeat", "outer_fold"
    ).agg(F.max(F.abs("y_pred")).alias("m"))
    return folds.groupBy("anchor", "feature_set").agg(
        F.max("m").alias("max_abs"),
        F.percentile("m", 0.5).alias("median_abs"),
        F.count("m").alias("n_folds"),
    )


@query(
    "a40_held_out_scale",
    f"""WITH {LONG_SQL}, p AS (SELECT lng.*, repeat, ((grp * 7 + repeat * 3) % 5 + 1)::INT AS fold
      FROM lng, (SELECT unnest([1, 2, 3, 4, 5]) AS repeat)),
    tr AS (SELECT repeat, f AS test_fold, anchor, feature, value FROM p,
      (SELECT unnest([1, 2, 3, 4, 5]) AS f) WHERE fold <> f),
    md AS (SELECT repeat, test_fold, anchor, feature, coalesce(quantile_cont(value, 0.5), 0) AS med
      FROM tr GROUP BY ALL),
    st AS (SELECT repeat, test_fold, anchor, feature, any_value(med) AS med,
      avg(coalesce(value, med)) AS mu, stddev_pop(coalesce(value, med)) AS train_std
      FROM tr JOIN md USING (repeat, test_fold, anchor, feature) GROUP BY ALL)
    SELECT st.repeat, st.test_fold, st.anchor, st.feature, train_std,
      max(abs(coalesce(value, med) - mu)) / nullif(train_std, 0) AS test_max_abs_z,
      max(abs(coalesce(value, med))) AS test_max_abs_raw,
      count(*) FILTER (WHERE value IS NULL) AS nonfinite_n,
      train_std > 0 AND train_std < 1e-10 AS tiny_train_std
    FROM st JOIN p ON st.repeat = p.repeat AND st.test_fold = p.fold AND st.anchor = p.anchor
      AND st.feature = p.feature GROUP BY st.repeat, st.test_fold, st.anchor, st.feature, train_std""",
    ["predictions"],
    ["train_std", "test_max_abs_z", "test_max_abs_raw"],
)
def a40(spark, sf_dir):
    """Largest held-out z-score per fold and feature."""
    long = anchored(spark, sf_dir).select("anchor", "feature", "grp", "value")
    groups = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("grp")).distinct()
    groups = groups.withColumn("repeat", fx.explode_of(*range(1, fx.REPEATS + 1)))
    folds = groups.withColumn("fold", ((F.col("grp") * 7 + F.col("repeat") * 3) % 5 + 1).cast("int"))
    return pf.held_out_scale(long, folds, ["anchor", "feature"], "grp", 5)


@query(
    "a40_scale_ranking",
    f"""WITH {LONG_SQL}, p AS (SELECT lng.*, repeat, ((grp * 7 + repeat * 3) % 5 + 1)::INT AS fold
      FROM lng, (SELECT unnest([1, 2, 3, 4, 5]) AS repeat)),
    tr AS (SELECT repeat, f AS test_fold, anchor, feature, value FROM p,
      (SELECT unnest([1, 2, 3, 4, 5]) AS f) WHERE fold <> f),
    md AS (SELECT repeat, test_fold, anchor, feature, coalesce(quantile_cont(value, 0.5), 0) AS med
      FROM tr GROUP BY ALL),
    st AS (SELECT repeat, test_fold, anchor, feature, any_value(med) AS med,
      avg(coalesce(value, med)) AS mu, stddev_pop(coalesce(value, med)) AS train_std
      FROM tr JOIN md USING (repeat, test_fold, anchor, feature) GROUP BY ALL),
    z AS (SELECT st.anchor, st.feature, train_std,
      max(abs(coalesce(value, med) - mu)) / nullif(train_std, 0) AS z,
      max(abs(coalesce(value, med))) AS raw, count(*) FILTER (WHERE value IS NULL) AS nf
      FROM st JOIN p ON st.repeat = p.repeat AND st.test_fold = p.fold AND st.anchor = p.anchor
        AND st.feature = p.feature
      GROUP BY st.repeat, st.test_fold, st.anchor, st.feature, train_std)
    SELECT anchor, feature, max(z) AS max_test_abs_z, quantile_cont(z, 0.5) AS median_test_abs_z,
      min(train_std) AS min_train_std, max(raw) AS max_test_abs_raw,
      count(*) FILTER (WHERE train_std > 0 AND train_std < 1e-10) AS tiny_std_fold_count,
      sum(nf)::BIGINT AS nonfinite_test_count FROM z GROUP BY anchor, feature""",
    ["predictions"],
    ["max_test_abs_z", "median_test_abs_z", "min_train_std", "max_test_abs_raw"],
)
def a40_ranking(spark, sf_dir):
    """Features ranked by their largest held-out z-score (one value per fold)."""
    z = a40(spark, sf_dir)
    return z.groupBy("anchor", "feature").agg(
        F.max("test_max_abs_z").alias("max_test_abs_z"),
        F.percentile("test_max_abs_z", 0.5).alias("median_test_abs_z"),
        F.min("train_std").alias("min_train_std"),
        F.max("test_max_abs_raw").alias("max_test_abs_raw"),
        F.count_if("tiny_train_std").alias("tiny_std_fold_count"),
        F.sum("nonfinite_n").alias("nonfinite_test_count"),
    ).orderBy("anchor", F.col("max_test_abs_z").desc())


@query(
    "a41_content_fingerprint",
    """SELECT o_orderpriority, (rn - 1) // 4096 AS block, count(*) AS n_ids,
      sha256(string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey)) AS digest
    FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn
      FROM orders) GROUP BY ALL""",
)
def a41(spark, sf_dir):
    """Digest of the sorted ids, block by block."""
    return pf.content_fingerprint(
        fx.table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey",
        "floor(o_orderkey / 65536)",
    )


REPS_SQL = """reps AS (SELECT o_custkey AS participant, o_orderpriority AS task, o_orderkey AS rep,
    floor(o_totalprice / 50000) AS initial,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE floor(o_totalprice / 60000) END AS final FROM orders)"""


def repetitions(spark, sf_dir):
    key = F.col("o_orderkey")
    return fx.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("participant"),
        F.col("o_orderpriority").alias("task"),
        key.alias("rep"),
        F.floor(F.col("o_totalprice") / 50000).cast("double").alias("initial"),
        F.when(key % 11 != 0, F.floor(F.col("o_totalprice") / 60000).cast("double")).alias("final"),
    )


REP_CHUNK = "floor(rep / 1000000)"


@query(
    "a42_repetition_continuity",
    f"""WITH {REPS_SQL}, j AS (SELECT abs(initial - lag(final) OVER
      (PARTITION BY participant, task ORDER BY rep)) AS jump FROM reps)
    SELECT max(jump) AS max_jump, avg((jump = 0)::INT::DOUBLE) AS zero_fraction,
      count(jump) AS n_jumps, quantile_cont(jump, 0.5) AS median_jump FROM j WHERE jump IS NOT NULL""",
    rounded=["zero_fraction"],
)
def a42(spark, sf_dir):
    """Jump from one repetition's end to the next one's start."""
    return pf.continuity(
        repetitions(spark, sf_dir), ["participant", "task"], "rep", "initial", "final", REP_CHUNK
    )


@query(
    "a42_varying_sequences",
    f"""WITH {REPS_SQL} SELECT count(*) FILTER (WHERE n > 1) AS n_varying, count(*) AS n_sequences
    FROM (SELECT count(DISTINCT final) AS n FROM reps GROUP BY participant, task)""",
)
def a42_varying(spark, sf_dir):
    """Sequences whose final rating is not the same throughout."""
    return pf.varying_sequences(repetitions(spark, sf_dir), ["participant", "task"], "final")


@query(
    "a43_cross_task_differences",
    f"""WITH {REPS_SQL}, m AS (SELECT participant, task, 'initial' AS field,
      quantile_cont(initial, 0.5) AS median FROM reps WHERE initial IS NOT NULL GROUP BY ALL
      UNION ALL SELECT participant, task, 'final', quantile_cont(final, 0.5) FROM reps
      WHERE final IS NOT NULL GROUP BY ALL)
    SELECT a.participant, a.field, a.median AS first_median, b.median AS second_median
    FROM m a JOIN m b ON a.participant = b.participant AND a.field = b.field AND a.task = '1-URGENT'
    AND b.task = '5-LOW' WHERE abs(a.median - b.median) > 1e-9""",
    rounded=["first_median", "second_median"],
)
def a43(spark, sf_dir):
    """Fields of one participant that disagree between two tasks."""
    return pf.cross_task_differences(
        repetitions(spark, sf_dir), "participant", "task", ["initial", "final"], "1-URGENT", "5-LOW"
    )


@query(
    "a44_path_anomalies",
    r"""WITH i AS (SELECT *,
      nullif(coalesce(nullif(upper(regexp_extract(folder, '(?i)(P\d{3})([CZ])(\d{3})S(\d{3})', 1)), ''),
        upper(regexp_extract(folder, '(?i)(P[A-Z0-9]{3})([CZ])(\d{3})S(\d{3})', 1))), '') AS fp,
      nullif(coalesce(nullif(upper(regexp_extract(name, '(?i)(P\d{3})([CZ])(\d{3})S(\d{3})', 1)), ''),
        upper(regexp_extract(name, '(?i)(P[A-Z0-9]{3})([CZ])(\d{3})S(\d{3})', 1))), '') AS np,
      nullif(coalesce(nullif(upper(regexp_extract(folder, '(?i)(P\d{3})([CZ])(\d{3})S(\d{3})', 2)), ''),
        upper(regexp_extract(folder, '(?i)(P[A-Z0-9]{3})([CZ])(\d{3})S(\d{3})', 2))), '') AS fc,
      nullif(coalesce(nullif(upper(regexp_extract(name, '(?i)(P\d{3})([CZ])(\d{3})S(\d{3})', 2)), ''),
        upper(regexp_extract(name, '(?i)(P[A-Z0-9]{3})([CZ])(\d{3})S(\d{3})', 2))), '') AS nc,
      nullif(regexp_extract(folder, '(?i)(P[A-Z0-9]{3})([CZ])(\d{3})S(\d{3})', 4), '') AS fs,
      nullif(regexp_extract(name, '(?i)(P[A-Z0-9]{3})([CZ])(\d{3})S(\d{3})', 4), '') AS ns,
      CASE WHEN path ILIKE '%/composite/%' THEN 'Composite' WHEN path ILIKE '%/ziptie/%' THEN 'WireHarness' END AS task,
      CASE WHEN path ILIKE '%/composite/%' THEN 'C' WHEN path ILIKE '%/ziptie/%' THEN 'Z' END AS code
      FROM file_names)
    SELECT file_id, folder, name, path, 'folder_task_code_mismatch' AS type,
      'directory task=' || task || ', folder code=' || fc AS detail FROM i WHERE fc <> code
    UNION ALL SELECT file_id, folder, name, path, 'filename_task_code_mismatch',
      'directory task=' || task || ', filename code=' || nc FROM i WHERE nc <> code
    UNION ALL SELECT file_id, folder, name, path, 'participant_folder_filename_mismatch',
      'folder=' || fp || ' filename=' || np FROM i WHERE fp <> np
    UNION ALL SELECT file_id, folder, name, path, 'session_folder_filename_mismatch',
      'folder S' || fs || ' filename S' || ns FROM i WHERE fs <> ns
    UNION ALL SELECT file_id, folder, name, path, 'participant_unparsed',
      'No participant identifier could be parsed' FROM i WHERE coalesce(np, fp) IS NULL
    UNION ALL SELECT file_id, folder, name, path, 'nonstandard_participant_id', coalesce(np, fp)
      FROM i WHERE coalesce(np, fp) IS NOT NULL AND
      NOT regexp_matches(CASE WHEN np IS NOT NULL THEN name ELSE folder END, '(?i)P\d{3}[CZ]\d{3}S\d{3}')""",
    ["file_names"],
)
def a44(spark, sf_dir):
    """Files whose folder, name and directory disagree."""
    return pf.path_anomalies(fx.file_names(spark, sf_dir), "path", "folder", "name")


@query(
    "a45_session_summary",
    """SELECT trial, count(*) AS n_files, string_agg(DISTINCT line::VARCHAR, ',' ORDER BY line::VARCHAR)
      AS reps, bool_or(line = 1) AS has_initial, bool_or(line >= 6) AS has_final
    FROM axes GROUP BY trial""",
    ["axes"],
)
def a45(spark, sf_dir):
    """Files, repetitions present and rest segments per session; few distinct repetitions each."""
    pairs = fx.axes(spark, sf_dir).groupBy("trial", "line").agg(F.count(F.lit(1)).alias("n"))
    reps = F.array_sort(F.collect_list(F.col("line").cast("string")))
    return pairs.groupBy("trial").agg(
        F.sum("n").alias("n_files"),
        F.array_join(reps, ",").alias("reps"),
        F.bool_or(F.col("line") == 1).alias("has_initial"),
        F.bool_or(F.col("line") >= 6).alias("has_final"),
    )


@query(
    "a46_split_overlap",
    """SELECT channel, count(*) FILTER (WHERE n = 2) AS n_overlap, count(*) AS n_participants
    FROM (SELECT channel, participant, count(DISTINCT day >= '2024-01-24') AS n FROM signals
      GROUP BY ALL) GROUP BY channel""",
    ["signals"],
)
def a46(spark, sf_dir):
    """Participants found in both parts of a date split, by task."""
    tagged = fx.signals(spark, sf_dir).withColumn("late", F.col("day") >= "2024-01-24")
    per = tagged.groupBy("channel", "participant").agg(
        (F.bool_or("late") & F.bool_or(~F.col("late"))).alias("both")
    )
    return per.groupBy("channel").agg(
        F.count_if("both").alias("n_overlap"), F.count(F.lit(1)).alias("n_participants")
    )


@query(
    "a47_outcome_distribution",
    """SELECT task, sum(n)::BIGINT AS n_rows, sum(p)::BIGINT AS positives, sum(p) / sum(n)::DOUBLE AS prevalence,
      count(*) AS n_groups, count(*) FILTER (WHERE p > 0) AS groups_with_event
    FROM (SELECT task, grp, count(*) AS n, sum(y_true) AS p FROM prob_predictions
      WHERE repeat = 1 AND feature_set = 'base' GROUP BY ALL) GROUP BY task""",
    ["prob_predictions"],
    ["prevalence"],
)
def a47(spark, sf_dir):
    """Positives, prevalence and groups with an event by task."""
    df = fx.prob_predictions(spark, sf_dir).where("repeat = 1 AND feature_set = 'base'")
    per = df.groupBy("task", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("p"))
    return per.groupBy("task").agg(
        F.sum("n").alias("n_rows"),
        F.sum("p").alias("positives"),
        (F.sum("p") / F.sum("n")).alias("prevalence"),
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("p") > 0).alias("groups_with_event"),
    )


LAG_SQL = """lagged AS (SELECT *, rn AS interval_index FROM (SELECT *,
    row_number() OVER w AS rn, lag(time1) OVER w AS lag1_time1, lag(time2) OVER w AS lag1_time2,
    lag(hr_mean) OVER w AS lag1_hr_mean, lag(wrist_rms) OVER w AS lag1_wrist_rms,
    lag(hip_rms) OVER w AS lag1_hip_rms FROM intervals
    WINDOW w AS (PARTITION BY trial ORDER BY time1, time2)) WHERE rn > 1)"""


def lagged(spark, sf_dir):
    return wn.lag_one_interval(
        fx.intervals(spark, sf_dir), "trial", ["time1", "time2"], TIME,
        ["time1", "time2", "hr_mean", "wrist_rms", "hip_rms"],
    )


@query(
    "a48_timing_verification",
    f"""WITH {LAG_SQL} SELECT count(*) AS n_rows,
      count(*) FILTER (WHERE abs(lag1_time2 - time1) <= 1e-9) AS n_exact,
      min(time1 - lag1_time2) AS min_gap, max(time1 - lag1_time2) AS max_gap FROM lagged""",
    ["intervals"],
)
def a48(spark, sf_dir):
    """Lagged windows that end exactly where prediction starts."""
    from cohortlift.functions.cleaning import near

    gap = F.col("time1") - F.col("lag1_time2")
    return lagged(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(near("lag1_time2", "time1")).alias("n_exact"),
        F.min(gap).alias("min_gap"),
        F.max(gap).alias("max_gap"),
    )


@query(
    "j8_lag_one_interval",
    f"""WITH {LAG_SQL} SELECT trial, worker, task, interval_index, time1, time2, state,
      lag1_time1, lag1_time2, lag1_hr_mean, lag1_wrist_rms, lag1_hip_rms FROM lagged""",
    ["intervals"],
)
def j8(spark, sf_dir):
    """Each interval's outcome with the features of the interval before."""
    return lagged(spark, sf_dir).drop("hr_mean", "wrist_rms", "hip_rms")


@query(
    "w3_connectedness",
    """SELECT trial, coalesce(bool_and(abs(time2 - nxt) <= 1e-9), true) AS intervals_connected
    FROM (SELECT *, lead(time1) OVER (PARTITION BY trial ORDER BY time1, time2) AS nxt FROM intervals)
    GROUP BY trial""",
    ["intervals"],
)
def w3(spark, sf_dir):
    """Whether a trial's intervals follow on one another."""
    return wn.connectedness(fx.intervals(spark, sf_dir), ["trial"], "time1", "time2", TIME)


@query(
    "w4_event_on_last_interval",
    f"""WITH {SEQ_SQL} SELECT trial, event_count,
      event_count = 1 AND event_is_last_row AS single_and_last FROM seq WHERE event_count > 0""",
    ["intervals"],
)
def w4(spark, sf_dir):
    """Trials whose only event is on the last interval."""
    seq = sequences(spark, sf_dir).where("event_count > 0")
    return seq.select(
        "trial", "event_count",
        ((F.col("event_count") == 1) & F.col("event_is_last_row")).alias("single_and_last"),
    )


@query(
    "w6_interval_index",
    """SELECT trial, time1, row_number() OVER (PARTITION BY trial ORDER BY time1, time2) AS interval_index
    FROM intervals""",
    ["intervals"],
)
def w6(spark, sf_dir):
    """Place of an interval in its trial, counted from one."""
    from cohortlift.operators.ordered import positions

    df = fx.intervals(spark, sf_dir).select("trial", "time1", "time2")
    return positions(df, ["trial"], ["time1", "time2"], TIME, out="interval_index").drop("time2")


@query(
    "w9_keep_first",
    """SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""",
)
def w9(spark, sf_dir):
    """First order of each customer."""
    df = fx.table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice"
    )
    return wn.keep_first(df, ["o_custkey"], ["o_orderkey"])


# --- rating grid -----------------------------------------------------------------------------
GRID_LONG_SQL = """ffill AS (SELECT * REPLACE (last_value(subject IGNORE NULLS) OVER
    (PARTITION BY file_no ORDER BY pos) AS subject) FROM rating_grid),
  obs AS (SELECT pos, subject, task_order, length_of_trial, end_of_trial, before_task,
    regexp_extract(name, '(\\d+)_sec', 1)::BIGINT AS t, v
    FROM (UNPIVOT ffill ON """ + ", ".join(f'"{c}"' for c in GRID_COLS) + """ INTO NAME name VALUE v)),
  series AS (SELECT pos, t::DOUBLE AS t, v FROM obs
    UNION SELECT pos, length_of_trial, end_of_trial FROM ffill
      WHERE length_of_trial % 10 = 0 AND length_of_trial IS NOT NULL)"""


def filled_grid(spark, sf_dir):
    from cohortlift.operators.ordered import forward_fill

    grid = fx.rating_grid(spark, sf_dir)
    done = forward_fill(grid, ["file_no"], "pos", "subject", "subject_filled", width=256)
    return done.withColumn("subject", F.col("subject_filled")).drop("subject_filled")


@query(
    "p2_forward_fill",
    """SELECT pos, file_no, last_value(subject IGNORE NULLS) OVER (PARTITION BY file_no ORDER BY pos)
      AS subject FROM rating_grid""",
    ["rating_grid"],
)
def p2(spark, sf_dir):
    """Blank subject cells take the subject above them."""
    return filled_grid(spark, sf_dir).select("pos", "file_no", "subject")


def long_ratings(spark, sf_dir):
    from cohortlift.operators.ratings import grid_to_long

    return grid_to_long(filled_grid(spark, sf_dir), ["pos", "subject", "task_order"])


@query(
    "p14_grid_to_long",
    f"WITH {GRID_LONG_SQL} SELECT pos, subject, task_order, t, v FROM obs",
    ["rating_grid"],
)
def p14(spark, sf_dir):
    """Wide rating grid turned long, empty cells left out."""
    return long_ratings(spark, sf_dir)


def rating_series(spark, sf_dir):
    from cohortlift.operators.ratings import series_with_end

    return series_with_end(filled_grid(spark, sf_dir), ["pos"])


@query(
    "j6_exact_horizon_pairs",
    f"""WITH {GRID_LONG_SQL}, s AS (SELECT pos, t, max_by(v, pri) AS v FROM
      (SELECT pos, t::DOUBLE AS t, v, 0 AS pri FROM obs UNION ALL
       SELECT pos, length_of_trial, end_of_trial, 1 FROM ffill WHERE length_of_trial % 10 = 0)
      GROUP BY pos, t)
    SELECT a.pos, a.t, a.v, b.v AS target_v, a.t + 10 AS target_time FROM s a JOIN s b
      ON a.pos = b.pos AND b.t = a.t + 10 WHERE a.t >= 10""",
    ["rating_grid"],
)
def j6(spark, sf_dir):
    """Ratings paired with the rating exactly ten seconds later."""
    return wn.exact_horizon_pairs(rating_series(spark, sf_dir), ["pos"], "t", "v", 10.0, 10.0)


@query(
    "a22_rating_series_quality",
    f"""WITH {GRID_LONG_SQL}, s AS (SELECT pos, 0.0::DOUBLE AS t, before_task AS v FROM ffill
      UNION ALL SELECT pos, t::DOUBLE, v FROM obs
      UNION ALL SELECT pos, length_of_trial, end_of_trial FROM ffill),
    mono AS (SELECT pos, count(*) FILTER (WHERE v < p - 1e-12) AS violations FROM
      (SELECT pos, t, v, lag(v) OVER (PARTITION BY pos ORDER BY t, v) AS p FROM s) GROUP BY pos),
    dd AS (SELECT pos, t, max_by(v, pri) AS v FROM (SELECT pos, t, v, 0 AS pri FROM s) GROUP BY pos, t),
    ex AS (SELECT a.pos, count(*) AS n FROM (SELECT DISTINCT pos, t FROM s) a JOIN
      (SELECT DISTINCT pos, t FROM s) b ON a.pos = b.pos AND b.t = a.t + 10 WHERE a.t >= 10 GROUP BY a.pos),
    o AS (SELECT pos, count(*) AS n_regular, max(t) AS max_time, any_value(length_of_trial) AS d,
      count(*) FILTER (WHERE t >= length_of_trial - 1e-9) AS after_end,
      count(*) FILTER (WHERE t < length_of_trial - 1e-9) AS seen FROM obs GROUP BY pos)
    SELECT ffill.pos, coalesce(n_regular, 0) AS n_regular, max_time,
      (SELECT count(*) FROM range(10, 71, 10) g(x) WHERE x < length_of_trial - 1e-9) AS expected_count,
      coalesce(seen, 0) = (SELECT count(*) FROM range(10, 71, 10) g(x) WHERE x < length_of_trial - 1e-9)
        AS expected_complete,
      coalesce(after_end, 0) AS at_or_after_end, coalesce(max_time // 10 - n_regular, 0) AS internal_gaps,
      violations AS monotonic_violations, coalesce(ex.n, 0) AS n_exact_targets
    FROM ffill LEFT JOIN o USING (pos) LEFT JOIN mono USING (pos) LEFT JOIN ex USING (pos)""",
    ["rating_grid"],
)
def a22(spark, sf_dir):
    """Grid completeness, late values, gaps, falls and exact-horizon targets per trial."""
    from cohortlift.operators.ratings import series_quality

    return series_quality(filled_grid(spark, sf_dir), "pos", 10.0)


@query(
    "w7_monotonic_violations",
    f"""WITH {GRID_LONG_SQL} SELECT pos, count(*) FILTER (WHERE v < p - 1e-12) AS monotonic_violations
    FROM (SELECT pos, t, v, lag(v) OVER (PARTITION BY pos ORDER BY t) AS p FROM obs) GROUP BY pos""",
    ["rating_grid"],
)
def w7(spark, sf_dir):
    """Times a rating falls below the one before it."""
    long = long_ratings(spark, sf_dir)
    back = with_previous(long, ["pos"], ["t"], "floor(t / 655360)", ["v"])
    return back.groupBy("pos").agg(
        F.count_if(F.col("v") < F.col("prev_v") - 1e-12).alias("monotonic_violations")
    )


@query(
    "w8_internal_gaps",
    f"""WITH {GRID_LONG_SQL}, m AS (SELECT pos, max(t) AS mx FROM obs GROUP BY pos),
    g AS (SELECT pos, unnest(range(10, mx + 1, 10)) AS t FROM m)
    SELECT g.pos, g.t FROM g ANTI JOIN obs ON g.pos = obs.pos AND g.t = obs.t""",
    ["rating_grid"],
)
def w8(spark, sf_dir):
    """Grid times with no rating before the last one seen."""
    from cohortlift.operators.ratings import internal_gaps

    return internal_gaps(long_ratings(spark, sf_dir), "pos", "t", 10)
