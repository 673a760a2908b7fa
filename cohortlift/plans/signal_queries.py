"""Channel statistics and window features over the event samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlift.functions.cleaning import clean_numeric, magnitude
from cohortlift.operators import signals as sg
from cohortlift.operators import windows as wn
from cohortlift.operators.ordered import exact_quantiles, with_previous
from cohortlift.plans import fixtures as fx
from cohortlift.plans.registry import query

TRIAL = ["participant", "day", "channel"]
POS = "floor(pos / 65536)"
ELEVEN = ["mean", "std", "median", "q25", "q75", "p05", "p95", "rms", "range", "slope", "valid_fraction"]

RANKED = """ranked AS (SELECT *, (row_number() OVER (PARTITION BY {keys} ORDER BY pos) - 1)
    / nullif(count(*) OVER (PARTITION BY {keys}) - 1, 0)::DOUBLE - 0.5 AS t
  FROM {src} WHERE value IS NOT NULL)"""


def ranked(keys, src="signals"):
    return RANKED.format(keys=keys, src=src)


@query(
    "a1_channel_summary",
    f"""WITH {ranked("participant, day, channel")},
    slopes AS (SELECT participant, day, channel, regr_slope(value, t) AS slope FROM ranked
      GROUP BY ALL HAVING count(*) > 1)
    SELECT participant, day, channel, avg(value) AS mean, stddev_pop(value) AS std,
      quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q25,
      quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.05) AS p05,
      quantile_cont(value, 0.95) AS p95, sqrt(avg(value * value)) AS rms,
      max(value) - min(value) AS range, any_value(slope) AS slope,
      count(value) / count(*)::DOUBLE AS valid_fraction
    FROM signals LEFT JOIN slopes USING (participant, day, channel)
    GROUP BY participant, day, channel""",
    ["signals"],
    ELEVEN,
)
def a1(spark, sf_dir):
    """Eleven statistics per participant, day and channel."""
    return sg.channel_summary(fx.signals(spark, sf_dir), TRIAL, "value", ["pos"], POS)


@query(
    "a2_compact_summary",
    f"""WITH {ranked("participant, channel")},
    slopes AS (SELECT participant, channel, regr_slope(value, t) AS slope FROM ranked GROUP BY ALL)
    SELECT participant, channel, avg(value) AS mean, stddev_pop(value) AS std,
      quantile_cont(value, 0.5) AS median,
      quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
      sqrt(avg(value * value)) AS rms, max(value) - min(value) AS range, any_value(slope) AS slope
    FROM signals JOIN slopes USING (participant, channel) GROUP BY participant, channel""",
    ["signals"],
    ["mean", "std", "median", "iqr", "rms", "range", "slope"],
)
def a2(spark, sf_dir):
    """Seven statistics per participant and channel."""
    return sg.compact_summary(
        fx.signals(spark, sf_dir), ["participant", "channel"], "value", ["pos"], POS
    )


@query(
    "a3_muscle_extras",
    """WITH c AS (SELECT participant, channel, value - 50 AS v,
      lag(value - 50) OVER (PARTITION BY participant, channel ORDER BY pos) AS p
      FROM signals WHERE value IS NOT NULL)
    SELECT participant, channel, avg(abs(v)) AS mav, avg(abs(v - p)) AS waveform_length_norm,
      avg((v * p < 0)::INT::DOUBLE) AS zero_cross_rate FROM c GROUP BY ALL""",
    ["signals"],
    ["mav", "waveform_length_norm", "zero_cross_rate"],
)
def a3(spark, sf_dir):
    """Amplitude, step and zero-crossing features of a centred signal."""
    centred = fx.signals(spark, sf_dir).withColumn("value", F.col("value") - 50)
    return sg.muscle_extras(centred, ["participant", "channel"], "value", ["pos"], POS)


@query(
    "a4_signal_magnitude_area",
    """SELECT trial, avg(abs(x) + abs(y) + abs(z)) AS signal_magnitude_area FROM axes
    GROUP BY trial""",
    ["axes"],
    ["signal_magnitude_area"],
    digits=9,
)
def a4(spark, sf_dir):
    """Mean of the summed absolute axes per trial."""
    return sg.magnitude_area(fx.axes(spark, sf_dir), ["trial"], ["x", "y", "z"])


@query(
    "a5_rank_slope",
    f"""WITH {ranked("participant")} SELECT participant, regr_slope(value, t) AS slope
    FROM ranked GROUP BY participant""",
    ["signals"],
    ["slope"],
)
def a5(spark, sf_dir):
    """Trend over the rank of valid samples per participant."""
    return sg.rank_slope(fx.signals(spark, sf_dir), ["participant"], "value", ["pos"], POS)


@query(
    "a6_time_quality",
    """WITH d AS (SELECT participant, t_us, t_us - lag(t_us) OVER
      (PARTITION BY participant ORDER BY pos) AS dt FROM signals)
    SELECT participant, min(t_us) AS time_min, max(t_us) AS time_max,
      quantile_cont(dt::DOUBLE, 0.5) FILTER (WHERE dt > 0) AS median_time_step
    FROM d GROUP BY participant""",
    ["signals"],
    ["median_time_step"],
)
def a6(spark, sf_dir):
    """Time range and median positive step per participant."""
    return sg.time_quality(fx.signals(spark, sf_dir), ["participant"], "t_us", ["pos"], POS)


@query(
    "p13_vector_magnitude",
    """SELECT trial, line, part, channel, sqrt(x * x + y * y + z * z) AS magnitude FROM axes
    WHERE sqrt(x * x + y * y + z * z) IS NOT NULL""",
    ["axes"],
    ["magnitude"],
)
def p13(spark, sf_dir):
    """Length of the three-axis sample where every axis is present."""
    df = fx.axes(spark, sf_dir)
    return df.select(
        "trial", "line", "part", "channel",
        magnitude(*[clean_numeric(a) for a in "xyz"]).alias("magnitude"),
    ).where("magnitude IS NOT NULL")


@query(
    "a33_robust_raw_summary",
    """SELECT channel, count(value) AS n, min(value) AS min, max(value) AS max,
      quantile_cont(value, 0.5) AS median, quantile_cont(abs(value), 0.5) AS abs_q50,
      quantile_cont(abs(value), 0.95) AS abs_q95, quantile_cont(abs(value), 0.99) AS abs_q99,
      quantile_cont(abs(value), 0.999) AS abs_q999, max(abs(value)) AS abs_max
    FROM signals GROUP BY channel""",
    ["signals"],
    ["median", "abs_q50", "abs_q95", "abs_q99", "abs_q999"],
)
def a33(spark, sf_dir):
    """Range and tail levels per channel, up to the 99.9 % level."""
    df = fx.signals(spark, sf_dir).withColumn("size", F.abs("value"))
    ends = df.groupBy("channel").agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.max("size").alias("abs_max"),
    )
    mid = exact_quantiles(df, ["channel"], "value", {"median": 0.5})
    tail = exact_quantiles(
        df, ["channel"], "size",
        {"abs_q50": 0.5, "abs_q95": 0.95, "abs_q99": 0.99, "abs_q999": 0.999},
    )
    return ends.join(mid, ["channel"]).join(tail, ["channel"])


@query(
    "a34_tail_multiples",
    """WITH q AS (SELECT channel, quantile_cont(abs(value), 0.999) AS abs_q999,
      quantile_cont(abs(value), 0.5) AS m FROM signals GROUP BY channel),
    b AS (SELECT channel, abs_q999,
      CASE WHEN abs_q999 > 0 THEN abs_q999 ELSE greatest(m, 1e-12) END AS base FROM q)
    SELECT channel, abs_q999, multiple, base * multiple AS threshold,
      count(*) FILTER (WHERE abs(value) > base * multiple) AS n_beyond
    FROM signals JOIN b USING (channel),
      (SELECT unnest([0.5::DOUBLE, 1, 10, 100, 1000, 1000000]) AS multiple)
    GROUP BY channel, abs_q999, base, multiple""",
    ["signals"],
    ["abs_q999", "threshold"],
)
def a34(spark, sf_dir):
    """Samples beyond multiples of the channel's own tail level."""
    return sg.tail_multiples(
        fx.signals(spark, sf_dir), ["channel"], "value", [0.5, 1.0, 10.0, 100.0, 1000.0, 1e6]
    )


@query(
    "w1_previous_and_next_sample",
    """SELECT pos, participant, value,
      lag(value) OVER (PARTITION BY participant ORDER BY pos) AS prev_value,
      lead(value) OVER (PARTITION BY participant ORDER BY pos) AS next_value FROM signals""",
    ["signals"],
)
def w1(spark, sf_dir):
    """Previous and next sample of the same participant."""
    df = fx.signals(spark, sf_dir).select("pos", "participant", "value")
    from cohortlift.operators.ordered import with_next

    back = with_previous(df, ["participant"], ["pos"], POS, ["value"])
    return with_next(back, ["participant"], ["pos"], POS, ["value"])


@query(
    "w2_first_difference",
    """SELECT pos, participant, t_us - lag(t_us) OVER (PARTITION BY participant ORDER BY pos) AS step_us
    FROM signals""",
    ["signals"],
)
def w2(spark, sf_dir):
    """Difference to the previous sample's time."""
    df = fx.signals(spark, sf_dir).select("pos", "participant", "t_us")
    back = with_previous(df, ["participant"], ["pos"], POS, ["t_us"])
    return back.select("pos", "participant", (F.col("t_us") - F.col("prev_t_us")).alias("step_us"))


@query(
    "w5_contiguous_runs",
    """WITH h AS (SELECT channel, h, row_number() OVER (PARTITION BY channel ORDER BY h) AS rn
      FROM (SELECT DISTINCT channel, t_us // 3600000000 AS h FROM signals WHERE value > 100))
    SELECT channel, min(h) AS run_start, max(h) AS run_end, max(h) - min(h) + 1 AS run_length
    FROM h GROUP BY channel, h - rn""",
    ["signals"],
)
def w5(spark, sf_dir):
    """Runs of consecutive hours that hold a sample over 100."""
    df = fx.signals(spark, sf_dir).where("value > 100")
    hours = df.select("channel", F.floor(F.col("t_us") / 3_600_000_000).alias("hour")).distinct()
    return sg.contiguous_runs(hours, ["channel"], "hour", width=128)


@query(
    "o2_top_k_by_size",
    """SELECT participant, pos, value, rank FROM (SELECT *, row_number() OVER
      (PARTITION BY participant ORDER BY abs(value) DESC, pos) AS rank FROM signals
      WHERE value IS NOT NULL) WHERE rank <= 5""",
    ["signals"],
)
def o2(spark, sf_dir):
    """Five largest samples by size per participant, ties by position."""
    df = fx.signals(spark, sf_dir).where("value IS NOT NULL").select("participant", "pos", "value")
    return wn.top_k(df, ["participant"], [F.abs("value").desc(), F.col("pos")], 5)


# --- windows over samples ---------------------------------------------------------------------
# A participant's samples sit on an hourly index grid: index = place among the participant's
# samples in source order, rate = samples per hour at 1 per unit, horizon and window in units.
WINDOW = 8
STEP = 4


def indexed(spark, sf_dir):
    """Samples with a 0-based index inside the participant; the index is the sample clock."""
    from cohortlift.operators.ordered import positions

    df = positions(fx.signals(spark, sf_dir), ["participant"], ["pos"], POS, out="place")
    return df.select("participant", "channel", "value", (F.col("place") - 1).alias("idx"))


def trial_windows(spark, sf_dir):
    trials = (
        fx.signals(spark, sf_dir)
        .groupBy("participant")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("duration", F.col("n") + (F.col("participant") % 4) - 1.5)
    )
    times = F.sequence(F.lit(WINDOW), F.greatest(F.col("n"), F.lit(WINDOW)), F.lit(STEP))
    return wn.candidate_windows(trials, times, window=WINDOW, rate=1.0)


WINDOW_SQL = """idx AS (SELECT participant, channel, value,
    row_number() OVER (PARTITION BY participant ORDER BY pos) - 1 AS idx FROM signals),
  cand AS (SELECT participant, n, duration, t, (t - 8)::BIGINT AS sa, t::BIGINT AS sb,
    round_even(n - (duration - (t - 8)), 0)::BIGINT AS ea,
    round_even(n - (duration - t), 0)::BIGINT AS eb
    FROM (SELECT participant, n, n + participant % 4 - 1.5::DOUBLE AS duration,
      unnest(range(8, greatest(n, 8) + 1, 4)) AS t
      FROM (SELECT participant, count(*) AS n FROM signals GROUP BY participant))),
  ok AS (SELECT * FROM cand WHERE sa >= 0 AND sb <= n AND sb > sa AND ea >= 0 AND eb <= n AND eb > ea),
  win AS (SELECT participant, n, duration, t, 'START' AS anchor, sa AS a, sb AS b FROM ok
    UNION ALL SELECT participant, n, duration, t, 'END', ea, eb FROM ok),
  hit AS (SELECT win.participant, t, anchor, idx, channel, value, a, b FROM win JOIN idx
    ON win.participant = idx.participant AND idx >= a AND idx < b)"""


@query(
    "p23_sample_bounds",
    f"WITH {WINDOW_SQL} SELECT participant, n, duration, t, anchor, a, b FROM win",
    ["signals"],
)
def p23(spark, sf_dir):
    """Sample bounds of each prediction window under both anchors."""
    return trial_windows(spark, sf_dir).withColumn("t", F.col("t").cast("bigint"))


def met(spark, sf_dir):
    return wn.window_samples(
        trial_windows(spark, sf_dir), indexed(spark, sf_dir), ["participant"], "idx", WINDOW
    )


@query(
    "j7_window_sample_join",
    f"""WITH {WINDOW_SQL} SELECT participant, t, anchor, count(*) AS n_samples,
      count(value) AS n_valid, avg(value) AS mean, max(value) AS max, min(idx) AS first_idx
    FROM hit GROUP BY participant, t, anchor""",
    ["signals"],
    ["mean"],
)
def j7(spark, sf_dir):
    """Samples matched to windows, then reduced per window and anchor."""
    return (
        met(spark, sf_dir)
        .groupBy("participant", F.col("t").cast("bigint").alias("t"), "anchor")
        .agg(
            F.count(F.lit(1)).alias("n_samples"),
            F.count("value").alias("n_valid"),
            F.avg("value").alias("mean"),
            F.max("value").alias("max"),
            F.min("idx").alias("first_idx"),
        )
    )


@query(
    "a35_window_preflight",
    f"""WITH {WINDOW_SQL} SELECT participant, t, anchor, count(*) AS n, count(value) AS finite_n,
      count(*) - count(value) AS nonfinite_n, count(value) / count(*)::DOUBLE AS finite_fraction,
      max(abs(value)) AS abs_max, quantile_cont(abs(value), 0.999) AS abs_q999,
      min(value) AS min, max(value) AS max FROM hit GROUP BY participant, t, anchor""",
    ["signals"],
    ["finite_fraction", "abs_q999"],
)
def a35(spark, sf_dir):
    """Raw checks per window; a window holds at most WINDOW samples, so its quantile is local."""
    size = F.abs("value")
    return (
        met(spark, sf_dir)
        .groupBy("participant", F.col("t").cast("bigint").alias("t"), "anchor")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("value").alias("finite_n"),
            (F.count(F.lit(1)) - F.count("value")).alias("nonfinite_n"),
            (F.count("value") / F.count(F.lit(1))).alias("finite_fraction"),
            F.max(size).alias("abs_max"),
            F.percentile(size, 0.999).alias("abs_q999"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )


MANIFEST_SQL = """st AS (SELECT participant, anchor, t, channel,
    participant % 5 = 3 AND channel = 'error' AS masked,
    count(value) AS finite_n, count(*) AS n, max(abs(value)) AS abs_max FROM hit GROUP BY ALL)"""


def stream_manifest(spark, sf_dir):
    masked = (F.col("participant") % 5 == 3) & (F.col("channel") == "error")
    return (
        met(spark, sf_dir)
        .groupBy("participant", "anchor", F.col("t").cast("bigint").alias("t"), "channel")
        .agg(
            F.count("value").alias("finite_n"),
            F.count(F.lit(1)).alias("n"),
            F.max(F.abs("value")).alias("abs_max"),
        )
        .withColumn("masked", masked)
    )


@query(
    "a36_stream_window_manifest",
    f"""WITH {WINDOW_SQL}, {MANIFEST_SQL}
    SELECT participant, t, anchor, count(*) AS present_n,
      count(*) FILTER (WHERE masked) AS masked_n,
      count(*) FILTER (WHERE NOT masked AND finite_n = n) AS available_n,
      5 - count(*) AS missing_n,
      coalesce(bool_and(finite_n = n) FILTER (WHERE NOT masked), false) AS passes
    FROM st GROUP BY participant, t, anchor""",
    ["signals"],
)
def a36(spark, sf_dir):
    """Available, masked and missing channels per window with a pass flag."""
    clean = ~F.col("masked") & (F.col("finite_n") == F.col("n"))
    passes = F.bool_and(F.when(~F.col("masked"), F.col("finite_n") == F.col("n")))
    return stream_manifest(spark, sf_dir).groupBy("participant", "t", "anchor").agg(
        F.count(F.lit(1)).alias("present_n"),
        F.count_if("masked").alias("masked_n"),
        F.count_if(clean).alias("available_n"),
        (F.lit(5) - F.count(F.lit(1))).alias("missing_n"),
        F.coalesce(passes, F.lit(False)).alias("passes"),
    )


@query(
    "a36_stream_issues",
    f"""WITH {WINDOW_SQL}, {MANIFEST_SQL}
    SELECT participant, t, anchor, channel, 'nonfinite_samples' AS issue FROM st
      WHERE NOT masked AND finite_n < n
    UNION ALL SELECT participant, t, anchor, channel, 'gross_amplitude' FROM st
      WHERE NOT masked AND abs_max > 300
    UNION ALL SELECT participant, t, anchor, channel, 'masked_stream' FROM st WHERE masked""",
    ["signals"],
)
def a36_issues(spark, sf_dir):
    """Issue list of the stream manifest, one row per window, channel and failed check."""
    m = stream_manifest(spark, sf_dir)
    issues = F.array(
        F.when(~F.col("masked") & (F.col("finite_n") < F.col("n")), F.lit("nonfinite_samples")),
        F.when(~F.col("masked") & (F.col("abs_max") > 300), F.lit("gross_amplitude")),
        F.when(F.col("masked"), F.lit("masked_stream")),
    )
    return m.select(
        "participant", "t", "anchor", "channel", F.explode(F.array_compact(issues)).alias("issue")
    )


@query(
    "a37_channel_rollup",
    f"""WITH {WINDOW_SQL}, {MANIFEST_SQL}
    SELECT channel, anchor, count(*) AS n_windows, sum(finite_n)::BIGINT AS finite_n,
      sum(n - finite_n)::BIGINT AS nonfinite_n, max(abs_max) AS abs_max,
      count(*) FILTER (WHERE masked) AS masked_windows FROM st GROUP BY channel, anchor""",
    ["signals"],
)
def a37(spark, sf_dir):
    """Window checks rolled up per channel and anchor."""
    return stream_manifest(spark, sf_dir).groupBy("channel", "anchor").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.sum("finite_n").alias("finite_n"),
        F.sum(F.col("n") - F.col("finite_n")).alias("nonfinite_n"),
        F.max("abs_max").alias("abs_max"),
        F.count_if("masked").alias("masked_windows"),
    )


@query(
    "f4_channel_mask",
    """SELECT pos, participant, channel,
      CASE WHEN NOT (participant % 5 = 3 AND channel = 'error') THEN value END AS value FROM signals""",
    ["signals"],
)
def f4(spark, sf_dir):
    """Masked channels turn missing; their rows stay and are never filled with zero."""
    from cohortlift.operators.quarantine import mask_channels

    df = fx.signals(spark, sf_dir).select("pos", "participant", "channel", "value")
    mask = df.select("participant").distinct().where("participant % 5 = 3")
    mask = mask.withColumn("channel", F.lit("error"))
    return mask_channels(df, mask, ["participant", "channel"], ["value"])


@query(
    "a38_anchor_preflight",
    """SELECT anchor, count(*) AS n_values, count(*) - count(y_pred) AS nonfinite_n,
      max(abs(y_pred)) AS abs_max, quantile_cont(abs(y_pred), 0.99999) AS abs_q99999
    FROM predictions GROUP BY anchor""",
    ["predictions"],
    ["abs_max", "abs_q99999"],
)
def a38(spark, sf_dir):
    """Flattened size check of one anchor's feature values."""
    df = fx.predictions(spark, sf_dir).withColumn("size", F.abs(clean_numeric("y_pred")))
    ends = df.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n_values"),
        (F.count(F.lit(1)) - F.count("size")).alias("nonfinite_n"),
        F.max("size").alias("abs_max"),
    )
    return ends.join(exact_quantiles(df, ["anchor"], "size", {"abs_q99999": 0.99999}), ["anchor"])
