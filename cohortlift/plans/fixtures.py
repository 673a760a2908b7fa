"""Panel-shaped readings of the supplied tables.

Each reading exists twice: as a DataFrame and, for the oracle, as the same SELECT in SQL.
Dirt (missing values, sentinels, mismatches) is a fixed arithmetic rule on the row id, so both
sides see the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.operators.joining import dealt

REPEATS = 5
LINES_OF_TASK = 250_000  # of lineitem
EVENTS_OF_TASK = 25_000  # each of which stands for ten or twenty predictions
GRID_LINES = range(1, 8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def explode_of(*values) -> Column:
    """A literal axis of a grid; exploding it needs no join."""
    return F.explode(F.array(*[F.lit(v) for v in values]))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


# --- sensor samples: user = participant, day = trial, event type = channel ------------------
def signals(spark, sf_dir) -> DataFrame:
    pos = F.col("event_id")
    dirty = F.when(pos % 97 == 0, F.lit(None).cast("double")).when(pos % 83 == 0, F.lit(-2.0))
    return table(spark, sf_dir, "events").select(
        pos.alias("pos"),
        F.col("user_id").alias("participant"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.col("event_type").alias("channel"),
        micros(F.col("ts")).alias("t_us"),
        dirty.otherwise(F.col("value")).alias("value"),
    )


# --- three-axis samples: order = trial, supplier = channel ----------------------------------
def axes(spark, sf_dir) -> DataFrame:
    y = F.when(F.col("l_suppkey") % 10 == 0, F.col("l_quantity")).when(
        F.col("l_partkey") % 50 != 0, F.col("l_extendedprice") / 1000
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trial"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("channel"),
        F.col("l_quantity").alias("x"),
        y.alias("y"),
        (F.col("l_discount") * 100).alias("z"),
    )


# --- interval (long) and trial (short) tables ------------------------------------------------
def intervals(spark, sf_dir) -> DataFrame:
    event = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.08)
    lines = dealt(table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINES_OF_TASK)
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.max(event.cast("int")).alias("state"),
        F.max("l_quantity").alias("hr_mean"),
        F.min("l_extendedprice").alias("wrist_rms"),
        F.max("l_discount").alias("hip_rms"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("trial"),
        F.col("o_custkey").alias("worker"),
        F.col("o_orderpriority").alias("task"),
        ((F.col("l_linenumber") - 1) * 10.0).cast("double").alias("time1"),
        (F.col("l_linenumber") * 10.0).cast("double").alias("time2"),
        "state",
        "hr_mean",
        "wrist_rms",
        "hip_rms",
    )


def trials(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    """Short records; ``rows`` are the intervals where they are at hand."""
    key = F.col("o_orderkey")
    rows = intervals(spark, sf_dir) if rows is None else rows
    ends = rows.groupBy("trial").agg(
        F.max("time2").alias("last_time2"), F.max("state").alias("ever")
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").where(key % 31 != 0)
    return (
        orders.join(ends, F.col("trial") == key)
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            "trial",
            (F.col("o_custkey") + F.when(key % 19 == 0, 1).otherwise(0)).alias("worker"),
            F.when(key % 29 == 0, F.lit("other")).otherwise(F.col("o_orderpriority")).alias("task"),
            (F.col("last_time2") + F.when(key % 13 == 0, 5.0).otherwise(0.0)).alias("total_time"),
            F.when(key % 17 == 0, 1 - F.col("ever")).otherwise(F.col("ever")).alias("fatigue"),
            F.col("c_mktsegment").alias("sex"),
            F.col("c_acctbal").alias("weight"),
        )
    )


# --- wide rating grid -------------------------------------------------------------------------
def rating_grid(spark, sf_dir) -> DataFrame:
    key = F.col("l_orderkey")
    rating = F.floor(F.col("l_quantity") / 10) + F.col("l_linenumber")
    wide = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_linenumber").alias("last_line"),
        *[
            F.max(F.when(F.col("l_linenumber") == i, rating)).cast("double").alias(f"{i * 10}_sec")
            for i in GRID_LINES
        ],
    )
    extra = F.when(key % 3 == 0, 10).when(key % 3 == 1, 0).otherwise(5)
    return wide.select(
        key.alias("pos"),
        F.floor(key / 996).cast("bigint").alias("file_no"),
        F.when(key % 6 == 0, F.concat(F.lit("Subject "), F.floor(key / 6).cast("string"))).alias(
            "subject"
        ),
        F.concat(F.lit("task"), (key % 6 + 1).cast("string")).alias("task_order"),
        (key % 4).cast("double").alias("before_task"),
        *[F.col(f"{i * 10}_sec") for i in GRID_LINES],
        F.lit(20.0).alias("end_of_trial"),
        (F.col("last_line") * 10 + extra).cast("double").alias("length_of_trial"),
    )


# --- out-of-fold predictions -----------------------------------------------------------------
def predictions(spark, sf_dir) -> DataFrame:
    r, i, fs, anchor = F.col("repeat"), F.col("row_id"), F.col("feature_set"), F.col("anchor")
    base = 50 + ((i * 31 + r * 17) % 61 - 30) * 0.5
    shift = F.when(anchor == "END", (i % 7 - 3) * 0.25).otherwise(0.0)
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("grp"),
        F.col("event_type").alias("task"),
        F.col("value").alias("y_true"),
    )
    return (
        dealt(rows, ["row_id"], EVENTS_OF_TASK)
        .withColumn("repeat", explode_of(*range(1, REPEATS + 1)))
        .withColumn("anchor", explode_of("START", "END"))
        .withColumn("feature_set", explode_of("base", "comb"))
        .withColumn("outer_fold", ((F.col("grp") * 7 + r * 3) % 5 + 1).cast("int"))
        .withColumn(
            "y_pred",
            F.when(fs == "base", base).otherwise(base * 0.6 + F.col("y_true") * 0.4 + shift),
        )
    )


def prob_predictions(spark, sf_dir) -> DataFrame:
    r, i = F.col("repeat"), F.col("row_id")
    y = (F.col("value") >= 60).cast("int")
    base = ((i * 31 + r * 17) % 997) / F.lit(997.0)
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("grp"),
        F.col("event_type").alias("task"),
        y.alias("y_true"),
    )
    return (
        dealt(rows, ["row_id"], EVENTS_OF_TASK)
        .withColumn("repeat", explode_of(*range(1, REPEATS + 1)))
        .withColumn("feature_set", explode_of("base", "comb"))
        .withColumn("outer_fold", ((F.col("grp") * 7 + r * 3) % 5 + 1).cast("int"))
        .withColumn(
            "y_prob",
            F.when(F.col("feature_set") == "base", base).otherwise(
                base * 0.7 + F.col("y_true") * 0.3
            ),
        )
    )


# --- frozen representations: the two halves of a vector are the two anchors ------------------
def representations(spark, sf_dir) -> DataFrame:
    e = F.col("embedding")
    return (
        table(spark, sf_dir, "embeddings")
        .withColumn("anchor", explode_of("START", "END"))
        .select(
            F.col("vec_id").alias("row_id"),
            F.col("label").alias("grp"),
            "anchor",
            F.when(F.col("anchor") == "START", F.slice(e, 1, 32))
            .otherwise(F.slice(e, 33, 32))
            .alias("embedding"),
        )
    )


# --- file names -------------------------------------------------------------------------------
def file_names(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    pid = F.lpad((k % 1000).cast("string"), 3, "0")
    session = F.lpad((k % 7).cast("string"), 3, "0")
    code = F.when(k % 2 == 0, F.lit("C")).otherwise(F.lit("Z"))
    who = F.when(k % 41 == 0, F.concat(F.lit("PA"), F.substring(pid, 2, 2))).otherwise(
        F.concat(F.lit("P"), pid)
    )
    folder = F.concat(
        who, F.when(k % 23 == 0, F.lit("C")).otherwise(code), F.lit("001S"), session
    )
    part = F.when(k % 8 == 6, F.lit("Initial_Rest_")).when(
        k % 8 == 7, F.lit("Final_Rest_")
    ).otherwise(F.concat(F.lit("Rep"), (k % 8).cast("string"), F.lit("_")))
    inner = F.when(k % 37 == 0, F.lit("unknown")).otherwise(
        F.concat(who, code, F.lit("001S"), F.when(k % 43 == 0, F.lit("999")).otherwise(session))
    )
    task = F.when(k % 2 == 0, F.lit("Composite")).otherwise(F.lit("ZipTie"))
    name = F.concat(part, inner, F.lit(".csv"))
    return table(spark, sf_dir, "customer").select(
        k.alias("file_id"),
        folder.alias("folder"),
        name.alias("name"),
        F.concat_ws("/", F.lit("data"), task, folder, name).alias("path"),
    )


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "signals": (
        (),
        """SELECT event_id AS pos, user_id AS participant, strftime(ts, '%Y-%m-%d') AS day,
        event_type AS channel, epoch_us(ts) AS t_us,
        CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 83 = 0 THEN -2.0::DOUBLE
             ELSE value END AS value FROM events""",
    ),
    "axes": (
        (),
        """SELECT l_orderkey AS trial, l_linenumber AS line, l_partkey AS part,
        l_suppkey AS channel, l_quantity AS x,
        CASE WHEN l_suppkey % 10 = 0 THEN l_quantity WHEN l_partkey % 50 <> 0
             THEN l_extendedprice / 1000 END AS y, l_discount * 100 AS z FROM lineitem""",
    ),
    "intervals": (
        (),
        """SELECT l_orderkey AS trial, o_custkey AS worker, o_orderpriority AS task,
        ((l_linenumber - 1) * 10)::DOUBLE AS time1, (l_linenumber * 10)::DOUBLE AS time2,
        max(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.08 THEN 1 ELSE 0 END) AS state,
        max(l_quantity) AS hr_mean, min(l_extendedprice) AS wrist_rms, max(l_discount) AS hip_rms
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    ),
    "trials": (
        ("intervals",),
        """SELECT trial, o_custkey + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS worker,
        CASE WHEN o_orderkey % 29 = 0 THEN 'other' ELSE o_orderpriority END AS task,
        last_time2 + CASE WHEN o_orderkey % 13 = 0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END
          AS total_time,
        CASE WHEN o_orderkey % 17 = 0 THEN 1 - ever ELSE ever END AS fatigue,
        c_mktsegment AS sex, c_acctbal AS weight
        FROM orders JOIN (SELECT trial, max(time2) AS last_time2, max(state) AS ever
          FROM intervals GROUP BY trial) ON trial = o_orderkey
        LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 31 <> 0""",
    ),
    "rating_grid": (
        (),
        """SELECT l_orderkey AS pos, l_orderkey // 996 AS file_no,
        CASE WHEN l_orderkey % 6 = 0 THEN 'Subject ' || (l_orderkey // 6) END AS subject,
        'task' || (l_orderkey % 6 + 1) AS task_order, (l_orderkey % 4)::DOUBLE AS before_task, """
        + ", ".join(
            f"max(CASE WHEN l_linenumber = {i} THEN floor(l_quantity / 10) + l_linenumber END)"
            f'::DOUBLE AS "{i * 10}_sec"'
            for i in GRID_LINES
        )
        + """, 20.0::DOUBLE AS end_of_trial,
        (max(l_linenumber) * 10 + CASE l_orderkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 0 ELSE 5 END)
          ::DOUBLE AS length_of_trial FROM lineitem GROUP BY l_orderkey""",
    ),
    "predictions": (
        (),
        """SELECT row_id, grp, task, y_true, repeat, anchor, feature_set,
        ((grp * 7 + repeat * 3) % 5 + 1)::INT AS outer_fold,
        CASE WHEN feature_set = 'base' THEN base ELSE base * 0.6::DOUBLE + y_true * 0.4::DOUBLE
          + CASE WHEN anchor = 'END' THEN (row_id % 7 - 3) * 0.25::DOUBLE ELSE 0.0 END END AS y_pred
        FROM (SELECT event_id AS row_id, user_id AS grp, event_type AS task, value AS y_true,
          repeat, anchor, feature_set,
          50 + ((event_id * 31 + repeat * 17) % 61 - 30) * 0.5::DOUBLE AS base
          FROM events, (SELECT unnest([1, 2, 3, 4, 5]) AS repeat),
          (SELECT unnest(['START', 'END']) AS anchor),
          (SELECT unnest(['base', 'comb']) AS feature_set))""",
    ),
    "prob_predictions": (
        (),
        """SELECT row_id, grp, task, y_true, repeat, feature_set,
        ((grp * 7 + repeat * 3) % 5 + 1)::INT AS outer_fold,
        CASE WHEN feature_set = 'base' THEN base ELSE base * 0.7::DOUBLE + y_true * 0.3::DOUBLE END
          AS y_prob
        FROM (SELECT event_id AS row_id, user_id AS grp, event_type AS task,
          CASE WHEN value >= 60 THEN 1 ELSE 0 END AS y_true, repeat, feature_set,
          ((event_id * 31 + repeat * 17) % 997) / 997.0::DOUBLE AS base
          FROM events, (SELECT unnest([1, 2, 3, 4, 5]) AS repeat),
          (SELECT unnest(['base', 'comb']) AS feature_set))""",
    ),
    "representations": (
        (),
        """SELECT vec_id AS row_id, label AS grp, anchor,
        CASE WHEN anchor = 'START' THEN embedding[1:32] ELSE embedding[33:64] END AS embedding
        FROM embeddings, (SELECT unnest(['START', 'END']) AS anchor)""",
    ),
    "file_names": (
        (),
        """SELECT file_id, folder, name, 'data/' || CASE WHEN file_id % 2 = 0 THEN 'Composite'
          ELSE 'ZipTie' END || '/' || folder || '/' || name AS path FROM (
        SELECT k AS file_id,
        who || CASE WHEN k % 23 = 0 THEN 'C' ELSE code END || '001S' || session AS folder,
        CASE WHEN k % 8 = 6 THEN 'Initial_Rest_' WHEN k % 8 = 7 THEN 'Final_Rest_'
             ELSE 'Rep' || (k % 8) || '_' END
        || CASE WHEN k % 37 = 0 THEN 'unknown' ELSE who || code || '001S' ||
             CASE WHEN k % 43 = 0 THEN '999' ELSE session END END || '.csv' AS name
        FROM (SELECT c_custkey AS k,
          CASE WHEN c_custkey % 41 = 0 THEN 'PA' || substr(lpad((c_custkey % 1000)::VARCHAR, 3, '0'), 2, 2)
               ELSE 'P' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') END AS who,
          CASE WHEN c_custkey % 2 = 0 THEN 'C' ELSE 'Z' END AS code,
          lpad((c_custkey % 7)::VARCHAR, 3, '0') AS session FROM customer))""",
    ),
}


def with_views(names: Sequence[str], sql: str, recursive: bool = False) -> str:
    """Prefix a SELECT with the readings it names; ``sql`` may open with further CTEs."""
    order: list[str] = []

    def add(name: str) -> None:
        for parent in VIEWS[name][0]:
            add(parent)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    head = "WITH RECURSIVE " if recursive else "WITH "
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return head + ", ".join([*parts, body[5:]])
    return (head + ", ".join(parts) + " " + body) if parts else body
