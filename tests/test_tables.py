"""Readers, sinks, guards and parsing on small files and literal rows."""

import re

import pytest
from pyspark.sql import functions as F

from cohortlift.functions import parsing as ps
from cohortlift.operators import guards as gd
from cohortlift.operators import joining as jn
from cohortlift.operators import roles as rl
from cohortlift.plans import fixtures
from cohortlift.plans.evaluation_queries import x7
from cohortlift.plans.model_queries import l1
from cohortlift.sources import readers, tables


def test_differing_headers_are_read_as_one(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.csv").write_text("Time,HR,Note\n1,60,x\n2,bad,y\n")
    (tmp_path / "two.csv").write_text("HR,Time\n70,3\n")
    df = readers.read_tolerant_csv(spark, str(tmp_path), ["Time", "HR", "ECG"])
    got = readers.typed(df, ["Time", "HR", "ECG"]).orderBy("Time").collect()
    assert [(r.Time, r.HR, r.ECG) for r in got] == [(1.0, 60.0, None), (2.0, None, None), (3.0, 70.0, None)]
    assert got[2].source_file.endswith("two.csv")


def test_readers_by_suffix(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n")
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    spark.range(3).write.parquet(str(tmp_path / "p"))
    for suffix in ("tsv", "csv"):
        assert readers.read_any(spark, str(tmp_path / f"t.{suffix}"), suffix).columns == ["a", "b"]
    assert readers.read_any(spark, str(tmp_path / "p"), "parquet").count() == 3


def test_resume_skips_what_is_stored(spark, tmp_path):
    path = str(tmp_path / "done")
    grid = spark.range(6).withColumnRenamed("id", "task")
    seen = []

    def work(todo):
        seen.append(sorted(r.task for r in todo.collect()))
        return todo.withColumn("score", F.lit(1.0))

    tables.resume_append(grid.where("task < 4"), path, ["task"], work)
    tables.resume_append(grid, path, ["task"], work)
    assert seen == [[0, 1, 2, 3], [4, 5]] and spark.read.parquet(path).count() == 6


def test_contract_breaches_fail(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None)], "k int, y double")
    check = gd.contract(df, ["k"], ["y"])
    row = check.first()
    assert (row.repeated_keys, row.null_y, row.ok) == (1, 1, False)
    with pytest.raises(Exception, match="broken"):
        gd.enforce(check, "broken").collect()
    with pytest.raises(ValueError, match="missing columns"):
        gd.require_columns(df, ["absent"])


def test_repeated_key_fails_a_one_to_one_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="key repeated"):
        jn.one_to_one_left(left, right, ["k"], ("_l", "_r")).collect()
    fine = jn.one_to_one_left(left, right.limit(1), ["k"], ("_l", "_r"))
    assert sorted(fine.columns) == ["k", "v_l", "v_r"] and fine.count() == 2


def test_identity_and_natural_order(spark):
    names = ["Rep1_P001C001S003.csv", "rep12_pa00z001s003.csv", "none.csv"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.i for r in df.select(ps.identity(F.col("n")).alias("i")).collect()]
    assert [(g.participant, g.code, g.standard) for g in got] == [
        ("P001", "C", True), ("PA00", "Z", False), (None, None, False)
    ]
    labels = spark.createDataFrame([("t10",), ("t9",), ("T1",)], "s string")
    assert [r.s for r in labels.orderBy(ps.natural_key(F.col("s"))).collect()] == ["T1", "t9", "t10"]


def test_snippets_may_overlap(spark):
    df = spark.createDataFrame([("aa KEY b\n key cc",)], "t string")
    got = df.select(ps.keyword_snippets(F.col("t"), "key", 3, 4).alias("s")).first().s
    assert got == ["aa KEY b ", "b key cc"]


def test_role_order_and_forbidden_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "id int, sensor_b double, ctx double, sensor_a double")
    rules = [("^id$", "identifier", "id"), ("^sensor_", "wearable_feature", "s"), ("^ctx", "context_core", "c")]
    d = rl.role_dictionary(spark, df, rules)
    assert rl.columns_of(d, ["context_core", "wearable_feature"]) == ["ctx", "sensor_b", "sensor_a"]
    assert rl.columns_of(d, ["wearable_feature"], forbidden=["sensor_b"]) == ["sensor_a"]


def test_aliased_columns_take_the_best_fit(spark):
    catalog = spark.createDataFrame(
        [("a", 0, "Max Heart Rate"), ("a", 1, "HR"), ("a", 2, "t"), ("b", 0, "Heart Rate"), ("b", 1, "heart")],
        "table string, place int, column string",
    )
    got = rl.aliased_columns(catalog, {"pulse": ["hr", "heart rate"], "time": ["t"]})
    best = {(r.table, r.meaning): r.column for r in got.collect()}
    assert best["a", "pulse"] == "HR" and best["b", "pulse"] == "Heart Rate" and best["a", "time"] == "t"


def test_long_digit_runs_compare_as_numbers(spark):
    names = ["a2234567890123", "a999999999999", "a10", "a9", "a009b", "a9999999999999999999"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = [r.s for r in df.orderBy(ps.natural_key(F.col("s")), "s").collect()]
    assert got == ["a9", "a009b", "a10", "a999999999999", "a2234567890123", "a9999999999999999999"]


def test_a_data_row_like_the_header_stays(spark, tmp_path):
    from cohortlift.sources import readers

    (tmp_path / "x.csv").write_text("t,v\n1,2\nt,v\n3,4\n")
    got = readers.read_tolerant_csv(spark, str(tmp_path), ["v"]).collect()
    assert sorted(r.v for r in got) == ["2", "4", "v"]


def test_clip_probability_leaves_missing_missing(spark):
    from cohortlift.functions import cleaning as cl

    df = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (1.0,), (0.5,)], "p double")
    got = [r.p for r in df.select(cl.clip_probability("p").alias("p")).collect()]
    assert got == [None, None, 1e-6, 1 - 1e-6, 0.5]


def test_two_predictions_of_a_side_fail(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 9.0), (1, "b", 2.0)], "k int, side string, v double")
    with pytest.raises(Exception, match="key repeated"):
        jn.paired_sides(df, ["k"], "side", "a", "b", "v", []).collect()


def test_a_supplied_table_in_several_files_or_without_rows_is_one_count(spark, tmp_path):
    spark.range(7).repartition(3).write.parquet(str(tmp_path / "parts.parquet"))
    spark.range(0).write.parquet(str(tmp_path / "empty.parquet"))
    named = {f"{t}.parquet": spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("parts", "empty")}
    got = {r.file: r.n_rows for r in readers.rows_per_table(named).collect()}
    assert got == {"parts.parquet": 7, "empty.parquet": 0}


def test_exploded_rows_are_not_broadcast_to_the_listed_ids(spark):
    from cohortlift.operators import quarantine as qr

    spark.range(1000).write.mode("overwrite").parquet(path := tables.scratch_path(spark, "ids"))
    rows = spark.read.parquet(path).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20))))
    listed = spark.read.parquet(path).where("id % 100 = 0")
    check = qr.before_and_after(rows, qr.drop_rows(rows, listed, "id"), listed, "id")
    assert tuple(check.first()) == (10, 10, 0, True)
    depth = None
    for line in check._jdf.queryExecution().sparkPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if "LeftSemi" in line:
            depth = at
        elif depth is not None and at <= depth:
            depth = None
        assert depth is None or "Generate" not in line


def test_neither_side_of_a_resumed_grid_is_broadcast(spark):
    grid = spark.range(100).withColumnRenamed("id", "task")
    todo = tables.remaining(grid, grid.where("task < 90"), ["task"])
    assert "Broadcast" not in todo._jdf.queryExecution().sparkPlan().toString()
    assert sorted(r.task for r in todo.collect()) == list(range(90, 100))


def test_an_archive_of_many_files_makes_no_task_per_file(spark, tmp_path):
    df = spark.range(6000).selectExpr("id % 1500 AS p", "id % 2 AS t", "concat('x', id) AS v")
    root = str(tmp_path / "archive")
    tables.write_archive(df, root, ["p", "t"], "v", "txt")
    (tmp_path / "archive" / "_hidden").mkdir()
    (tmp_path / "archive" / "_hidden" / "no.txt").write_text("x")
    (tmp_path / "archive" / "p=0" / "more.csv").write_text("abc")
    found = readers.discovered(spark, root, {"p": "p=([^/]+)/", "t": "/t=([^/]+)/"}, "*.txt")
    assert found.rdd.getNumPartitions() <= 16
    assert (found.count(), found.select("p", "t").distinct().count()) == (1500, 1500)
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root + "/p=*")
    assert sorted(r.value for r in lines.collect()) == sorted(f"x{i}" for i in range(6000))
    sizes = {r.path: r.n_bytes for r in readers.inventory(spark, root, "*.{csv,txt}").collect()}
    assert len(sizes) == 1501 and sizes[f"file:{root}/p=0/more.csv"] == 3


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name, keys", [("intervals", ["trial", "time1"]), ("predictions", ["anchor", "feature_set", "row_id"]),
                                        ("prob_predictions", ["feature_set", "row_id"])])
def test_tasks_stay_small_however_long_the_table(spark, tmp_path, monkeypatch, name, keys):
    lines = spark.range(6_000).selectExpr(
        "id DIV 4 AS l_orderkey", "CAST(id % 4 AS int) AS l_linenumber", "'R' AS l_returnflag", "0.1D AS l_discount",
        "1.0D AS l_quantity", "2.0D AS l_extendedprice",
    )
    orders = spark.range(1_500).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "'1-URGENT' AS o_orderpriority")
    events = spark.range(6_000).selectExpr("id AS event_id", "id % 9 AS user_id", "'view' AS event_type", "1.0D * id AS value")
    for table, df in (("lineitem", lines), ("orders", orders), ("events", events)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    monkeypatch.setattr(fixtures, "LINES_OF_TASK", 500)
    monkeypatch.setattr(fixtures, "EVENTS_OF_TASK", 500)
    per_key = getattr(fixtures, name)(spark, str(tmp_path)).groupBy(*keys).count()
    sizes = per_key.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("count").alias("n")).collect()
    copies = sum(r.n for r in sizes) / 6_000
    assert len(sizes) == 12 and max(r.n for r in sizes) < 1_000 * copies
    assert exchanges(per_key) == 1  # before the rows are multiplied or grouped, not after


def test_stored_and_rebuilt_rows_meet_where_they_were_dealt(spark, tmp_path):
    events = spark.range(2_000).selectExpr("id AS event_id", "id % 9 AS user_id", "'view' AS event_type", "1.0D * id AS value")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    checked = x7(spark, str(tmp_path))
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert not [k for k in re.findall(r"hashpartitioning\(([^)]*)\)", plan) if "row_id" in k and "anchor" in k]
    found = checked.agg(F.sum("n_keys"), F.sum("only_second"), F.sum("only_first")).first()
    assert tuple(found) == (2_000 * 20, 4 * 20, 0)  # ids 0, 601, 1202 and 1803 are not stored


def test_fold_preprocessing_reads_the_lines_once(spark, tmp_path):
    lines = spark.range(600).selectExpr(
        "id DIV 4 AS l_orderkey", "CAST(id % 4 AS int) AS l_linenumber", "'R' AS l_returnflag", "0.1D AS l_discount",
        "1.0D * (id % 13) AS l_quantity", "2.0D * (id % 11) AS l_extendedprice",
    )
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.range(150).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "concat(1 + id % 3, '-P') AS o_orderpriority")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    done = l1(spark, str(tmp_path))
    assert not [f for f in done.inputFiles() if "lineitem" in f] and done.count() == 600
