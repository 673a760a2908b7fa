"""Stage tables: sinks, embedding tables, audit facts and resumable appends."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from itertools import groupby
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    A temporary folder stands in only where one process does all the work; on a cluster executors
    would each write to their own disk, so a missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="cohortlift-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a stage table; rows are written where they are, so a hot partition value is
    written by as many tasks as hold it."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """A table that several later steps read: written once to the shared folder, read back.

    Later plans start from files, so nothing upstream is computed twice, a lost executor only
    costs a re-read, and the planner knows the true size when it chooses a join.
    """
    path = scratch_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_archive(df: DataFrame, root: str, folders: Sequence[str], line: str, suffix: str) -> None:
    """One text file for every combination of ``folders``, below a folder for each (name=value).

    Spark's writer lists, renames and checks every file on its own in the driver when it commits,
    which takes longer than all else where there are many small files. Here a task has its
    combinations in order and streams each into its file; a task that is run again writes the same
    files again.
    """
    names = list(folders)

    def write(rows) -> None:
        system, top = fs.FileSystem.from_uri(re.sub("^file:/*", "/", root))
        for key, lines in groupby(rows, lambda r: tuple(r[: len(names)])):
            parts = [f"{n}={'__HIVE_DEFAULT_PARTITION__' if v is None else quote(str(v), safe=' ')}" for n, v in zip(names, key)]
            folder = "/".join([top.rstrip("/"), *parts])
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/part-00000.{suffix}") as out:
                for r in lines:
                    out.write(f"{r[-1]}\n".encode())

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.select(*names, line).repartition(tasks, *names).sortWithinPartitions(*names)
    placed.foreachPartition(write)


def write_embeddings(
    df: DataFrame, path: str, row_id: str, vector: str, scalars: Sequence[str]
) -> None:
    """Embedding table keyed by row id and scalars; vectors stored as ARRAY<FLOAT>."""
    kept = df.select(row_id, *scalars, F.col(vector).cast("array<float>").alias(vector))
    kept.write.mode("overwrite").parquet(path)


def read_embeddings(
    spark: SparkSession, path: str, rows: DataFrame, row_id: str
) -> DataFrame:
    """Stored vectors joined to the rows that need them by id, never by position."""
    return rows.join(spark.read.parquet(path), row_id, "left")


def audit_facts(*sections: tuple[str, DataFrame, Sequence[str]]) -> DataFrame:
    """Long audit table (section, scope, metric, value) from small summary tables.

    Each section is (name, table, scope columns); the remaining columns are its metrics.
    """
    out = None
    for name, df, scope in sections:
        metrics = [c for c in df.columns if c not in scope]
        cells = df.select(
            F.lit(name).alias("section"),
            (F.concat_ws("/", *scope) if scope else F.lit("All")).alias("scope"),
            *[F.col(c).cast("double").alias(c) for c in metrics],
        )
        long = cells.unpivot(["section", "scope"], metrics, "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table below ``path``; None where no run has finished writing a part of it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = system.listFiles(folder, True) if system.exists(folder) else None
    while files is not None and files.hasNext():
        name = files.next().getPath().toString()
        if name.endswith(".parquet") and "/_temporary/" not in name:
            return spark.read.parquet(path)
    return None


def remaining(grid: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Task keys not stored yet. Both sides grow with the grid, and stored keys are far smaller as
    files than in memory: neither is broadcast."""
    return grid.join(done.select(*keys).distinct().hint("merge"), list(keys), "left_anti")


def resume_append(grid: DataFrame, path: str, keys: Sequence[str], work) -> None:
    """Run ``work`` on the keys missing from the table at ``path`` and append its rows.

    A rerun after a crash skips what is stored: parquet appends are committed whole.
    """
    done = stored(grid.sparkSession, path)
    todo = grid if done is None else remaining(grid, done, keys)
    work(todo).write.mode("append").parquet(path)
