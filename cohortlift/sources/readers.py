"""Reading sensor archives: typed, tolerant of differing headers, with path-borne metadata."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.functions.cleaning import clean_numeric
from cohortlift.sources.tables import staged

# How each suffix is read.
FORMATS = {
    "csv": ("csv", {"header": "true", "sep": ","}),
    "tsv": ("csv", {"header": "true", "sep": "\t"}),
    "txt": ("csv", {"header": "true", "sep": "\t"}),
    "parquet": ("parquet", {}),
}


def read_any(spark: SparkSession, path: str, suffix: str, sep: str | None = None) -> DataFrame:
    """One call for csv, tsv, delimited txt and parquet; text columns stay text."""
    fmt, options = FORMATS[suffix]
    reader = spark.read.format(fmt).options(**options)
    if sep:
        reader = reader.option("sep", sep)
    return reader.option("recursiveFileLookup", "true").load(path)


def typed(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Numeric columns coerced, bad cells missing, everything else as read."""
    return df.select(*[clean_numeric(c).alias(c) if c in numeric else F.col(c) for c in df.columns])


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Hadoop writes it, and the path within it."""
    return fs.FileSystem.from_uri(re.sub("^file:/*", "/", path))


def _listed(folders: DataFrame) -> DataFrame:
    """(path, length, folder) of what lies in every folder, names that Spark hides left out."""

    def children(batches):
        for pdf in batches:
            for path in pdf["path"]:
                system, inner = file_system(path)
                head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
                found = [f for f in system.get_file_info(fs.FileSelector(inner))
                         if "=" in f.base_name or f.base_name[0] not in "._"]
                yield pd.DataFrame({
                    "path": [head + f.path for f in found],
                    "length": [f.size if f.is_file else 0 for f in found],
                    "folder": [not f.is_file for f in found],
                })

    return folders.mapInPandas(children, "path string, length bigint, folder boolean")


def files_below(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below a folder, listed in tasks level by level.

    The driver sees no path, and there is no task or file handle per file.
    """
    qualified = spark._jvm.org.apache.hadoop.fs.Path(root)
    qualified = qualified.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(qualified).toString()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, levels = spark.createDataFrame([(qualified,)], "path string"), []
    while not folders.isEmpty():
        level = staged(_listed(folders), "listed")
        levels.append(level.where("NOT folder").drop("folder"))
        folders = level.where("folder").select("path").repartition(tasks)
    regex = "|".join(fnmatch.translate(p) for p in _braces(pattern))
    return reduce(DataFrame.unionByName, levels).where(F.element_at(F.split("path", "/"), -1).rlike(regex))


def _braces(pattern: str) -> list[str]:
    """A glob with {a,b} as the globs without."""
    met = re.search(r"\{([^{}]*)\}", pattern)
    if not met:
        return [pattern]
    return [q for p in met[1].split(",") for q in _braces(pattern[: met.start()] + p + pattern[met.end() :])]


def inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Path, name, suffix and size of every file below ``root``; contents are never read."""
    files = files_below(spark, root, pattern)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path",
        name.alias("name"),
        F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("suffix"),
        F.col("length").alias("n_bytes"),
    )


def discovered(
    spark: SparkSession, root: str, from_path: Mapping[str, str], pattern: str = "*"
) -> DataFrame:
    """The inventory with what each path says: a column per pattern, its first group, or missing."""
    files = inventory(spark, root, pattern)
    return files.withColumns({
        name: F.nullif(F.regexp_extract("path", regex, 1), F.lit("")) for name, regex in from_path.items()
    })


def rows_per_file(df: DataFrame) -> DataFrame:
    """Data rows per source file of a freshly read table (no column is decoded)."""
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def rows_per_table(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Data rows of every named table, be it one file, a folder of part files or empty."""
    out = None
    for name, df in tables.items():
        total = rows_per_file(df).agg(F.coalesce(F.sum("n_rows"), F.lit(0).cast("bigint")).alias("n_rows"))
        one = total.select(F.lit(name).alias("file"), "n_rows")
        out = one if out is None else out.unionAll(one)
    return out


def wanted_columns(tables: Sequence[DataFrame], wanted: Sequence[str]) -> DataFrame:
    """Union of tables with differing headers, cut to the wanted columns each one has."""
    cut = [t.select(*[c for c in wanted if c in t.columns]) for t in tables]
    out = cut[0]
    for t in cut[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    absent = [c for c in wanted if c not in out.columns]
    return out.select(*[F.lit(None).cast("string").alias(c) if c in absent else F.col(c) for c in wanted])


def read_tolerant_csv(
    spark: SparkSession, root: str, wanted: Sequence[str], sep: str = ","
) -> DataFrame:
    """CSV files below ``root`` whose headers differ, cut to the wanted columns, as text.

    A file's header is the first line of its first block. Lines meet the header of their file
    in a join, and each wanted column is taken from the place that header gives it, so any
    number of files and headers is one plan; the driver only learns the widest header. Adds
    ``source_file``.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(root).select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    headers = lines.where("_start = 0").groupBy("source_file").agg(
        F.min_by("value", "_id").alias("_header"), F.min("_id").alias("_first")
    )
    width = headers.agg(F.max(F.size(F.split("_header", f"[{sep}]")))).first()[0] or 1
    schema = ", ".join(f"c{i} string" for i in range(width))

    def parts(c: str) -> Column:
        cells = F.from_csv(F.col(c), F.lit(schema), {"sep": sep})
        return F.array(*[cells[f"c{i}"] for i in range(width)])

    # the header goes by its place: a data row may read the same
    met = lines.join(headers, "source_file").where(F.col("_id") != F.col("_first"))
    met = met.withColumn("_cells", parts("value")).withColumn(
        "_names", F.transform(parts("_header"), lambda h: F.trim(h))
    )
    place = [F.array_position("_names", F.lit(c)) for c in wanted]
    return met.select(
        *[
            F.when(at > 0, F.get("_cells", (at - 1).cast("int"))).alias(c)
            for c, at in zip(wanted, place)
        ],
        "source_file",
    )


def preview(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First n rows in a stated order (a top-n per task, never a full sort)."""
    return df.orderBy(*order).limit(n)
