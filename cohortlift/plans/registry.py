"""Registry of queries: a Spark plan over the given tables and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.plans.fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(
    name: str,
    sql: str | None = None,
    views: Sequence[str] = (),
    rounded: Sequence[str] = (),
    digits: int = 6,
    recursive: bool = False,
):
    """Register a plan. ``rounded`` doubles are cut to ``digits`` on both sides, since two
    engines add floating-point numbers in different orders."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            for c in rounded:
                df = df.withColumn(c, F.round(F.col(c), digits) + F.lit(0.0))
            return df

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            text = with_views(views, sql, recursive)
            if rounded:
                cut = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in rounded)
                text = f"SELECT * REPLACE ({cut}) FROM ({text})"
            ORACLES[name] = text
        return fn

    return wrap
