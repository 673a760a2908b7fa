"""Set comparisons of key tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def membership(df: DataFrame, key: str, task: str, a: str, b: str) -> DataFrame:
    """Sizes of both sets, their intersection, union and differences, from one grouping."""
    per = df.where(F.col(task).isin(a, b)).groupBy(key).agg(
        F.bool_or(F.col(task) == a).alias("_a"), F.bool_or(F.col(task) == b).alias("_b")
    )
    return per.agg(
        F.count_if("_a").alias("n_first"),
        F.count_if("_b").alias("n_second"),
        F.count_if(F.col("_a") & F.col("_b")).alias("n_both"),
        F.count(F.lit(1)).alias("n_either"),
        F.count_if(F.col("_a") & ~F.col("_b")).alias("n_first_only"),
        F.count_if(~F.col("_a") & F.col("_b")).alias("n_second_only"),
    )


def expected_pairs(
    observed: DataFrame, key: str, member: str, members: Sequence
) -> DataFrame:
    """Missing and unexpected (key, member) pairs against the full grid of the given members.

    The grid is spread with explode from the distinct keys; no join builds it.
    """
    seen = observed.select(key, member).distinct()
    want = seen.select(key).distinct().withColumn(
        member, F.explode(F.array(*[F.lit(m) for m in members]))
    )
    missing = want.join(seen, [key, member], "left_anti").withColumn("status", F.lit("missing"))
    extra = seen.where(~F.col(member).isin(*members)).withColumn("status", F.lit("unexpected"))
    return missing.unionByName(extra)


def aligned_union(*tables: DataFrame) -> DataFrame:
    """Rows of all tables under the union of their columns, absent cells NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def key_equality(
    a: DataFrame, b: DataFrame, keys: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Keys found on one side only, counted (per ``by``), and whether the sets are equal."""
    cols = list(dict.fromkeys([*by, *keys]))
    tagged = a.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(
        b.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    per = tagged.groupBy(*cols).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    out = per.groupBy(*by).agg(
        F.count_if(F.col("_b") == 0).alias("only_first"),
        F.count_if(F.col("_a") == 0).alias("only_second"),
        F.count(F.lit(1)).alias("n_keys"),
    )
    return out.withColumn("equal", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def best_candidate(
    scores: DataFrame, keys: Sequence[str], score: str, params: str, lower_is_better: bool = True
) -> DataFrame:
    """Best candidate per task: score to 1e-12, then the smallest parameter text."""
    signed = F.col(score) if lower_is_better else -F.col(score)
    best = F.min(F.struct(F.bround(signed, 12).alias("_s"), F.col(params), F.col(score)))
    return scores.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col(f"_b.{params}").alias(params), F.col(f"_b.{score}").alias(score)
    )
