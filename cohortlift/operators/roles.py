"""The role dictionary: which column may be used for what."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Roles whose columns may enter a model.
ELIGIBLE = ("context_core", "context_extended", "baseline_physiology", "wearable_feature")


def role_dictionary(
    spark: SparkSession, df: DataFrame, rules: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """column, position, role, family, eligible; the first rule whose pattern fits wins.

    ``rules``: (regular expression over the column name, role, family), in order.
    """
    names = list(enumerate(df.columns))
    base = spark.createDataFrame(names, "position int, column string")
    role, family = F.lit("other"), F.lit("other")
    for pattern, r, f in reversed(list(rules)):
        fits = F.col("column").rlike(pattern)
        role = F.when(fits, F.lit(r)).otherwise(role)
        family = F.when(fits, F.lit(f)).otherwise(family)
    return base.withColumn("role", role).withColumn("family", family).withColumn(
        "eligible", F.col("role").isin(*ELIGIBLE).cast("int")
    )


def columns_of(
    dictionary: DataFrame,
    roles: Sequence[str] = (),
    families: Sequence[str] = (),
    forbidden: Sequence[str] = (),
) -> list[str]:
    """Columns of the roles (in the order asked for), without repeats and forbidden names.

    The dictionary has one row per column of a table, so this collect is as small as a schema.
    """
    rows = dictionary.orderBy("position").collect()
    if families:
        rows = [r for r in rows if r.family in families]
    picked: list[str] = []
    for role in roles or sorted({r.role for r in rows}):
        picked += [r.column for r in rows if r.role == role]
    return [c for c in dict.fromkeys(picked) if c not in set(forbidden)]


def families_by_prefix(columns: Sequence[str], prefixes: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """Sensor families named by column prefix, plus one with all of them."""
    out = {f: [c for c in columns if c.startswith(tuple(p))] for f, p in prefixes.items()}
    out["All"] = [c for c in columns if any(c in v for v in out.values())]
    return out


def split_by_type(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) by the stored type; booleans count as categorical."""
    types = {f.name: f.dataType for f in df.schema}
    numeric = [c for c in columns if isinstance(types[c], T.NumericType)]
    return numeric, [c for c in columns if c not in numeric]


def allowed_metadata(
    df: DataFrame, key: str, exact: Sequence[str], keywords: Sequence[str], prefix: str
) -> DataFrame:
    """Key and whitelisted columns (by normalised name or keyword), prefixed."""
    from cohortlift.functions.parsing import normalise_name

    kept = []
    for c in df.columns:
        z = normalise_name(c)
        if c != key and (z in exact or any(k in z for k in keywords)):
            kept.append(F.col(c).alias(f"{prefix}{z}"))
    return df.select(key, *kept)


def aliased_columns(catalog: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """The column of each table that fits each meaning best, from a catalog (table, place, column).

    A name equal to an alias goes before one that holds it, an earlier alias before a later one,
    an earlier column before a later one. Gives (table, meaning, column).
    """
    from cohortlift.functions.parsing import normalise_name, normalise_text

    known = [(m, i, normalise_name(a)) for m, names in aliases.items() for i, a in enumerate(names)]
    name = normalise_text(F.col("column"))
    fits = F.array_compact(
        F.array(*[
            F.when(name.contains(a), F.struct(F.lit(m).alias("meaning"), (name != a).alias("part"), F.lit(i).alias("turn")))
            for m, i, a in known
        ])
    )
    ranked = catalog.select("table", "place", "column", F.explode(fits).alias("fit")).select(
        "table", "column", "fit.meaning", F.struct("fit.part", "fit.turn", "place").alias("rank")
    )
    return ranked.groupBy("table", "meaning").agg(F.min_by("column", "rank").alias("column"))


def semantic_candidates(catalog: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Columns of a catalog (table, column) that contain a keyword of each meaning."""
    from cohortlift.functions.parsing import normalise_text

    name = normalise_text(F.col("column"))
    hits = F.array_compact(
        F.array(*[
            F.when(name.rlike("|".join(re.escape(k) for k in keys)), F.lit(g))
            for g, keys in groups.items()
        ])
    )
    return catalog.select("table", "column", F.explode(hits).alias("meaning"))
