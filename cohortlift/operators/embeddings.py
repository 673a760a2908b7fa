"""Operators around frozen embedding tables; vectors stay vectors, nothing is exploded by dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlift.functions.cleaning import is_finite


def doubles(v: Column | str) -> Column:
    """Vectors are added up in double precision whatever they are stored in."""
    c = F.col(v) if isinstance(v, str) else v
    return c.cast("array<double>")


def mean_vector(v: Column, weight: Column | None = None) -> Column:
    """Element-wise (weighted) mean as an aggregate with partial results before the shuffle."""
    vec = array_to_vector(doubles(v))
    mean = Summarizer.mean(vec, weight) if weight is not None else Summarizer.mean(vec)
    return vector_to_array(mean)


def sum_vector(v: Column) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(doubles(v))))


def pool(df: DataFrame, levels: Sequence[Sequence[str]], vector: str) -> DataFrame:
    """Mean pooling level by level: ``levels`` lists the keys kept after each step.

    [[row, loc, chan], [row, loc], [row]] pools patches, then channels, then the locations that
    are there; a missing location simply has no row.
    """
    out = df
    for keys in levels:
        out = out.groupBy(*keys).agg(mean_vector(F.col(vector)).alias(vector))
    return out


def first_patch_pool(
    df: DataFrame, patch: str, levels: Sequence[Sequence[str]], vector: str
) -> DataFrame:
    """Pooling of the first patch only (a summary token in front of the sequence)."""
    return pool(df.where(F.col(patch) == 0), levels, vector)


def weighted_pool(df: DataFrame, keys: Sequence[str], vector: str, weight: str) -> DataFrame:
    """Chunks weighted by how many valid patches each one holds."""
    return df.groupBy(*keys).agg(mean_vector(F.col(vector), F.col(weight)).alias(vector))


def chunk_windows(
    samples: DataFrame, keys: Sequence[str], index: str, value: str, size: int
) -> DataFrame:
    """Cut windows into chunks of ``size`` samples, the last one padded right with zeros.

    ``index`` counts from 0 inside the window without gaps. Every sample appears once; padding
    rows carry valid = false.
    """
    placed = samples.select(
        *keys,
        F.floor(F.col(index) / size).cast("bigint").alias("chunk"),
        (F.col(index) % size).cast("bigint").alias("offset"),
        F.col(value).alias(value),
        F.lit(True).alias("valid"),
    )
    ends = samples.groupBy(*keys).agg((F.max(index) + 1).alias("_n"))
    pad = F.when(
        F.col("_n") % size != 0,
        F.sequence(F.col("_n"), (F.floor(F.col("_n") / size) + 1) * size - 1),
    )
    padding = ends.select(*keys, F.explode(pad).alias("_i")).select(
        *keys,
        F.floor(F.col("_i") / size).cast("bigint").alias("chunk"),
        (F.col("_i") % size).cast("bigint").alias("offset"),
        F.lit(0.0).alias(value),
        F.lit(False).alias("valid"),
    )
    return placed.unionByName(padding)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def dot_n(a: Column, b: Column, n: int, unroll: int = 64) -> Column:
    """Dot product of two arrays of known length; short ones are written out so they compile."""
    if n > unroll:
        return dot(a, b)
    return sum((a[i] * b[i] for i in range(1, n)), a[0] * b[0])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, NULL when either has no length."""
    x, y = doubles(a), doubles(b)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return dot(x, y) / F.nullif(norm, F.lit(0.0))


def anchor_cosine(df: DataFrame, key: str, vector: str, anchors: tuple[str, str]) -> DataFrame:
    """Cosine between the two anchors' vectors of each row, in one grouping."""
    def at(a):
        return F.max_by(vector, F.when(F.col("anchor") == a, F.lit(1)))

    both = df.groupBy(key).agg(at(anchors[0]).alias("_a"), at(anchors[1]).alias("_b"))
    return both.select(key, cosine(F.col("_a"), F.col("_b")).alias("cosine"))


def lock(df: DataFrame, by: Sequence[str], row_id: str, vector: str, dims: int) -> DataFrame:
    """Rows, distinct ids, vectors of the wrong length and vectors with non-finite cells."""
    good = F.forall(doubles(vector), is_finite)
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(row_id).alias("n_ids"),
        F.count_if(F.size(vector) != dims).alias("wrong_length"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("nonfinite"),
    )
    fine = (F.col("n_rows") == F.col("n_ids")) & (F.col("wrong_length") == 0)
    return out.withColumn("ok", fine & (F.col("nonfinite") == 0))


def append_to_context(
    rows: DataFrame, embeddings: DataFrame, keys: Sequence[str], context: Sequence[str],
    vector: str, out: str = "features",
) -> DataFrame:
    """Context columns and the row's vector as one feature array, matched by key."""
    joined = rows.join(embeddings, list(keys))
    head = F.array(*[F.col(c).cast("double") for c in context])
    return joined.withColumn(out, F.concat(head, doubles(vector)))


def to_columns(df: DataFrame, vector: str, dims: int, prefix: str = "emb_") -> DataFrame:
    """Named columns emb_000 …; for narrow use, models take the array."""
    cols = [F.col(vector)[i].cast("double").alias(f"{prefix}{i:03d}") for i in range(dims)]
    return df.select(*[c for c in df.columns if c != vector], *cols)
