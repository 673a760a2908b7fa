"""Mixing of sources to target weights: how often each document is taken.

Words are counted once per document and added up per source; the shares follow from the sources
alone. A document is then taken floor(rate) times, and once more with the rate's fraction as
probability, drawn from its id, so that any task can tell a document's copies by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.ranks import ranked, sums_before
from cohortlift.sources.tables import staged

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 13
SALTS = 16
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, rate) from (source, size), one row a source.

    The total of all sizes is shared by weight; weights go round over the sources in code point
    order, a missing source last. A target above ``cap`` times its source's size stops there and
    the excess is shared by weight among the others, until none is above. In the order of what a
    unit of weight may take (cap x size / weight), the stopped sources come first: the first one
    that has room for its share of what those before leave ends them, which running sums tell for
    all sources at once. A source without words has target and rate 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~"))  # "~" is behind "="
    order = ranked(totals.withColumns({"_all": F.lit(""), "_name": name}), "_all", ["_name"], "mixing-sources")
    turn = F.array(*[F.lit(int(w)).cast("bigint") for w in weights])
    order = order.withColumn("weight", F.element_at(turn, (F.col("pos") % len(weights) + 1).cast("int")))
    order = order.withColumn("room", F.col("source_size") * cap).drop("pos", "n")
    order = ranked(order.withColumn("_each", F.col("room") / F.col("weight")), "_all", ["_each", "_name"], "mixing-rooms")
    shares = staged(sums_before(order, ["room", "weight"]), "mixing-shares")
    whole = shares.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    wide = lambda c: c.cast("decimal(18,0)")
    rest, heavy = F.lit(whole.size) - F.col("before_room"), F.lit(whole.weight) - F.col("before_weight")
    fits = shares.where(wide(F.col("room")) * wide(heavy) >= wide(rest) * wide(F.col("weight")))
    first = fits.orderBy("pos").select("pos", rest.alias("rest"), heavy.alias("heavy")).first()
    if first is None:  # no source at all
        return shares.select("source", "source_size", F.lit(0.0).alias("target"), F.lit(0.0).alias("rate"))
    share = F.lit(first.rest) * F.col("weight") / F.lit(first.heavy)
    target = F.when(F.col("pos") < first.pos, F.col("room").cast("double")).otherwise(share)
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return shares.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def drawn(key: Column, seed: int) -> Column:
    """A number from 0 up to 1 that depends on the seed and the key alone; a missing key is drawn
    as the empty one."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(1 << 32)


def with_copies(rows: DataFrame, shares: DataFrame, key: str, source: str, seed: int = SEED) -> DataFrame:
    """``rows`` with source_size, target and ``copies``. The shares are few and small as a rule, but
    where they have to be joined by shuffle, a hot source is dealt over ``SALTS`` keys."""
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")
    spread = shares.select(
        F.col("source").alias("_source"), "source_size", "target", "rate",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
    )
    joined = rows.withColumn("_s", salt).join(
        staged(spread, "mixing-rates"), (F.col("_s") == F.col("_salt")) & F.col(source).eqNullSafe(F.col("_source")), "left"
    )
    once = F.floor("rate")
    more = (drawn(F.col(key), seed) < F.col("rate") - once).cast("bigint")
    return joined.withColumn("copies", once + more).drop("_s", "_salt", "_source", "rate")


def mixing_plan(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    seed: int = SEED,
) -> DataFrame:
    """(key, source, size, source_size, target, copies) for each row of ``docs``.

    Size is the number of words; a null text has none. Repeated rows each give a row and count to
    their source; rows of one id are drawn alike. A null source is a source. An empty table gives
    none; further columns are ignored whatever their names. Texts are read once; what follows
    works on sizes.
    """
    sizes = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sizes = staged(sizes, "mixing-sizes")
    plan = with_copies(sizes, targets(sizes, weights, cap), "_key", "source", seed)
    return plan.select(F.col("_key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies")


def mixed(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", copy: str = "copy", **options
) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken, with its columns as they
    were and ``copy`` from 1 on; rows not taken are left out. ``copy`` must not be one of them."""
    if copy in docs.columns:
        raise ValueError(f"{copy!r} is a column already")
    seed = options.pop("seed", SEED)
    sizes = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    shares = targets(sizes, **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.withColumns({"_id": F.col(f"_row.`{key}`"), "_of": F.col(f"_row.`{source}`")})
    taken = with_copies(rows, shares, "_id", "_of", seed).where("copies > 0")
    return taken.select("_row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy))


def mixing_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): taken words count every copy."""
    plan = mixing_plan(docs, **options)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
