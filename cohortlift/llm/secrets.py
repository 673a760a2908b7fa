"""Secret scan: patterns, and a ratio of character models for what they miss (operator 8).

Three patterns give the base findings. Their values are the labelled sample of random strings, all
other long tokens of the corpus that of ordinary identifiers: each trains a Markov model of single
characters. Tokens outside the base findings whose mean log-likelihood ratio per character is
beyond a threshold, set half-way between both samples, are findings too.

Only DataFrame and SQL expressions are used. Places come from the lengths of the stretches between
matches; running sums are taken over slices of ``SLICE`` matches, so that a text with very many
matches costs little more than its length. The model is a table over pairs of printable characters,
whose size is set by the alphabet.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlift.sources.tables import staged

#: Kinds in order of precedence, their patterns, the group that is the secret, and
#: the least length of it.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # runs are maximal, so shorter ones can be left out at once
]
TOKEN = r"[A-Za-z0-9+/_=-]{12,}"
LEAST_TOKEN = 20  # characters of a token that the models may report
LEAST_RATIO = 0.25  # nats per character below which nothing is reported
TAIL = 0.01  # share of either sample that is left out when the threshold is set between them
FIRST, SYMBOLS = 32, 95  # printable ASCII
SMOOTHING = 0.5
BACKOFF = 200.0  # pairs that the mere frequency of the second character stands for
SLICE = 256
_SPANS = "array<struct<start:bigint,stop:bigint,value:string>>"


def with_spans(df: DataFrame, name: str, pattern: str, group: int, least: int, text: str = "text") -> DataFrame:
    """Add column ``name``: (start, stop, value) of each match whose group has ``least`` characters.

    Matches are leftmost and do not overlap; places are code points, stop exclusive.
    """
    quoted = F.lit(pattern)
    df = df.withColumn("_m", F.regexp_extract_all(text, quoted, F.lit(0)))
    df = df.withColumn("_v", F.regexp_extract_all(text, quoted, F.lit(group)) if group else F.col("_m"))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split(text, pattern, -1)))
    sizes = (  # zipped, so that no array is computed again for each of its elements
        "slice(zip_with(_p, zip_with(_m, _v, (x, v) -> named_struct('l', cast(length(x) as bigint), 'v', v)), "
        "(p, y) -> named_struct('g', cast(length(p) as bigint), 'l', y.l, 'v', y.v)), 1, size(_m))"
    )
    df = df.withColumn("_l", F.when(F.size("_m") > 0, F.expr(sizes)))
    sums = (
        f"transform(sequence(0, (size(_l) - 1) div {SLICE}), "
        f"s -> aggregate(slice(_l, s * {SLICE} + 1, {SLICE}), 0L, (a, x) -> a + x.g + x.l))"
    )
    df = df.withColumn("_s", F.when(F.size("_m") > 0, F.expr(sums)))
    found = (
        f"flatten(transform(_s, (t, s) -> aggregate(slice(_l, s * {SLICE} + 1, {SLICE}), "
        f"named_struct('at', aggregate(slice(_s, 1, cast(s as int)), 0L, (a, x) -> a + x), 'out', cast(array() as {_SPANS})), "
        "(a, x) -> named_struct('at', a.at + x.g + x.l, 'out', "
        f"if(length(x.v) >= {least}, concat(a.out, array(named_struct('start', a.at + x.g, 'stop', a.at + x.g + x.l, 'value', x.v))), a.out)), "
        "a -> a.out)))"
    )
    df = df.withColumn(name, F.coalesce(F.when(F.size("_m") > 0, F.expr(found)), F.expr(f"cast(array() as {_SPANS})")))
    return df.drop("_m", "_v", "_p", "_l", "_s")


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, assign, access, hex, tokens) of each document: base spans, and long tokens apart from them."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for kind, pattern, group, least in KINDS:
        df = with_spans(df, kind, pattern, group, least)
    df = with_spans(df, "_t", TOKEN, 0, 12)
    apart = "filter(_t, t -> not exists(concat(assign, access, hex), b -> b.start < t.stop and t.start < b.stop))"
    return df.select("id", *[k for k, *_ in KINDS], F.expr(apart).alias("tokens"))


def pair_counts(values: DataFrame) -> dict[tuple[int, int], int]:
    """How often each pair of neighbouring printable characters stands in the values (at most
    ``SYMBOLS`` squared rows, however many values there are)."""
    pairs = values.where("length(value) > 1").select(
        F.explode(F.expr("transform(sequence(1, length(value) - 1), i -> substring(value, i, 2))")).alias("pair")
    )
    rows = pairs.groupBy("pair").agg(F.count("*").alias("n")).collect()
    return {(ord(r.pair[0]) - FIRST, ord(r.pair[1]) - FIRST): r.n for r in rows}


def log_ratios(random: dict, ordinary: dict) -> list[float]:
    """log p(second | first) as a random string less as an identifier, by place of the pair."""

    def model(counts: dict) -> list[float]:
        before, after = [0.0] * SYMBOLS, [SMOOTHING] * SYMBOLS
        for (a, b), n in counts.items():
            before[a] += n
            after[b] += n
        total = sum(after)
        return [
            math.log((counts.get((a, b), 0) + BACKOFF * after[b] / total) / (before[a] + BACKOFF))
            for a in range(SYMBOLS)
            for b in range(SYMBOLS)
        ]

    return [round(x - y, 6) for x, y in zip(model(random), model(ordinary))]


def ratio(value: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio per pair of neighbouring characters."""
    ratios = F.from_json(F.lit(json.dumps(table)), "array<double>")  # folded to a constant
    code = lambda i: F.ascii(F.substr(value, i, F.lit(1))) - FIRST
    places = F.sequence(F.lit(1), F.length(value) - 1)
    total = F.aggregate(places, F.lit(0.0), lambda s, i: s + ratios[code(i) * SYMBOLS + code(i + 1)])
    return total / (F.length(value) - 1)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found array<struct<start, stop, kind, value, ratio>>), by start, then kind.

    Null and empty texts have no findings. Without base findings or without ordinary tokens in the
    corpus there are no models and only base findings. Repeated rows each give a row; further
    columns are ignored whatever their names.
    """
    rows = staged(scanned(docs, id_col, text_col), "secret-scan")
    random = rows.select(F.explode(F.concat(*[k for k, *_ in KINDS])).alias("x")).select("x.value")
    ordinary = rows.select(F.explode("tokens").alias("x")).select("x.value")
    known, common = pair_counts(random), pair_counts(ordinary)
    kinds = [
        F.expr(
            f"transform({kind}, x -> named_struct('start', x.start, 'k', {i}, 'stop', x.stop, 'kind', '{kind}', "
            "'value', x.value, 'ratio', cast(null as double)))"
        )
        for i, (kind, *_) in enumerate(KINDS)
    ]
    if known and common:
        table = log_ratios(known, common)
        edge = lambda values, share: (
            values.where("length(value) > 1")
            .agg(F.percentile_approx(ratio(F.col("value"), table), share, 10_000))
            .first()[0]
        )
        # half-way between where ordinary tokens end and where secrets begin
        least = max(LEAST_RATIO, (edge(ordinary, 1 - TAIL) + edge(random, TAIL)) / 2)
        long = rows.withColumn("long", F.expr(f"filter(tokens, x -> length(x.value) >= {LEAST_TOKEN})"))
        parts = lambda x: F.struct(
            x.start.alias("start"), x.stop.alias("stop"), x.value.alias("value"), ratio(x.value, table).alias("ratio")
        )
        scored = long.withColumn("scored", F.transform("long", parts))
        rows = scored.withColumn("model", F.filter("scored", lambda x: x.ratio > least))
        kinds.append(
            F.expr(
                f"transform(model, x -> named_struct('start', x.start, 'k', {len(KINDS)}, 'stop', x.stop, 'kind', 'model', "
                "'value', x.value, 'ratio', x.ratio))"
            )
        )
    return rows.select(F.col("id").alias(id_col), F.array_sort(F.concat(*kinds)).alias("found"))


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of a table of findings."""
    joined = lambda array: (
        f"array_join(transform({array}, x -> concat_ws(':', x.kind, cast(x.start as string), cast(x.stop as string))), ',')"
    )
    base = f"filter(found, x -> x.k < {len(KINDS)})"
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k, *_ in KINDS]
    return found.select(
        id_col, *counts, F.sha2(F.expr(joined(base)), 256).alias("base_sha256"), F.expr(joined("found")).alias("spans")
    )
