"""URL filter: host rules, and a ratio of character models for what no rule decides (operator 6).

URLs that a rule allows and URLs that one blocks train two variable-order Markov models over
characters: counts of every character after every context of up to ``ORDER`` characters, each
order smoothed with the next shorter one. A URL without a rule is judged by the mean difference of
the two log-likelihoods per character against a threshold that is calibrated on the URLs with one.

Counts, model and scores are tables; nothing that grows with the URLs is broadcast or collected.
Every distinct host and path is scored once. A character group that stands in every URL is one row
of the model that all URLs join: it is copied under ``SALTS`` keys, among which URLs are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlift.sources.tables import staged

ORDER = 4
SMOOTHING = 4.0  # characters that the next shorter context stands for
SYMBOLS = 256.0
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EDGE = "\u0001"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; empty where null or without ``://``."""
    rest = F.expr(f"if(instr({url}, '://') > 0, substring({url}, instr({url}, '://') + 3), '')")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. A rule is a verdict and host/path."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own_host, slash, own_path = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(text: str = "s") -> Column:
    """Every character of a text with the ORDER characters before it; the end counts as one."""
    return F.expr(
        f"transform(sequence(1, length({text}) + 1), i -> substring(concat(repeat('{EDGE}', {ORDER}), {text}, '{EDGE}'), i, {ORDER + 1}))"
    )


def model_table(training: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, llr) of every wanted gram: log p(last character | context) allowed less blocked.

    ``training`` has (s, verdict, n) rows, ``wanted`` distinct (gram) rows.
    """
    seen = training.select("verdict", "n", F.explode(grams()).alias("gram"))
    side = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0))
    counts = staged(seen.groupBy("gram").agg(side("allow").alias("a"), side("block").alias("b")), "url-grams")
    out = wanted.select("gram", F.lit(1 / SYMBOLS).alias("pa"), F.lit(1 / SYMBOLS).alias("pb"))
    for k in range(ORDER + 1):  # contexts of k characters
        ends = counts.select(F.expr(f"right(gram, {k + 1})").alias("part"), "a", "b")
        both = ends.groupBy("part").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        contexts = both.groupBy(F.expr(f"left(part, {k})").alias("context")).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
        out = (
            out.withColumn("part", F.expr(f"right(gram, {k + 1})"))
            .withColumn("context", F.expr(f"left(right(gram, {k + 1}), {k})"))
            .join(both, "part", "left")
            .join(contexts, "context", "left")
        )
        mixed = lambda n, total, p: (
            (F.coalesce(F.col(n), F.lit(0)) + SMOOTHING * F.col(p)) / (F.coalesce(F.col(total), F.lit(0)) + SMOOTHING)
        )
        out = out.select("gram", mixed("a", "na", "pa").alias("pa"), mixed("b", "nb", "pb").alias("pb"))
    return out.select("gram", (F.log("pa") - F.log("pb")).alias("llr"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of ``pages``.

    Null URLs and ones without ``://`` have an empty host and path, which no rule fits, and are
    judged by the models like any other. Without URLs on both sides of the rules the models say
    nothing and the verdict is allow. Repeated rows each give a row; further columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path("url")
    rows = rows.select("id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    rows = staged(rows.withColumn("s", F.concat("host", "path")), "urls")
    texts = staged(
        rows.groupBy("s", F.col("found.verdict").alias("verdict")).agg(F.count("*").alias("n")), "url-texts"
    )
    sides = {r.verdict for r in texts.select("verdict").distinct().collect()}
    if not {"allow", "block"} <= sides:
        scores = texts.select("s", F.lit(0.0).alias("score")).distinct()
        threshold = 0.0
    else:
        spread = texts.select("s", F.explode(grams()).alias("gram"))
        model = staged(
            model_table(texts.where("verdict is not null"), spread.select("gram").distinct()), "url-model"
        )
        salted = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        parts = spread.withColumn("salt", F.pmod(F.xxhash64("s"), F.lit(SALTS)).cast("int"))
        scores = staged(
            parts.join(salted, ["gram", "salt"]).groupBy("s").agg(F.avg("llr").alias("score")), "url-scores"
        )
        threshold = calibrated(texts.where("verdict is not null").join(scores, "s"))
    out = rows.join(scores, "s", "left")
    method = F.when(F.coalesce("score", F.lit(0.0)) >= threshold, "allow").otherwise("block")
    return out.select(
        F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", method).alias("verdict"), "score",
    )


def calibrated(scored: DataFrame) -> float:
    """The threshold with the least sum of the two error rates, over hundredths from -5 to 5."""
    place = F.greatest(F.lit(-500), F.least(F.lit(500), F.floor(F.col("score") * 100))).cast("int")
    counts = scored.groupBy(place.alias("bin"), "verdict").agg(F.sum("n").alias("n")).collect()
    total = {v: sum(r.n for r in counts if r.verdict == v) for v in ("allow", "block")}
    best, at = None, 0.0
    for cut in sorted({r.bin for r in counts} | {0}, key=lambda c: (abs(c), c)):
        lost = sum(r.n for r in counts if r.verdict == "allow" and r.bin < cut) / max(1, total["allow"])
        passed = sum(r.n for r in counts if r.verdict == "block" and r.bin >= cut) / max(1, total["block"])
        if best is None or lost + passed < best - 1e-12:
            best, at = lost + passed, cut / 100
    return at
