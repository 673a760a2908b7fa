"""Names, identities and labels taken out of text, all with built-in regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identity and label formats of the sensor archives.
STANDARD_ID = r"(?i)(P\d{3})([CZ])(\d{3})S(\d{3})"
LOOSE_ID = r"(?i)(P[A-Z0-9]{3})([CZ])(\d{3})S(\d{3})"
SHORT_PID = r"(?i)\bP0*(\d{1,3})\b"
WORDED_PID = r"(?i)(?:participant|subject|user)[_\-\s]*0*(\d{1,3})"
REPETITION = r"(?i)^Rep(\d+)_"
PATH_TASKS = {"composite": "Composite", "ziptie": "WireHarness"}
TASK_CODES = {"Composite": "C", "WireHarness": "Z"}
REST_SEGMENTS = ["Initial_Rest", "Final_Rest"]


def _group(c: Column, pattern: str, idx: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, idx), F.lit(""))


def normalise_text(c: Column) -> Column:
    """Lower case, every run of other characters to one underscore, none at the ends."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", ""
    )


def normalise_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def squeeze_name(name: str) -> str:
    """Lower case without any whitespace (rating-grid headers)."""
    return re.sub(r"\s+", "", name.lower())


def identity(c: Column) -> Column:
    """struct(participant, code, task_no, session, standard) out of a file or folder name."""
    def field(i: int) -> Column:
        return F.upper(F.coalesce(_group(c, STANDARD_ID, i), _group(c, LOOSE_ID, i)))

    return F.struct(
        field(1).alias("participant"),
        field(2).alias("code"),
        field(3).alias("task_no"),
        field(4).alias("session"),
        c.rlike(STANDARD_ID).alias("standard"),
    )


def padded_pid(c: Column) -> Column:
    digits = F.coalesce(_group(c, SHORT_PID, 1), _group(c, WORDED_PID, 1))
    number = digits.cast("int").cast("string")
    return F.when(digits.isNotNull(), F.concat(F.lit("P"), F.lpad(number, 3, "0")))


def task_from_path(path: Column) -> Column:
    """Task named by a directory of the path, with either path separator."""
    parts = F.split(F.lower(path), r"[/\\]")
    out = F.lit(None).cast("string")
    for token, task in PATH_TASKS.items():
        out = F.coalesce(out, F.when(F.array_contains(parts, token), F.lit(task)))
    return out


def expected_code(task: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, code in TASK_CODES.items():
        out = F.when(task == name, F.lit(code)).otherwise(out)
    return out


def segment(name: Column) -> Column:
    """struct(segment, rep): a rest segment, a numbered repetition, or the bare stem."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    rep = _group(stem, REPETITION, 1).cast("int")
    label = F.when(rep.isNotNull(), F.concat(F.lit("Rep"), rep.cast("string")))
    for rest in REST_SEGMENTS:
        label = F.when(stem.startswith(rest + "_"), F.lit(rest)).otherwise(label)
    return F.struct(F.coalesce(label, stem).alias("segment"), rep.alias("rep"))


def first_integer(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def natural_key(c: Column) -> Column:
    """Sort key in which digit runs of any length compare as numbers.

    A run stands behind its own length, so the longer of two numbers without leading zeros is the
    larger one and equal lengths compare digit by digit.
    """

    def number(p: Column) -> Column:
        digits = F.ltrim(p, F.lit("0"))
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    pieces = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(p.rlike(r"^\d+$"), number(p)).otherwise(p),
        ),
        "",
    )


def keyword_count(text: Column, keyword: str) -> Column:
    """Case-insensitive occurrences of a literal keyword over the whole text."""
    return F.regexp_count(F.lower(text), F.lit(re.escape(keyword.lower()))).cast("bigint")


def keyword_snippets(
    text: Column, keyword: str, before: int, after: int, keep: int = 4
) -> Column:
    """Context of the first ``keep`` hits, case-insensitive, whitespace squeezed.

    Hits do not overlap; their contexts may. Characters are counted in the text as stored.
    """
    word = F.lit(keyword.lower())
    size = len(keyword)
    low = F.lower(text)
    hits, start = [], F.lit(1)
    for _ in range(keep):
        at = F.nullif(F.call_function("locate", word, low, start), F.lit(0))
        lo = F.greatest(at - before, F.lit(1))
        piece = F.substring(text, lo, at + size + after - lo)
        hits.append(F.when(at.isNotNull(), F.regexp_replace(piece, r"\s+", " ")))
        start = at + size
    return F.array_compact(F.array(*hits))
