"""Fill-in-middle: a text is cut in two places and its middle moved to the end.

Each run of texts is one sequence of UTF-8 bytes, every byte in one of eight classes, held as a
wavelet matrix of three bit vectors with counted words. The rank of a class says how often it
occurs before a byte, so the ranks of the classes that open a unit add up to the number of units
begun there; a bisection on that count finds the byte of a cut. No text is decoded, and a text of
any length takes as many steps as its length has bits.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.scan import NONBLANK, flat, slices

MARKS = ("<P>", "<S>", "<M>")
# byte classes; all but INNER open a code point, HEAD opens a word
INNER, BREAK, BLANK, HEAD, ASCII, TWO, THREE, FOUR = range(8)
UNITS = {"char": (BREAK, BLANK, HEAD, ASCII, TWO, THREE, FOUR), "word": (HEAD,)}
BITS = 3
_LEADS = np.full(256, ASCII, np.uint8)
_LEADS[0x80:0xC0] = INNER
_LEADS[0xC0:0xE0] = TWO
_LEADS[0xE0:0xF0] = THREE
_LEADS[0xF0:] = FOUR
_LEADS[~NONBLANK] = BLANK
_LEADS[0x0A] = BREAK


def byte_classes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Class of every byte; ``at`` holds where the texts begin, so no word runs across two texts."""
    classes = _LEADS[raw]
    filled = NONBLANK[raw]
    opens = filled.copy()
    opens[1:] &= ~filled[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    opens[heads] = filled[heads]
    classes[opens & (classes != INNER)] = HEAD
    return classes


class WaveletMatrix:
    """Rank queries over a sequence of small symbols, for many places at once."""

    def __init__(self, symbols: np.ndarray, bits: int = BITS):
        self.size = len(symbols)
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = ((symbols >> shift) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros((self.size >> 6) + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.levels.append((shift, words, before, self.size - int(before[-1])))
            if shift:
                symbols = np.concatenate([symbols[~bit], symbols[bit]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & below)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before each place."""
        low, high = np.zeros(1, np.int64), at
        for shift, words, before, zeros in self.levels:
            low_ones, high_ones = self._ones(words, before, low), self._ones(words, before, high)
            if symbol >> shift & 1:
                low, high = zeros + low_ones, zeros + high_ones
            else:
                low, high = low - low_ones, high - high_ones
        return high - low

    def count(self, symbols: Sequence[int], at: np.ndarray) -> np.ndarray:
        """How many of these symbols occur before each place; the shorter of set and rest is asked."""
        rest = [c for c in range(1 << len(self.levels)) if c not in symbols]
        if len(rest) < len(symbols):
            return at - sum(self.rank(c, at) for c in rest)
        return sum(self.rank(c, at) for c in symbols)


def cut_places(tree: WaveletMatrix, opening: Sequence[int], low: np.ndarray, high: np.ndarray, units: np.ndarray):
    """Byte behind the first ``units`` units of each range: the last one up to which no more than
    that many units have begun. Zero units end at the start of the range."""
    base, start = tree.count(opening, low), low
    wanted = base + units
    while (low < high).any():
        middle = (low + high + 1) >> 1
        fits = tree.count(opening, middle) <= wanted
        low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
    return np.where(units > 0, low, start)


def draws(key: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of sha256("seed:key") as unsigned integers; a missing key is
    drawn as the empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    marks: tuple[str, str, str] = MARKS,
    unit: str = "char",
    percent: int = 90,
    spm_percent: int = 20,
    seed: int = 1,
    batch_bytes: int = 4_000_000,
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for each row of ``docs``.

    ``n`` counts units (code points, or words with the blanks behind them); both cuts fall behind
    a number of units drawn from 0 to n by the id's hash. ``form`` is plain (100 - ``percent`` of
    a hundred ids, empty texts, and texts that hold a mark), psm (prefix, suffix, middle) or spm
    (suffix, prefix, middle, ``spm_percent`` of a hundred of the rest).

    Null text is empty. Rows of one id are drawn alike, each gives a row; an empty table gives
    none; further columns are ignored whatever their names. The id keeps its type. Marks must
    differ, and none may begin inside another, or a piece could form one with its neighbour.
    """
    for one in marks:
        others = [x for x in marks if x != one]
        if len(others) < 2 or any(x in one for x in others) or any(x.startswith(one[i:]) for x in marks for i in range(1, len(one))):
            raise ValueError(f"{one!r} holds another mark, or its end begins one")
    opening = UNITS[unit]
    p, s, m = (x.encode() for x in marks)

    def run(batches):
        for batch in slices(batches, "text", batch_bytes):
            raw, at = flat(batch.column("text"))
            tree = WaveletMatrix(byte_classes(raw, at))
            low, high = at[:-1], at[1:]
            n = tree.count(opening, high) - tree.count(opening, low)
            h = [batch.column(f"h{i}").to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4)]
            one, two = h[0] % (n + 1), h[1] % (n + 1)
            first = cut_places(tree, opening, low, high, np.minimum(one, two))
            second = cut_places(tree, opening, low, high, np.maximum(one, two))
            chars = [tree.count(UNITS["char"], x) for x in (low, first, second)]
            marked = batch.column("marked").to_numpy(zero_copy_only=False)
            plain = marked | (high == low) | (h[2] % 100 >= percent)
            spm = h[3] % 100 < spm_percent
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            data, output = raw.tobytes(), []
            for kind, a, b, c, d in zip(form, low.tolist(), first.tolist(), second.tolist(), high.tolist()):
                if kind == "plain":
                    output.append(data[a:d])
                elif kind == "psm":
                    output.append(b"".join((p, data[a:b], s, data[c:d], m, data[b:c])))
                else:
                    output.append(b"".join((s, data[c:d], p, data[a:b], m, data[b:c])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(n, pa.int64()),
                    pa.array(form.tolist(), pa.string()),
                    pa.array(chars[1] - chars[0], pa.int64(), mask=plain),
                    pa.array(chars[2] - chars[1], pa.int64(), mask=plain),
                    pa.array(output, pa.binary()).cast(pa.string(), safe=False),
                ],
                names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.lit(False)
    for mark in marks:
        marked = marked | text.contains(mark)
    rows = docs.select(
        F.col(id_col).alias("id"),
        text.alias("text"),
        marked.alias("marked"),
        *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col(id_col), seed), 1)],
    )
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )


def restored(output: Column | str, form: Column | str, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that gave ``output``: a cut text holds each mark once, so the marks part its pieces."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    piece = F.split(output, "|".join(re.escape(x) for x in marks), -1)
    return (
        F.when(form == "psm", F.concat(piece[1], piece[3], piece[2]))
        .when(form == "spm", F.concat(piece[2], piece[3], piece[1]))
        .otherwise(output)
    )


def middle_digest(docs: DataFrame, **options) -> DataFrame:
    """``fill_in_middle`` with the sha256 of its output and of the text rebuilt from it."""
    return fill_in_middle(docs, **options).withColumns({
        "output_sha256": F.sha2("output", 256),
        "restored_sha256": F.sha2(restored("output", "form"), 256),
    }).drop("output")
