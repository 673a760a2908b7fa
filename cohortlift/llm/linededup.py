"""Removal of repeated passages by content-defined chunks of lines (operator 9).

A text is cut into lines: at line breaks, and inside a long paragraph at the stops of its
sentences and clauses, so that a passage is found wherever it was pasted. A rolling hash runs over
the hashes of the lines, and a line whose rolling hash is the smallest of some window of lines ends a
chunk, as does the end of a long line and of the line before one. The ends depend on nearby lines only, so a passage gives the same chunks in every document
that holds it, however its surroundings are shifted.

1. Chunks are counted by hash over the whole corpus, folded on the map side.
2. Chunks that occur more than once are read again, at the ends of a run of them together with the
   chunks beside it; runs of under ``SEED_WORDS`` words, or that cannot come to ``min_words`` words, are passed over. Occurrences are
   dealt by hash and a salt and compared, byte by byte, with the first one (smallest id, then
   place); the first ones of all salts are then compared with each other. At the ends of runs an
   occurrence grows into the neighbouring chunks by whole words as far as the bytes agree. All that
   is cut thus stands in an earlier document, or earlier in the same one.
3. The spans found join to runs; runs of at least ``min_words`` words are cut out. The first
   occurrence stays.

Bit tables of fixed size spare the second reading most chunks that occur once, and the last join
most documents that nothing is cut from; what slips through is settled by the exact steps.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.scan import ALNUM, byte_class, flat, mix, slices, span_hashes
from cohortlift.sources.tables import staged

MIN_WORDS = 30
SEED_WORDS = 8  # words of a run of repeated chunks from which it is compared at all
WINDOW = 2  # of so many neighbouring lines at least one ends a chunk
LONG = 96  # bytes from which a line is a chunk by itself
BESIDE = 3  # chunks on either side that an occurrence may grow into
NEAR = 6  # chunks from either end of a run whose occurrences may grow
TABLE_BITS = 1 << 25
SALTS, HOT = 64, 5_000  # tasks that a chunk with more occurrences than HOT is dealt to
LINE_END = byte_class((0x0A, 0x0A))
STOP = byte_class((0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))
BLANK = byte_class((0x20, 0x20), (0x09, 0x09))


class Chunks:
    """Lines and chunks of a string column, as places in its bytes."""

    def __init__(self, column: pa.Array):
        raw, self.at = flat(column)
        self.raw = raw
        ends = LINE_END[raw]
        ends[1:] |= STOP[raw[:-1]] & BLANK[raw[1:]]  # a stop takes the blank after it along
        heads = self.at[1:]
        ends[heads[(heads > 0)] - 1] = True
        stops = np.flatnonzero(ends) + 1
        starts = np.concatenate([[0], stops[:-1]]).astype(np.int64) if len(stops) else stops
        self.starts, self.stops = starts, stops  # lines
        self.hashes = span_hashes(raw, starts, stops)
        self.first = np.searchsorted(starts, self.at)  # text i holds lines first[i]:first[i + 1]
        n = len(starts)
        text = np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))
        # the rolling hash of a line and the one before it in the same text
        before = np.zeros(n, np.uint64)
        before[1:] = self.hashes[:-1]
        head = np.ones(n, bool)
        head[1:] = text[1:] != text[:-1]
        before[head] = np.uint64(0)
        rolling = mix(self.hashes + before * np.uint64(0x9FB21C651E98DF25))
        smallest = np.zeros(n, bool)  # the smallest of some WINDOW neighbours of one text
        if n >= WINDOW:
            m = n - WINDOW + 1
            least = rolling[:m]
            for k in range(1, WINDOW):
                least = np.minimum(least, rolling[k : k + m])
            whole = text[:m] == text[WINDOW - 1 :]
            for k in range(WINDOW):
                smallest[k : k + m] |= whole & (rolling[k : k + m] == least)
        long = stops - starts >= LONG
        smallest |= long
        smallest[:-1] |= long[1:]
        tail = np.ones(n, bool)
        tail[:-1] = head[1:]
        last = np.flatnonzero(smallest | tail)  # last line of each chunk
        self.last = last
        self.begin = np.concatenate([[0], last[:-1] + 1]).astype(np.int64) if len(last) else last
        self.text = text[last]
        inside = ALNUM[raw]
        self.word_starts = inside.copy()
        self.word_starts[1:] &= ~inside[:-1]
        self.chunk_hash = span_hashes(raw, starts[self.begin], stops[last]) if n else np.zeros(0, np.uint64)

    def span(self, c: int) -> tuple[int, int]:
        return int(self.starts[self.begin[c]]), int(self.stops[self.last[c]])


def _chunk_rows(docs: DataFrame, kind: str) -> DataFrame:
    def run(batches):
        for batch in slices(batches, "text"):
            chunks = Chunks(batch.column("text"))
            if len(chunks.text):
                ids = batch.column("id").take(pa.array(chunks.text))
                hashes = pa.array(chunks.chunk_hash.view(np.int64))
                yield pa.RecordBatch.from_arrays([ids, hashes], names=["id", "hash"])

    return docs.mapInArrow(run, f"id {kind}, hash bigint")


def bit_table(rows: DataFrame, hashed: Column, bits: int = TABLE_BITS) -> np.ndarray:
    """``bits`` flags: set where a hash falls. The size does not grow with the data."""
    slot = F.pmod(hashed, F.lit(bits))
    words = rows.select(F.shiftright(slot, 6).alias("w"), F.pmod(hashed, F.lit(64)).cast("int").alias("i"))
    found = words.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, i))").alias("b")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    return out


def bits_of(hashes: np.ndarray, flags: np.ndarray) -> np.ndarray:
    slot = np.mod(hashes, np.int64(len(flags) * 64))
    return ((flags[slot >> 6] >> (slot & 63)) & 1).astype(bool)


def split_by_bit(rows: DataFrame, key: str, flags: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Rows whose key's bit is set, and the others, which need not be shuffled to be joined."""
    shared = rows.sparkSession.sparkContext.broadcast(flags)

    @F.pandas_udf("boolean")
    def bit(hashes: pd.Series) -> pd.Series:
        return pd.Series(bits_of(hashes.to_numpy(), shared.value))

    there = bit(F.xxhash64(key))  # only the hashes go to Python
    return rows.where(there), rows.where(~there)


def _read_again(docs: DataFrame, tables: list[np.ndarray], min_words: int, kind: str) -> DataFrame:
    """Chunks whose bit is set in the first table, with their bytes and, near the ends of a run of such chunks, the bytes
    of the chunks beside them. Runs that have too few words together with what is beside them are
    left out: nothing that they can grow to would be cut. Chunks in the second table get a salt."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    names = ["hash", "salt", "place", "size", "start", "body", "before", "after"]
    schema = f"id {kind}, hash bigint, salt int, place int, size bigint, start bigint, body binary, before binary, after binary"

    def run(batches):
        flags, hot = shared.value
        for batch in slices(batches, "text"):
            c = Chunks(batch.column("text"))
            if not len(c.text):
                continue
            signed = c.chunk_hash.view(np.int64)
            hit = bits_of(signed, flags)
            deal = np.where(bits_of(signed, hot), c.text % SALTS, -1)  # by row: copies part too
            head = np.searchsorted(c.text, np.arange(batch.num_rows + 1))
            opens, closes = hit.copy(), hit.copy()
            opens[1:] &= ~(hit[:-1] & (c.text[1:] == c.text[:-1]))
            closes[:-1] &= ~(hit[1:] & (c.text[1:] == c.text[:-1]))
            first, last = np.flatnonzero(opens), np.flatnonzero(closes)
            if not len(first):
                continue
            low = np.maximum(first - BESIDE, head[c.text[first]])
            high = np.minimum(last + BESIDE, head[c.text[last] + 1] - 1)
            words = np.concatenate([[0], np.cumsum(c.word_starts)])
            own_words = words[c.stops[c.last[last]]] - words[c.starts[c.begin[first]]]
            enough = words[c.stops[c.last[high]]] - words[c.starts[c.begin[low]]] >= min_words
            enough &= own_words >= SEED_WORDS
            raw = c.raw.tobytes()
            out: dict[str, list] = {k: [] for k in names}
            for i, j in zip(first[enough].tolist(), last[enough].tolist()):
                own = c.text[i]
                left, right = int(head[own]), int(head[own + 1]) - 1
                at, size = int(c.at[own]), int(c.at[own + 1] - c.at[own])
                for k in range(i, j + 1):
                    a, b = c.span(k)
                    out["hash"].append(int(signed[k]))
                    out["salt"].append(int(deal[k]))
                    out["place"].append(k - int(head[own]))
                    out["size"].append(size)
                    out["start"].append(a - at)
                    out["body"].append(raw[a:b])
                    out["before"].append(raw[c.span(max(left, k - BESIDE))[0] : a] if k - i < NEAR else b"")
                    out["after"].append(raw[b : c.span(min(right, k + BESIDE))[1]] if j - k < NEAR else b"")
            rows = np.repeat(c.text[first[enough]], (last - first + 1)[enough])
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            columns = [pa.array(out[k], t) for k, t in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), *columns], names=["id", *names])

    return docs.mapInArrow(run, schema)


def grow_on(ours: bytes, theirs: bytes) -> int:
    """Bytes at the start of ``ours`` that ``theirs`` starts with too, in whole words."""
    same = os.path.commonprefix([ours, theirs])
    if len(same) == len(ours):
        return len(ours)
    return max(same.rfind(b" "), same.rfind(b"\n")) + 1


def grow_back(ours: bytes, theirs: bytes) -> int:
    """The same for the ends."""
    return grow_on(ours[::-1], theirs[::-1])


def _against_first(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Rows dealt by ``keys`` and sorted, each compared with the first of its group byte by byte.

    Gives the spans (id, size, start, stop) of those that agree, and the first row of each salted
    group with a null stop and its bytes. A task holds one first row at a time, however large a
    group is.
    """
    schema = (
        f"id {kind}, hash bigint, place int, size bigint, start bigint, stop bigint, "
        "body binary, before binary, after binary"
    )
    salted = "salt" in keys
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "id", "place")

    def run(batches):
        carried = None  # the first row of the group that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            extra = carried is not None
            if extra:
                batch = pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
            col = {k: batch.column(k) for k in batch.schema.names}
            new = np.ones(batch.num_rows, bool)
            new[1:] = False
            for k in keys:
                values = col[k].to_numpy()
                new[1:] |= values[1:] != values[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(batch.num_rows), 0))
            of_first = {k: col[k].take(pa.array(first)) for k in ("id", "place", "body")}
            same = pc.equal(col["body"], of_first["body"]).to_numpy(zero_copy_only=False)
            # a repeated row is no copy
            other = pc.or_(pc.not_equal(col["id"], of_first["id"]), pc.not_equal(col["place"], of_first["place"]))
            found = np.flatnonzero(same & other.to_numpy(zero_copy_only=False))
            start = col["start"].to_numpy()[found].copy()
            stop = start + pc.binary_length(col["body"]).to_numpy()[found]
            for side in ("before", "after"):
                size = pc.binary_length(col[side]).to_numpy()
                for i in np.flatnonzero((size[found] > 0) & (size[first[found]] > 0)):
                    ours, theirs = col[side][found[i]].as_py(), col[side][first[found[i]]].as_py()
                    if side == "before":
                        start[i] -= grow_back(ours, theirs)
                    else:
                        stop[i] += grow_on(ours, theirs)
            heads = np.zeros(0, np.int64)
            if salted:
                heads = np.flatnonzero(new & (col["salt"].to_numpy() >= 0))
                heads = heads[heads > 0] if extra else heads
            took = batch.take(pa.array(np.concatenate([found, heads])))
            is_head = np.arange(took.num_rows) >= len(found)
            none = pa.nulls(took.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    *[took.column(k) for k in ("id", "hash", "place", "size")],
                    pa.array(np.concatenate([start, col["start"].to_numpy()[heads]])),
                    pa.array(np.concatenate([stop, np.zeros(len(heads), np.int64)]), mask=is_head),
                    *[pc.if_else(pa.array(is_head), took.column(k), none) for k in ("body", "before", "after")],
                ],
                names=["id", "hash", "place", "size", "start", "stop", "body", "before", "after"],
            )
            carried = batch.slice(int(first[-1]), 1)

    return ordered.mapInArrow(run, schema)


def runs(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Spans made for a text of this size, joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans if s["size"] == size):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def count_words(data: bytes) -> int:
    inside = ALNUM[np.frombuffer(data, np.uint8)]
    return int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum())


def has_words(name: str):
    """Whether a text has a word at all, as a column."""
    return F.coalesce(F.col(name).rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]"), F.lit(False))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from the text, and ``removed_words`` and ``removed_spans``.

    The occurrence in the row with the smallest id, first place, stays. Spans are byte offsets in
    the UTF-8 text as it was. Null texts stay null, empty ones empty. Rows that share an id are
    taken to be one document: what is cut is cut from each of them of the same length, and a text
    repeated only under one id is not cut. Rows with a null id are left as they are. All other
    columns are kept; ones called removed_words or removed_spans are replaced.
    """
    columns = [c for c in docs.columns if c not in ("removed_words", "removed_spans")]
    inner = {c: f"c{i}" for i, c in enumerate(columns)}
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    )
    repeated = staged(
        _chunk_rows(texts, kind).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"),
        "repeated-chunks",
    )
    # a chunk that is everywhere is dealt to SALTS tasks; their first rows then meet each other
    tables = [bit_table(repeated.where(f"n > {least}"), F.col("hash")) for least in (1, HOT)]
    salted = _read_again(texts, tables, min_words, kind)
    near = staged(_against_first(salted, ["hash", "salt"], kind), "salted-chunks")
    far = _against_first(near.where("stop is null"), ["hash"], kind)
    spans = near.where("stop is not null").unionByName(far.where("stop is not null"))
    per_text = spans.groupBy("id").agg(F.collect_set(F.struct("size", "start", "stop")).alias("spans"))
    per_text = staged(per_text, "chunk-spans")
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in inner.items()])
    touched, untouched = split_by_bit(rows, inner[id_col], bit_table(per_text, F.xxhash64("id")))
    joined = touched.join(per_text.withColumnRenamed("id", "span_id"), F.col(inner[id_col]) == F.col("span_id"), "left")
    joined = joined.drop("span_id")
    text_key = inner[text_col]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    found = "array<struct<start:bigint,stop:bigint>>"

    def run(batches):
        for batch in batches:
            texts_, spans_ = batch.column(text_key), batch.column("spans")
            new, words, cut = None, [0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            for i in np.flatnonzero(np.asarray(spans_.is_valid())):
                text = texts_[i].as_py()
                data = (text or "").encode("utf-8")
                out, last = [], 0
                for a, b in runs(spans_[i].as_py(), len(data)):
                    n = count_words(data[a:b])
                    if n < min_words:
                        continue
                    out.append(data[last:a])
                    last = b
                    words[i] += n
                    cut[i].append({"start": a, "stop": b})
                if words[i]:
                    new = new or texts_.to_pylist()
                    new[i] = b"".join([*out, data[last:]]).decode("utf-8")
            columns_ = [pa.array(new, texts_.type) if n == text_key and new else batch.column(n) for n in inner.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns_,
                    pa.array(words, pa.int64()),
                    pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                ],
                names=[*inner.values(), "removed_words", "removed_spans"],
            )

    result = joined.mapInArrow(run, f"{schema}, removed_words bigint, removed_spans {found}").unionByName(
        untouched.withColumns({"removed_words": F.lit(0).cast("bigint"), "removed_spans": F.array().cast(found)})
    )
    return result.select(*[F.col(k).alias(c) for c, k in inner.items()], "removed_words", "removed_spans")
