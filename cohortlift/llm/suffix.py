"""Benchmark decontamination with training suffix arrays (operator 3).

The documents that one task holds are worked off in shards of bounded size. Each shard becomes a
suffix array over its words: suffixes that begin with no word group of the benchmark are left out,
since no match can start there, and the rest are sorted to the depth of a window. Every suffix of
every benchmark item is then binary-searched in it; the range it falls into gives the locations of
its window, and windows that go on along a diagonal join to the longest verbatim matches.

The benchmark comes to the shards in blocks of bounded size, one pass over the documents for each,
so nothing that is broadcast grows with either side. Words are compared as 64-bit hashes, and the
bytes of every matched word are compared before a match counts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.scan import ALNUM, Words, slices
from cohortlift.sources.tables import staged

WINDOW = 10
BLOCK_BYTES = 4_000_000  # of benchmark text, for each pass over the documents
SHARD_BYTES = 4_000_000  # of document text, for each suffix array; a longer text stands alone
PASSES_A_STAGE = 4


@dataclass
class Probe:
    """A block of the benchmark: its words, and every suffix cut to a window."""

    vocabulary: np.ndarray  # sorted hashes; word ids are places in it plus 1
    spelled: list[bytes]
    pairs: np.ndarray  # sorted keys of adjacent word ids
    quads: np.ndarray | None  # sorted keys of pair ranks two apart, if no window is shorter
    singles: np.ndarray  # word ids that are a window by themselves
    keys: np.ndarray  # (window, ceil(WINDOW / 2)) word ids packed by twos
    masks: np.ndarray
    lengths: np.ndarray
    items: list[list[tuple[str, int]]]  # of each window: item and offset of the suffix in it


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """1 + the place of each value in a sorted table, 0 where it is not there."""
    if not len(table):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at + 1, 0)


def pack(ids: np.ndarray) -> np.ndarray:
    """Rows of word ids with two ids to a number, an odd last one by itself."""
    if ids.shape[1] % 2:
        ids = np.concatenate([ids, np.zeros((len(ids), 1), ids.dtype)], axis=1)
    return (ids[:, 0::2].astype(np.int64) << 32) | ids[:, 1::2]


def build_probe(items: list[tuple[str, str | None]], window: int = WINDOW) -> Probe | None:
    """A probe of (item id, text) rows; None if no item has a word."""
    words = Words(pa.array([t for _, t in items], pa.large_string()), ALNUM)
    if not len(words.starts):
        return None
    vocabulary, first = np.unique(words.hashes, return_index=True)
    ids = np.searchsorted(vocabulary, words.hashes) + 1
    rows, lengths, owner = [], [], []
    for i in range(len(items)):
        own = ids[words.first[i] : words.first[i + 1]]
        if not len(own):
            continue
        size = min(window, len(own))
        for p in range(len(own) - size + 1):
            row = np.zeros(window, np.int64)
            row[:size] = own[p : p + size]
            rows.append(row)
            lengths.append(size)
            owner.append((items[i][0], p))
    matrix = np.array(rows)
    packed = pack(matrix)
    # equal windows are searched once; a zero ends a short one, so rows tell the length too
    _, keep, group = np.unique(packed, axis=0, return_index=True, return_inverse=True)
    named: list[list[tuple[str, int]]] = [[] for _ in keep]
    for g, who in zip(group.ravel().tolist(), owner):
        named[g].append(who)
    length = np.array(lengths)[keep]
    matrix = matrix[keep]
    width = len(vocabulary) + 1
    two = length >= 2
    left, right = matrix[:, :-1], matrix[:, 1:]
    pair_keys = np.unique((left * width + right)[right > 0])
    quads = None
    if length.min() >= 4:
        ranks = in_sorted(left * width + right, pair_keys)  # (window, window - 1)
        inner = (ranks[:, :-2] > 0) & (ranks[:, 2:] > 0)
        quads = np.unique((ranks[:, :-2] * (len(pair_keys) + 1) + ranks[:, 2:])[inner])
    return Probe(
        vocabulary=vocabulary,
        spelled=[words.word(i) for i in first],
        pairs=pair_keys,
        quads=quads,
        singles=np.unique(matrix[~two, 0]),
        keys=packed[keep],
        masks=pack(np.where(np.arange(window)[None, :] < length[:, None], 0xFFFFFFFF, 0)) & np.int64(2**63 - 1),
        lengths=length,
        items=named,
    )


def suffix_array(sequence: np.ndarray, probe: Probe, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start places of the suffixes that may match, in word order, and their packed words."""
    n = len(sequence)
    padded = np.concatenate([sequence, np.zeros(window + 4, sequence.dtype)])
    pairs = np.zeros(n + 2, np.int64)
    both = np.flatnonzero((padded[:n] > 0) & (padded[1 : n + 1] > 0))
    width = len(probe.vocabulary) + 1
    pairs[both] = in_sorted(padded[both] * width + padded[both + 1], probe.pairs)
    if probe.quads is not None:
        starts = np.flatnonzero((pairs[:n] > 0) & (pairs[2 : n + 2] > 0))
        keys = pairs[starts] * (len(probe.pairs) + 1) + pairs[starts + 2]
        starts = starts[in_sorted(keys, probe.quads) > 0]
    else:
        starts = np.flatnonzero((pairs[:n] > 0) | np.isin(sequence, probe.singles))
    rows = pack(padded[starts[:, None] + np.arange(window)[None, :]])
    order = np.lexsort(rows.T[::-1])
    return starts[order], rows[order]


def search(rows: np.ndarray, probe: Probe) -> tuple[np.ndarray, np.ndarray]:
    """For every window the range of suffixes that begin with it, by two binary searches."""
    total = len(probe.keys)
    bounds = []
    for upper in (False, True):
        low, high = np.zeros(total, np.int64), np.full(total, len(rows), np.int64)
        for _ in range(int(len(rows)).bit_length() + 1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            mid = (low[live] + high[live]) // 2
            right = np.zeros(len(live), bool)  # the bound lies to the right of mid
            open_ = np.arange(len(live))
            for k in range(rows.shape[1]):
                a = rows[mid[open_], k] & probe.masks[live[open_], k]
                b = probe.keys[live[open_], k]
                right[open_[a < b]] = True
                open_ = open_[a == b]
                if not len(open_):
                    break
            if upper:
                right[open_] = True
            low[live[right]] = mid[right] + 1
            high[live[~right]] = mid[~right]
        bounds.append(low)
    return bounds[0], bounds[1]


def shard_matches(words: Words, probe: Probe, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of every occurrence in a shard. Places count words, plus one a text."""
    texts = len(words.at) - 1
    text_of = np.repeat(np.arange(texts), np.diff(words.first))
    places = np.arange(len(words.starts)) + text_of  # a zero stands between texts
    sequence = np.zeros(len(places) + texts, np.int64)
    sequence[places] = in_sorted(words.hashes, probe.vocabulary)
    while True:
        starts, rows = suffix_array(sequence, probe, window)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = search(rows, probe)
        size = high - low
        found = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(found)) - np.repeat(np.cumsum(size) - size, size)
        at = starts[low[found] + inside]
        # compare bytes: a word that only shares a hash is taken out, and the search repeated
        spans = np.unique(np.concatenate([at + k for k in range(window)])) if len(at) else at
        spans = spans[spans < len(sequence)]
        spans = spans[sequence[spans] > 0]
        word_at = np.searchsorted(places, spans)
        wrong = [
            p for p, w, i in zip(spans, word_at, sequence[spans] - 1) if words.word(w) != probe.spelled[i]
        ]
        if not wrong:
            return at, found
        sequence[wrong] = 0


def _pass(docs: DataFrame, probe: Probe, window: int, keep_text: bool) -> DataFrame:
    """Add the matches of one block: every row gathers spans."""
    shared = docs.sparkSession.sparkContext.broadcast(probe)
    names = [c for c in docs.columns if keep_text or c != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in names)

    def run(batches):
        known = shared.value
        for batch in slices(batches, "text", SHARD_BYTES):
            words = Words(batch.column("text"), ALNUM)
            at, found = shard_matches(words, known, window)
            texts = len(words.at) - 1
            base = words.first[:-1] + np.arange(texts)
            spans = batch.column("spans").to_pylist() if len(at) else None
            if spans is not None:
                owner = np.searchsorted(base, at, "right") - 1
                for text, place, w in zip(owner.tolist(), (at - base[owner]).tolist(), found.tolist()):
                    size = int(known.lengths[w])
                    spans[text] = spans[text] or []
                    spans[text] += [
                        {"item_id": item, "item_start": p, "doc_start": place, "length": size}
                        for item, p in known.items[w]
                    ]
                kind = batch.schema.field("spans").type
                column = pa.array([diagonals(s) if s else s for s in spans], kind)
            else:
                column = batch.column("spans")
            columns = {n: batch.column(n) for n in names} | {"spans": column, "n_words": pa.array(np.diff(words.first))}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(run, schema)


def diagonals(spans: list[dict]) -> list[dict]:
    """Join windows that continue one another in item and document to longest matches."""
    out: list[dict] = []
    last: dict[tuple, dict] = {}
    for s in sorted(spans, key=lambda s: (s["doc_start"], s["item_id"], s["item_start"])):
        key = (s["item_id"], s["doc_start"] - s["item_start"])
        held = last.get(key)
        if held and s["doc_start"] <= held["doc_start"] + held["length"]:
            held["length"] = max(held["length"], s["doc_start"] + s["length"] - held["doc_start"])
        else:
            last[key] = dict(s)
            out.append(last[key])
    return out


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    keep_text: bool = True,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``n_words`` and ``spans``: the longest verbatim matches of at least a window.

    A span gives item_id, the word offset in the item, the word offset in the document and the
    length in words. All columns of ``docs`` are kept; ones named n_words or spans are replaced.
    Null texts and texts without words have no spans, items without words match nothing, repeated
    rows are each matched, and an empty benchmark matches nothing. Null item ids read "null".
    """
    kind = "array<struct<item_id:string,item_start:int,doc_start:int,length:int>>"
    columns = [c for c in docs.columns if c not in ("n_words", "spans", "text", text_col)]
    inner = [f"c{i}" for i in range(len(columns))]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(columns, inner)],
        F.col(text_col).cast("string").alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.lit(None).cast(kind).alias("spans"),
    )
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item_id"),
        F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"),
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        block = dealt.where(F.col("block") == b).select("item_id", "text").collect()
        probe = build_probe([(r.item_id, r.text) for r in block], window)
        if probe is None:  # still count the words
            probe = build_probe([("", "\u0001 a")], window)
            probe.items = [[] for _ in probe.items]
        rows = _pass(rows, probe, window, keep_text or b + 1 < blocks)
        if b % PASSES_A_STAGE == PASSES_A_STAGE - 1 and b + 1 < blocks:
            rows = staged(rows, "benchmark-matches")
    return rows.select(
        *[F.col(k).alias(c) for c, k in zip(columns, inner)],
        *([F.col("text").alias(text_col)] if keep_text else []),
        "n_words",
        F.coalesce("spans", F.array().cast(kind)).alias("spans"),
    )


def hit_summary(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of a table with spans."""

    def run(batches):
        for batch in batches:
            n_hit, n_items, digest = [], [], []
            for spans in batch.column("spans").to_pylist():
                covered, end = 0, 0
                for s in sorted(spans, key=lambda s: s["doc_start"]):
                    stop = s["doc_start"] + s["length"]
                    covered += max(0, stop - max(end, s["doc_start"]))
                    end = max(end, stop)
                items = sorted({s["item_id"] for s in spans})
                n_hit.append(covered)
                n_items.append(len(items))
                digest.append(hashlib.sha256(",".join(items).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("n_words"),
                    pa.array(n_hit, pa.int64()),
                    pa.array(n_items, pa.int64()),
                    pa.array(digest, pa.string()),
                    pa.array([n > 0 for n in n_hit], pa.bool_()),
                ],
                names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    rows = matches.select(F.col(id_col).alias("id"), "n_words", "spans")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"{id_col} {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window of a benchmark item; columns as they were."""
    clean = benchmark_matches(docs, benchmark, window).where(F.size("spans") == 0)
    return clean.select(*docs.columns)
