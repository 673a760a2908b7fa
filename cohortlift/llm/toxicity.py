"""Toxicity by nearest labelled examples (operator 2).

Terms are words and word beginnings; every document is the counts of all its terms, weighted by
TF-IDF with document frequencies over the whole corpus. The labelled examples form a block-max
inverted index over every term that occurs in one of them (``blockmax``); a term that no example
holds adds nothing to a product with an example, only to the length of the document's own vector.
The votes of the nearest ones, weighted by closeness, are put on the scale of a probability by a
monotone fit on left-out votes of the examples themselves.

The examples are a bounded sample of the labelled rows (``per_class`` of each label, by hash of
the id); everything else covers all documents. Tasks fold the examples, take their left-out votes
and score the texts; the driver passes the folded examples on, packed, and fits the votes.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.blockmax import BlockMaxIndex, least_int, ranges
from cohortlift.llm.scan import ALNUM, Words, prefix_sums, slices, span_hashes
from cohortlift.sources.tables import staged

PER_CLASS = 6_000  # labelled examples of each class at most
STARTS = (4, 5, 6)  # bytes of the word beginnings
NEIGHBOURS = 15
VOTERS = 500  # left-out votes of a task
TEXT_BYTES = 500_000  # of text whose terms are counted together
SCORED_BYTES = 4_000_000  # of text that is scored together
FILTERED_BYTES = 1_000_000  # the same where whole rows are at hand, beside what other stages left in a worker
MERGED = 1 << 20  # hashes of examples that are merged into the known ones together, at least


def term_hashes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, start and end of every term: whole words, and beginnings of longer ones."""
    text = np.repeat(np.arange(len(words.at) - 1), np.diff(words.first))
    size = words.ends - words.starts
    total = prefix_sums(words.data)
    hashes, texts = [span_hashes(words.data, words.starts, words.ends, total)], [text]
    starts, ends = [words.starts], [words.ends]
    for n in STARTS:
        long = np.flatnonzero(size > n)
        hashes.append(span_hashes(words.data, words.starts[long], words.starts[long] + n, total) ^ np.uint64(n))
        texts.append(text[long])
        starts.append(words.starts[long])
        ends.append(words.starts[long] + n)
    return tuple(np.concatenate(x) for x in (hashes, texts, starts, ends))


class Vocabulary:
    """Places of term hashes among the terms of the examples, by open addressing."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.mask = np.uint64((1 << max(4, (4 * len(terms)).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        left = np.arange(len(terms), dtype=np.int32)
        at = terms & self.mask
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            out = self.slots[at] != left
            left, at = left[out], (at[out] + np.uint64(1)) & self.mask

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for one that no example holds."""
        at = hashes & self.mask
        out = self.slots[at]
        wrong = np.flatnonzero(out >= 0)
        wrong = wrong[self.terms[out[wrong]] != hashes[wrong]]
        while len(wrong):
            at[wrong] = (at[wrong] + np.uint64(1)) & self.mask
            out[wrong] = self.slots[at[wrong]]
            wrong = wrong[out[wrong] >= 0]
            wrong = wrong[self.terms[out[wrong]] != hashes[wrong]]
        return out


def distinct_terms(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the different terms of each text, in that order."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return t[at], h[at], np.diff(np.append(at, len(h)))


def count_terms(column: pa.Array, known: Vocabulary) -> tuple[tuple, tuple]:
    """(text, place, count) of the known terms of a string column, and (text, hash, count) of the others."""
    hashes, text, _, _ = term_hashes(Words(column, ALNUM))
    at = known.places(hashes)
    hit = at >= 0
    n = max(1, len(known.terms))
    key, count = np.unique(text[hit] * n + at[hit], return_counts=True)
    return (key // n, key % n, count), distinct_terms(hashes[~hit], text[~hit])


def count_in_pieces(batch: pa.RecordBatch, text: str, known: Vocabulary) -> tuple[tuple, tuple]:
    """The same of a batch of any size, counted piece by piece."""
    found, before = [], 0
    for piece in slices([batch], text, TEXT_BYTES):
        found.append(tuple((t + before, x, n) for t, x, n in count_terms(piece.column(text), known)))
        before += piece.num_rows
    return tuple(tuple(np.concatenate(x) for x in zip(*side)) for side in zip(*found))


def packed(hashes: np.ndarray, rows: list[tuple]) -> bytes:
    """Examples folded to arrays and compressed: (id, places in ``hashes``, counts, label) rows."""
    rows = sorted(rows, key=lambda r: str(r[0]))
    size = np.array([len(r[1]) for r in rows], np.int64)
    terms = np.concatenate([np.zeros(0, np.int32), *[np.asarray(r[1], np.int32) for r in rows]])
    counts = np.concatenate([np.zeros(0, np.int32), *[np.asarray(r[2], np.int32) for r in rows]])
    counts = counts.astype(least_int(counts.max(initial=0)))  # most are below 256
    terms[1:] -= terms[:-1].copy()  # steps, which pack well
    arrays = [zlib.compress(x, 1) for x in (hashes, terms, counts)]
    return pickle.dumps((*arrays, counts.dtype.str, size, [r[3] for r in rows], [r[0] for r in rows]))


PACK = "hashes binary, body binary, n0 bigint, n1 bigint, empty0 bigint, empty1 bigint"


def fold_examples(examples: DataFrame) -> DataFrame:
    """One row: the sorted hashes of all terms of the (id, label, text) rows, the rows packed, and
    how many of each label there are, in all and without terms. The rows are a bounded sample."""

    def run(batches):
        ids, labels, found, every, fresh = [], [], [], np.zeros(0, np.uint64), []
        for batch in slices(batches, "text", TEXT_BYTES):
            hashes, text, _, _ = term_hashes(Words(batch.column("text"), ALNUM))
            owner, term, count = distinct_terms(hashes, text)
            fresh.append(np.unique(term))
            if sum(map(len, fresh)) > max(MERGED, len(every)):
                every, fresh = np.unique(np.concatenate([every, *fresh])), []
            count = count.astype(np.int32)
            first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            found += [(term[a:b], count[a:b]) for a, b in zip(first[:-1], first[1:])]
            ids += batch.column("id").to_pylist()
            labels += batch.column("label").to_pylist()
        every = np.unique(np.concatenate([every, *fresh]))
        for i, (term, count) in enumerate(found):  # places are half as wide as hashes
            found[i] = np.searchsorted(every, term).astype(np.int32), count
        rows = [(i, t, c, y) for i, y, (t, c) in zip(ids, labels, found)]
        n = [sum(y == k for y in labels) for k in (0, 1)]
        empty = [sum(y == k and not len(t) for y, (t, _) in zip(labels, found)) for k in (0, 1)]
        yield pa.RecordBatch.from_pylist(
            [{"hashes": every.tobytes(), "body": packed(every, rows), "n0": n[0], "n1": n[1], "empty0": empty[0], "empty1": empty[1]}],
            pa.schema([("hashes", pa.binary()), ("body", pa.binary()), *[(c, pa.int64()) for c in ("n0", "n1", "empty0", "empty1")]]),
        )

    return examples.repartition(1).mapInArrow(run, PACK)


def document_frequencies(texts: DataFrame, terms: np.ndarray) -> DataFrame:
    """(known, term, n): texts that hold a term, by place in ``terms`` if known and else by hash."""
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def rows(known, term, n):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(term), known)), pa.array(term.astype(np.int64)), pa.array(n.astype(np.int64))],
            names=["known", "term", "n"],
        )

    def run(batches):
        known = Vocabulary(shared.value)
        total = np.zeros(len(known.terms), np.int64)
        for batch in slices(batches, "text", TEXT_BYTES):
            (_, place, _), (_, other, _) = count_terms(batch.column("text"), known)
            total += np.bincount(place, minlength=len(total))
            other, n = np.unique(other, return_counts=True)
            yield rows(False, other.view(np.int64), n)
        there = np.flatnonzero(total)
        yield rows(True, there, total[there])

    found = texts.select("text").mapInArrow(run, "known boolean, term bigint, n bigint")
    counted = staged(found.groupBy("known", "term").agg(F.sum("n").alias("n")), "toxic-frequencies")
    shared.destroy()
    return counted


class Index:
    """The examples as a worker uses them, and what turns votes into scores. Sent packed; what is
    made from the examples is made when it is first asked for."""

    def __init__(self, body: bytes, idf: np.ndarray, importance: dict[int, float]):
        self.body, self.idf, self.share = body, idf, importance
        self.empty_score, self.votes, self.scores = 0.0, np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("body", "idf", "share", "empty_score", "votes", "scores")}

    @cached_property
    def unpacked(self) -> tuple:
        hashes, steps, counts, kind, size, label, ids = pickle.loads(self.body)
        first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        terms = np.cumsum(np.frombuffer(zlib.decompress(steps), np.int32), dtype=np.int32)
        hashes, counts = np.frombuffer(zlib.decompress(hashes), np.uint64), np.frombuffer(zlib.decompress(counts), kind)
        return hashes, first, terms, counts, np.array(label, float), ids

    def settle(self) -> None:
        """Unpack for good, where the index is sent no further."""
        if self.body:
            self.unpacked
            self.body = b""

    @cached_property
    def known(self) -> Vocabulary:
        return Vocabulary(self.unpacked[0])

    @property
    def ids(self) -> list:
        return self.unpacked[5]

    @property
    def label(self) -> np.ndarray:
        return self.unpacked[4]

    @cached_property
    def importance(self) -> np.ndarray:
        """Labelled rows that each example stands for."""
        return np.where(self.label == 1, self.share[1], self.share[0])

    @cached_property
    def blocks(self) -> BlockMaxIndex:
        _, first, terms, counts, _, _ = self.unpacked
        damped = 1 + np.log(np.maximum(1, np.arange(counts.max(initial=1) + 1)))  # weight of a count
        return BlockMaxIndex(len(self.idf), first, terms, lambda own: damped[counts[own]] * self.idf[terms[own]])

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts, dtype=np.float64)) * self.idf[terms]

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weight = self.weights(terms, counts)
        return weight / np.sqrt((weight * weight).sum())

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS):
        """The k nearest examples and their cosines, ties to the smaller place; exact."""
        return self.blocks.best(np.array([0, len(terms)]), terms, self.weights(terms, counts), k)[0][:2]

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        weight = cosine**2 * self.importance[at]
        return float((weight * self.label[at]).sum() / weight.sum())

    def left_out_votes(self, turns: np.ndarray):
        """(vote, label, importance) of examples by their nearest others, where there are any;
        ``turns`` counts examples block by block, so that like ones come together."""
        _, first, terms, counts, _, _ = self.unpacked
        places = self.blocks.order[turns]
        many = first[places + 1] - first[places]
        at = ranges(first[places], many)
        here = np.concatenate([[0], np.cumsum(many)])
        found = self.blocks.best(here, terms[at], self.weights(terms[at], counts[at]), NEIGHBOURS, skip=places)
        for p, (near, close, _) in zip(places, found):
            if len(near):
                yield self.vote(near, close), self.label[p], self.importance[p]

    def score_texts(self, n: int, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray):
        """(score, places, cosines, squared length) of each of n texts, from (text, term, count) in that order."""
        first = np.searchsorted(owner, np.arange(n + 1))
        if not len(self.ids):
            return [(self.empty_score, np.zeros(0, np.int64), np.zeros(0), 0.0)] * n
        out = []
        for at, close, square in self.blocks.best(first, terms, self.weights(terms, counts), NEIGHBOURS):
            score = self.empty_score
            if len(at):
                score = float(np.interp(self.vote(at, close), self.votes, self.scores))
            out.append((min(1.0, max(0.0, score)), at, close, square))
        return out


def monotone_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y (adjacent violators pooled); equal votes are
    one knot, so their order does not matter."""
    x, at = np.unique(np.round(x, 12), return_inverse=True)
    heavy, sums = np.bincount(at, weight, len(x)), np.bincount(at, weight * y, len(x))
    pools: list[list[float]] = []
    for a, s, w in zip(x, sums, heavy):
        pools.append([s, w, a * w])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]):
            s, w2, c = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += w2
            pools[-1][2] += c
    knots = np.array([p[2] / p[1] for p in pools])
    smoothed = np.array([(p[0] + 0.05) / (p[1] + 0.1) for p in pools])
    return knots, np.maximum.accumulate(np.clip(smoothed, 0.0, 1.0))


def build_index(rows: list, idf: np.ndarray, importance: dict[int, float]) -> Index:
    """The index of (id, terms, counts, label) rows of different ids; terms ascend in each."""
    return Index(packed(np.zeros(0, np.uint64), rows), idf, importance)


@dataclass
class Fitted:
    """A fitted scorer: the index as the tasks read it, the texts it was fitted over and how many
    of them hold each term that no example has."""

    shared: Broadcast
    index: Index
    texts: DataFrame
    size: int
    others: DataFrame


def calibrated(index: Index, n: int, spark) -> Broadcast:
    """The index with a monotone fit of its examples' left-out votes, sent to the tasks."""
    shared = spark.sparkContext.broadcast(index)

    def run(batches):
        shared.value.settle()
        for batch in batches:
            found = list(shared.value.left_out_votes(batch.column("id").to_numpy()))
            vote, label, weight = (np.array(x, float) for x in zip(*found)) if found else [np.zeros(0)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()) for x in (vote, label, weight)], names=["v", "y", "w"])

    votes = spark.range(0, n, 1, max(1, n // VOTERS)).mapInArrow(run, "v double, y double, w double").toArrow()
    if votes.num_rows:  # a bounded sample
        index.votes, index.scores = monotone_fit(*[votes.column(c).to_numpy() for c in ("v", "y", "w")])
    return shared


def fit(
    docs: DataFrame,
    labels: DataFrame,
    held_out=None,
    per_class: int = PER_CLASS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Fitted:
    """Index the labelled examples over all their terms, weighed over all of ``docs``.

    ``held_out`` is a condition on ``labels`` whose rows are not learnt from. Null labels and ids
    are not learnt from; of an id that is repeated, one row is.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if held_out is not None:
        known = known.where(~held_out)
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    sample = None
    for value in (0, 1):  # the smallest hashes of each class
        own = known.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(per_class)
        sample = own if sample is None else sample.unionAll(own)
    sample = staged(sample.groupBy("id").agg(F.max("label").alias("label")), "toxic-sample")
    # at most 2 * per_class rows of two numbers
    chosen = texts.join(F.broadcast(sample), "id").groupBy("id")
    chosen = staged(chosen.agg(F.max("label").alias("label"), F.min("text").alias("text")), "toxic-examples")
    packs = fold_examples(chosen).collect()
    pack = packs[0].asDict() if packs else {"hashes": b"", "body": packed(np.zeros(0, np.uint64), []), "n0": 0, "n1": 0, "empty0": 0, "empty1": 0}
    terms = np.frombuffer(bytes(pack["hashes"]), np.uint64)
    size = texts.count()
    frequency = document_frequencies(texts, terms)
    own = frequency.where("known").select("term", "n").toArrow()
    idf = np.full(len(terms), np.log(1.0 + size) + 1)
    idf[own.column("term").to_numpy()] = np.log((1.0 + size) / (1.0 + own.column("n").to_numpy())) + 1
    share = {y: totals.get(y, 0) / max(1, pack[f"n{y}"]) for y in (0, 1)}
    index = Index(bytes(pack["body"]), idf, share)
    n, lost = pack["n0"] + pack["n1"], share[0] * pack["empty0"] + share[1] * pack["empty1"]
    rate = share[1] * pack["n1"] / (share[0] * pack["n0"] + share[1] * pack["n1"]) if n else 0.0
    index.empty_score = float((share[1] * pack["empty1"] + rate) / (lost + 1))
    shared = calibrated(index, n, spark)
    return Fitted(shared, index, texts, size, frequency.where("not known").select("term", "n"))


def scorer(fitted: Fitted):
    """What a task scores with: the index from the broadcast, with the fit of the votes, which came
    later and is small."""
    index, shared = fitted.index, fitted.shared
    late = (index.empty_score, index.votes, index.scores)

    def make() -> Index:
        own = shared.value
        own.settle()
        own.empty_score, own.votes, own.scores = late
        return own

    return make


def toxicity_scores(fitted: Fitted, id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, evidence) for each row that the scorer was fitted over.

    Null and empty texts and texts that share no term with any example get the rate of toxic
    labels among examples without terms; without labels of both classes every score is the rate of
    the one there is, 0 if there is none. Repeated rows each give a row. Evidence lists the nearest
    examples, their cosines and labels.
    """
    texts, made = fitted.texts, scorer(fitted)
    kind = texts.schema["id"].dataType.simpleString()
    # what tells rows apart; equal rows have equal vectors
    keyed = texts.select("id", "text", F.xxhash64("id", "text").alias("k"), F.hash("id", "text").alias("l"))
    near_kind = f"array<struct<id:{kind},cosine:double,label:int>>"

    def run(batches):
        index = made()
        for batch in slices(batches, "text", SCORED_BYTES):
            nearest = pa.struct([("id", batch.schema.field("id").type), ("cosine", pa.float64()), ("label", pa.int32())])
            own, (owner, other, count) = count_in_pieces(batch, "text", index.known)
            both = index.score_texts(batch.num_rows, *own)
            near = [
                [{"id": index.ids[i], "cosine": float(c), "label": int(index.label[i])} for i, c in zip(at[:5], close[:5])]
                for _, at, close, _ in both
            ]
            offsets = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("id", "k", "l")],
                    pa.array([r[0] for r in both], pa.float64()),
                    pa.array(near, pa.list_(nearest)),
                    pa.array([r[3] for r in both], pa.float64()),
                    pa.ListArray.from_arrays(offsets, pa.array(other.view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(count, pa.int32())),
                ],
                names=["id", "k", "l", "score", "near", "square", "others", "counts"],
            )

    scored = staged(
        keyed.mapInArrow(
            run,
            f"id {kind}, k bigint, l int, score double, near {near_kind}, square double, "
            "others array<bigint>, counts array<int>",
        ),
        "toxic-scored",
    )
    fitted.shared.unpersist()
    # the part of a vector's length that lies in terms which no example holds
    pairs = scored.select("k", "l", F.size("others").alias("own"), F.explode(F.arrays_zip("others", "counts")).alias("t"))
    pairs = pairs.select("k", "l", "own", F.col("t.others").alias("term"), F.col("t.counts").alias("c"))
    weight = (1 + F.log(F.col("c"))) * (F.log(F.lit(1.0 + fitted.size) / (1 + F.col("n"))) + 1)
    rest = (
        pairs.join(fitted.others, "term")
        .groupBy("k", "l")
        .agg((F.sum(weight * weight) * F.max("own") / F.count("*")).alias("rest"))  # equal rows once
    )
    joined = scored.select("id", "k", "l", "score", "near", "square").join(rest, ["k", "l"], "left")
    shorter = F.sqrt(F.col("square") / (F.col("square") + F.coalesce("rest", F.lit(0.0))))
    evidence = F.transform(
        "near",
        lambda x: F.struct(x["id"].alias("id"), F.round(x["cosine"] * shorter, 12).alias("cosine"), x["label"].alias("label")),
    )
    return joined.select(
        F.col("id").alias(id_col),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        evidence.alias("evidence"),
    )


def not_toxic(docs: DataFrame, fitted: Fitted, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; texts are read
    again rather than shuffled to meet their scores."""
    made = scorer(fitted)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]

    def run(batches):
        index = made()
        for batch in slices(batches, text, FILTERED_BYTES):
            own, _ = count_in_pieces(batch, text, index.known)
            yield batch.filter(pa.array([r[0] < threshold for r in index.score_texts(batch.num_rows, *own)], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
