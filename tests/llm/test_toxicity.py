"""Votes and scores of the toxicity operator against plain dictionaries, and the block-max index."""

import collections
import math
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlift.llm import blockmax, scan, toxicity
from tests.llm.helpers import fold, prose


def terms_of(text):
    words = [w.encode() for w in re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", fold(text))]
    return collections.Counter([(0, w) for w in words] + [(n, w[:n]) for w in words for n in (4, 5, 6) if len(w) > n])


def by_hand(docs, labels, held_out, k=15):
    """score of every document: all cosines, the k nearest, weighted votes, adjacent violators pooled."""
    counts = [terms_of(t) for _, t in docs]
    df = collections.Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}
    vectors = [{t: (1 + math.log(n)) * idf[t] for t, n in c.items()} for c in counts]
    length = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    known = [(i, y) for i, y in labels if not held_out(i)]
    totals = collections.Counter(y for _, y in known)
    place = {i: p for p, (i, _) in enumerate(docs)}
    examples = sorted(((i, y) for i, y in known if i in place), key=lambda r: str(r[0]))
    there = collections.Counter(y for _, y in examples)
    weight = {y: totals[y] / max(1, there[y]) for y in (0, 1)}

    def vote(p, but=None):
        close = []
        for rank, (i, y) in enumerate(examples):
            e = place[i]
            dot = sum(x * vectors[e].get(t, 0.0) for t, x in vectors[p].items())
            if i != but and dot > 0:
                close.append((-round(dot / length[p] / length[e], 12), rank, y))
        near = sorted(close)[:k]
        sums = [(c * c * weight[y], y) for c, _, y in near]
        return sum(w * y for w, y in sums) / sum(w for w, _ in sums) if sums else None

    at_vote = collections.defaultdict(lambda: [0.0, 0.0, 0.0])
    for i, y in examples:
        if (v := vote(place[i], i)) is not None:
            w, own = weight[y], at_vote[round(v, 12)]
            own[0], own[1], own[2] = own[0] + y * w, own[1] + w, own[2] + round(v, 12) * w
    pools = []
    for v in sorted(at_vote):
        pools.append(at_vote[v])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    knots = [p[2] / p[1] for p in pools]
    scores = np.maximum.accumulate([(p[0] + 0.05) / (p[1] + 0.1) for p in pools])
    bare = [y for i, y in examples if not counts[place[i]]]
    rate = weight[1] * there[1] / (weight[0] * there[0] + weight[1] * there[1])
    empty = (weight[1] * sum(bare) + rate) / (sum(weight[y] for y in bare) + 1)
    out = []
    for p in range(len(docs)):
        v = vote(p)
        out.append(empty if v is None else float(np.interp(v, knots, scores)))
    return out


def test_scores_by_hand(spark):
    draw, docs, labels = random.Random(4), [], []
    for i in range(160):
        bad = i % 4 == 0
        words = prose(i, 25, "abcdefgh").split() + draw.choices(["vilest", "nastier", "rotten"] if bad else ["kindly", "pleasant"], k=2)
        draw.shuffle(words)
        docs.append((i, " ".join(words)))
        if i % 5 != 3:
            labels.append((i, int(bad != (i % 31 == 0))))
    docs += [(500, ""), (501, "??"), (502, "vilest nastier"), (503, docs[0][1]), (504, docs[0][1]), (505, None)]
    labels += [(500, 0), (502, 1)]
    held_out = lambda i: i % 3 == 1
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    fitted = toxicity.fit(frame, known, held_out=F.col("doc_id") % 3 == 1)
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(fitted).collect()}
    want = by_hand(docs, labels, held_out)
    assert [got[i] for i, _ in docs] == pytest.approx(want, abs=1e-9)


def languages(n, seed=3, words=400):
    """Sparse vectors in four groups that share few terms, as documents of four languages do."""
    draw = np.random.default_rng(seed)
    first, terms, weights = [0], [], []
    for i in range(n):
        low = (i % 4) * words
        own = np.unique(np.concatenate([low + draw.zipf(1.3, 40) % words, 4 * words + draw.integers(0, 30, 2)]))
        terms.append(own)
        weights.append(draw.uniform(0.5, 4, len(own)))
        first.append(first[-1] + len(own))
    return 4 * words + 30, np.array(first), np.concatenate(terms), np.concatenate(weights)


def test_blocks_are_skipped_and_nothing_is_lost():
    size, first, terms, weights = languages(3_000)
    index = blockmax.BlockMaxIndex(size, first, terms, weights.__getitem__)
    assert len(index.members) == 6 and sorted(np.concatenate(index.members)) == list(range(3_000))
    full = np.zeros((3_000, size))
    for i in range(3_000):
        full[i, terms[first[i] : first[i + 1]]] = index.vector(i)
    asked = np.arange(0, 3_000, 37)
    _, q_first, q_terms, q_weights = languages(len(asked), seed=9)
    for skip in (None, asked):
        found = list(index.best(q_first, q_terms, q_weights, 15, skip=skip))
        assert index.read < 0.7 * len(asked) * len(index.members)
        for j, (at, cosine, square) in enumerate(found):
            own = slice(q_first[j], q_first[j + 1])
            query = np.zeros(size)
            query[q_terms[own]] = q_weights[own] / np.sqrt((q_weights[own] ** 2).sum())
            close = np.round(full @ query, 12)
            if skip is not None:
                close[asked[j]] = 0
            want = [i for i in np.lexsort((np.arange(3_000), -close))[:15] if close[i] > 0]
            assert at.tolist() == want and np.allclose(cosine, close[want])
            assert square == pytest.approx((q_weights[own] ** 2).sum())


def test_bounds_are_bounds():
    size, first, terms, weights = languages(1_500, seed=5)
    index = blockmax.BlockMaxIndex(size, first, terms, weights.__getitem__)
    owner = np.repeat(np.arange(20), np.diff(first[:21]))
    bound = index.bounds(20, owner, terms[: first[20]], index.vectors(np.arange(20)))
    for b, own in enumerate(index.members):
        for i in range(20):
            mine = slice(first[i], first[i + 1])
            assert (index.exact(own, terms[mine], index.vector(i)) <= bound[i, b] + 1e-12).all()


def test_reading_needs_little_memory_beside_the_index():
    size, first, terms, weights = languages(6_000, seed=6)
    index = blockmax.BlockMaxIndex(size, first, terms, weights.__getitem__)
    assert index.example.dtype == np.uint16 and index.where.dtype == np.uint8
    _, q_first, q_terms, q_weights = languages(512, seed=7)
    tracemalloc.start()
    index.best(q_first, q_terms, q_weights, 15)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 8 * blockmax.BATCH * index.n  # two numbers for each example and text of a batch


def test_an_example_is_unfolded_once_for_all_texts_it_is_near_to():
    size, first, terms, weights = languages(1_500, seed=8)
    index = blockmax.BlockMaxIndex(size, first, terms, weights.__getitem__)
    assert all(m.itemsize == 2 for m in index.matrices)
    unfolded = []
    index.weigh = lambda own: unfolded.append(own) or weights[own]
    _, q_first, q_terms, q_weights = languages(1_000, seed=11)
    found = index.best(q_first, q_terms, q_weights, 15)
    assert sum(len(at) for at, _, _ in found) == 15_000 and len(unfolded) <= 1_500


def test_power_tables_are_no_longer_than_the_text_needs(monkeypatch):
    monkeypatch.setattr(scan, "_POWERS", {})
    data = np.arange(1_000, dtype=np.uint8) % 7
    scan.span_hashes(data, np.array([0, 7]), np.array([5, 12]))
    assert all(len(table) < 4 * len(data) for table in scan._POWERS.values())


@pytest.mark.parametrize("n", [1, 14, 71, 300])
def test_few_examples_of_any_length(n):
    draw, size = np.random.default_rng(n), 60
    own = [np.unique(draw.zipf(1.3, draw.integers(0, 12)) % size) for _ in range(n)]
    first, terms = np.cumsum([0, *map(len, own)]), np.concatenate(own).astype(np.int64)
    weights = draw.uniform(0.1, 4, len(terms))
    index = blockmax.BlockMaxIndex(size, first, terms, weights.__getitem__)
    full = np.zeros((n, size))
    for i in range(n):
        full[i, own[i]] = index.vector(i)
    for j, (at, cosine, _) in enumerate(index.best(first, terms, weights, 15)):
        close = np.round(full @ full[j], 12)
        assert at.tolist() == [i for i in np.lexsort((np.arange(n), -close))[:15] if close[i] > 0]
        assert np.allclose(cosine, close[at])


def test_counts_weigh_in_double_precision():
    rows = [(i, np.array([0, 1], np.int32), np.array([200 + i, 1000], np.int32), i % 2) for i in range(4)]
    index = toxicity.build_index(rows, np.array([1.5, 2.5]), {0: 1.0, 1: 1.0})
    counts = index.unpacked[3]
    assert counts.dtype == np.uint16
    assert index.weights(np.zeros(1, int), counts[:1])[0] == (1 + math.log(200)) * 1.5
