import collections
import hashlib
import math
import random
import re

import pytest

from cohortlift.llm import mixing
from tests.llm.helpers import prose, rows, with_clashes


def water_levels(sizes, weights, cap):
    """Targets by sharing and resharing until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped = set()
    while True:
        rest = sum(sizes.values()) - sum(cap * sizes[s] for s in stopped)
        heavy = sum(weight[s] for s in names if s not in stopped)
        out = {s: cap * sizes[s] if s in stopped else rest * weight[s] / heavy for s in names}
        above = {s for s in names if out[s] > cap * sizes[s] + 1e-9 and s not in stopped}
        if not above:
            return out
        stopped |= above


def by_hand(docs, weights=(1, 2, 3), cap=3, seed=13):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in docs]
    total = collections.Counter()
    for n, (_, _, s) in zip(size, docs):
        total[s] += n
    target = water_levels(total, weights, cap) if docs else {}
    out = []
    for n, (i, _, s) in zip(size, docs):
        rate = target[s] / total[s] if total[s] else 0
        u = int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
        out.append((i, n, total[s], round(target[s], 6), n * (math.floor(rate) + (u < rate - math.floor(rate)))))
    return sorted(out, key=repr)


def corpus(seed=4, n=600):
    draw = random.Random(seed)
    names = ["hot"] * 40 + ["a", "B", "é", "", "zz", None, "tiny", "_", "~", "=x"]
    docs = [(i, prose(i, draw.randint(1, 30)) + " \xa0 x\n\ty ", draw.choice(names)) for i in range(n)]
    docs += [(None, "no id", "a"), (None, None, None), (5, None, "only null"), (6, "", "only null"), (7, " \n ", "hot")]
    return docs + docs[:8] * 2 + [(10**9, prose(1, 20_000), "long")]


def test_plan_by_hand(spark):
    for docs, weights, cap in ((corpus(), (1, 2, 3), 3), (corpus(5), (5, 1), 1), (corpus(6, 50), (1, 1000), 2)):
        df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string, source string"))
        got = [(*r[:3], round(r[3], 6), r[4]) for r in rows(mixing.mixing_report(df, weights=weights, cap=cap))]
        assert sorted(got, key=repr) == by_hand(docs, weights, cap)
        assert all(r[4] <= cap * r[1] for r in got)
        assert abs(sum(dict((r[2], r[3]) for r in got).values()) - sum(r[1] for r in got)) <= 1e-6 * sum(r[1] for r in got) or cap > 1


def test_taken_words_come_near_targets(spark):
    draw = random.Random(2)
    docs = [(i, "w " * draw.randint(5, 60), draw.choice(["a"] * 9 + ["b", "c", "d"])) for i in range(20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = mixing.mixing_report(df).groupBy("source_size").agg({"taken": "sum", "target": "max"}).collect()
    assert len(found) == 4
    for r in found:
        assert abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.03


def test_mix_repeats_rows_as_planned(spark):
    docs = [(i, t, s) for i, (_, t, s) in enumerate(corpus(7, 200))]
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    plan = {r.doc_id: r.copies for r in mixing.mixing_plan(df).collect()}
    out = mixing.mixed(df)
    assert out.columns == [*df.columns, "copy"]
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r.copy)
        assert r.text == docs[r.doc_id][1] and r.source == docs[r.doc_id][2] and r.component == "x"
    assert {i: sorted(c) for i, c in got.items()} == {i: list(range(1, c + 1)) for i, c in plan.items() if c}
    with pytest.raises(ValueError):
        mixing.mixed(df, copy="text")


def test_empty_tables_and_wordless_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert rows(mixing.mixing_report(df)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.mixing_report(df.limit(0)).count() == 0
    assert mixing.mixed(df).count() == 0
