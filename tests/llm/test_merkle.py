import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cohortlift.llm import merkle
from cohortlift.llm.ranks import ranked, sums_before
from tests.llm.helpers import prose, rows, with_clashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, more=0):
    i, text, lang, source, n = doc
    values = (i, source, lang, None if n is None else n + more, text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, arity):
    """(root, for each leaf its (left, right) siblings from the leaf up)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            run = i - i % arity
            path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + arity])))
        nodes = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        at = [i // arity for i in at]
    return nodes[0], paths


def by_hand(docs, arity=2):
    out, groups = [], {}
    for doc in docs:
        groups.setdefault((doc[2] is not None, (doc[2] or "").encode()), []).append(doc)
    roots, members = [], []
    for g in sorted(groups):
        own = sorted(groups[g], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        subroot, paths = tree([leaf(d) for d in own], arity)
        roots.append(subroot)
        members.append((own, paths))
    root, over = tree(roots, arity)
    for subroot, (own, paths), top in zip(roots, members, over):
        for doc, path in zip(own, paths):
            changed = doc[0] is not None and zlib.crc32(str(doc[0]).encode()) % 7 == 0
            node = leaf(doc, int(changed))
            for left, right in path + top:
                node = h(left, node, right)
            proof = h(*(left + right for left, right in path + top))
            out.append((doc[0], leaf(doc), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def corpus(n, seed=1):
    draw = random.Random(seed)
    langs = ["en"] * 6 + ["de", "", None, "ü", "zz", "~"]
    docs = [(i, prose(i, 5), draw.choice(langs), draw.choice(["a", None]), draw.choice([7, None, 12])) for i in range(n)]
    docs += docs[:5] * 3 + [(None, None, None, None, None)] * 3 + [(4, "other text", "en", "a", 1), (9, "", "one", "", 0)]
    return docs + [(10**12, prose(2, 30_000), "en", "é", 3)]


@pytest.mark.parametrize("n, levels", [(0, 6), (300, 1), (300, 2), (300, 6)])
def test_manifest_by_hand(spark, n, levels):
    docs = corpus(n)
    df = with_clashes(spark.createDataFrame(docs, SCHEMA).drop("n")).drop("label")
    assert rows(merkle.tamper_report(df, levels=levels)) == by_hand(docs)


def test_other_arity(spark):
    docs = corpus(200)
    df = spark.createDataFrame(docs, SCHEMA)
    for arity in (3, 5):
        assert rows(merkle.tamper_report(df, arity=arity, levels=2)) == by_hand(docs, arity)


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(3, "x", "en", "a", 1)], SCHEMA)
    row = merkle.tamper_report(df).collect()
    assert [tuple(r) for r in row] == by_hand([(3, "x", "en", "a", 1)])
    assert row[0].root == row[0].subroot == row[0].leaf and row[0].proof_sha256 == h("")
    assert merkle.tamper_report(df.limit(0)).count() == 0


def test_fields_cannot_be_shifted_into_each_other(spark):
    a, b = ("1", "1:2", None), ("1", "1", ":2")
    df = spark.createDataFrame([a, b], "x string, y string, z string")
    assert df.select(merkle.leaf_hash([F.col(c) for c in df.columns]).alias("h")).distinct().count() == 2


def test_places_in_ranges(spark):
    draw = random.Random(3)
    data = [("hot" if i % 3 else f"g{i % 7}", draw.choice([None, 1, 2, i % 50])) for i in range(3_000)]
    df = spark.createDataFrame(data, "g string, x long")
    got = ranked(df, "g", ["x"], "places", range_rows=200).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append((r.pos, r.x, r.n))
    assert sum(map(len, groups.values())) == len(data)
    for members in groups.values():
        members.sort(key=lambda r: r[0])
        assert [r[0] for r in members] == list(range(len(members)))
        keys = [(r[1] is not None, r[1] or 0) for r in members]
        assert keys == sorted(keys) and {r[2] for r in members} == {len(members)}


def test_sums_before_places(spark, monkeypatch):
    monkeypatch.setattr("cohortlift.llm.ranks.BLOCK", 7)
    df = spark.range(100).selectExpr("id AS pos", "id % 5 AS x")
    got = {r.pos: r.before_x for r in sums_before(df, ["x"]).collect()}
    assert got == {i: sum(k % 5 for k in range(i)) for i in range(100)}
