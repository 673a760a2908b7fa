import math
import random

import numpy as np
from pyspark.sql import functions as F

from cohortlift.llm import quality, toxicity, urls
from tests.llm.helpers import prose, rows, with_clashes


def labelled(spark, n=400):
    draw, docs, labels = random.Random(8), [], []
    for i in range(n):
        text, toxic, good = prose(i, 60), i % 5 == 0, i % 3 != 0
        if toxic:
            words = text.split()
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(["zzvile", "zznasty", "zzrotten"]))
            text = " ".join(words)
        if not good:
            text = " | ".join(text.upper().split()[:20]) + "!!! $$$"
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    docs += [(9000, None), (9001, ""), (9002, "?"), (9003, "x" * 20_000), (0, docs[0][1])]
    labels += [(9000, None, None), (None, 1, 1), (12345, 1, 1)]
    return (
        with_clashes(spark.createDataFrame(docs, "doc_id long, text string")),
        with_clashes(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")),
    )


def accuracy(scores, truth):
    return np.mean([scores[i] == y for i, y in truth.items()])


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    fitted = toxicity.fit(docs, labels, held_out=F.col("doc_id") % 4 == 1)
    got = toxicity.toxicity_scores(fitted)
    assert got.count() == docs.count()
    predicted = {r.doc_id: r.predicted for r in got.collect()}
    assert accuracy(predicted, {i: int(i % 5 == 0) for i in range(400) if i % 4 == 1}) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.collect())
    kept = toxicity.not_toxic(docs, fitted)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got.collect() if r.score < 0.5)


def test_nearest_examples_are_exact():
    draw = np.random.default_rng(2)
    idf = draw.uniform(1, 4, 30)
    data = []
    for i in range(700):
        terms = np.sort(draw.choice(30, draw.integers(0, 6), replace=False))
        data.append((i, terms.tolist(), draw.integers(1, 4, len(terms)).tolist(), int(i % 7 == 0)))
    index = toxicity.build_index(data, idf, {0: 1.0, 1: 1.0})
    full = np.zeros((700, 30))
    by_id = {r[0]: r for r in data}
    for place, i in enumerate(index.ids):
        if by_id[i][1]:
            full[place, by_id[i][1]] = index.vector(np.array(by_id[i][1]), np.array(by_id[i][2]))
    for _ in range(40):
        terms = np.sort(draw.choice(30, draw.integers(1, 5), replace=False))
        counts = draw.integers(1, 4, len(terms))
        query = np.zeros(30)
        query[terms] = index.vector(terms, counts)
        close = np.round(full @ query, 12)
        want = [i for i in np.lexsort((np.arange(700), -close))[:15] if close[i] > 0]
        at, cosine = index.nearest(terms, counts)
        assert at.tolist() == want
        assert np.allclose(cosine, close[want])


def test_rare_wording_finds_its_example(spark):
    docs, labels = labelled(spark)
    rare = "qqone qqtwo qqthree qqfour qqfive qqsix"  # in one toxic example, so of no likelihood ratio
    more = spark.createDataFrame([(20_000, rare), (20_001, rare), (20_002, rare + " wwunseen wwunseen")], "doc_id long, text string")
    docs = docs.unionByName(with_clashes(more))
    labels = labels.unionByName(with_clashes(spark.createDataFrame([(20_000, 1, 1)], labels.schema[:3])))
    got = {r.doc_id: r for r in toxicity.toxicity_scores(toxicity.fit(docs, labels)).collect()}
    assert got[20_001].evidence[0].id == 20_000 and abs(got[20_001].evidence[0].cosine - 1) < 1e-9
    size = docs.count()
    idf = lambda n: math.log((1 + size) / (1 + n)) + 1
    seen = 0.0
    for n in (4, 5, 6, 99):
        for w in {w[:n] for w in rare.split() if n == 99 or len(w) > n}:
            seen += idf(3) ** 2
    unseen = 4 * ((1 + math.log(2)) * idf(1)) ** 2  # the word and its three beginnings
    assert abs(got[20_002].evidence[0].cosine - math.sqrt(seen / (seen + unseen))) < 1e-9
    assert got[20_001].score == got[20_002].score


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = labelled(spark, 20)
    assert {r.score for r in toxicity.toxicity_scores(toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.toxicity_scores(toxicity.fit(docs.limit(0), labels)).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = quality.quality_scores(docs, labels, held_out=F.col("doc_id") % 4 == 1)
    assert got.count() == docs.count()
    predicted = {r.doc_id: r.predicted for r in got.collect()}
    assert accuracy(predicted, {i: int(i % 3 != 0) for i in range(400) if i % 4 == 1}) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_discriminant_is_a_difference_of_log_densities():
    draw = np.random.default_rng(1)
    x = {0: draw.normal(size=(300, 4)), 1: draw.normal(size=(500, 4)) @ np.diag([1, 2, 3, 4]) + 1}
    model = quality.fit_moments({y: (float(len(m)), m.sum(axis=0), m.T @ m) for y, m in x.items()})
    point = draw.normal(size=(1, 4))
    density = []
    for y in (0, 1):
        factor = np.linalg.inv(model.factors[y])
        c = factor @ factor.T
        d = (point - model.means[y])[0]
        n = len(x[y]) / 800
        density.append(math.log(n) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * d @ np.linalg.solve(c, d))
    assert np.isclose(model.difference(point)[0], density[1] - density[0])


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


def test_hosts_paths_and_rules(spark):
    cases = [
        (1, "https://A.Example.com/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
        (2, "http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (3, "ftp://xcom/a", "xcom", "/a", None, None),
        (4, "x://com", "com", "", None, None),
        (5, "x://b.net/es/?u=://y", "b.net", "/es/", "net/es/", "block"),
        (6, None, "", "", None, None),
        (7, "no scheme", "", "", None, None),
        (8, "", "", "", None, None),
        (9, "x://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        (9, "x://É.com/\u00c9?", "É.com", "/\u00c9", "com/", "allow"),
    ]
    pages = with_clashes(spark.createDataFrame([c[:2] for c in cases], "page_id long, url string"))
    got = {(r.page_id, r.host): r for r in urls.judged(pages, RULES).collect()}
    for i, _, host, path, rule, verdict in cases:
        r = got[i, host]
        assert (r.path, r.rule) == (path, rule) and r.verdict in ("allow", "block") and (verdict in (None, r.verdict))
    assert urls.judged(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in urls.judged(pages.where("page_id = 7"), RULES).collect()} == {"allow"}


def test_model_scores_against_plain_counts(spark):
    draw = random.Random(6)
    word = lambda kind: "".join(draw.choice(kind) for _ in range(8))
    pages = [(i, f"x://a{i}.{'com' if i % 2 else 'net'}/es/{word('abcd' if i % 2 else 'wxyz')}") for i in range(120)]
    pages += [(500 + i, f"x://b.org/{word('abcd')}") for i in range(10)]
    pages += [(600 + i, f"x://b.org/{word('wxyz')}") for i in range(10)]
    got = urls.judged(spark.createDataFrame(pages, "page_id long, url string"), RULES).collect()
    ratio = plain_model([(r.host + r.path, r.rule and r.verdict) for r in got])
    for r in got:
        assert math.isclose(r.score, ratio(r.host + r.path), abs_tol=1e-9)
        if r.page_id >= 500:
            assert r.verdict == ("allow" if r.page_id < 600 else "block")


def plain_model(texts, order=urls.ORDER):
    counts = {"allow": {}, "block": {}}
    padded = lambda s: urls.EDGE * order + s + urls.EDGE
    for s, verdict in texts:
        if verdict:
            t = padded(s)
            for i in range(order, len(t)):
                for k in range(order + 1):
                    for key in ((t[i - k : i], t[i]), (t[i - k : i], None)):
                        counts[verdict][key] = counts[verdict].get(key, 0) + 1

    def log_p(c, context, ch):
        p = 1 / urls.SYMBOLS
        for k in range(order + 1):
            h = context[order - k :]
            p = (c.get((h, ch), 0) + urls.SMOOTHING * p) / (c.get((h, None), 0) + urls.SMOOTHING)
        return math.log(p)

    def ratio(s):
        t = padded(s)
        parts = [
            log_p(counts["allow"], t[i - order : i], t[i]) - log_p(counts["block"], t[i - order : i], t[i])
            for i in range(order, len(t))
        ]
        return sum(parts) / len(parts)

    return ratio


def test_repeated_rows(spark):
    docs, labels = labelled(spark, 60)
    twice = docs.unionAll(docs)
    assert len(rows(quality.quality_scores(twice, labels).select("doc_id"))) == 2 * docs.count()
