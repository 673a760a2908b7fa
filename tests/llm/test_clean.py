import random

from cohortlift.llm import hnsw, linededup, neardup, suffix
from cohortlift.llm.components import components
from cohortlift.llm.secrets import secret_digest, secret_spans
from tests.llm.helpers import benchmark_hits, near_groups, prose, rows, secrets, with_clashes


def docs_of(spark, pairs):
    return with_clashes(spark.createDataFrame(pairs, "doc_id long, text string"))


def small_words(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(["a", "b", "c", "The", "É", "x1"]) for _ in range(n))


def test_benchmark_matches(spark, monkeypatch):
    draw = random.Random(1)
    docs = [(i, small_words(i, draw.randint(0, 60))) for i in range(80)] + [(90, None), (91, ""), (92, "?!"), (3, "a b")]
    items = [(i, small_words(1000 + i, draw.choice([0, 1, 3, 5, 10, 11, 20]))) for i in range(14)] + [(99, None), (7, "É")]
    own, bench = docs_of(spark, docs), with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    got = rows(suffix.hit_summary(suffix.benchmark_matches(own, bench)))
    assert got == sorted(benchmark_hits(docs, items), key=repr)
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 60)  # several passes
    assert rows(suffix.hit_summary(suffix.benchmark_matches(own, bench))) == got
    clean = suffix.decontaminated(own, bench)
    assert clean.columns == own.columns
    assert clean.count() == sum(not r[-1] for r in got)
    nothing = bench.limit(0)
    assert suffix.decontaminated(own, nothing).count() == own.count()
    assert suffix.hit_summary(suffix.benchmark_matches(own.limit(0), bench)).count() == 0


def test_longest_matches_and_places(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    text = "start here " + " ".join(item.split()[1:]).upper() + " end"
    found = suffix.benchmark_matches(
        spark.createDataFrame([(1, text)], "doc_id long, text string"),
        spark.createDataFrame([("q", item)], "item_id string, text string"),
    ).first()
    assert [tuple(s) for s in found.spans] == [("q", 1, 2, 12)]


def family(seed, base_words, copies, most_edits):
    draw = random.Random(seed)
    base = [draw.choice([f"w{i}" for i in range(400)]) for _ in range(base_words)]
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(draw.randint(0, most_edits)):
            words[draw.randrange(len(words))] = f"w{draw.randrange(400)}"
        out.append(" ".join(words))
    return out


def test_near_duplicates(spark, monkeypatch):
    texts = family(1, 90, 120, 5) + family(2, 60, 60, 3) + [prose(i, 40) for i in range(30)]
    docs = list(enumerate(texts + [None, "", " \t", "x", "X", "x y", "x  Y"]))
    own = docs_of(spark, docs)
    for shingle, percent in ((3, 85), (5, 80)):
        want = near_groups(docs, shingle, percent)
        assert sorted(rows(neardup.near_duplicates(own, shingle, percent))) == want
    monkeypatch.setattr(neardup, "BLOCK", 9)  # buckets of many blocks
    assert sorted(rows(neardup.near_duplicates(own, 3, 85))) == near_groups(docs, 3, 85)
    assert neardup.near_duplicates(own.limit(0)).count() == 0


def test_near_duplicates_with_repeated_rows_and_null_ids(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)]
    got = rows(neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85))
    assert got == sorted(
        [(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (None, 4, None, None), (3, 0, 3, True)], key=repr
    )


def test_odd_sketches_keep_every_similar_pair():
    import numpy as np

    draw = np.random.default_rng(5)
    seeds, most = neardup._seeds(), neardup.most_different_bits(85)
    for _ in range(60):
        both = draw.integers(0, 2**63, 170, dtype=np.uint64)
        a, b = (np.unique(np.append(both, draw.integers(0, 2**63, 15, dtype=np.uint64))) for _ in range(2))
        assert neardup.linked(a, b, 85)
        x, y = (np.frombuffer(neardup.odd_sketch(neardup.minhash(s, seeds)), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= most


def test_components(spark):
    links = [(i, i + 1) for i in range(40, 60)] + [(5, 3), (3, 9), (7, 7), (None, 4), (3, 5), (100, 40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 40 for i in [*range(40, 61), 100]} | {3: 3, 5: 3, 9: 3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_passages_go_and_clean_documents_stay(spark):
    draw, docs, passages = random.Random(2), [], [prose(500 + g, 52) for g in range(20)]
    for g, p in enumerate(passages):
        for c in range(3):
            words = prose(1000 + 10 * g + c, 80).split(" ")
            k = draw.randrange(len(words))
            joint = ["\n", " "][(g + c) % 2]
            docs.append((len(docs), " ".join(words[:k]) + joint + p + joint + " ".join(words[k:])))
    clean = [(len(docs) + i, prose(5000 + i, 120)) for i in range(60)]
    odd = [(900, None), (901, ""), (902, "\n\n"), (903, "It. Was. So. " * 3), (904, prose(9, 4000))]
    exact = [(910, clean[0][1])]
    own = docs_of(spark, docs + clean + odd + exact)
    cut = linededup.without_repeats(own)
    assert cut.columns == [*own.columns, "removed_words", "removed_spans"]
    got = {r.doc_id: r for r in cut.collect()}
    for i, text in docs:
        words, p = got[i].text, passages[i // 3].split()
        left = sum(" ".join(p[k : k + 8]) in words for k in range(len(p) - 7))
        assert (got[i].text == text) if i % 3 == 0 else left <= (len(p) - 7) // 2
    for i, text in clean + odd:
        assert got[i].text == text and got[i].removed_words == 0
    assert got[910].text.strip() == ""
    for i, text in docs:  # the spans are what was cut
        data = text.encode()
        for s in reversed(got[i].removed_spans):
            data = data[: s.start] + data[s.stop :]
        assert data.decode() == got[i].text
    assert linededup.without_repeats(own.limit(0)).count() == 0


def test_repeated_rows_of_one_id_are_one_document(spark):
    text = prose(77, 90)
    got = linededup.without_repeats(spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string"))
    assert {r.text for r in got.collect()} == {text}


def test_secret_spans(spark):
    odd = [
        None, "", "é token=secret: abcdefghijklmnop", 'PassWord = "aaaaaaaaaaaa', "\U0001f600 api-key=1 APIKEY:0123456789abcdef0123",
        "AKIA" * 6, "token=short token=abcdefghijkl AKIA1234567890123", " ".join(f"secret={i:016x}" for i in range(600)),
        "f" * 16 + "g" + "0" * 15, "toKen=ABCDEFGHIJKLMN \u017fecret=ABCDEFGHIJKLMNOP", "token=abcdefghijkl", "token=abcdefghijkl",
    ]
    docs = list(enumerate(odd))
    got = secret_digest(secret_spans(docs_of(spark, docs)))
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got.collect()} == {
        i: secrets(t) for i, t in docs
    }
    assert secret_digest(secret_spans(docs_of(spark, docs).limit(0))).count() == 0


def test_model_adds_random_strings_and_leaves_identifiers(spark):
    draw = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(draw.choice(alphabet) for _ in range(n))
    word = lambda: "".join(draw.choice(["ta", "ri", "mo", "en", "st"]) for _ in range(draw.randint(7, 12)))
    docs = [(i, f"{word()} token={key(32)} {word()} {word()}") for i in range(300)]
    docs += [(1000 + i, f"{word()} note {key(36)} {word()}") for i in range(2)]
    found = {r.doc_id: r.found for r in secret_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i in (1000, 1001):
        assert [f.value for f in found[i] if f.kind == "model"] == [dict(docs)[i].split()[2]]
    assert sum(f.kind == "model" for f in sum(found.values(), [])) == 2


def test_nearest_against_brute_force(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 16))
    vectors = [(centres[i % 12] + 0.4 * draw.normal(size=16)).tolist() for i in range(900)]
    vectors += [vectors[0]] * 40  # ties
    table = [(i, v) for i, v in enumerate(vectors)]
    odd = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (5200, [1.0, 2.0])]
    df = with_clashes(spark.createDataFrame(table + odd, "vec_id long, embedding array<double>"))
    got = {}
    for r in hnsw.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=300).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = hnsw.unit_rows(vectors)
    hits = total = 0
    for q in range(0, len(vectors), 50):
        close = unit @ unit[q]
        close[q] = -9
        best = np.lexsort((np.arange(len(close)), -np.round(close, 12)))[:5]
        own = sorted(got[q])
        assert [r for r, *_ in own] == [1, 2, 3, 4, 5]
        assert all(abs(s - close[i]) < 1e-12 for _, i, s in own)
        hits += len({i for _, i, _ in own} & set(best.tolist()))
        total += 5
        if q == 0:
            assert [i for _, i, _ in own] == best.tolist()
    assert hits / total >= 0.95 and not {5000, 5050, 5100, 5150} & set(got)
    assert hnsw.nearest(df.limit(0), df.limit(0)).count() == 0


def test_repeated_rows_leave_room_for_other_ids(spark):
    same, other = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    table = [(1, same)] * 20 + [(i, same) for i in range(2, 9)] + [(i, [float(i), 1.0, -2.0]) for i in range(20, 30)]
    df = spark.createDataFrame(table + [(50, other)] * 20, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in hnsw.nearest(df, df.where("vec_id in (1, 2)")).collect())
    assert got == [(1, i, i + 1) for i in range(1, 6)] + [(2, i, v) for i, v in enumerate((1, 3, 4, 5, 6), 1)]
