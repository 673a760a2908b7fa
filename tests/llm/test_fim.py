import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cohortlift.llm import fim
from cohortlift.llm.scan import flat
from tests.llm.helpers import prose, rows, with_clashes


def plainly(i, text):
    """(id, n, form, prefix, middle, output) by slicing code points."""
    t = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(x in t for x in fim.MARKS) or h[2] % 100 >= 90:
        return i, len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < 20:
        return i, len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    draw = random.Random(5)
    letters = ["a", " ", "\n", "é", "語", "\U0001f600", "<", "P", ">", "S", "M", "́", " ", "\x00"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 90))) for _ in range(200)]
    return [None, "", " ", "<P>", "x<M>y", "<", "\U0001f600" * 400, "é" * 50, prose(1, 60_000), *texts, *texts[:9]]


def test_pieces_equal_plain_slices(spark):
    texts = list(enumerate(odd_texts())) + [(3, "a b c"), (3, "a b c"), (None, "no id at all"), (None, None)]
    docs = with_clashes(spark.createDataFrame(texts, "doc_id long, text string"))
    want = [plainly(i, t) for i, t in texts]
    for size in (500, 4_000_000):
        assert rows(fim.fill_in_middle(docs, batch_bytes=size)) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = fim.fill_in_middle(docs).select("doc_id", fim.restored("output", "form"))
    assert rows(back) == sorted(((i, t or "") for i, t in texts), key=repr)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    both = [(*w[:5], digest(w[5]), digest(t or "")) for w, (_, t) in zip(want, texts)]
    assert rows(fim.middle_digest(docs)) == sorted(both, key=repr)
    assert fim.middle_digest(docs.limit(0)).count() == 0


def test_ranks_count_classes():
    column = pa.array(["ab  é\n", "", "語 x", None, "  lead"])
    raw, at = flat(column)
    classes = fim.byte_classes(raw, at)
    tree = fim.WaveletMatrix(classes)
    for place in range(len(raw) + 1):
        for c in range(8):
            assert tree.rank(c, np.array([place]))[0] == (classes[:place] == c).sum()
    assert tree.count((fim.HEAD,), at).tolist() == [0, 2, 2, 4, 4, 5]


def test_word_units_keep_their_blanks(spark):
    texts = [(i, prose(i, 40) + "  \n tail é ") for i in range(40)] + [(77, "  ahead of words")]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    got = {r.doc_id: r for r in fim.fill_in_middle(docs, unit="word", percent=100, spm_percent=0).collect()}
    for i, text in texts:
        r = got[str(i)]
        assert r.n == len(text.split()) and r.form == "psm"
        middle = r.output.split("<M>")[1]
        prefix = text[: r.prefix_chars]
        assert len(middle) == r.middle_chars and text.startswith(prefix + middle)
        h = hashlib.sha256(f"1:{i}".encode()).hexdigest()
        a, b = sorted(int(h[8 * k : 8 * k + 8], 16) % (r.n + 1) for k in (0, 1))
        assert len(prefix.split()) == a and len((prefix + middle).split()) == b
        assert not a or re.search(r"\s$", prefix) or prefix == text


def test_marks_that_run_into_each_other_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for marks in (("aa", "b", "c"), ("<P>", "<P>", "<M>"), ("<P>", "x<P>y", "z"), ("ab", "bc", "d")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, marks=marks)
