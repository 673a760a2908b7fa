import hashlib

import pytest
from tokenizers import Tokenizer

from cohortlift.llm import bpe
from cohortlift.llm.tokencount import count_long, token_counts
from tests.llm.helpers import prose, rows, with_clashes

ODD = [
    None, "", "   ", "a  b \n\n c\t ", "don't WE'LL 's<|endoftext|>x <|startoftext|><|endoftext|>", "é" * 300,
    "x" * 3000 + " y", "\n" * 300 + "z", "İ ΑΣ ½ 123 4", "<|endoftext" * 20, "\U0001f600!!!??? ünï",
]


def table(spark, texts):
    return with_clashes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_encode_and_decode_like_the_library(spark):
    lib = Tokenizer.from_file(bpe.tokenizer_path("word_bpe_49k.json"))
    texts = ODD + [prose(i, 300) for i in range(8)] + ["same", "same"]
    want = []
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), digest(" ".join(map(str, ids))), digest(back)))
    docs = table(spark, texts)
    assert rows(bpe.encoding_digest(docs)) == sorted(want, key=repr)
    path = bpe.tokenizer_path("word_bpe_49k.json")
    encoded = bpe.encode_documents(docs, path)
    back = {r.doc_id: r.text for r in bpe.decode_documents(encoded, path).collect()}
    for r in encoded.collect():
        assert r.token_ids == lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert back[r.doc_id] == lib.decode(r.token_ids, skip_special_tokens=False)
    assert bpe.encoding_digest(docs.limit(0)).count() == 0


def test_long_and_short_words_merge_alike():
    vocab = bpe.vocabulary(bpe.tokenizer_path("byte_bpe_50k.json"))
    words = [w.encode() for w in prose(3, 400).split()]
    assert vocab.merges.encode(words) == [vocab.merges._long_word(w) for w in words]


def test_counts_like_the_library(spark):
    lib = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    texts = ODD + [prose(i, 700) for i in range(4)]
    want = []
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    docs = table(spark, texts)
    assert rows(token_counts(docs)) == sorted(want, key=repr)
    assert rows(token_counts(docs, chunk=200, overlap=16)) == sorted(want, key=repr)
    assert token_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(20, 1), (33, 8), (64, 40)])
def test_splices_are_stable(chunk, overlap):
    import random

    path = bpe.tokenizer_path("byte_bpe_50k.json")
    lib, vocab = Tokenizer.from_file(path), bpe.vocabulary(path)
    memo, draw = bpe.Memo(vocab, len), random.Random(chunk)
    parts = ["a", "l", "'", "'ll", " ", "  ", "\n", "<|endoftext|>", "<|", "1", "é", "!", "t"]
    for _ in range(60):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 120)))
        assert count_long(text, vocab, memo, chunk, overlap) == len(lib.encode(text, add_special_tokens=False).ids)
