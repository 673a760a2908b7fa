"""Token counts of whole texts, huge ones by overlap resynchronisation (operator 7).

A huge text is encoded chunk by chunk, each chunk overlapping the one before, with the offset of
every word. Two neighbouring chunks are spliced at a word start that both report. Such a start is
proven stable: words are cut from left to right without looking back, so once a start is right,
all that follows it is as in the whole text; the left chunk vouches for starts that lie further
from its cut end than any rule looks ahead, and the right chunk runs on from there. Where no common
start exists, as inside one endless word, the overlap is doubled until there is one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.llm import bpe
from cohortlift.llm.scan import flat, slices

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 256
LOOKAHEAD = 3  # characters a splitting rule may look at beyond the word it cuts


def _size(vocab: bpe.Vocabulary):
    return len


def chunk_words(vocab: bpe.Vocabulary, words: bpe.Memo, chunk: str) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and token count of every word of a chunk."""
    starts: list[int] = []
    found: list[str] = []
    at = 0
    for piece, added in vocab.segments(chunk):
        if added:
            starts.append(at)
            found.append("\ud800" + piece)
        else:
            for m in vocab.split.finditer(piece):
                starts.append(at + m.start())
                found.append(m.group())
        at += len(piece)
    known = words.learn([found])
    return np.array(starts, np.int64), np.array([known[w] for w in found], np.int64)


def count_long(
    text: str, vocab: bpe.Vocabulary, words: bpe.Memo, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> int:
    """Tokens of one text by overlapping chunks. ``vocab`` must have no normaliser."""
    margin = max(LOOKAHEAD, vocab.longest_added)
    sure, total = 0, 0  # `sure` is a true word start; everything before it is counted
    start, end = 0, min(chunk, len(text))
    starts, counts = chunk_words(vocab, words, text[start:end])
    while end < len(text):
        reach = overlap
        while True:
            begin = max(sure, end - reach)
            stop = min(len(text), begin + max(chunk, 2 * reach))
            more, more_counts = chunk_words(vocab, words, text[begin:stop])
            more += begin
            # the first word of a chunk that begins anywhere is no evidence; one at `sure` is
            right = more if begin == sure else more[more > begin]
            common = np.intersect1d(starts[(starts >= sure) & (starts <= end - margin)], right)
            if len(common) and (stop > end or stop == len(text)):
                break
            reach *= 2  # one endless word fills the overlap
        splice = int(common[-1])
        total += int(counts[(starts >= sure) & (starts < splice)].sum())
        sure, start, end, starts, counts = splice, begin, stop, more, more_counts
    return total + int(counts[starts >= sure].sum())


def token_counts(
    docs: DataFrame,
    path: str | None = None,
    limit: int = 512,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``.

    Null or empty text: no bytes, no tokens. Repeated rows each give a row, an empty table gives
    none, further columns are ignored whatever their names. A text of up to ``chunk`` characters
    is encoded whole.
    """
    where = path or bpe.tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        vocab, words = bpe.vocabulary(where), bpe.memo(where, _size)
        for batch in slices(batches, "text", 400_000):
            column = batch.column("text")
            texts = bpe.shown(column)
            short = [vocab.words(t) if len(t) <= chunk else [] for t in texts]
            known = words.learn(short)
            tokens = [sum([known[w] for w in cut]) for cut in short]
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    tokens[i] = count_long(t, vocab, words, chunk, overlap)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(np.diff(flat(column)[1])),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"{id_col} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
