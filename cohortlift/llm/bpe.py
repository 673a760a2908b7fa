"""Byte-pair encoding and decoding with published vocabulary files (operator 5).

A word is held as a contiguous rank array: its parts side by side, and beside each part the merge
rank of the pair that it begins. The smallest rank is found by scanning, the boundary inside that
pair is deleted, and the ranks of the two neighbouring pairs are looked up anew. Words are short,
so a scan beats a heap; words of similar length are worked off together as the columns of one matrix.
Only a word beyond ``SHORT_WORD`` bytes goes to a heap, where scanning would cost its square.

Texts are cut into words as the vocabulary file says. Each task keeps the words that it has met in
a memo of bounded size, so that a word is merged once per task in the common case.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.scan import slices

MEMO_WORDS = 250_000  # entries kept per task; a bound on memory, not on what is encoded
SHORT_WORD = 64  # bytes; longer words are merged with a heap, to the same result
_NONE = np.int32(2**31 - 1)
#: Fixed value: the split of byte-level vocabularies whose file asks for it with ``use_regex``.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str) -> str:
    """Where the machine keeps the published vocabulary ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """One printable character for each byte: itself where printable, else the next from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merges:
    """The merge table of a vocabulary as sorted arrays, and the merging of many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        out: list[list[int]] = [[]] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        ordered = size[order]
        start = int(np.searchsorted(ordered, 1))
        while start < len(order):  # words of similar length, and a bounded number of cells
            width = int(ordered[start])
            if width > SHORT_WORD:
                for i in order[start:].tolist():
                    out[i] = self._long_word(words[i])
                break
            upto = int(np.searchsorted(ordered, width + max(2, width // 4), "right"))
            upto = min(upto, int(np.searchsorted(ordered, SHORT_WORD, "right")))
            stop = max(start + 1, min(upto, start + max(1, 400_000 // (width + 4))))
            rows = order[start:stop].tolist()
            self._block([words[i] for i in rows], size[order[start:stop]], rows, out)
            start = stop
        return out

    def _long_word(self, word: bytes) -> list[int]:
        """The same merges for a word too long to be scanned anew for each of them: a heap of
        (rank, place) over linked parts, stale entries skipped."""
        n = len(word)
        raw = np.frombuffer(word, np.uint8)
        parts = self.inner[raw]
        parts[-1] = self.final[raw[-1]]
        ranks = self.pair_ranks(parts[:-1], parts[1:]).tolist() + [int(_NONE)]
        parts = parts.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, r in enumerate(ranks) if r != _NONE]
        heapq.heapify(heap)
        known = self.by_pair
        while heap:
            rank, i = heapq.heappop(heap)
            if ranks[i] != rank:
                continue
            j = after[i]
            parts[i], after[i], ranks[j] = int(self.made[rank]), after[j], -1
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k < 0:
                    continue
                right = after[k]
                ranks[k] = known.get(parts[k] * self.width + parts[right], int(_NONE)) if right < n else int(_NONE)
                if ranks[k] != _NONE:
                    heapq.heappush(heap, (ranks[k], k))
        out, i = [], 0
        while i < n:
            out.append(parts[i])
            i = after[i]
        return out

    @functools.cached_property
    def by_pair(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist()))

    def _block(self, words: list[bytes], size: np.ndarray, rows: list[int], out: list) -> None:
        """Words side by side: column j of ``parts`` is a word, and ``ranks`` holds beside each of
        its parts the rank of the pair that begins there. Ranks are spaced by ``step`` so that a
        place can be added and one minimum gives both."""
        n, width = len(words), int(size.max())
        step = np.int64(width + 2)
        none = np.int64(2**62) // step * step
        parts = np.full((width + 1, n), -1, np.int32)
        raw = np.frombuffer(b"".join(words), np.uint8)
        column = np.repeat(np.arange(n), size)
        place = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
        parts[place, column] = self.inner[raw]
        parts[size - 1, np.arange(n)] = self.final[raw[np.cumsum(size) - 1]]
        ranks = np.full((width + 1, n), none, np.int64)

        def pair(left, right):
            found = self.pair_ranks(left, right).astype(np.int64)
            return np.where(found == _NONE, none, found * step)

        both = (parts[:-1] >= 0) & (parts[1:] >= 0)
        ranks[:-1][both] = pair(parts[:-1][both], parts[1:][both])
        alive, steps = np.arange(n), np.arange(width + 1)[:, None]
        while True:
            low = (ranks + steps[: len(ranks)]).min(axis=0)
            over = low >= none
            if over.any():
                for j, ids in zip(alive[over].tolist(), parts[:, over].T.tolist()):
                    out[rows[j]] = ids[: ids.index(-1)]
                keep = ~over
                alive, low = alive[keep], low[keep]
                if not len(alive):
                    return
                parts, ranks = parts[:, keep], ranks[:, keep]
                used = int((parts >= 0).any(axis=1).sum()) + 1
                parts, ranks = parts[:used], ranks[:used]
            at, word = low % step, np.arange(len(alive))
            # delete the boundary between part `at` and the next one; the last row stays empty
            for i in range(int(at.min()) + 1, len(parts) - 1):
                moved = at < i
                np.copyto(parts[i], parts[i + 1], where=moved)
                np.copyto(ranks[i], ranks[i + 1], where=moved)
            parts[at, word] = self.made[low // step]
            # parts after the merged one moved up by one place: the next part is one further on
            merged, after = parts[at, word], parts[at + 1, word]
            ranks[at, word] = pair(merged, after)
            later = np.flatnonzero(at)
            if len(later):
                prior = at[later] - 1
                ranks[prior, later] = pair(parts[prior, later], merged[later])


class Vocabulary:
    """A vocabulary file: its splitting rules, merges, added tokens and token strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.folded = spec.get("normalizer") is not None
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (model["vocab"] | self.added).items()}
        pre = spec["pre_tokenizer"]
        split = next((p for p in pre.get("pretokenizers", []) if p["type"] == "Split"), None)
        self.split = regex.compile(split["pattern"]["Regex"] if split else BYTE_LEVEL_SPLIT)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))))
        self.longest_added = max(map(len, self.added), default=0)

    def normal(self, text: str) -> str:
        if not self.folded:
            return text
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # capital sigma is lowered by itself, not by its place in a word
            return "".join(c.lower() for c in text)
        return text.lower()

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of ordinary text, and the added tokens between them."""
        last = 0
        for m in self.special.finditer(text) if "<|" in text else ():
            if m.start() > last:
                yield text[last : m.start()], False
            yield m.group(), True
            last = m.end()
        if last < len(text):
            yield text[last:], False

    def words(self, text: str) -> list[str]:
        """The words of a text in order; an added token stands as a word of its own."""
        if "<|" not in text:
            return self.split.findall(self.normal(text))
        out: list[str] = []
        for piece, added in self.segments(text):
            # a mark keeps an added token apart from a word of the same letters
            out += ["\ud800" + piece] if added else self.split.findall(self.normal(piece))
        return out


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Memo:
    """What is known of each word, computed for all new words of a batch at once."""

    def __init__(self, vocab: Vocabulary, value, most: int = MEMO_WORDS):
        self.vocab, self.value, self.most = vocab, value, most
        self.known: dict[str, object] = {}

    def learn(self, texts_words: list[list[str]]) -> dict[str, object]:
        new = set().union(*texts_words) if texts_words else set()
        new.difference_update(self.known)
        if len(self.known) + len(new) > self.most:
            self.known = {}
            new = set().union(*texts_words)
        plain = [w for w in new if w[:1] != "\ud800"]
        for w, ids in zip(plain, self.vocab.merges.encode([w.encode("utf-8") for w in plain])):
            self.known[w] = self.value(ids)
        for w in new:
            if w[:1] == "\ud800":
                self.known[w] = self.value([self.vocab.added[w[1:]]])
        return self.known


@functools.lru_cache(maxsize=4)
def memo(path: str, value) -> Memo:
    """The memo of this worker process for a vocabulary and a kind of value; tasks share it."""
    vocab = vocabulary(path)
    return Memo(vocab, value(vocab))


def encode_texts(texts: list[str], vocab: Vocabulary, words_known: Memo) -> list[tuple[str, str]]:
    """For each text its ids as decimals and its decoded text, both joined by one space."""
    cut = [vocab.words(t) for t in texts]
    known = words_known.learn(cut)
    out = []
    for words in cut:
        pairs = [known[w] for w in words]
        out.append((" ".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])))
    return out


def _ids(vocab: Vocabulary):
    return lambda ids: ids


def _ids_and_tokens(vocab: Vocabulary):
    tokens = vocab.tokens
    return lambda ids: (" ".join(map(str, ids)), " ".join([tokens[i] for i in ids]))


def shown(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist() if column.null_count else column.to_pylist()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text: (id, token_ids array<int>). Null and empty texts give an empty array."""

    def run(batches):
        vocab, words_known = vocabulary(path), memo(path, _ids)
        for batch in slices(batches, "text"):
            cut = [vocab.words(t) for t in shown(batch.column("text"))]
            known = words_known.learn(cut)
            ids = [[i for w in words for i in known[w]] for words in cut]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "token_ids"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"{id_col} {rows.schema['id'].dataType.simpleString()}, token_ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Token strings of each id array joined by one space, which is what a vocabulary file without
    a decoder means by decoding: (id, text). Null arrays decode to the empty text; an id outside
    the vocabulary stands for nothing and is left out."""

    def run(batches):
        tokens = vocabulary(path).tokens
        for batch in batches:
            texts = [
                " ".join([tokens[i] for i in ids or () if i in tokens])
                for ids in batch.column("token_ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=[id_col, "text"])

    rows = encoded.select(F.col(id_col).alias("id"), "token_ids")
    return rows.mapInArrow(run, f"{id_col} {rows.schema['id'].dataType.simpleString()}, text string")


def encoding_digest(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs``.

    Null or empty text: no tokens, digests of the empty string. Repeated rows each give a row, an
    empty table gives none, further columns are ignored whatever their names.
    """
    where = path or tokenizer_path("word_bpe_49k.json")

    def run(batches):
        vocab, words_known = vocabulary(where), memo(where, _ids_and_tokens)
        for batch in slices(batches, "text", 400_000):
            both = encode_texts(shown(batch.column("text")), vocab, words_known)
            count = [a.count(" ") + 1 if a else 0 for a, _ in both]
            ids = [hashlib.sha256(a.encode("ascii")).hexdigest() for a, _ in both]
            back = [hashlib.sha256(b.encode("utf-8")).hexdigest() for _, b in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
