"""Exact nearest vectors by a block-max inverted index, for sparse vectors without negative weights.

Examples of like wording stand in a block. Of each block the index keeps the largest weight of
every term that occurs in it: a text's weights times these bound its cosine with any example of the
block. The quarter of the blocks with the highest bounds is read first; of the others a text reads
those whose bounds its k-th best cosine so far does not beat. Inside a block the commonest terms are
rows of a matrix, of which only those are multiplied that occur in a batch of like texts; the others
are postings. Weights are held in steps of the largest of their row or term, blocks are read in single
precision, and whatever both could hide is multiplied again in double precision.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

BLOCK = 512  # examples of a block on average
BATCH = 256  # texts that read blocks together
PIECE = 64  # vectors that are folded, and texts that are bounded, together
ROWS = 2_048  # rows of a block's matrix at most; all other terms are postings
COMMON = 8  # examples of a block from which a term may be a row
SHARE = 0.1  # of a block's examples from which a term may be a row; below, its postings cost less
WIDTH = 128  # of the vectors by which examples are sorted into blocks
ROUNDS = 4
GROUPS = 40  # groups of examples for each of the k nearest, whose largest cosines tell the k-th best
STEPS = 65_535  # from 0 to the largest weight of a matrix row or of a term's postings, rounded up
#: No weight is negative, so a single-precision cosine is off by this part of itself at most, beside
#: what the steps add.
OFF = (ROWS + 64) * 2.0**-24


def least_int(largest: int) -> type:
    """The narrowest unsigned integers that hold numbers up to ``largest``."""
    return np.min_scalar_type(largest).type


def ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, … (many[0] of them), first[1], … as one array."""
    out = np.repeat(first - np.cumsum(many) + many, many)
    out += np.arange(len(out))
    return out


def in_steps(x: np.ndarray, step: np.ndarray) -> np.ndarray:
    return np.minimum(STEPS, np.ceil(x / step))


def sorted_into_blocks(first: np.ndarray, terms: np.ndarray, vectors: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Block of every example: vectors folded to ``WIDTH`` columns, leaders far apart, then means."""
    n = len(first) - 1
    blocks = max(1, -(-n // BLOCK))
    if blocks == 1:
        return np.zeros(n, np.int64)
    x = np.zeros((n, WIDTH))
    for i in range(0, n, PIECE):
        ends = first[i : i + PIECE + 1]
        own = slice(ends[0], ends[-1])
        spread = (terms[own].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        column = np.repeat(np.arange(len(ends) - 1), np.diff(ends)) * WIDTH + (spread >> np.uint64(40)).astype(np.int64) % WIDTH
        weight = vectors(np.arange(i, i + len(ends) - 1))
        signed = np.where(spread >> np.uint64(63), weight, -weight)
        x[i : i + PIECE] = np.bincount(column, signed, minlength=(len(ends) - 1) * WIDTH).reshape(-1, WIDTH)
    x /= np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]
    leaders, close = [0], x @ x[0]
    while len(leaders) < blocks:
        leaders.append(int(np.argmin(close)))
        close = np.maximum(close, x @ x[leaders[-1]])
    middles = x[leaders]
    for _ in range(ROUNDS):
        block = np.argmax(x @ middles.T, axis=1)
        for b in range(blocks):
            own = x[block == b]
            if len(own):
                middles[b] = own.mean(0) / max(1e-12, np.sqrt((own.mean(0) ** 2).sum()))
    # like blocks get numbers that follow each other, so that batches of texts are alike
    close = middles @ middles.T
    turn, left = [0], np.arange(blocks) > 0
    while left.any():
        turn.append(int(np.argmax(np.where(left, close[turn[-1]], -np.inf))))
        left[turn[-1]] = False
    return np.argsort(turn)[block]


def by_term(size: int, terms: list, *columns: list) -> list[np.ndarray]:
    """Edges of each term's entries, and the columns in that order; in each piece terms ascend. Pieces
    are put in their places one by one, so that nothing is held twice."""
    many = np.zeros(size + 1, np.int64)
    for term in terms:
        many[1:] += np.bincount(term, minlength=size)
    edges = np.cumsum(many)
    edges = edges.astype(least_int(edges[-1]))
    out = [np.empty(edges[-1], pieces[0].dtype) for pieces in columns]
    free = edges[:-1].astype(np.int64)  # the next place of each term
    for i, term in enumerate(terms):
        head = np.flatnonzero(np.diff(term, prepend=-1))
        held = np.diff(np.append(head, len(term)))
        at = ranges(free[term[head]], held)
        free[term[head]] += held
        for x, pieces in zip(out, columns):
            x[at], pieces[i] = pieces[i], None
    return [edges, *out]


class BlockMaxIndex:
    """Vectors first[i]:first[i + 1] of terms, ascending and different in each; ``weigh`` gives the
    weights of some of them, a slice or places, which are not kept."""

    def __init__(self, size: int, first: np.ndarray, terms: np.ndarray, weigh: Callable[[slice], np.ndarray]):
        self.n, self.first, self.terms, self.weigh = len(first) - 1, first, terms, weigh
        self.length = np.ones(self.n)
        for i in range(self.n):
            own = weigh(slice(first[i], first[i + 1]))
            self.length[i] = np.sqrt(own @ own) if len(own) else 1.0
        self.block = sorted_into_blocks(first, terms, self.vectors)
        self.members = [np.flatnonzero(self.block == b) for b in range(int(self.block.max(initial=0)) + 1)]
        # examples stand in columns, block after block
        self.order = np.concatenate(self.members)
        self.column = np.zeros(self.n, np.int64)
        self.column[self.order] = np.arange(self.n)
        self.edges = np.concatenate([[0], np.cumsum([len(m) for m in self.members])])
        self.scratch = np.zeros(size)  # a weight for each term, 0 between calls
        self.matrices, self.step, names, rest, highest = [], [], [], ([], [], []), ([], [], [])
        for b, own in enumerate(self.members):
            matrix, step, common, postings, most = self._block(b, own)
            self.matrices.append(matrix)
            self.step.append(step)
            names.append(common)
            for pieces, x in zip((*rest, *highest), (*postings, *most)):
                pieces.append(x)
        # the terms that are rows somewhere, numbered, and their row in each block's matrix
        there = np.zeros(size, bool)
        there[np.concatenate(names)] = True
        self.number = np.where(there, np.cumsum(there) - 1, -1).astype(np.int32)
        self.row = np.full((len(self.members), int(there.sum())), -1, np.int16)
        for b, common in enumerate(names):
            self.row[b, self.number[common]] = np.arange(len(common))
        # the other postings of all blocks, by term, as runs of bytes that can be taken without an index
        self.least_step = np.zeros(size)
        for term, unit in zip(rest[0], rest[2]):
            head = np.flatnonzero(np.diff(term, prepend=-1))
            if len(head):
                self.least_step[term[head]] = np.maximum(self.least_step[term[head]], np.maximum.reduceat(unit, head) / STEPS)
        for b, term in enumerate(rest[0]):
            pair = np.empty(len(term), [("example", rest[1][b].dtype), ("steps", np.uint16)])
            pair["example"], pair["steps"] = rest[1][b], in_steps(rest[2][b], self.least_step[term])
            rest[1][b] = rest[2][b] = pair
        start, postings = by_term(size, *rest[:2])
        self.example = postings["example"]
        self.pair, self.held = postings.dtype, np.diff(start.astype(np.int64)).astype(least_int(len(postings)))
        at = pa.py_buffer(start.astype(np.int64) * postings.itemsize)
        self.postings = pa.Array.from_buffers(pa.large_binary(), size, [None, at, pa.py_buffer(postings)])
        # the largest weight of every (term, block) that occurs: of those terms as a table, of the others by term
        self.table = np.zeros((len(self.members), int(there.sum())))
        for b, (term, most) in enumerate(zip(highest[0], highest[2])):
            own = there[term]
            self.table[b, self.number[term[own]]] = most[own]
            highest[0][b], highest[1][b], highest[2][b] = term[~own], highest[1][b][~own], most[~own]
        self.table = np.ascontiguousarray(self.table.T)
        self.limits, self.where, self.most = by_term(size, *highest)

    def vector(self, i: int) -> np.ndarray:
        return self.weigh(slice(self.first[i], self.first[i + 1])) / self.length[i]

    def vectors(self, some: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[self.vector(i) for i in some]])

    def _block(self, b: int, own: np.ndarray):
        """Matrix of a block's commonest terms, postings of the others, largest weights of all."""
        many = self.first[own + 1] - self.first[own]
        at = ranges(self.first[own], many)
        term, unit = self.terms[at], self.vectors(own)
        column = np.repeat(np.arange(len(own)), many)
        order = np.argsort(term, kind="stable")
        term, unit, column = term[order], unit[order], column[order]
        head = np.flatnonzero(np.diff(term, prepend=-1))
        held, names = np.diff(np.append(head, len(term))), term[head]
        common = np.argsort(-held, kind="stable")[:ROWS]
        common = common[held[common] >= max(COMMON, SHARE * len(own))]
        line = np.full(len(head), -1, np.int16)
        line[common] = np.arange(len(common))
        row = np.repeat(line, held)
        dense = row >= 0
        most = np.maximum.reduceat(unit, head) if len(head) else unit
        step = most[common] / STEPS
        matrix = np.zeros((len(common), len(own)), np.uint16)
        matrix[row[dense], column[dense]] = in_steps(unit[dense], step[row[dense]])
        rest = ~dense
        postings = term[rest], (column[rest] + self.edges[b]).astype(least_int(self.n)), unit[rest].astype(np.float32)
        return matrix, step.astype(np.float32), names[common], postings, (names, np.full(len(names), b, least_int(len(self.members))), most)

    def bounds(self, q: int, owner: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each text and block a number that no cosine of the text with a member exceeds."""
        number, k = self.number[terms], len(self.members)
        out = np.zeros((q, k))
        own = np.flatnonzero(number >= 0)
        if len(own):
            head = np.flatnonzero(np.diff(owner[own], prepend=-1))
            out[owner[own[head]]] = np.add.reduceat(self.table[number[own]] * weight[own, None], head, axis=0)
        own = np.flatnonzero(number < 0)
        low = self.limits[terms[own]].astype(np.int64)
        many = self.limits[terms[own] + 1] - low
        at = ranges(low, many)
        out += np.bincount(np.repeat(owner[own] * k, many) + self.where[at], np.repeat(weight[own], many) * self.most[at],
                           minlength=q * k).reshape(q, k)
        return out

    def exact(self, at: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Cosines of a text's unit vector with some examples, in double precision."""
        return self.cosines(at, np.zeros(len(at), np.int64), np.array([0, len(terms)]), terms, weight)

    def cosines(self, example: np.ndarray, text: np.ndarray, first: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Cosines of pairs of an example and a text, in double precision; an example near to one text
        is often near to many, so each is unfolded once."""
        out, order = np.zeros(len(example)), np.argsort(example, kind="stable")
        heads = np.flatnonzero(np.diff(example[order])) + 1
        for pairs in np.split(order, heads) if len(order) else []:
            i = example[pairs[0]]
            theirs = self.terms[self.first[i] : self.first[i + 1]]
            self.scratch[theirs] = self.vector(i)
            for j in pairs.tolist():
                own = slice(first[text[j]], first[text[j] + 1])
                out[j] = self.scratch[terms[own]] @ weight[own]
            self.scratch[theirs] = 0
        return out

    def _batch(self, bound: np.ndarray, to: np.ndarray, terms: np.ndarray, weight: np.ndarray, k: int, skip):
        """Single-precision cosines of like texts, by column, and the least that one of the k nearest
        can show; columns of blocks that were not read show less."""
        m, n, edge = len(bound), self.n, np.searchsorted(to, np.arange(len(bound) + 1))
        out = np.zeros((m, n), np.float32)
        many, scaled = self.held[terms], weight * self.least_step[terms]
        wanted = pa.array(terms)
        for i, (a, e) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
            _, ends, data = self.postings.take(wanted[a:e]).buffers()
            if data:
                own = np.frombuffer(data, self.pair, np.frombuffer(ends, np.int64, 1, 8 * (e - a))[0] // self.pair.itemsize)
                out[i] = np.bincount(own["example"], np.repeat(scaled[a:e], many[a:e]) * own["steps"], minlength=n)
        # a line for each term of the batch that is a row somewhere, and its row in each block
        number = self.number[terms]
        own = np.flatnonzero(number >= 0)
        used = np.zeros(self.row.shape[1], bool)
        used[number[own]] = True
        line, rows = np.cumsum(used) - 1, self.row[:, used]
        wide = np.zeros((rows.shape[1], m), np.float32)
        wide[line[number[own]], to[own]] = weight[own]
        # what steps can add to a cosine: by the postings, by a matrix
        rest = np.bincount(to, scaled, minlength=m)
        more, least = np.zeros(m), np.zeros(m)
        turn = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
        few = -(-bound.shape[1] // 4)
        for low, high in ((0, few), (few, bound.shape[1])):  # the likeliest blocks tell how far the others reach
            wanted = (turn >= low) & (turn < high) & (bound > 0) & (bound >= least[:, None])
            self.read += int(wanted.sum())
            for b in np.flatnonzero(wanted.any(0)):
                text, lines = np.flatnonzero(wanted[:, b]), np.flatnonzero(rows[b] >= 0)
                part = wide[lines]
                if len(text) < m:
                    part = part[:, text]
                    some = part.any(1)
                    lines, part = lines[some], part[some]
                if len(lines):
                    row = rows[b, lines]
                    part = part * self.step[b][row, None]
                    more[text] = np.maximum(more[text], part.sum(0))
                    out[text, self.edges[b] : self.edges[b + 1]] += part.T @ self.matrices[b][row].astype(np.float32)
            if skip is not None:
                out[np.arange(m), self.column[skip]] = 0
            if n > k:  # the k-th best of the largest of some groups is no more than the k-th best of all
                groups = min(n, GROUPS * k)
                largest = out[:, : n // groups * groups].reshape(m, -1, groups).max(1)
                least = (np.partition(largest, groups - k, axis=1)[:, groups - k] * (1 - OFF) - rest - more) * (1 - 4 * OFF)
        return out, least

    def best(self, first: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, skip: np.ndarray | None = None):
        """[(places, cosines, squared length)] of each text: the k nearest examples with a cosine above
        0, ties to the smaller place. Text i passes over example skip[i]."""
        q = len(first) - 1
        owner = np.repeat(np.arange(q), np.diff(first))
        square = np.bincount(owner, weights * weights, minlength=q)
        weight = weights / np.sqrt(square)[owner]
        bound = np.zeros((q, len(self.members)))
        for i in range(0, q, PIECE):
            own = slice(first[i], first[min(q, i + PIECE)])
            bound[i : i + PIECE] = self.bounds(min(q - i, PIECE), owner[own] - i, terms[own], weight[own])
        bound *= 1 + 4 * OFF
        like = np.argsort(np.argmax(bound, axis=1), kind="stable")  # texts of one leading block together
        near: list = [np.zeros(0, np.int64)] * q
        self.read = 0  # blocks that the last call read
        for i in range(0, q, BATCH):
            texts = like[i : i + BATCH]
            many = first[texts + 1] - first[texts]
            at, to = ranges(first[texts], many), np.repeat(np.arange(len(texts)), many)
            close, least = self._batch(bound[texts], to, terms[at], weight[at], k, None if skip is None else skip[texts])
            for j, text in enumerate(texts.tolist()):
                near[text] = np.sort(self.order[(close[j] > 0) & (close[j] >= least[j])])
        edges = np.concatenate([[0], np.cumsum([len(x) for x in near])]).astype(np.int64)
        pairs = np.concatenate([self.order[:0], *near]), np.repeat(np.arange(q), np.diff(edges))
        cosines, found = self.cosines(*pairs, first, terms, weight), []
        for text, some in enumerate(near):
            cosine = cosines[edges[text] : edges[text + 1]]
            best = np.argsort(-np.round(cosine, 12), kind="stable")[:k]
            found.append((some[best], cosine[best], float(square[text])))
        return found
