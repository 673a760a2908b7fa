"""Approximate nearest neighbours with a small-world graph for each shard (operator 4).

Rows are dealt to shards of bounded size. A shard becomes a hierarchical navigable small-world
graph, held as flat arrays: for each layer the members and a fixed number of neighbour places for
each. Layers thin out geometrically by a hash of the row; neighbours of a node are picked so that
none is closer to another neighbour than to the node. While a graph is built, the candidates of a
block of nodes are found by one product with the nodes before them, which in a shard of bounded
size costs less than walking the graph for each.

A search takes a block of queries through a graph together: down the upper layers greedily, then
along the bottom layer with a beam. The best of each shard are merged; the score that is returned
is the cosine of the original vectors in double precision.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlift.sources.tables import staged

SHARD_ROWS = 4_096
LINKS = 16  # neighbours of a node in the upper layers; twice as many in the bottom one
CANDIDATES = 96  # considered when neighbours are picked
BEAM = 128  # width of the search in the bottom layer
QUERY_BLOCK = 256
KEPT_COPIES = 8  # ids kept for rows with equal vectors: more than any result can hold of them


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>) of rows that take part: no nulls, no non-finite parts, not zero."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("vector"))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine & some)


def pick(candidates: np.ndarray, close: np.ndarray, among: np.ndarray, most: int) -> list[int]:
    """Neighbours from candidates in falling order of closeness: one is taken unless it is closer
    to one already taken than to the node; the rest fill up what is left."""
    taken: list[int] = []
    passed: list[int] = []
    for i in range(len(candidates)):
        if len(taken) == most:
            break
        if taken and among[i, taken].max() > close[i]:
            passed.append(i)
        else:
            taken.append(i)
    taken += passed[: most - len(taken)]
    return candidates[taken].tolist()


class Graph:
    """A layered graph over unit vectors: ``layers`` of (members, neighbours by place, -1 for none)."""

    def __init__(self, unit: np.ndarray, ids: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.unit, self.ids, self.layers = unit, ids, layers

    @classmethod
    def build(cls, unit: np.ndarray, ids: np.ndarray, level: np.ndarray) -> Graph:
        layers = []
        for depth in range(int(level.max()) + 1):
            members = np.flatnonzero(level >= depth)
            most = LINKS if depth else 2 * LINKS
            layers.append((members, cls._layer(unit[members], most)))
        return cls(unit, ids, layers)

    @staticmethod
    def _layer(unit: np.ndarray, most: int) -> np.ndarray:
        n = len(unit)
        links: list[list[int]] = [[] for _ in range(n)]
        block = 256
        for start in range(0, n, block):
            stop = min(n, start + block)
            close = unit[start:stop] @ unit[:stop].T
            for i in range(start, stop):
                row = close[i - start, :i]
                if not i:
                    continue
                few = min(CANDIDATES, i)
                near = np.argpartition(-row, few - 1)[:few]
                near = near[np.argsort(-row[near], kind="stable")]
                mine = pick(near, row[near], unit[near] @ unit[near].T, most // 2)
                links[i] = mine
                for j in mine:
                    links[j].append(i)
                    if len(links[j]) > most + LINKS // 2:
                        links[j] = Graph._shrunk(unit, j, links[j], most)
        out = np.full((n, most), -1, np.int32)
        for i, own in enumerate(links):
            if len(own) > most:
                own = Graph._shrunk(unit, i, own, most)
            out[i, : len(own)] = own
        return out

    @staticmethod
    def _shrunk(unit: np.ndarray, i: int, own: list[int], most: int) -> list[int]:
        near = np.array(own)
        close = unit[near] @ unit[i]
        order = np.argsort(-close, kind="stable")
        near = near[order]
        return pick(near, close[order], unit[near] @ unit[near].T, most)

    def search(self, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the best ``beam`` nodes that each query meets, nearest first."""
        q = len(queries)
        at = np.zeros(q, np.int64)
        top = self.layers[-1][0]
        at[:] = top[0]
        best = queries @ self.unit[top[0]]
        for members, links in reversed(self.layers[1:]):
            live = np.arange(q)
            while len(live):
                place = np.searchsorted(members, at[live])
                near = links[place]
                node = np.where(near >= 0, members[near], at[live][:, None])
                cosine = np.einsum("qkd,qd->qk", self.unit[node], queries[live])
                k = cosine.argmax(axis=1)
                found = cosine[np.arange(len(live)), k]
                better = found > best[live] + 1e-12
                live, k, found, node = live[better], k[better], found[better], node[better]
                best[live], at[live] = found, node[np.arange(len(live)), k]
        links = self.layers[0][1]
        n, width = len(self.unit), links.shape[1]
        met = np.zeros((q, n + 1), bool)
        met[np.arange(q), at] = True
        met[:, n] = True  # the place that stands for no neighbour
        places = np.full((q, beam), n, np.int64)
        cosines = np.full((q, beam), -np.inf, np.float32)
        open_ = np.zeros((q, beam), bool)
        places[:, 0], cosines[:, 0], open_[:, 0] = at, best, True
        live = np.arange(q)
        while len(live):
            # the nearest few open nodes of each beam are opened in one step
            order = np.argsort(~open_[live], axis=1, kind="stable")[:, :4]
            chosen = np.take_along_axis(places[live], order, 1)
            valid = np.take_along_axis(open_[live], order, 1)
            open_[live[:, None], order] = False
            near = np.where(valid[:, :, None], links[np.minimum(chosen, n - 1)], -1).reshape(len(live), -1)
            near = np.where(near < 0, n, near).astype(np.int64)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            near = np.where(met[live[:, None], near], n, near)
            met[live[:, None], near] = True
            cosine = np.einsum("qkd,qd->qk", self.unit[np.minimum(near, n - 1)], queries[live])
            cosine = np.where(near == n, -np.inf, cosine).astype(np.float32)
            all_places = np.concatenate([places[live], near], axis=1)
            all_cosines = np.concatenate([cosines[live], cosine], axis=1)
            all_open = np.concatenate([open_[live], near < n], axis=1)
            order = np.argsort(-all_cosines, axis=1, kind="stable")[:, :beam]
            places[live] = np.take_along_axis(all_places, order, 1)
            cosines[live] = np.take_along_axis(all_cosines, order, 1)
            open_[live] = np.take_along_axis(all_open, order, 1)
            live = live[open_[live].any(axis=1)]
        return places, cosines

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        arrays = {"unit": self.unit, "ids": self.ids}
        for i, (members, links) in enumerate(self.layers):
            arrays |= {f"m{i}": members, f"l{i}": links}
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        held = np.load(io.BytesIO(data))
        layers = [(held[f"m{i}"], held[f"l{i}"]) for i in range((len(held.files) - 2) // 2)]
        return cls(held["unit"], held["ids"], layers)


def unit_rows(vectors: list) -> np.ndarray:
    matrix = np.array([np.asarray(v, float) for v in vectors])
    matrix /= np.abs(matrix).max(axis=1, keepdims=True)  # no overflow in the norm
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, graph) for every shard of (id, vector) rows. Rows of other lengths than the
    commonest of a shard's lengths are kept in graphs of their own length: (shard, length, graph)."""
    total = rows.count()
    shards = max(1, -(-total // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn(
        "length", F.size("vector")
    )

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        matrix = np.array(frame["vector"].tolist())
        ids = frame["id"].to_numpy()
        # equal vectors are one node that stands for their smallest ids
        _, first, group = np.unique(matrix, axis=0, return_index=True, return_inverse=True)
        group = group.ravel()
        order = np.argsort(group, kind="stable")
        begin = np.searchsorted(group[order], np.arange(len(first)))
        rank = np.arange(len(order)) - begin[group[order]]
        held = np.full((len(first), KEPT_COPIES), -1, np.int64)
        few = rank < KEPT_COPIES
        held[group[order][few], rank[few]] = ids[order][few]
        sequence = np.argsort(first, kind="stable")  # insertion in order of id
        unit = unit_rows(list(matrix[first[sequence]])).astype(np.float32)
        draw = np.array([hash_unit(i) for i in held[sequence, 0]])
        level = np.minimum((-np.log(draw) / np.log(LINKS)).astype(int), 8)
        level[0] = level.max()
        graph = Graph.build(unit, held[sequence], level)
        return pd.DataFrame(
            {"shard": [int(frame["shard"].iloc[0])], "length": [matrix.shape[1]], "graph": [graph.to_bytes()]}
        )

    return dealt.groupBy("shard", "length").applyInPandas(work, "shard int, length int, graph binary")


def hash_unit(i: int) -> float:
    """A number in (0, 1] that follows from an id."""
    x = (int(i) * 0x9E3779B97F4A7C15 + 0xD6E8FEB86659FD93) & (2**64 - 1)
    x ^= x >> 32
    x = (x * 0xA0761D6478BD642F) & (2**64 - 1)
    x ^= x >> 29
    return ((x >> 11) + 1) / 2.0**53


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    shard_rows: int = SHARD_ROWS,
    beam: int = BEAM,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, by cosine.

    Every usable row of ``vectors`` is indexed; a query's own id is no candidate of it. Rows with
    null, zero or non-finite vectors, and null ids, take no part on either side; vectors of
    different lengths are not compared. Ties go to the smaller id. Repeated rows of one id count
    once. Further columns are ignored whatever their names.
    """
    if k >= KEPT_COPIES:
        raise ValueError(f"k must be below {KEPT_COPIES}")
    # a repeated row would take the places of other ids with its vector, and fill a shard or a block
    rows = staged(usable(vectors, id_col, vector_col).dropDuplicates(["id", "vector"]), "vectors")
    index = staged(build_index(rows, shard_rows), "graphs")
    asked = usable(queries, id_col, vector_col).dropDuplicates(["id", "vector"])
    asked = staged(asked.withColumn("length", F.size("vector")), "queries")
    total = asked.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    # the stated queries meet every shard in blocks: a block is one row, sent to each shard
    packed = (
        asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        .groupBy("block", "length")
        .agg(F.collect_list(F.struct("id", "vector")).alias("queries"))
    )
    shards = index.select("shard", "length").distinct()
    pairs = packed.join(shards, "length").join(index.hint("merge"), ["shard", "length"])

    def work(batches):
        for batch in batches:
            for graph_, asked_ in zip(batch["graph"], batch["queries"]):
                graph = Graph.from_bytes(graph_)
                ids = np.array([q["id"] for q in asked_])
                exact = unit_rows([q["vector"] for q in asked_])
                places, _ = graph.search(exact.astype(np.float32), max(beam, k + 2))
                out = []
                for row, found in enumerate(places):
                    found = found[found < len(graph.unit)][: 4 * k]
                    near = graph.unit[found].astype(float) @ exact[row]
                    copies = graph.ids[found]
                    real = (copies >= 0) & (copies != ids[row])
                    where = np.nonzero(real)
                    order = np.lexsort((copies[where], -near[where[0]]))[: 2 * k]
                    out += [(int(ids[row]), int(copies[where][o]), float(near[where[0]][o])) for o in order]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "near"])

    found = pairs.select("graph", "queries").mapInPandas(work, "query_id bigint, vec_id bigint, near double")
    # 2 k from each shard leave room for ties that single precision tells apart wrongly
    few = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    kept = found.distinct().withColumn("n", F.row_number().over(few)).where(F.col("n") <= 4 * k)
    scored = (
        kept.join(rows.select(F.col("id").alias("vec_id"), F.col("vector").alias("v")).dropDuplicates(["vec_id"]), "vec_id")
        .join(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("q")).dropDuplicates(["query_id"]), "query_id")
        .select("query_id", "vec_id", cosine("q", "v").alias("score"))
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def cosine(a: str, b: str):
    """Cosine of two double arrays, summed in order of the parts."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
