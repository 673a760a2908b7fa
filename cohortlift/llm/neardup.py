"""Near duplicates by MinHash bands, odd sketches and full sets (operator 10).

1. Every document becomes the set of its word shingles. Documents with equal sets form one class,
   which its smallest id stands for from here on.
2. MinHash samples of the set give bands, whose equality proposes pairs, and an odd sketch: the
   samples are folded into a bitmap of parities, so that the bits in which two bitmaps differ
   estimate how many samples differ, precisely where similarities are high.
3. In every band bucket each class is paired with the bucket's smallest one. Pairs whose sketches
   allow the wanted similarity are confirmed on the full sets. In a group of copies this links
   nearly all members with one pair each.
4. Buckets in which classes of different components remain are dealt to blocks. A block compares
   sketches, confirms on the full sets and returns no more links than it takes to join what belongs
   together; buckets of several blocks that are still mixed then do so for every pair of blocks.
5. Links and classes give the components.

Nothing is capped: a bucket of any size is covered by its blocks. Sets are held as sorted 64-bit
shingle fingerprints.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.components import components
from cohortlift.llm.scan import NONBLANK, Words, mix, shingle_hashes, slices
from cohortlift.sources.tables import staged

BANDS, ROWS = 24, 4  # a pair at 0.85 shares no band once in 5e7 pairs, at 0.8 once in 3e5
SAMPLES = 192
SKETCH_BITS = 512
BLOCK = 512  # members of a bucket in one block


@dataclass(frozen=True)
class Plan:
    """How documents become sets and how similar sets must be."""

    shingle: int = 5
    percent: int = 80  # link if 100 * intersection >= percent * union


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    grown = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = (grown & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return low[:SAMPLES] | np.uint32(1), low[SAMPLES:]


def minhash(members: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest of each sample's permutation of the members, in blocks of bounded size."""
    times, plus = seeds
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    short = (members >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 2048):
        part = short[i : i + 2048]
        np.minimum(out, ((part[None, :] ^ plus[:, None]) * times[:, None]).min(axis=1), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> bytes:
    """Parity of the samples that fall on each bit."""
    key = mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)))
    counts = np.bincount((key % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def most_different_bits(percent: int) -> int:
    """Bits in which the sketches of a pair at the wanted similarity stay, but for six deviations.

    With d differing samples about 2d points fall on the bitmap, each flipping a bit.
    """
    p = percent / 100
    differ = SAMPLES * (1 - p) + 6 * (SAMPLES * p * (1 - p)) ** 0.5
    if differ >= SAMPLES:
        return SKETCH_BITS
    mean = SKETCH_BITS / 2 * (1 - np.exp(-4 * differ / SKETCH_BITS))
    return int(mean + 6 * mean**0.5) + 1


def profiles(docs: DataFrame, plan: Plan, sets: bool = False) -> DataFrame:
    """(id, n_shingles, class key, bands, sketch) of each document, or (id, members) for ``sets``."""
    size = plan.shingle

    def run(batches):
        seeds = _seeds()
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"), NONBLANK)
            hashes, first = words.hashes, words.first
            own = [
                np.unique(shingle_hashes(hashes[first[i] : first[i + 1]], size)) for i in range(batch.num_rows)
            ]
            if sets:
                columns = [batch.column("id"), pa.array([m.tobytes() for m in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "members"])
                continue
            keys, bands, sketches = [], [], []
            for m in own:
                if not len(m):
                    keys.append(None)
                    bands.append([])
                    sketches.append(None)
                    continue
                keys.append(hashlib.blake2b(m.tobytes(), digest_size=16).digest())
                samples = minhash(m, seeds)
                rows = samples[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
                key = np.arange(BANDS, dtype=np.uint64)
                for j in range(ROWS):
                    key = mix(key * np.uint64(0x9FB21C651E98DF25) + rows[:, j])
                bands.append(key.view(np.int64).tolist())
                sketches.append(odd_sketch(samples))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(m) for m in own], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()),
                ],
                names=["id", "n_shingles", "key", "bands", "sketch"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    if sets:
        return docs.mapInArrow(run, f"id {kind}, members binary")
    return docs.mapInArrow(run, f"id {kind}, n_shingles bigint, key binary, bands array<bigint>, sketch binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketch_filter(pairs: DataFrame, reps: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) whose sizes and odd sketches allow the wanted similarity."""
    most, percent = most_different_bits(plan.percent), plan.percent

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(n, -1) for c in ("sa", "sb")
            )
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = np.bitwise_count(a ^ b).sum(axis=1) <= most
            keep &= 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    right = reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    kind = reps.schema["rep"].dataType.simpleString()
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(
        run, f"a {kind}, b {kind}"
    )


def _confirm(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) that are linked on their full sets."""
    percent = plan.percent

    def run(batches):
        for batch in batches:
            sides = zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist())
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sides]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("ma"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("mb"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "ma", "mb")
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _block_links(rows: DataFrame, plan: Plan) -> DataFrame:
    """Links between components: between those of one block, or of each pair of blocks of a bucket."""
    most, percent = most_different_bits(plan.percent), plan.percent
    kind = rows.schema["rep"].dataType.simpleString()

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep", kind="stable")
        first, second = int(frame["low"].iloc[0]), int(frame["high"].iloc[0])
        block = frame["block"].to_numpy()
        left = np.flatnonzero(block == first)
        right = left if first == second else np.flatnonzero(block == second)
        sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint64).reshape(len(frame), -1)
        size = frame["n_shingles"].to_numpy()
        parent = {c: c for c in frame["component"]}
        own = frame["component"].tolist()
        members = frame["members"].tolist()

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        out = []
        for i in left:
            differ = np.bitwise_count(sketch[right] ^ sketch[i]).sum(axis=1)
            near = (differ <= most) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]))
            for j in right[near]:
                if j <= i and first == second:
                    continue
                x, y = root(own[i]), root(own[j])
                if x != y and linked(np.frombuffer(members[i], np.uint64), np.frombuffer(members[j], np.uint64), percent):
                    parent[x] = y
                    out.append((own[i], own[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.groupBy("bucket", "low", "high").applyInPandas(work, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document.

    Linked are documents whose shingle sets meet 100 * intersection >= percent * union; the
    component is the smallest id reachable. Texts of fewer words than a shingle are one shingle;
    texts without words, empty or null have none and are linked with nothing. Rows that share an
    id are one document, linked by any of its texts, and each row is returned. Rows with a null
    id are returned unlinked. Further columns are ignored whatever their names.
    """
    plan = Plan(shingle, percent)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shape = staged(profiles(texts, plan), "near-profiles")
    full = shape.where("key is not null and id is not null")
    # classes of equal sets: one row each, folded on the map side
    classes = full.groupBy("key").agg(F.min("id").alias("rep"))
    first = full.join(classes, "key")
    reps = staged(
        first.where("id = rep").dropDuplicates(["key"]).select("rep", "n_shingles", "sketch", "bands"), "near-classes"
    )
    # buckets of two or more classes, and in each the pair with its smallest class
    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    lowest = rows.groupBy("bucket").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1")
    rows = staged(rows.join(lowest.hint("merge"), "bucket"), "near-buckets")
    pairs = rows.where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = staged(_sketch_filter(pairs, reps, plan), "near-pairs")
    wanted = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id")))
    crowded = rows.where("n > 2 and rep <> low")
    wanted = wanted.unionAll(crowded.select(F.col("rep").alias("id"))).distinct()
    sets = staged(profiles(texts.join(wanted, "id", "left_semi"), plan, sets=True), "near-sets")
    links = staged(_confirm(pairs, sets, plan), "near-links")
    labels = staged(_relabelled(reps.select("rep", F.col("rep").alias("component")), components(links)), "near-labels")

    # what the pairs with the smallest class could not settle: first inside blocks, then across
    shapes = reps.select("rep", "n_shingles", "sketch").join(sets.select(F.col("id").alias("rep"), "members"), "rep")
    inside = _mixed(crowded, labels).withColumn("high", F.col("block")).withColumnRenamed("block", "low")
    inside = inside.withColumn("block", F.col("low")).join(shapes, "rep")
    labels = staged(_relabelled(labels, components(_block_links(inside, plan))), "near-labels")
    across = staged(_mixed(crowded.where(F.col("n") > BLOCK), labels), "near-across")
    if not across.isEmpty():
        spread = across.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        spread = spread.where("block <> other").select(
            "bucket", "rep", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
        )
        labels = staged(_relabelled(labels, components(_block_links(spread.join(shapes, "rep"), plan))), "near-labels")
    known = first.select("id", "rep").distinct().join(labels, "rep").groupBy("id").agg(F.min("component").alias("component"))
    out = shape.select("id", "n_shingles").join(known, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (component == F.col("id")).alias("kept")
    )


def _relabelled(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """(rep, component) after components have been joined to smaller ones."""
    both = labels.join(moved.withColumnRenamed("component", "lower"), F.col("component") == F.col("node"), "left")
    return both.select("rep", F.coalesce("lower", "component").alias("component"))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, each dealt to one block of its bucket."""
    known = members.select("bucket", "rep").join(labels, "rep")
    mixed = known.groupBy("bucket").agg(
        F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n")
    )
    mixed = mixed.where("c0 <> c1").select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    return known.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
