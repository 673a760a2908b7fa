"""A Merkle manifest: a hash tree over each group's rows, and one over the groups.

The leaves of a group stand side by side in blocks of ``arity ** levels`` places. Within a block
every row carries the hash of its own ancestor, so the siblings of that ancestor are found a fixed
number of rows before and behind it: one lag and lead column for each slot, masked where the run of
siblings does not reach. The first row of a run hashes the parent, and the rows behind it take it
over. All levels of a block need one shuffle; block roots are the leaves of the next pass, of which
there are log(rows) / levels. Texts are hashed in the scan and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlift.llm.ranks import ranked
from cohortlift.sources.tables import staged

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, LEVELS = 2, 6


def framed(value: Column) -> Column:
    """A value so written that no two rows of values read alike: its byte count, a colon, itself;
    a dash where it is missing."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def climbed(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """(g, pos, n, node, …) with ``node`` raised by up to ``levels`` levels, to the root where a
    group has no more, and ``path``, the left and right siblings met on the way, joined."""
    block = f"pos div {arity**levels}"
    order = W.partitionBy("g", "_block").orderBy("pos")
    until = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df, steps = nodes.withColumn("_block", F.expr(block)), []
    for level in range(levels):
        unit = arity**level
        slot = F.expr(f"pos div {unit} % {arity}")
        count = F.expr(f"(n + {unit - 1}) div {unit}")
        several = count > 1
        run = F.least(F.lit(arity), count - (F.expr(f"pos div {unit}") - slot))
        left = [F.when(slot >= j, F.lag("node", j * unit).over(order)) for j in range(arity - 1, 0, -1)]
        # the last run may end in a sibling of too few rows to reach so far: it holds the last row
        right = [
            F.when(slot + j < run, F.coalesce(F.lead("node", j * unit).over(order), F.last("node").over(whole)))
            for j in range(1, arity)
        ]
        df = df.withColumns({"_l": F.concat_ws("", *left), "_r": F.concat_ws("", *right)})
        first = several & (F.expr(f"pos % {unit * arity}") == 0)
        df = df.withColumn("_up", F.when(first, F.sha2(F.concat("node", "_r"), 256)))
        parent = F.last("_up", ignorenulls=True).over(until)
        step = F.when(several, F.struct(F.col("_l").alias("l"), F.col("_r").alias("r")))
        df = df.withColumns({"node": F.when(several, parent).otherwise(F.col("node")), f"_s{level}": step})
        steps.append(f"_s{level}")
    path = F.array_compact(F.array(*steps)).alias("path")
    return df.select(*nodes.columns, path)


def grown(leaves: DataFrame, arity: int, levels: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Passes over (g, pos, n, node, …) up to the roots: the table of each pass with its blocks,
    and (g, root, pass), one row a group."""
    span, passes, roots = arity**levels, [], None
    nodes = leaves
    while True:
        done = staged(climbed(nodes, arity, levels), f"{name}-pass")
        passes.append(done)
        blocks = F.expr(f"(n + {span - 1}) div {span}")
        ended = done.where((blocks <= 1) & (F.col("pos") == 0))
        ended = ended.select("g", F.col("node").alias("root"), F.lit(len(passes)).alias("pass"))
        roots = ended if roots is None else roots.unionByName(ended)
        nodes = done.where((blocks > 1) & F.expr(f"pos % {span} = 0"))
        nodes = nodes.select("g", F.expr(f"pos div {span}").alias("pos"), blocks.alias("n"), "node")
        if nodes.isEmpty():
            return passes, roots


def lowered(passes: list[DataFrame], tops: DataFrame, span: int) -> DataFrame:
    """The rows of the first pass with the whole path to the root: what ``tops`` (g, pass, path, …)
    says of a group goes to the blocks of the pass that ended it, and from there down, block by
    block, so no join meets more than ``span`` rows of a key."""
    rest = [c for c in tops.columns if c not in ("g", "pass", "path")]
    above = None
    for i in range(len(passes), 0, -1):
        own = tops.where(F.col("pass") == i).select("g", F.lit(0).cast("bigint").alias("_block"), F.col("path").alias("_path"), *rest)
        above = own if above is None else own.unionByName(above)
        joined = passes[i - 1].withColumn("_block", F.expr(f"pos div {span}")).join(above, ["g", "_block"])
        joined = joined.withColumn("path", F.concat("path", "_path")).drop("_path", "_block")
        above = joined.select("g", F.col("pos").alias("_block"), F.col("path").alias("_path"), *rest)
    return joined


def manifest(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "lang",
    fields: Sequence[str] = FIELDS,
    carry: dict[str, Column] | None = None,
    arity: int = ARITY,
    levels: int = LEVELS,
) -> DataFrame:
    """(key, leaf, subroot, root, path, …) for each row of ``docs``: its hash, the root of its
    group, the root over all groups, and the siblings on the way as array<struct<l, r>>, from the
    leaf up; ``carry`` adds columns computed from the row.

    Leaves ascend by key (missing first), rows of one key by their hash; equal rows are leaves of
    their own. A missing group is a group, the first one. While a level has several nodes every
    ``arity`` of them, and the fewer left over, become one. An empty table gives no rows; further
    columns are ignored whatever their names.
    """
    carry = carry or {}
    # a mark before the name sets a missing group apart from an empty one and before it
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"),
        F.col(key).alias("_key"),
        leaf_hash([F.col(f) for f in fields]).alias("leaf"),
        *[c.alias(f"_c_{n}") for n, c in carry.items()],
    )
    placed = ranked(leaves, "g", ["_key", "leaf"], "merkle-leaves").withColumn("node", F.col("leaf"))
    passes, roots = grown(placed, arity, levels, "merkle")
    roots = staged(roots, "merkle-subroots")
    groups = roots.select(F.lit("").alias("g"), F.col("g").alias("_group"), "root", "pass")
    groups = ranked(groups, "g", ["_group"], "merkle-groups")
    groups = groups.select("g", "pos", "n", F.col("root").alias("node"), "_group", F.col("root").alias("subroot"), F.col("pass").alias("_pass"))
    over, root = grown(groups, arity, levels, "merkle-top")
    paths = lowered(over, root.select("g", "pass", F.expr("cast(array() as array<struct<l: string, r: string>>)").alias("path"), "root"), arity**levels)
    tops = staged(paths.select(F.col("_group").alias("g"), F.col("_pass").alias("pass"), "path", "subroot", "root"), "merkle-tops")
    whole = lowered(passes, tops, arity**levels)
    return whole.select(
        F.col("_key").alias(key), "leaf", "subroot", "root", "path", *[F.col(f"_c_{n}").alias(n) for n in carry]
    )


def proof_digest(path: Column | str) -> Column:
    """sha256 of all siblings on a path, from the leaf up, each run from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def folded(leaf: Column, path: Column | str) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


def tamper_report(docs: DataFrame, **options) -> DataFrame:
    """The manifest with each row's proof digest, and whether the row still proves the root after
    one has been added to n_chars where 7 divides the crc32 of the id."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = [F.col("n_chars") + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    rows = manifest(docs, carry={"tampered": F.when(hit, leaf_hash(changed))}, **options)
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), "path"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest("path").alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
