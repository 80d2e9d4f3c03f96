"""Merkle manifest of a table: a tree per key, a tree over their roots, and a proof for every row.

Leaves are numbered in Spark, inner nodes are hashed in blocks of neighbouring nodes, and proofs come from pointer jumping: a node
holds the siblings on its way to an ancestor and that ancestor; joining the nodes with themselves appends the ancestor's siblings to
the node's and doubles the distance, until every leaf has reached the root. All of it is Spark's own expressions.

Join sizes. In round k the ancestors lie on every 2**k-th level, so a node is asked for by at most 2**(2**k) leaves, and the nodes that can
be asked for are that much fewer than the leaves: where many leaves ask for one node the table of nodes is small enough for a broadcast,
which the planner decides by the staged table's size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.ordering import positions, staged
from shelfwise.sources.staging import stage

#: A block has 2 ** so many neighbouring nodes; its part of the tree is hashed in one row.
BLOCK_BITS = 10
#: The number of the tree over the trees.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """Length in bytes, colon and value, so that no two rows read the same; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(values: Sequence[Column]) -> Column:
    """Lowercase hexadecimal SHA-256 of a row's fields."""
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def parents(nodes: Column) -> Column:
    """Digests one level up: of every two neighbours, or of the last one alone."""
    pair = lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))), 256)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), pair)


def block_levels(leaves: Column, whole: Column) -> Column:
    """The levels above the leaves of a block, the leaves first: ``BLOCK_BITS`` of them, or up to the root if the block is the whole tree."""
    def up(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        return F.when(whole & (F.size(last) == 1), levels).otherwise(F.concat(levels, F.array(parents(last))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(BLOCK_BITS)), F.array(leaves), up)


def siblings(level: Column) -> Column:
    """Per node of a block's level, the sibling to its left and to its right as bytes, empty where there is none."""
    nothing = F.lit(b"")

    def both(_: Column, i: Column) -> Column:
        before = F.when(i % 2 == 1, F.unhex(F.get(level, i - 1)))
        after = F.when(i % 2 == 0, F.unhex(F.get(level, i + 1)))
        return F.struct(F.coalesce(before, nothing).alias("before"), F.coalesce(after, nothing).alias("after"))

    return F.transform(level, both)


def grow(frontier: DataFrame, largest: int) -> tuple[DataFrame, DataFrame]:
    """All nodes below the roots, ``tree, height, level, idx, steps``, and the roots, ``tree, root``.

    ``frontier`` has the leaves of trees of two leaves or more, ``tree, height, n, idx, digest``; ``largest`` is the greatest ``n``. A round
    shuffles one row per node of every ``BLOCK_BITS``-th level, and a block's row is bounded, however many leaves one tree has.
    """
    nodes = roots = None
    base = 0
    while nodes is None or largest > 1:
        whole = F.col("n") <= 1 << BLOCK_BITS
        own = F.sort_array(F.collect_list(F.struct("idx", "digest")))["digest"]
        blocks = frontier.groupBy("tree", "height", "n", F.shiftright("idx", BLOCK_BITS).alias("block")).agg(own.alias("own"))
        blocks = stage(blocks.select("tree", "height", "n", "block", block_levels(F.col("own"), whole).alias("levels")))
        by_level = blocks.select("tree", "height", "block", F.posexplode(F.slice("levels", 1, F.size("levels") - 1)).alias("up", "level"))
        own_nodes = by_level.select("tree", "height", "block", "up", F.posexplode(siblings(F.col("level"))).alias("at", "step"))
        first = F.col("block") * F.expr(f"shiftleft(1L, {BLOCK_BITS} - up)")
        own_nodes = own_nodes.select("tree", "height", (F.col("up") + base).alias("level"), (first + F.col("at")).alias("idx"), F.array("step").alias("steps"))
        tops = blocks.select("tree", "height", F.ceil(F.col("n") / (1 << BLOCK_BITS)).alias("n"), F.col("block").alias("idx"), F.element_at("levels", -1)[0].alias("digest"))
        own_roots = tops.filter("n = 1").select("tree", F.col("digest").alias("root"))
        nodes = own_nodes if nodes is None else nodes.unionByName(own_nodes)
        roots = own_roots if roots is None else roots.unionByName(own_roots)
        frontier, base, largest = tops.filter("n > 1"), base + BLOCK_BITS, -(-largest >> BLOCK_BITS)
    return nodes, roots


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def jump(nodes: DataFrame, depth: int) -> DataFrame:
    """``tree, level, idx, steps`` of every leaf, with the steps of its whole way to the root.

    ``nodes`` have one step each and their parent as ``up_tree, up_level, up_idx`` (null below the root); ``depth`` is the longest way.
    Round k keeps the nodes of every 2**k-th level, which are all that a leaf can point to. Nodes that have reached the root are not joined again.
    """
    key = ["tree", "level", "idx"]
    table, drop = staged(nodes)
    distance = 1
    while distance < depth:
        last = 2 * distance >= depth
        reach = table.filter((F.col("tree") == TOP) | ((F.col("level") > 0) & (F.col("level") % distance == 0)))
        met = reach.select(*(F.col(c).alias(f"met_{c}") for c in [*key, "up_tree", "up_level", "up_idx", "steps"]))
        kept = table.filter((F.col("level") == 0) if last else (F.col("tree") == TOP) | (F.col("level") % (2 * distance) == 0))
        ahead = kept.filter("up_tree is not null").join(met, [F.col(f"up_{c}") == F.col(f"met_{c}") for c in key], "left")
        longer = F.concat("steps", F.coalesce("met_steps", F.array().cast(table.schema["steps"].dataType)))
        ahead = ahead.select(*key, *(F.col(f"met_up_{c}").alias(f"up_{c}") for c in key), longer.alias("steps"))
        old = drop
        table, drop = staged(ahead.unionByName(kept.filter("up_tree is null")))
        old()
        distance *= 2
    return table.filter("level = 0").select(*key, "steps")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(F.lower(F.hex(s["before"])), h, F.lower(F.hex(s["after"]))), 256))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of all siblings on the way, level by level."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.lower(F.concat(F.hex(s["before"]), F.hex(s["after"])))), ""), 256)


def manifest(rows: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", tree: str = "lang", also: Mapping[str, Column] | None = None) -> DataFrame:
    """A proof per row: ``key``, ``tree``, ``leaf, subroot, root, steps`` and the columns of ``also``, which are computed where the rows are read.

    Per value of ``tree`` (null is one of its own) the leaves ascend by ``key``, nulls first, rows of equal key by their digests; repeated rows
    are leaves of their own. The trees' roots ascend by ``tree``, null first, then by bytes. A tree of one leaf has that leaf as its root; then its
    steps begin in the upper tree, and a table of one row has a root equal to its leaf and no steps. Null and empty fields differ, texts are hashed
    whole, other columns of ``rows`` are not read, an empty table gives no rows.
    """
    also = dict(also or {})
    leaves = rows.select(F.col(key).alias("key"), F.col(tree).cast("string").alias("name"), digest([F.col(c) for c in fields]).alias("leaf"), *(c.alias(f"also_{n}") for n, c in also.items()))
    leaves = positions(leaves, ["name", "key", "leaf"], "place")
    trees = positions(leaves.groupBy("name").agg(F.min("place").alias("start"), F.count("*").alias("n")), ["start"], "tree")
    trees = stage(trees.withColumn("height", height(F.col("n"))))
    bounds = trees.agg(F.count("*").alias("trees"), F.max("n").alias("n"), F.max("height").alias("height")).first()
    width, upper = bounds["trees"], max(bounds["trees"] - 1, 0).bit_length()
    own = trees.select(F.col("name").alias("tree_name"), "tree", "start", "n", "height")
    leaves = stage(leaves.join(own, F.col("name").eqNullSafe(F.col("tree_name"))).withColumn("idx", F.col("place") - F.col("start")).drop("tree_name", "place", "start"))

    grown, subroots = grow(leaves.filter("n > 1").select("tree", "height", "n", "idx", F.col("leaf").alias("digest")), bounds["n"] or 0)
    subroots = stage(subroots.unionByName(leaves.filter("n = 1").select("tree", F.col("leaf").alias("root"))))
    lower = grown.withColumn("inside", F.col("level") + 1 < F.col("height"))
    parent = lambda inside, up: F.when(F.col("inside"), inside).otherwise(up)
    nodes = lower.select(
        "tree", "level", "idx", "steps", parent(F.col("tree"), F.lit(TOP).cast("long")).alias("up_tree"),
        parent(F.col("level") + 1, F.lit(0)).alias("up_level"), parent(F.shiftright("idx", 1), F.col("tree")).alias("up_idx"),
    )
    if width > 1:
        top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(upper).alias("height"), F.lit(width).cast("long").alias("n"), F.col("tree").alias("idx"), F.col("root").alias("digest"))
        above, roots = grow(top, width)
        inside = F.col("level") + 1 < F.col("height")
        above = above.select("tree", "level", "idx", "steps", F.when(inside, F.col("tree")).alias("up_tree"), F.when(inside, F.col("level") + 1).alias("up_level"), F.when(inside, F.shiftright("idx", 1)).alias("up_idx"))
        nodes = nodes.unionByName(above)
    else:
        roots = subroots
    root = roots.first()
    ways = jump(nodes, (bounds["height"] or 0) + upper).withColumnRenamed("steps", "found")
    lone = F.col("n") == 1
    at = leaves.withColumn("at_tree", F.when(lone, F.lit(TOP)).otherwise(F.col("tree"))).withColumn("at_idx", F.when(lone, F.col("tree")).otherwise(F.col("idx")))
    ways = ways.select(F.col("tree").alias("way_tree"), F.col("idx").alias("way_idx"), "found")
    met = at.join(ways, (F.col("at_tree") == F.col("way_tree")) & (F.col("at_idx") == F.col("way_idx")), "left").join(subroots.select("tree", F.col("root").alias("subroot")), "tree")
    none = F.array().cast(nodes.schema["steps"].dataType)
    return met.select(
        F.col("key").alias(key), F.col("name").alias(tree), "leaf", "subroot", F.lit(root["root"] if root else None).cast("string").alias("root"), F.coalesce("found", none).alias("steps"),
        *(F.col(f"also_{n}").alias(n) for n in also),
    )


def tamper_check(rows: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of documents of which about a seventh count one character too many.

    A row is tampered with where 7 divides the CRC-32 of its decimal id (a null id never) and ``n_chars`` is not null; its proof is the original's.
    """
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    changed = F.when(chosen, digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]))
    proofs = manifest(rows, also={"changed": changed}).withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("steps")))
    return proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
