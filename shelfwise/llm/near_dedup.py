"""Near-duplicates by b-bit MinHash.

1. One pass gives every text the fingerprint of its set of word windows and the minima of its MinHashes; of these the low eight bits
   are kept and packed, and a hash of every band. Equal sets are one class, of which one row goes on.
2. Classes with an equal band meet in a bucket. Buckets are cut into blocks, and pairs of blocks are compared in tasks: similarities are
   estimated by bit counts and corrected for chance collisions, what may reach the threshold is confirmed on the full sets, and a
   spanning forest of the links goes out, never all pairs. A bucket whose members are in one component already is not compared.
3. Buckets of several blocks are compared block by block with themselves and with their first block. When all bands have been through
   that, every member outside a bucket's largest component meets all members, so no link between components is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.cells import WHITE_LOWER, Slice, distinct_in_text, hashes, mixed, slices, small_batches, windows, without_rows, words
from shelfwise.llm.components import components
from shelfwise.sources.staging import stage

SIGNATURE = "row long, doc_id long, n_shingles long, set_a long, set_b long, signature binary, bands array<long>"
#: Minima are taken over stretches of so many shingles, which stay in a core's cache.
STRETCH = 1 << 16
#: A block has about so many sets and shingles; incidence matrices are multiplied so many columns at a time.
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 1024, 600_000, 4096
#: Bands are compared in steps that begin with band 0 and these.
STEPS = (2, 8)
#: At most so many row numbers are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def shingle_sets(part: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of every text's word windows and the texts' bounds among them."""
    found = words(part, WHITE_LOWER)
    own = hashes(found.vocabulary)[found.ids] if len(found.ids) else np.zeros(0, np.uint64)
    return distinct_in_text(*windows(own, found.bounds, size))


def minima(values: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """``count`` MinHashes of every set, as rows of 32-bit numbers; sets must not be empty."""
    rng = np.random.default_rng(20240229)
    factors = rng.integers(0, 2**31, count, np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 2**32, count, np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, count), np.uint32)
    low = 0
    while low < len(bounds) - 1:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + STRETCH, "right")) - 1)
        own = short[bounds[low]:bounds[high]]
        at = bounds[low:high] - bounds[low]
        for k in range(count):
            out[low:high, k] = np.minimum.reduceat((own ^ shifts[k]) * factors[k], at)
        low = high
    return out


def set_sums(values: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit number of every set: equal sets have equal sums."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values ^ np.uint64(seed)), dtype=np.uint64)])
        return total[bounds[1:]] - total[bounds[:-1]]


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``SIGNATURE`` of every text: set size, set fingerprint, the low eight bits of all minima, and a hash of every band's minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                values, bounds = shingle_sets(part, size)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                low = minima(values, np.append(bounds[:-1][full], bounds[-1]), bands * rows)
                packed_ = (low & np.uint32(255)).astype(np.uint8)
                keys = np.zeros((len(full), bands), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, r::rows][:, :bands] + np.arange(bands, dtype=np.uint64) * np.uint64(1 << 40))
                has = np.zeros(len(part), bool)
                has[full] = True
                at = np.cumsum(has) - 1
                blobs = pa.array([packed_[k].tobytes() if h else None for k, h in zip(at, has, strict=True)], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has) * bands]), pa.int32()), pa.array(keys.view(np.int64).ravel()))
                span = slice(part.first, part.first + len(part))
                columns = [batch.column(0)[span], batch.column(1)[span], pa.array(sizes), pa.array(set_sums(values, bounds, 1).view(np.int64)), pa.array(set_sums(values, bounds, 2).view(np.int64)), blobs, lists]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SIGNATURE.split(", ")])

    return docs.select("row", "doc_id", "text").mapInArrow(run, SIGNATURE)


@dataclass(frozen=True)
class Rule:
    """Two sets are linked if ``den * intersection >= num * union``; bands of ``rows`` minima find candidates.

    At the threshold, all bands miss a pair with a probability of ``(1 - t ** rows) ** bands``: 4e-7 for the two rules below.
    """

    num: int
    den: int
    bands: int
    rows: int
    size: int = 5

    @property
    def cutoff(self) -> float:
        """Pairs of a lower estimate are not looked at: six standard deviations below the threshold."""
        t = self.num / self.den
        return t - 6 * math.sqrt(t * (1 - t) / (self.bands * self.rows))


AT_85 = Rule(85, 100, 25, 5)
AT_80 = Rule(80, 100, 28, 4)


# -- links between the members of a group -------------------------------------------------------------------------------------


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarities of all rows of two matrices of packed eight-bit minima, from bit counts and corrected for chance collisions."""
    pad = -left.shape[1] % 8
    a, b = (np.ascontiguousarray(np.pad(m, ((0, 0), (0, pad)))).view(np.uint64) for m in (left, right))
    other = np.zeros((len(a), len(b)), np.int32)
    ones = np.uint64(0x0101010101010101)
    for k in range(a.shape[1]):
        x = a[:, k, None] ^ b[None, :, k]
        for shift in (4, 2, 1):
            x |= x >> np.uint64(shift)
        other += np.bitwise_count(x & ones)
    chance = 1 / 256
    return ((1 - other / left.shape[1]) - chance) / (1 - chance)


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, as products of incidence matrices of their common elements."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.int64)

    def cells(values: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        hit = common[at] == values
        return owner[hit], at[hit]

    if not len(common):
        return out
    (row_a, col_a), (row_b, col_b) = cells(a, left), cells(b, right)
    for low in range(0, len(common), COLUMNS):
        dense = []
        for rows, columns, n in ((row_a, col_a, len(left)), (row_b, col_b, len(right))):
            own = (columns >= low) & (columns < low + COLUMNS)
            m = np.zeros((n, min(COLUMNS, len(common) - low)), np.float32)
            m[rows[own], columns[own] - low] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def linked_labels(rule: Rule, labels: np.ndarray, sizes: np.ndarray, signature: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, over labels, of all links between members of the left and the right side that have different labels."""
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    small, large = np.minimum(sizes[left][:, None], sizes[right]), np.maximum(sizes[left][:, None], sizes[right])
    open_ = (labels[left][:, None] != labels[right]) & (rule.den * small >= rule.num * large)
    if not open_.any():
        return []
    open_ &= estimates(signature[left], signature[right]) >= rule.cutoff
    rows, columns = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    if not len(rows):
        return []
    left, right, open_ = left[rows], right[columns], open_[np.ix_(rows, columns)]
    met = intersections([sets[i] for i in left], [sets[i] for i in right])
    linked = open_ & ((rule.den + rule.num) * met >= rule.num * (sizes[left][:, None] + sizes[right]))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest, most = [], len(np.unique(np.concatenate([labels[left], labels[right]]))) - 1
    a, b = np.nonzero(linked)
    for x, y in zip(labels[left[a]].tolist(), labels[right[b]].tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            forest.append((x, y))
            if len(forest) == most:
                break
    return forest


def links(groups: DataFrame, rule: Rule) -> DataFrame:
    """Edges ``a, b`` between labels from rows ``key, i, j, side, label, n_shingles, signature, set``; a group has two blocks at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            sets = t.column("set").combine_chunks()
            bounds, values = sets.offsets.to_numpy(), sets.values.to_numpy()
            signature = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(len(t), -1)
            forest = linked_labels(rule, t.column("label").to_numpy(), t.column("n_shingles").to_numpy(), signature, [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], t.column("side").to_numpy())
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in forest], pa.int64()) for k in (0, 1)], ["a", "b"])

        last = None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [batch.num_rows]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                own = tuple(keys[:, a])
                if held and own != last:
                    yield close()
                    held = []
                held.append(batch.slice(a, b - a))
                last = own
        if held:
            yield close()

    dealt = groups.select("key", "i", "j", "side", "label", "n_shingles", "signature", "set").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


# -- groups: bands, buckets, blocks -------------------------------------------------------------------------------------------


def shingle_table(docs: DataFrame, needed: DataFrame, size: int, small: bool) -> DataFrame:
    """``rep, set`` of the rows that ``needed`` names: the full sets, from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                values, bounds = shingle_sets(part, size)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.first:part.first + len(part)], lists], ["rep", "set"])

    wanted = needed.select(F.col("rep").alias("row"))
    return docs.select("row", "text").join(F.broadcast(wanted) if small else wanted, "row", "left_semi").mapInArrow(run, "rep long, set array<long>")


def open_buckets(members: DataFrame) -> DataFrame:
    """``key, m, weight`` of buckets whose members have different labels; of buckets with the same members, one stays."""
    buckets = members.groupBy("key").agg(
        F.count("*").alias("m"), F.sum("n_shingles").alias("weight"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), F.min("label").alias("low"), F.max("label").alias("high"),
    )
    return buckets.filter("low < high").groupBy("m", "x", "y", "weight").agg(F.min("key").alias("key")).select("key", "m", "weight")


def block_of(count: Column, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64("rep", F.lit(salt)), count).cast("int")


def blocks(m: Column, weight: Column) -> Column:
    return F.greatest(F.ceil(m / BLOCK_ROWS), F.ceil(weight / BLOCK_SHINGLES)).cast("int")


def triple(i: Column, j: Column, side: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))


def first_groups(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """Every block of a bucket with itself, and the first block with every other."""
    held = members.join(buckets.withColumn("count", blocks(F.col("m"), F.col("weight"))), "key").withColumn("block", block_of(F.col("count")))
    zero, own = F.lit(0), F.col("block")
    later = F.transform(F.sequence(F.lit(1), F.greatest(F.col("count") - 1, F.lit(1))), lambda j: triple(zero, j, F.lit(1)))
    places = F.when(own > 0, F.array(triple(own, own, F.lit(3)), triple(zero, own, F.lit(2)))).when(F.col("count") > 1, F.concat(F.array(triple(zero, zero, F.lit(3))), later)).otherwise(F.array(triple(zero, zero, F.lit(3))))
    return held.withColumn("place", F.explode(places)).select("key", "place.*", "rep", "label", "n_shingles")


def rest_groups(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """What is left of buckets of several blocks: every member outside the bucket's largest component against all members."""
    large = members.join(buckets.withColumn("count", blocks(F.col("m"), F.col("weight"))).filter("count > 1"), "key")
    parts = large.groupBy("key", "count", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    main = parts.groupBy("key", "count").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("m"), F.sum("w").alias("weight"), F.count("*").alias("labels")).filter("labels > 1")
    left_out = parts.join(main.select("key", "main"), "key").filter(F.col("label") != F.col("main.label")).groupBy("key").agg(blocks(F.sum("n"), F.sum("w")).alias("outside"))
    held = members.join(main.join(left_out, "key").select("key", "count", "outside", F.col("main.label").alias("main")), "key")
    # Block numbers of the members outside, and of all members.
    right = held.withColumn("j", block_of(F.col("count"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("outside") - 1))).withColumn("side", F.lit(2))
    left = held.filter("label != main").withColumn("i", block_of(F.col("outside"), 1)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("count") - 1))).withColumn("side", F.lit(1))
    names = ["key", "i", "j", "side", "rep", "label", "n_shingles"]
    return left.select(*names).unionByName(right.select(*names))


def near_groups(docs: DataFrame, rule: Rule = AT_85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, n_shingles, component_id, kept`` of every row.

    Documents are linked if the similarity of their sets of distinct word windows reaches the rule's threshold; a component's id is its
    smallest document id (a null id is the largest), and its first row with that id is kept. Texts with fewer words than a window have one
    window; null texts and texts without words have none and are alone. ``docs`` is a file scan or another plan with stable row numbers; ids may
    repeat, other columns are ignored, and an empty table gives no rows.
    """
    base = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    signed = stage(signatures(base, rule.size, rule.bands, rule.rows))
    # Equal sets are one class from here on.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = stage(signed.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("row").alias("rep"), first))
    banded = signed.join(classes.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), "n_shingles", F.posexplode("bands").alias("band", "key"))
    crowded = banded.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    banded = stage(banded.join(crowded, "key", "left_semi"))
    needed = stage(banded.select("rep").distinct())
    small = needed.count() <= BROADCAST_ROWS
    sets = stage(shingle_table(base, needed, rule.size, small))
    signs = signed.select(F.col("row").alias("rep"), "signature").join(F.broadcast(needed) if small else needed, "rep", "left_semi")
    content = stage(sets.join(signs, "rep"))
    labels = stage(needed.select("rep", F.col("rep").alias("label")))

    def merged(groups: DataFrame, labels: DataFrame) -> DataFrame:
        edges = stage(links(groups.join(content, "rep"), rule))
        if edges.isEmpty():
            return labels
        found = components(edges).withColumnRenamed("label", "root")
        return stage(labels.join(found, F.col("label") == F.col("node"), "left").select("rep", F.coalesce("root", "label").alias("label")))

    # Few bands at first: what they join needs no second look in the many bands that follow.
    for low, high in zip((0, *STEPS), (*STEPS, rule.bands), strict=True):
        own = banded.filter(F.col("band").between(low, high - 1)).select("key", "rep", "n_shingles")
        members = own.join(labels, "rep")
        buckets = stage(open_buckets(members))
        if buckets.isEmpty():
            continue
        labels = merged(first_groups(members, buckets), labels)
    # By now components have grown as far as such steps let them, and few members stand outside.
    members = banded.select("key", "rep", "n_shingles").join(labels, "rep")
    buckets = stage(open_buckets(members).filter(blocks(F.col("m"), F.col("weight")) > 1))
    if not buckets.isEmpty():
        labels = merged(stage(rest_groups(members, buckets)), labels)

    named = classes.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    heads = named.groupBy("label").agg(F.min("first").alias("head"))
    answer = stage(named.join(heads, "label").select("set_a", "set_b", "n_shingles", "head"))
    rows = signed.select("row", "doc_id", "n_shingles", "set_a", "set_b")
    joined = rows.join(answer, ["set_a", "set_b", "n_shingles"], "left")
    return joined.select("row", "doc_id", "n_shingles", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"), (F.col("head").isNull() | (F.col("row") == F.col("head.row"))).alias("kept"))


def drop_near_copies(docs: DataFrame, rule: Rule = AT_80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of every component; all columns stay."""
    return without_rows(docs, near_groups(docs, rule, id_col, text_col).filter(~F.col("kept")))
