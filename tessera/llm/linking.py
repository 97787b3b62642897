"""Links among candidates: from an index (key, node) to the components of sets that are alike.

Two nodes are candidates if they share a key. Nodes are first compared with one leader each, the
best of their keys' leaders; this settles most near copies. What is left is split in two: pairs
of nodes with the same leader, and pairs that share a key and have different leaders; either is a
group of nodes around a leader. A group whose nodes are of one component is done. In the others, the
nodes outside of the group's largest component are compared with all its nodes, in blocks, by bit
maps of their sets: a token toggles one bit, so the bits in which two maps differ are no more than
the tokens in which the sets differ, and a pair with too many is no link for certain. Only pairs that
pass are compared by whole sets: first a few of each two components, then, in groups that had more
and still have several components, all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, release
from tessera.llm.components import components
from tessera.llm.words import give_back

#: Rows of the smaller side that are broadcast after a count; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Members of a leader that one task compares; more are dealt over several.
MEMBERS_PER_TASK = 2_000
#: Nodes of a block, and pairs of each two components that are compared first.
BLOCK, FIRST = 4_096, 8
#: 64-bit words of a bit map at most, and words that are in memory at once while maps are compared.
MOST_WORDS, COMPARED = 1 << 10, 1 << 21
#: Pairs that a task gathers before it keeps the first of each two components only.
KEPT = 1 << 18


def counted_hint(some: DataFrame) -> DataFrame:
    """For broadcast if it is small, counted first."""
    return F.broadcast(some) if some.count() <= BROADCAST_ROWS else some


def like_size(percent: int, a: str = "n", b: str = "other_n") -> Column:
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (leader, node) whose sets link.

    A leader's row comes first in each task that has members of it; members are read one batch
    after another. A leader with many members is dealt over several tasks.
    """
    many = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > MEMBERS_PER_TASK)
    many = materialise(many, "leaders")
    if many.limit(1).count():
        shares = F.coalesce(F.ceil(F.col("members") / MEMBERS_PER_TASK), F.lit(1)).cast("int")
        dealt = pairs.join(counted_hint(many), "leader", "left").withColumn("share", F.pmod(F.hash("node"), shares))
    else:
        dealt = pairs.withColumn("share", F.lit(0))
    members = dealt.select("leader", "share", "node", F.lit(1).alias("turn"))
    leaders = members.select("leader", "share").distinct().select("leader", "share", F.col("leader").alias("node"), F.lit(0).alias("turn"))
    rows = members.unionByName(leaders).join(sets, "node")
    ordered = rows.repartition("leader", "share").sortWithinPartitions("leader", "share", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, []
        for batch in batches:
            out = []
            for a, b, turn, raw in zip(*(batch.column(c).to_pylist() for c in ("leader", "node", "turn", "set")), strict=True):
                mine = np.frombuffer(raw, np.uint64)
                if not turn:
                    own = [mine, *own] if a == leader else [mine]  # a node has several sets at most if its identifier was repeated
                    leader = a
                elif any(linked(x, mine, percent) for x in own):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
        give_back()

    return ordered.mapInArrow(run, "a long, b long")


def map_words(n: int) -> int:
    """64-bit words of the bit map of n tokens: a power of two, two to four bits a token up to MOST_WORDS."""
    return min(MOST_WORDS, 1 << max(0, (2 * n - 1).bit_length() - 6))


def bit_map(tokens: np.ndarray) -> np.ndarray:
    """The parity of the tokens that fall on each bit."""
    bits = map_words(len(tokens)) * 64
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Maps of so many words: bits of equal place modulo the length add up."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


def _maps(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, bits of the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(raw, np.uint64) for raw in batch.column("set").to_pylist()]
            columns = [batch.column("node"), pa.array([len(s) for s in own], pa.int64()), pa.array([bit_map(s).tobytes() for s in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "bits"])
        give_back()

    return sets.join(counted_hint(nodes), "node", "left_semi").select("node", "set").mapInArrow(run, "node long, n long, bits binary")


class Maps:
    """Nodes with their components, sizes and bit maps, by length of the maps."""

    def __init__(self, nodes: list[int], parts: list[int], sizes: list[int], bits: list[bytes]):
        by_words: dict[int, list[int]] = {}
        for i, raw in enumerate(bits):
            by_words.setdefault(len(raw) // 8, []).append(i)
        arrays = [np.array(c, np.int64) for c in (nodes, parts, sizes)]
        self.of = {}
        for words, at in by_words.items():
            some = np.array(at)[np.argsort(arrays[2][at], kind="stable")]
            maps = np.frombuffer(b"".join(bits[i] for i in some), np.uint64).reshape(-1, words)
            self.of[words] = (*(a[some] for a in arrays), maps)


def passing(queries: Maps, targets: Maps, percent: int) -> Iterator[np.ndarray]:
    """Rows (node, component, node, component, differing bits) of pairs of different components that the maps don't rule out."""
    for words, (node, part, size, maps) in queries.of.items():
        for other_words, (t_node, t_part, t_size, t_maps) in targets.of.items():
            length = min(words, other_words)
            mine, theirs = _folded(maps, length), _folded(t_maps, length)
            step, at = 256, 0
            while at < len(node):
                end = min(at + step, len(node))
                low = np.searchsorted(t_size, -(-percent * size[at] // 100), "left")
                high = np.searchsorted(t_size, 100 * size[end - 1] // percent, "right")
                room = max(1, COMPARED // ((end - at) * length))
                for a in range(low, high, room):
                    b = min(a + room, high)
                    total = size[at:end, None] + t_size[None, a:b]
                    differ = np.bitwise_count(mine[at:end, None, :] ^ theirs[None, a:b, :]).sum(-1, dtype=np.int64)
                    ok = ((100 + percent) * differ <= (100 - percent) * total) & (part[at:end, None] != t_part[None, a:b])
                    i, j = np.nonzero(ok)
                    if len(i):
                        yield np.stack([node[at:end][i], part[at:end][i], t_node[a:b][j], t_part[a:b][j], differ[i, j]], 1)
                at = end


def fewest(found: np.ndarray, first: int) -> tuple[np.ndarray, bool]:
    """Of passing()'s rows, each pair once, the first of each two components with the fewest differing bits; and whether there are more."""
    swap = found[:, 1] > found[:, 3]
    ordered = np.where(swap[:, None], found[:, [2, 3, 0, 1, 4]], found)
    rows = np.unique(ordered[:, [1, 3, 4, 0, 2]], axis=0)
    starts = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1))))
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    return rows[place < first][:, [3, 0, 4, 1, 2]], bool((place >= first).any())


def _block_pairs(members: DataFrame, sets: DataFrame, percent: int, first: int | None) -> DataFrame:
    """leader, node, grp, more: pairs of different components of the groups (grp, node, component) that the maps don't rule out.

    With first, of each two components in a block so many pairs, and more is true where there are others.
    """
    counts = members.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("c"))
    groups = counts.groupBy("grp").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("members"), F.max("c").alias("most"), F.count(F.lit(1)).alias("parts"))
    open_groups = materialise(groups.where("parts > 1").select("grp", "main", F.ceil((F.col("members") - F.col("most")) / BLOCK).cast("int").alias("qs"), F.ceil(F.col("members") / BLOCK).cast("int").alias("ts")), "groups")
    own = materialise(members.join(counted_hint(open_groups), "grp"), "open")
    maps = materialise(_maps(sets, own.select("node").distinct()), "maps")
    outside = F.col("component") != F.col("main")
    block = lambda count, seed: F.pmod(F.xxhash64("node", F.lit(seed)), count).cast("int")
    # A group of one block is one task, and a node stands in it once.
    one = own.where("ts = 1").select("grp", F.lit(0).alias("q"), F.lit(0).alias("t"), F.when(outside, 2).otherwise(1).alias("side"), "node", "component")
    several = own.where("ts > 1")
    queries = several.where(outside).select("grp", block(F.col("qs"), 1).alias("q"), F.explode(F.sequence(F.lit(0), F.col("ts") - 1)).alias("t"), F.lit(0).alias("side"), "node", "component")
    targets = several.select("grp", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), block(F.col("ts"), 2).alias("t"), F.lit(1).alias("side"), "node", "component")
    dealt = one.unionByName(queries).unionByName(targets).join(maps, "node")
    ordered = dealt.repartition("grp", "q", "t").sortWithinPartitions("grp", "q", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            sides = []
            for some in ((0, 2), (1, 2)):  # those outside of the main component, and all
                rows = [h[1:] for h in held if h[0] in some]
                if not rows:
                    return
                sides.append(Maps(*(list(c) for c in zip(*rows, strict=True))))
            kept, more, limit = np.zeros((0, 5), np.int64), False, KEPT
            for pairs in passing(*sides, percent):
                if first is None:
                    yield batch_of(pairs, False)
                    continue
                kept = np.concatenate((kept, pairs))
                if len(kept) > limit:
                    kept, cut = fewest(kept, first)
                    more, limit = more or cut, max(KEPT, 2 * len(kept))
            if len(kept):
                kept, cut = fewest(kept, first)
                yield batch_of(kept, more or cut)

        def batch_of(pairs: np.ndarray, more: bool) -> pa.RecordBatch:
            n = len(pairs)
            columns = [pa.array(pairs[:, 0]), pa.array(pairs[:, 2]), pa.array([now[0]] * n, pa.int64()), pa.array([more] * n)]
            return pa.RecordBatch.from_arrays(columns, names=["leader", "node", "grp", "more"])

        for batch in batches:
            for grp, q, t, *row in zip(*(batch.column(c).to_pylist() for c in ("grp", "q", "t", "side", "node", "component", "n", "bits")), strict=True):
                if (grp, q, t) != now and held:
                    yield from found()
                    held = []
                now = (grp, q, t)
                held.append(row)
        if held:
            yield from found()
        held.clear()
        give_back()

    return materialise(ordered.mapInArrow(run, "leader long, node long, grp long, more boolean"), "passing")


def _top(*more: str) -> Column:
    """Of a key's rows the one with the best score, the likely origin of near copies; ties by the smallest node."""
    return F.max(F.struct("common", (-F.col("node")).alias("minus"), *more)).alias("top")


def first_pairs(crowded: DataFrame, percent: int) -> DataFrame:
    """leader, node: each node with the best leader of like size of its keys."""
    tops = crowded.groupBy("key").agg(_top("n")).select("key", F.col("top.common").alias("best"), (-F.col("top.minus")).alias("leader"), F.col("top.n").alias("leader_n"))
    led = crowded.join(tops, "key").where((F.col("node") != F.col("leader")) & like_size(percent, "n", "leader_n"))
    return led.groupBy("node").agg(F.max(F.struct("best", (-F.col("leader")).alias("minus"))).alias("top")).select((-F.col("top.minus")).alias("leader"), "node")


def crowded(index: DataFrame, scored: bool) -> DataFrame:
    """Index rows (key, node, n, common) whose key several nodes have. Unless they are scored, a node's score tells how crowded its keys are."""
    several = index.groupBy("key").agg((F.min("node") != F.max("node")).alias("several"), F.log2(F.count(F.lit(1))).cast("float").alias("crowd")).where("several")
    if scored:
        return index.join(several.select("key"), "key")
    rows = materialise(index.drop("common").join(several.select("key", "crowd"), "key"), "crowds")
    return rows.drop("crowd").join(rows.groupBy("node").agg(F.sum("crowd").cast("float").alias("common")), "node")


def _groups(rows: DataFrame, led: DataFrame, labels: DataFrame) -> DataFrame:
    """grp, node of the pairs to be looked at: nodes with one leader, and nodes that share a key and have neither leader nor component in common."""
    around = led.select(F.col("leader").alias("grp"), "node").union(led.select("leader", "leader")).distinct()
    own = rows.select("node").distinct().join(labels, "node", "left").join(led, "node", "left")
    own = materialise(own.select("node", F.coalesce("component", "node").alias("component"), F.coalesce("leader", "node").alias("leader")), "placed")
    placed = rows.join(own, "node")
    apart = (F.min("component") != F.max("component")) & (F.min("leader") != F.max("leader"))
    keys = placed.groupBy("key").agg(_top(), apart.alias("apart")).where("apart").select("key", F.xxhash64(F.lit("key"), -F.col("top.minus")).alias("grp"))
    across = rows.select("key", "node").join(keys, "key").select("grp", "node").distinct()
    return materialise(around.unionByName(across), "members")


def link(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, component of the nodes that have links. rows: key, node, n (size of its set), common (score) of keys that several nodes have."""
    spark = rows.sparkSession
    led = materialise(first_pairs(rows, percent), "pairs")
    found = materialise(compare(led, sets, percent), "found")
    labels = components(found)
    groups = _groups(rows, led, labels)
    for first in (FIRST, None):
        placed = groups.join(labels, "node", "left").select("grp", "node", F.coalesce("component", "node").alias("component"))
        pairs = _block_pairs(placed, sets, percent, first)
        links = materialise(compare(pairs.select("leader", "node").distinct(), sets, percent), "found")
        if links.limit(1).count():
            found = found.unionByName(links)
            labels = components(found)
        more = materialise(pairs.where("more").select("grp").distinct(), "more")
        if not more.limit(1).count():
            break
        groups = groups.join(counted_hint(more), "grp", "left_semi")
    release(spark, led)
    return labels
