"""Merkle manifest of a table: a hash tree for each group, one root over the groups, a proof for each row.

Rows are range-sorted by group and identifier. Each range is cut into pieces of one group, and the
number of leaves in the pieces before it is a piece's offset in its group, so that every piece knows
the coordinates (level, index) of its leaves. A piece builds all nodes whose children it has; the
nodes at its ragged ends are shuffled by coordinate, and the levels above are finished by one
aggregation a level of at most FAN_OUT nodes a row. Coordinates also give the ancestors of a ragged
node by arithmetic, so one join brings the upper part of all proofs back to the pieces. The
groups' roots are the leaves of one more tree of the same kind.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tessera.llm.common import ascii_lower, materialise, named, release
from tessera.session import partitions

#: Children of a node (a power of two), leaves of a piece at most, of a range about, and of a range of a small table at least.
FAN_OUT, PIECE, RANGE_LEAVES, LEAST_LEAVES = 8, 1 << 14, 1 << 17, 1 << 11
#: Leaves whose proofs are in one batch.
BATCH = 1 << 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

PROOF = "array<struct<place: int, siblings: string>>"


def leaf_hash(columns: list[Column]) -> Column:
    """Hex sha256 of the columns: `-` for null, otherwise the number of UTF-8 bytes, `:` and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's hex hash and its proof give."""

    def up(below: Column, step: Column) -> Column:
        at = 64 * step["place"]
        return F.sha2(F.concat(F.substring(step["siblings"], F.lit(1), at), below, F.substring(step["siblings"], at + 1, F.length(step["siblings"]))), 256)

    return F.aggregate(proof, leaf, up)


def joined(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


def local_levels(leaves: list[bytes], start: int, total: int) -> list[tuple[int, list[bytes], int, int]]:
    """The nodes that a piece can build from the leaves start, start + 1, ... of a group of total leaves.

    For each level: index of the first node, the nodes' hashes, and the indexes from which and up to
    which (not included) nodes have a parent in the next level; the others are ragged.
    """
    out, first, nodes, count = [], start, leaves, total
    while True:
        end, above = first + len(nodes), -(-count // FAN_OUT)
        low, high = -(-first // FAN_OUT), above if end == count else end // FAN_OUT
        if count == 1 or low >= high:
            return [*out, (first, nodes, first, first)]
        out.append((first, nodes, low * FAN_OUT, min(high * FAN_OUT, end)))
        nodes = [joined(nodes[k * FAN_OUT - first : (k + 1) * FAN_OUT - first]) for k in range(low, high)]
        first, count = low, above


def _height(total: int) -> int:
    levels = 0
    while total > 1:
        total, levels = -(-total // FAN_OUT), levels + 1
    return levels


def _hex(leaves: list[bytes]) -> list[bytes]:
    return [x.hex().encode() for x in leaves]


def _ranges(rows: int, shuffled: int) -> int:
    """As many ranges as shuffles have partitions if they are neither too small nor too large then."""
    return max(1, math.ceil(rows / RANGE_LEAVES), min(shuffled, rows // LEAST_LEAVES))


def _pieces(leaves: DataFrame, ranges: int) -> DataFrame:
    """part, seq, group, n, idents, leaves, extras: the leaves (group, ident, leaf, extra) range-sorted and cut into pieces of one group."""
    order = ["group", "ident", "leaf", F.monotonically_increasing_id()]  # rows that are alike may stand in any order
    dealt = leaves.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    of = {f.name: f for f in leaves.schema}
    shape = StructType(
        [
            StructField("part", LongType()),
            StructField("seq", LongType()),
            of["group"],
            StructField("n", LongType()),
            StructField("idents", ArrayType(of["ident"].dataType)),
            StructField("leaves", ArrayType(BinaryType())),
            StructField("extras", ArrayType(of["extra"].dataType)),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def piece() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            columns = [whole.column(c).combine_chunks() for c in ("ident", "leaf", "extra")]
            ends = pa.array([0, whole.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, c) for c in columns]
            numbers = [pa.array([x], pa.int64()) for x in (part, seq, whole.num_rows)]
            return pa.RecordBatch.from_arrays([*numbers[:2], whole.column("group").combine_chunks().slice(0, 1), numbers[2], *lists], names=shape.names)

        for batch in batches:
            code = pc.dictionary_encode(batch.column("group"), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                while a < b:
                    if held and (n == PIECE or held[-1].column("group")[0] != batch.column("group")[a]):
                        yield piece()
                        seq, held, n = seq + 1, [], 0
                    take = min(b - a, PIECE - n)
                    held.append(batch.slice(a, take))
                    a, n = a + take, n + take
        if held:
            yield piece()

    return materialise(dealt.mapInArrow(cut, shape), "merkle-pieces")


def _ragged(placed: DataFrame) -> DataFrame:
    """tree, total, part, seq, level, idx, hash of the nodes at the pieces' ragged ends, and of the roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ragged = []
                for level, (first, nodes, low, high) in enumerate(local_levels(_hex(row["leaves"]), row["before"], row["total"])):
                    ragged += [(level, first + i, h.decode()) for i, h in enumerate(nodes) if not low <= first + i < high]
                own = [pa.array([row[c]] * len(ragged), pa.int64()) for c in ("tree", "total", "part", "seq")]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(zip(*ragged, strict=True), (pa.int32(), pa.int64(), pa.string()), strict=True))], names=names)

    names = ["tree", "total", "part", "seq", "level", "idx", "hash"]
    return materialise(placed.select("tree", "total", "part", "seq", "before", "leaves").mapInArrow(run, "tree long, total long, part long, seq long, level int, idx long, hash string"), "merkle-ragged")


def _families(ragged: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """For each level its parents that no piece could build (tree, level, parent, children, hash), and tree, hash of the roots."""
    families, roots = [], []
    left = F.col("total")
    nodes = ragged.where(F.col("level") == 0).select("tree", "total", left.alias("left"), "idx", "hash")
    for level in range(height + 1):
        roots.append(nodes.where("left = 1").select("tree", "hash"))
        if level == height:
            break
        grouped = nodes.where("left > 1").groupBy("tree", "total", "left", F.expr(f"idx div {FAN_OUT}").alias("parent"))
        children = grouped.agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("children"))  # FAN_OUT at most
        digest = F.sha2(F.array_join(F.col("children.hash"), ""), 256)
        families.append(materialise(children.select("tree", "total", "left", F.lit(level).alias("level"), "parent", "children", digest.alias("hash")), "merkle-level"))
        left = F.expr(f"(left + {FAN_OUT - 1}) div {FAN_OUT}")
        built = families[-1].select("tree", "total", left.alias("left"), F.col("parent").alias("idx"), "hash")
        counted = F.col("total")
        for _ in range(level + 1):
            counted = F.floor((counted + (FAN_OUT - 1)) / FAN_OUT)
        own = ragged.where(F.col("level") == level + 1).select("tree", "total", counted.cast("long").alias("left"), "idx", "hash")
        nodes = built.unionByName(own)
    return families, materialise(functools.reduce(DataFrame.unionByName, roots), "merkle-roots")


def _upper_proofs(ragged: DataFrame, families: list[DataFrame]) -> DataFrame:
    """part, seq, tops (level, idx, path): the proofs of the pieces' ragged nodes, from the coordinates of their ancestors."""
    bits = FAN_OUT.bit_length() - 1
    every = functools.reduce(DataFrame.unionByName, families).select("tree", F.col("level").alias("at"), "parent", "children")
    up = F.col("at") - F.col("level")
    climbed = ragged.select("tree", "total", "part", "seq", "level", "idx", F.explode(F.sequence("level", F.lit(len(families) - 1))).alias("at")).where(F.col("level") < len(families))
    # Beyond a tree's own height there is no family, so the join ends its climb.
    climbed = climbed.withColumn("own", F.expr(f"shiftright(idx, {bits} * (at - level))")).withColumn("parent", F.expr(f"own div {FAN_OUT}")).withColumn("up", up)
    found = climbed.join(every, ["tree", "at", "parent"])
    siblings = F.array_join(F.filter("children", lambda c: c["idx"] != F.col("own"))["hash"], "")
    place = (F.col("own") - F.col("parent") * FAN_OUT).cast("int")
    steps = found.select("part", "seq", "level", "idx", F.struct("up", place.alias("place"), siblings.alias("siblings")).alias("step"))
    path = F.transform(F.sort_array(F.collect_list("step")), lambda s: F.struct(s["place"].alias("place"), s["siblings"].alias("siblings")))
    paths = steps.groupBy("part", "seq", "level", "idx").agg(path.alias("path"))  # a step a level
    return paths.groupBy("part", "seq").agg(F.collect_list(F.struct("level", "idx", "path")).alias("tops"))  # FAN_OUT x levels x 2 at most


def _forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pieces, in as many partitions as ranges, with what their leaves' proofs need, and tree, group, hash of the groups' roots."""
    ranges = _ranges(leaves.count(), partitions(leaves.sparkSession))
    pieces = _pieces(leaves, ranges)
    # A row a piece, of a few numbers.
    in_group, one = Window.partitionBy("group").orderBy("part", "seq"), F.shiftleft(F.col("part"), 32) + F.col("seq")
    before = F.coalesce(F.sum("n").over(in_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy("group")
    numbered = pieces.select("part", "seq", "group", before.alias("before"), F.sum("n").over(whole).alias("total"), F.min(one).over(whole).alias("tree"))
    numbered = materialise(numbered, "merkle-offsets")
    placed = pieces.join(numbered.drop("group"), ["part", "seq"])
    height = _height(numbered.agg(F.max("total")).first()[0] or 0)
    ragged = _ragged(placed)
    families, roots = _families(ragged, height)
    groups = numbered.where(one == F.col("tree")).select("tree", "group")
    tops = _upper_proofs(ragged, families) if families else None
    placed = placed.join(tops, ["part", "seq"], "left") if families else placed.withColumn("tops", F.lit(None).cast(f"array<struct<level: int, idx: bigint, path: {PROOF}>>"))
    return placed.repartition(ranges, "part", "seq"), groups.join(roots, "tree")


def _proofs(placed: DataFrame) -> DataFrame:
    """ident, leaf, extra, subroot, root, proof of each leaf. placed also has hash (the tree's root), root and above (its proof)."""
    source = placed.select("idents", "leaves", "extras", "before", "total", "tops", "hash", "root", "above")
    of = {f.name: f.dataType for f in source.schema}
    shape = f"ident {of['idents'].elementType.simpleString()}, leaf string, extra {of['extras'].elementType.simpleString()}, subroot string, root string, proof {PROOF}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                batch = whole.slice(at, 1)
                row = batch.select(["leaves", "before", "total", "tops", "above"]).to_pylist()[0]
                leaves, ending = _hex(row["leaves"]), [(s["place"], s["siblings"]) for s in row["above"] or []]
                tops = {(t["level"], t["idx"]): [(s["place"], s["siblings"]) for s in t["path"]] for t in row["tops"] or []}
                levels, above = local_levels(leaves, row["before"], row["total"]), []
                for level in range(len(levels) - 1, -1, -1):  # each node's proof from its parent's
                    first, nodes, low, high = levels[level]
                    texts, proofs = [h.decode() for h in nodes], []
                    for i in range(first, first + len(nodes)):
                        if low <= i < high:
                            start, end = i // FAN_OUT * FAN_OUT - first, min((i // FAN_OUT + 1) * FAN_OUT - first, len(nodes))
                            step = (i % FAN_OUT, "".join(texts[start : i - first]) + "".join(texts[i - first + 1 : end]))
                            proofs.append([step, *above[i // FAN_OUT - levels[level + 1][0]]])
                        else:
                            proofs.append(tops.get((level, i), []) + ending)
                    above = proofs
                idents, extras = (batch.column(c).flatten() for c in ("idents", "extras"))
                for start in range(0, len(leaves), BATCH):
                    some = above[start : start + BATCH]
                    steps = [s for p in some for s in p]
                    ends = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in some]))), pa.int32())
                    fields = [pa.array([s[0] for s in steps], pa.int32()), pa.array([s[1] for s in steps], pa.string())]
                    proof = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names=["place", "siblings"]))
                    same = [pa.array(batch.column(c).to_pylist() * len(some), pa.string()) for c in ("hash", "root")]
                    yield pa.RecordBatch.from_arrays(
                        [idents.slice(start, len(some)), pa.array([h.decode() for h in leaves[start : start + BATCH]]), extras.slice(start, len(some)), *same, proof],
                        names=["ident", "leaf", "extra", "subroot", "root", "proof"],
                    )

    return source.mapInArrow(run, shape)


def manifest(docs: DataFrame, ident: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = COLUMNS, extra: Column | None = None) -> DataFrame:
    """ident, leaf, extra, subroot, root, proof for each row of docs.

    A leaf is leaf_hash() of the columns. The leaves of a group stand by identifier, null first, and
    rows with one identifier by their hashes; repeated rows are leaves each. Every FAN_OUT
    neighbours become one node until one is left, the group's subroot; a single leaf is its own
    subroot. Subroots by group, null first, in the order of their UTF-8 bytes, give root in the same
    way. proof has a step a level: how many siblings stand before the node, and the siblings' hex
    hashes one after another; fold() gives the root back. Null and empty texts hash differently;
    texts of any length are hashed whole. An empty table gives an empty result. Other columns are not
    looked at. extra is any column that is carried along.
    """
    hashed = docs.select(
        named(group).alias("group"),
        named(ident).alias("ident"),
        F.unhex(leaf_hash([named(c) for c in columns])).alias("leaf"),
        (F.lit(None).cast("int") if extra is None else extra).alias("extra"),
    )
    leaves = materialise(hashed, "merkle-leaves")
    placed, subroots = _forest(leaves)
    over, tops = _forest(materialise(subroots.select(F.lit(0).alias("group"), F.col("group").alias("ident"), F.unhex("hash").alias("leaf"), F.col("tree").alias("extra")), "merkle-subroots"))
    release(docs.sparkSession, leaves)
    over = over.join(tops.select("tree", "hash"), "tree").withColumns({"root": F.col("hash"), "above": F.lit(None).cast(PROOF)})
    groups = materialise(_proofs(over).select(F.col("extra").alias("tree"), F.col("leaf").alias("hash"), "root", F.col("proof").alias("above")), "merkle-groups")
    proved = _proofs(placed.join(groups, "tree"))
    return proved.withColumnRenamed("ident", ident)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lowered = F.when(F.col("text").isNotNull(), ascii_lower(F.col("text")))
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    tampered = F.when(changed, leaf_hash([lowered if c == "text" else F.col(c) for c in COLUMNS]))
    proved = manifest(docs, extra=tampered)
    folded = proved.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(F.col("proof.siblings"), ""), 256).alias("proof_sha256"),
        fold(F.coalesce("extra", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 12) -> str:
    """Levels as one query each; a group that is down to one node keeps it."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    hashed = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in COLUMNS) + ")"
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda crc, c: list_reduce(list_concat([xor(crc, c)], range(8)), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"leaves AS (SELECT doc_id, lang, {hashed('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {hashed(lower)} ELSE {hashed('text')} END AS given FROM documents)",
        f"a0 AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS h, count(*) OVER (PARTITION BY lang) AS remain FROM leaves)",
    ]

    def climb(name: str, key: str) -> None:
        for k in range(levels):
            parts.append(
                f"{name}{k + 1} AS (SELECT {key}, idx // {FAN_OUT} AS idx, CASE WHEN any_value(remain) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h, (any_value(remain) + {FAN_OUT - 1}) // {FAN_OUT} AS remain FROM {name}{k} GROUP BY {key}, idx // {FAN_OUT})"
            )

    climb("a", "lang")
    parts.append(f"b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS idx, h, count(*) OVER () AS remain, lang FROM a{levels})")
    climb("b", "g")
    placed = "p0 AS (SELECT doc_id, leaf, given AS folded, '' AS proof, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves)"
    parts.append(placed)
    for k in range(levels):
        # The siblings of each node, before and after it.
        parts.append(
            f"s{k} AS MATERIALIZED (SELECT lang, idx, remain, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM a{k} WINDOW w AS (PARTITION BY lang, idx // {FAN_OUT} ORDER BY idx))"
        )
        parts.append(
            f"p{k + 1} AS (SELECT doc_id, leaf, CASE WHEN remain = 1 THEN folded ELSE sha256(pre || folded || post) END AS folded, CASE WHEN remain = 1 THEN proof ELSE proof || pre || post END AS proof, p{k}.lang, p{k}.idx // {FAN_OUT} AS idx FROM p{k} JOIN s{k} ON p{k}.lang IS NOT DISTINCT FROM s{k}.lang AND p{k}.idx = s{k}.idx)"
        )
    parts.append(f"q0 AS (SELECT doc_id, leaf, folded, proof, b0.h AS subroot, b0.idx FROM p{levels} JOIN b0 ON p{levels}.lang IS NOT DISTINCT FROM b0.lang)")
    for k in range(levels):
        parts.append(
            f"t{k} AS MATERIALIZED (SELECT idx, remain, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM b{k} WINDOW w AS (PARTITION BY idx // {FAN_OUT} ORDER BY idx))"
        )
        parts.append(
            f"q{k + 1} AS (SELECT doc_id, leaf, CASE WHEN remain = 1 THEN folded ELSE sha256(pre || folded || post) END AS folded, CASE WHEN remain = 1 THEN proof ELSE proof || pre || post END AS proof, subroot, q{k}.idx // {FAN_OUT} AS idx FROM q{k} JOIN t{k} ON q{k}.idx = t{k}.idx)"
        )
    parts.append(f"root AS (SELECT h AS root FROM b{levels})")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM q{levels}, root"


OP13_SQL = _sql(8)
