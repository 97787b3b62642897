"""N-gram Jaccard join with token-combination prefixes.

The tokens of a document are its distinct word n-grams, as 64-bit hashes of the n-gram. They
have one global order: tokens of one document first, then rare ones, then frequent ones by rising
document frequency. The frequencies are counted over all documents by a shuffle of packed token
hashes. What is kept of them has a fixed size: a bit map of tokens that several documents have, and
the counts of those above FREQUENT_LEAST, MOST_FREQUENT of them at most, the most frequent. Any
order gives right results, so a full map costs comparisons at most.

A document that may miss t of its tokens is indexed under its first t + 1 tokens, one by one, if
these are rare. If not, its prefix goes on into the frequent tokens, which are dealt into groups
and indexed as combinations of two of a group: m tokens of a group count as m - 1, so the prefix
is extended until rare tokens and groups count t + 1 together. Two documents that link then share
a rare token or a combination. The groups grow with the size of a document, so combinations stay
in proportion to it; as linked documents are of like size, each is indexed under the groups of its
own size level and the next.

Documents with equal sets are one class and stand in the index once. Candidates are verified by
linking.py: each document with one leader, that of its keys with the most common tokens, then those
of different components in blocks, where bit maps rule out most pairs for certain. No candidate is
left out, and a large group of near copies takes about as many comparisons as it has members.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, free_names, materialise, named, release
from tessera.llm.linking import counted_hint, crowded, link
from tessera.llm.words import Texts, Words, mixed, slices
from tessera.session import partitions

#: Words in an n-gram, and the least Jaccard similarity of a link in hundredths.
WORDS, PERCENT = 3, 90
#: Tokens of more documents than this are frequent; so many of them are known by frequency at most.
FREQUENT_LEAST, MOST_FREQUENT = 24, 1 << 22
#: Tokens are counted by their leading bits, and sent on when a task has gathered so many.
COUNT_BITS, GATHERED = 42, 4 << 20
#: Bits of the map of tokens that several documents have: 32 MB, whatever the corpus.
MAP_BITS = 28
#: Packs of counted tokens for each shuffle partition; one is counted at a time.
PACKS = 16
KEYED_SHAPE = "ident long, h long, n long, digest binary, common float, keys array<bigint>"
KEYED = [c.split()[0] for c in KEYED_SHAPE.split(", ")]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]


def token_sets(column: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Document and 64-bit hash of each distinct token, ordered by both."""
    texts = Texts(column)
    texts.bytes = _LOWER[texts.bytes]
    words = Words(texts)
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.distinct.to_pylist()), np.uint64, len(words.distinct))
    value = of_word[words.code]
    count = max(len(value) - width + 1, 0)
    at = np.flatnonzero(words.doc[:count] == words.doc[width - 1 :]) if count else np.zeros(0, np.int64)
    docs, tokens = [words.doc[at]], [mixed(*(value[at + i] for i in range(width)))]
    first = np.concatenate(([0], np.cumsum(words.per_doc)[:-1])) if texts.n else np.zeros(0, np.int64)
    for n in range(1, width):  # all words of a short text are one token
        some = np.flatnonzero(words.per_doc == n)
        docs.append(some)
        tokens.append(mixed(np.full(len(some), n), *(value[first[some] + i] for i in range(n))))
    doc, token = np.concatenate(docs), np.concatenate(tokens)
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return doc[new], token[new]


def _counted(token: np.ndarray) -> np.ndarray:
    return token >> np.uint64(64 - COUNT_BITS)


def packed(cells: np.ndarray, packs: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Pack, first cell, bytes a difference and differences of the sorted cells in each of so many even ranges."""
    bounds = [-(-(k << COUNT_BITS) // packs) for k in range(packs + 1)]  # a pack's first cell, and the end
    edges = np.searchsorted(cells, np.array(bounds, np.uint64))
    for k in np.flatnonzero(np.diff(edges)):
        own = cells[edges[k] : edges[k + 1]]
        steps = np.diff(own)
        width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
        yield int(k), int(own[0]), width, steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(first: int, width: int, steps: bytes) -> np.ndarray:
    raw = np.frombuffer(steps, np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return np.uint64(first) + np.concatenate((np.zeros(1, np.uint64), np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)))


def _token_counts(docs: DataFrame, width: int) -> DataFrame:
    """cell, count of the tokens of more than FREQUENT_LEAST rows of docs; and at, bits: each pack's part of the map, from its byte on. Equal rows count each."""
    shuffled = partitions(docs.sparkSession)
    least, packs = FREQUENT_LEAST, PACKS * shuffled

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            cells = np.concatenate(held)
            held.clear()
            cells.sort()
            rows = list(packed(cells, packs))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["pack", "first", "width", "steps"])

        for batch in batches:
            for part in slices(batch, "text"):
                _, token = token_sets(part.column("text"), width)
                if len(token):
                    held.append(_counted(token))
                    n += len(token)
                if n >= GATHERED:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def frequent() -> pa.RecordBatch:
            cells = np.sort(np.concatenate(held))
            starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            counts = np.diff(np.append(starts, len(cells)))
            some, several = counts > least, np.unique(cells[starts[counts > 1]] >> np.uint64(COUNT_BITS - MAP_BITS)).astype(np.int64)
            at = int(several[0]) // 8 if len(several) else 0
            bits = np.zeros((int(several[-1]) // 8 + 1 - at) * 8 if len(several) else 0, bool)
            bits[several - 8 * at] = True
            n = int(some.sum())
            columns = [
                pa.array([*cells[starts[some]].tolist(), None], pa.int64()),
                pa.array([*counts[some].tolist(), None], pa.int64()),
                pa.array([None] * n + [at], pa.int64()),
                pa.array([None] * n + [np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["cell", "count", "at", "bits"])

        for batch in batches:
            for own, first, bytes_a_step, steps in zip(*(batch.column(c).to_pylist() for c in ("pack", "first", "width", "steps")), strict=True):
                if own != now and held:
                    yield frequent()
                    held = []
                now = own
                held.append(unpacked(first, bytes_a_step, steps))
        if held:
            yield frequent()

    packs_of = docs.select("text").mapInArrow(pack, "pack int, first long, width int, steps binary")
    dealt = packs_of.repartitionById(shuffled, F.col("pack") % shuffled).sortWithinPartitions("pack")
    return dealt.mapInArrow(count, "cell long, count long, at long, bits binary")


def frequent_tokens(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The map of tokens that several rows of docs have, and cells, ascending, and counts of the frequent tokens."""
    known = materialise(_token_counts(docs, width), "frequent")
    counted, parts = known.where("cell IS NOT NULL"), known.where("bits IS NOT NULL")
    by_size = counted.groupBy(F.floor(F.log2("count") * 8).alias("size")).count().orderBy(F.desc("size")).collect()  # at most a few hundred sizes
    least, total = 0, 0
    for r in by_size:
        total += r["count"]
        if total > MOST_FREQUENT:
            least = r["size"] + 1
            break
    table = counted.where(F.floor(F.log2("count") * 8) >= least).select("cell", "count").toArrow()  # MOST_FREQUENT rows at most
    several = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in parts.select("at", "bits").collect():  # one map in all
        several[r["at"] : r["at"] + len(r["bits"])] |= np.frombuffer(r["bits"], np.uint8)
    release(docs.sparkSession, known)
    cells, counts = table["cell"].to_numpy().astype(np.uint64), table["count"].to_numpy().astype(np.float32)
    order = np.argsort(cells)
    return several, cells[order], counts[order]


def looked_up(token: np.ndarray, several: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each frequent token, 1 for others in the map, 0 for the rest."""
    bit = (token >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    known = ((several[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.float32)
    some = np.flatnonzero(known)
    if len(cells) and len(some):
        cell = _counted(token[some])
        at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
        known[some] = np.where(cells[at] == cell, counts[at], np.float32(1))
    return known


def level_starts(largest: int, percent: int = PERCENT) -> list[int]:
    """Sizes at which the levels of the groups start: documents of like size are in one level or in neighbouring ones."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(100 * starts[-1] // percent + 1)
    return starts


def combination_keys(token: np.ndarray, rare: int, misses: int, level: int, groups: int) -> np.ndarray:
    """Keys of a document's frequent prefix (token is in the global order) in a level with so many groups."""
    need, members, pairs = misses + 1 - rare, defaultdict(list), []
    for t, group in zip(token[rare:].tolist(), (token[rare:] % np.uint64(groups)).tolist(), strict=True):
        own = members[group]
        pairs += [(min(t, before), max(t, before)) for before in own]
        need -= bool(own)
        own.append(t)
        if not need:
            break
    if not pairs:
        return np.zeros(0, np.uint64)
    a, b = np.array(pairs, np.uint64).T
    return mixed(np.full(len(a), level + 1), a, b)


def index_keys(doc: np.ndarray, token: np.ndarray, count: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Document and key of each index row. doc and token as from token_sets(), count is 1 at most for rare tokens."""
    if not len(doc):
        return doc, token
    order = np.lexsort((token, count, doc))
    doc, token, count = doc[order], token[order], count[order]
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    sizes = np.diff(np.append(starts, len(doc)))
    misses = sizes - -(-percent * sizes // 100)
    rare = np.add.reduceat((count <= 1).astype(np.int64), starts)
    place = np.arange(len(doc)) - np.repeat(starts, sizes)
    single = place < np.repeat(np.minimum(misses + 1, rare), sizes)
    keys, of = [token[single]], [doc[single]]
    levels = level_starts(int(sizes.max()) * 2, percent)
    for i in np.flatnonzero(rare <= misses):
        size, own = int(sizes[i]), token[starts[i] : starts[i] + sizes[i]]
        level = int(np.searchsorted(levels, size, "right")) - 1
        for at in (level, level + 1):
            some = combination_keys(own, int(rare[i]), int(misses[i]), at, max(1, levels[at] // 30))
            keys.append(some)
            of.append(np.full(len(some), doc[starts[i]]))
    return np.concatenate(of), np.concatenate(keys)


def _keyed(docs: DataFrame, frequent: tuple[np.ndarray, ...], width: int, percent: int) -> DataFrame:
    """ident, h, n, digest of the set, common (mean logarithm of the counts), keys of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # the map, and MOST_FREQUENT numbers at most
    least = 100 // (100 - percent) - 1 if percent < 100 else 0  # smaller sets link with equal ones only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                rows = part.num_rows
                doc, token = token_sets(part.column("text"), width)
                n = np.bincount(doc, minlength=rows)
                ends = np.cumsum(n)
                digests = [xxhash.xxh3_128_digest(token[e - k : e].tobytes()) for e, k in zip(ends, n, strict=True)]
                count = looked_up(token, *known)
                common = np.bincount(doc, weights=np.log2(count + 1.0), minlength=rows) / np.maximum(n, 1)
                some = n[doc] >= least
                of, key = index_keys(doc[some], token[some], count[some], percent)
                order = np.argsort(of, kind="stable")
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=rows)))).astype(np.int32))
                keys = pa.ListArray.from_arrays(offsets, pa.array(key.view(np.int64)[order]))
                columns = [part.column("ident"), part.column("h"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(common.astype(np.float32)), keys]
                yield pa.RecordBatch.from_arrays(columns, names=KEYED)

    return docs.mapInArrow(run, KEYED_SHAPE)


def node_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, set (sorted hashes, 8 bytes each) of the nodes; one row for each text of a repeated identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, token = token_sets(part.column("text"), width)
                offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=part.num_rows)))) * 8
                sets = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(token)])
                yield pa.RecordBatch.from_arrays([part.column("ident"), sets.cast(pa.binary())], names=["node", "set"])

    some = docs.join(counted_hint(nodes.select(F.col("node").alias("ident"))), "ident", "left_semi")
    return some.select("ident", "text").mapInArrow(run, "node long, set binary").distinct()


def _components(index: DataFrame, docs: DataFrame, width: int, percent: int, scored: bool) -> DataFrame:
    """node, component of the nodes that have links. index: key, node, n, common."""
    rows = materialise(crowded(index, scored), "crowded")
    sets = materialise(node_sets(docs, materialise(rows.select("node").distinct(), "nodes"), width), "sets")
    labels = link(rows, sets, percent)
    release(docs.sparkSession, rows, sets)
    return labels


def components_of(keyed: DataFrame, slim: DataFrame, width: int, percent: int, ident: str, scored: bool = True) -> DataFrame:
    """ident, h, n_shingles, component_id from the rows with their keys (KEYED_SHAPE) and the texts (slim: ident, h, text).

    Unless they are scored, common is null, and how crowded the keys are stands for it.
    """
    rows = materialise(keyed, "keyed")
    base = rows.select("ident", "h", "n", "digest")
    # One row of a class is indexed; min_by passes over null identifiers.
    one = F.min_by(F.struct("n", "common", "keys"), F.col("ident")).alias("one")
    classes = materialise(rows.where("n > 0").groupBy("digest").agg(F.min("ident").alias("node"), one), "classes")
    indexed = classes.where("node IS NOT NULL").select("node", "one.n", "one.common", F.explode("one.keys").alias("key"))
    labels = _components(indexed, slim, width, percent, scored)
    of_class = classes.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    done = base.join(of_class, "digest", "left").select(
        F.col("ident").alias(ident),
        "h",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("ident")).otherwise(F.col("component")).alias("component_id"),
    )
    result = materialise(done, "similar")
    release(slim.sparkSession, rows, classes)
    return result


def slim_of(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, h (digest of the text), text."""
    return docs.select(named(ident).cast("long").alias("ident"), F.xxhash64(named(text)).alias("h"), named(text).alias("text"))


def similar_classes(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """ident, h (digest of the text), n_shingles, component_id for each row of docs.

    A-Z are lower-cased; words are runs without space and \\t\\n\\v\\f\\r; with fewer than width words the
    whole sequence is one n-gram. Null texts and texts without words have no n-gram and link with
    nothing. component_id is the smallest identifier that links reach. Rows with one identifier
    are one node of the links and each keep their own n_shingles. Null identifiers take part only
    through equal sets: such a row has the component of its class, or null. An empty table gives an
    empty result. Other columns are not looked at. n_shingles counts distinct 64-bit hashes: two
    n-grams of a text of a million words fall together with a chance of about 3 in 100 million.
    """
    slim = slim_of(docs, ident, text)
    return components_of(_keyed(slim, frequent_tokens(slim.select("text"), width), width, percent), slim, width, percent, ident)


def one_of_each(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest identifier, and rows without links.

    Rows with null identifiers stay. Repeated rows with one identifier and text stay once. Null and
    empty texts link with nothing and stay. The columns are those of docs, whatever their names.
    An empty table gives an empty result.
    """
    own_ident, own_hash = free_names(docs, "ident", "h")
    similar = similar_classes(docs, ident, text, width, percent)
    found = similar.select(named(ident).alias(own_ident), F.col("h").alias(own_hash), "component_id")
    some = found.where(F.col(own_ident).isNotNull())
    gone = materialise(some.where(F.col("component_id") != F.col(own_ident)).select(own_ident, own_hash).distinct(), "gone")
    repeated = materialise(some.groupBy(own_ident, own_hash).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(own_ident, own_hash), "repeated")
    release(docs.sparkSession, similar)
    keyed = docs.withColumns({own_ident: named(ident).cast("long"), own_hash: F.xxhash64(named(text))})
    both = [own_ident, own_hash]
    kept = keyed.join(counted_hint(gone), both, "left_anti")
    if repeated.limit(1).count():
        known = counted_hint(repeated)
        kept = kept.join(known, both, "left_anti").unionByName(kept.join(known, both, "left_semi").dropDuplicates(both))
    return kept.select(*map(named, docs.columns))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("h")
