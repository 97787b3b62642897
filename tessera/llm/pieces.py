"""SentencePiece encoding by Viterbi over unigram scores, and decoding.

The pieces are in a double-array trie over UTF-8 bytes. White space is escaped by a marker, a
marker is put before the text, the best path is the one with the greatest sum of the pieces'
log scores (of equal ones, that whose last piece starts first), and code points without a
piece become byte pieces. No piece has a marker behind another character, so no path crosses
the place before a run of white space: a text's segments from one run to the next are encoded
on their own, each distinct one of a batch once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm.common import named
from tessera.llm.words import Texts, encoded, slices

MARK = "▁"
#: An unknown code point scores this much less than the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Segments that are encoded at once, and the longest of them in bytes.
AT_ONCE, LONGEST_AT_ONCE = 32_768, 64
#: Text bytes of a slice; its arrays take about 60 times as much.
SLICE_BYTES = 4 << 20

_WIDTH = np.array([1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)])


class DoubleArray:
    """A trie of byte strings: the child of node s by byte c is base[s] + c + 1 if check there is s."""

    def __init__(self, keys: list[bytes]):
        size = 1 << 16
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        ordered = sorted((k, i) for i, k in enumerate(keys))
        free, hint = 257, 0  # where single children, and where several, are looked for
        todo = [(0, 0, len(ordered), 0)]
        while todo:
            node, low, high, depth = todo.pop()
            if len(ordered[low][0]) == depth if low < high else False:
                self.value[node] = ordered[low][1]
                low += 1
            if low >= high:
                continue
            kids, at = [], low
            while at < high:
                c, first = ordered[at][0][depth], at
                while at < high and ordered[at][0][depth] == c:
                    at += 1
                kids.append((c, first, at))
            if len(kids) == 1:  # any free cell does
                while self.check[free] >= 0:
                    free += 1
                    self._room(free)
                base = free - kids[0][0] - 1
            else:
                base = hint
                self._room(base + 258)
                while any(self.check[base + c + 1] >= 0 for c, _, _ in kids):
                    base += 1
                    self._room(base + 258)
                hint = base
            self.base[node] = base
            for c, first, last in kids:
                self.check[base + c + 1] = node
                todo.append((base + c + 1, first, last, depth + 1))


    def _room(self, at: int) -> None:
        if at >= len(self.check):
            more = len(self.check)
            self.base += [0] * more
            self.check += [-1] * more
            self.value += [-1] * more


class Pieces:
    """A piece vocabulary read from a model file, its trie and its scores."""

    def __init__(self, model: str):
        import sentencepiece

        table = sentencepiece.SentencePieceProcessor(model_file=model)
        count = table.get_piece_size()
        self.bytes_of, self.byte_id, keys, self.ids = [], {}, [], []
        for i in range(count):
            piece = table.id_to_piece(i)
            if table.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif table.is_control(i) or table.is_unknown(i) or table.is_unused(i):
                self.bytes_of.append(b"")
            else:
                keys.append(piece.encode())
                self.ids.append(i)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        if any(MARK in k.decode().lstrip(MARK) for k in keys):
            raise ValueError("a piece has a marker behind another character; its texts can't be cut into segments")
        self.scores = [table.get_score(i) for i in self.ids]
        self.unknown = min(self.scores, default=0.0) - UNKNOWN_PENALTY
        self.unknown_id = table.unk_id()
        self.trie = DoubleArray(keys)
        beyond = [0] * 300  # a look-up may go past the last cell
        self.base, self.value = (np.array(x + beyond, np.int64) for x in (self.trie.base, self.trie.value))
        self.check = np.array(self.trie.check + [-1] * 300, np.int64)
        self.score_of, self.id_of = np.array([*self.scores, 0.0]), np.array([*self.ids, 0], np.int32)
        self.sizes = np.array([len(x) for x in self.bytes_of])
        self.flat, self.begin = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(self.sizes) - self.sizes

    def segment(self, data: bytes) -> list[int]:
        """The ids of the best path through the bytes (white space already escaped)."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(data)
        best, came, by = [None] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            here = best[start]
            if here is None:  # inside a code point
                continue
            lead = data[start]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            node, single = 0, False
            for at in range(start, n):
                following = base[node] + data[at] + 1
                if check[following] != node or not following:
                    break
                node = following
                if (v := value[node]) >= 0:
                    end = at + 1
                    single |= end == start + width
                    if (score := here + scores[v]) > (best[end] if best[end] is not None else -np.inf):
                        best[end], came[end], by[end] = score, start, v
            if not single:
                end = min(n, start + width)
                if best[end] is None or here + self.unknown > best[end]:
                    best[end], came[end], by[end] = here + self.unknown, start, -1
        out: list[int] = []
        at = n
        while at:
            start = came[at]
            if by[at] >= 0:
                out.append(self.ids[by[at]])
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in reversed(data[start:at]))
            else:
                out.append(self.unknown_id)
            at = start
        return out[::-1]

    def segments(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments one after another, and how many each has."""
        escaped = Texts(pc.replace_substring(distinct.cast(pa.large_string()), " ", MARK))
        sizes = np.diff(escaped.ends)
        found: list = [None] * len(sizes)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= LONGEST_AT_ONCE]
        for start in range(0, len(order), AT_ONCE):
            some = order[start : start + AT_ONCE]
            length = int(sizes[some[-1]])
            places = escaped.ends[some][:, None] + np.arange(length)
            inside = np.arange(length) < sizes[some][:, None]
            data = np.where(inside, escaped.bytes[np.minimum(places, len(escaped.bytes) - 1)], 0) if length else np.zeros((len(some), 0), np.uint8)
            ids, ends, known = self._paths(data, sizes[some])
            for i in np.flatnonzero(known):
                found[some[i]] = ids[ends[i] : ends[i + 1]]
        for i, ids in enumerate(found):
            if ids is None:  # long, or with unknown code points
                found[i] = np.array(self.segment(escaped.bytes[escaped.ends[i] : escaped.ends[i + 1]].tobytes()), np.int32)
        return np.concatenate(found) if found else np.zeros(0, np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def _paths(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """segment() for all rows of data at once: ids, where each row's begin and end, and which rows have no unknown code point."""
        rows_n, length = data.shape
        best = np.full((rows_n, length + 1), -np.inf)
        came, by = np.zeros((rows_n, length + 1), np.int16), np.full((rows_n, length + 1), -1, np.int32)
        best[:, 0] = 0
        for start in range(length):
            rows = np.flatnonzero((sizes > start) & (best[:, start] > -np.inf))
            here, width = best[rows, start], _WIDTH[data[rows, start]]
            single = np.zeros(len(rows), bool)
            active, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for at in range(start, length):
                inside = sizes[rows[active]] > at
                active, node = active[inside], node[inside]
                following = self.base[node] + data[rows[active], at] + 1
                child = (self.check[following] == node) & (following > 0)
                active, node = active[child], following[child]
                if not len(active):
                    break
                value = self.value[node]
                hit = value >= 0
                of, value = active[hit], value[hit]
                score = here[of] + self.score_of[value]
                better = score > best[rows[of], at + 1]
                to = rows[of[better]]
                best[to, at + 1], came[to, at + 1], by[to, at + 1] = score[better], start, value[better]
                single[of] |= at + 1 == start + width[of]
            lone = np.flatnonzero(~single)
            end = np.minimum(sizes[rows[lone]], start + width[lone])
            score = here[lone] + self.unknown
            better = score > best[rows[lone], end]
            to, end = rows[lone][better], end[better]
            best[to, end], came[to, end], by[to, end] = score[better], start, -1
        at, known, steps = sizes.copy(), np.ones(rows_n, bool), []
        count = np.zeros(rows_n, np.int64)
        while len(rows := np.flatnonzero(at > 0)):
            value = by[rows, at[rows]]
            known[rows[value < 0]] = False
            steps.append((rows, value))
            count[rows] += 1
            at[rows] = came[rows, at[rows]]
        ends = np.concatenate(([0], np.cumsum(count)))
        ids = np.zeros(ends[-1], np.int32)
        for k, (rows, value) in enumerate(steps):
            ids[ends[rows + 1] - 1 - k] = self.id_of[value]
        return ids, ends, known

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids end. Null counts as empty, which has no ids."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        column = pc.replace_substring(column, MARK, " ")
        # The marker before each text, as a space.
        column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())))
        texts = Texts(column)
        if not len(texts.bytes):
            return np.zeros(0, np.int32), np.zeros(texts.n, np.int64)
        space = texts.bytes == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[texts.ends[:-1][np.diff(texts.ends) > 0]] = True
        starts = np.flatnonzero(first)
        code, distinct = encoded(texts.bytes, np.diff(np.append(starts, len(texts.bytes))))
        flat, sizes = self.segments(distinct)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        per = sizes[code]
        total = np.concatenate(([0], np.cumsum(per)))
        ids = flat[np.repeat(begin[code] - total[:-1], per) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, texts.ends[1:], "left")]

    def come_back(self, column: pa.Array, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each text is what its ids decode to."""
        texts = Texts(column)
        per = self.sizes[ids]
        total = np.concatenate(([0], np.cumsum(per)))
        data = self.flat[np.repeat(self.begin[ids] - total[:-1], per) + np.arange(total[-1])]
        size, own = np.diff(texts.ends), np.diff(np.concatenate(([0], total[ends])))
        same = own == np.where(size > 0, size + 1, 0)  # with the space before the text
        starts = total[ends] - own
        rows = np.flatnonzero(same & (size > 0))
        n = size[rows]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differs = data[np.repeat(starts[rows] + 1, n) + step] != texts.bytes[np.repeat(texts.ends[rows], n) + step]
        same[rows] = np.bincount(np.repeat(np.arange(len(rows)), n), weights=differs, minlength=len(rows))[: len(rows)] == 0
        return same

    def decode(self, ids) -> str:
        """The text of ids: bytes joined, markers turned into spaces, the one before the text taken away."""
        joined = b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")
        return joined[1:] if joined.startswith(" ") else joined


@lru_cache(maxsize=2)
def load(model: str) -> Pieces:
    return Pieces(model)


def encode_pieces(docs: DataFrame, model: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, ids (array), n_pieces, n_byte_pieces, ids_crc32 and round_trip for each row of docs.

    Null texts count as empty and have no ids. The marker character itself is taken for a space,
    so a text that holds it doesn't come back (round_trip false). Repeated rows are encoded
    each, an empty table gives an empty result, and other columns are not looked at.
    """
    slim = docs.select(named(ident).alias("__ident"), F.coalesce(named(text), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        is_byte = np.zeros(len(pieces.bytes_of), bool)
        is_byte[list(pieces.byte_id.values())] = True
        for batch in batches:
            for part in slices(batch, "__text", SLICE_BYTES):
                ids, ends = pieces.encode(part.column("__text"))
                starts = np.concatenate(([0], ends[:-1]))
                bytes_before = np.concatenate(([0], np.cumsum(is_byte[ids])))
                each = [ids[a:b] for a, b in zip(starts, ends, strict=True)]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in each]
                same = pieces.come_back(part.column("__text"), ids, ends)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column("__ident"), lists, pa.array(ends - starts), pa.array(bytes_before[ends] - bytes_before[starts]), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                    names=["ident", "ids", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"],
                )

    kind = slim.schema["__ident"].dataType.simpleString()
    return slim.mapInArrow(run, f"ident {kind}, ids array<int>, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean").withColumnRenamed("ident", ident)


def decode_pieces(encoded: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The columns of encoded and the text of its array of ids, as a column named by text.

    Byte pieces are joined to characters (U+FFFD for bytes that are none), markers become spaces,
    and the one before the text is taken away. Null arrays give null, empty ones the empty text;
    an empty table gives an empty result; a column of encoded that is named so is replaced.
    """
    slim = encoded.select(F.struct(*(named(c) for c in encoded.columns if c != text)).alias("row"), named(ids).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    done = slim.mapInArrow(run, StructType([slim.schema["row"], StructField("text", StringType())]))
    return done.select(*(F.col("row")[c].alias(c) for c in encoded.columns if c != text), F.col("text").alias(text))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
