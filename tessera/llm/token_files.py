"""Token-id files: frequency-ranked ids in byte-aligned codes with separate control bytes.

The rank of an id is its place by falling count over the whole corpus (ties by id), so the most
frequent 256 ids take one byte and the next 65 280 two. A value takes 1 to 4 little-endian
bytes; a control byte holds the lengths less one of four values, two bits each, the first value
in the lowest bits. A file is MAGIC and then blocks:

    rows u32 | control bytes u32 | data bytes u32 | rows x (doc_id i64, null u8, last u8, ids u32) | control | data

Each row of a block has its own control bytes, the last one filled up with zero bits. A text
of more than BLOCK_IDS ids continues in the next block. Reading looks each control byte up in a
table of lengths, adds the lengths up to places and gathers the bytes, all by numpy.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, named, work_dir
from tessera.llm.content_sort import ranges_below
from tessera.llm.words import Texts, Words, slices
from tessera.session import partitions

MAGIC = b"TSRVB001"
BLOCK_IDS = 1 << 18
ROW = np.dtype([("doc", "<i8"), ("null", "u1"), ("last", "u1"), ("n", "<u4")])
HEAD = np.dtype("<u4")
#: Lengths of the four values of each control byte.
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
#: Distinct parts that a worker remembers the ids of.
REMEMBERED = 600_000
#: Sampled keys for each file when the splitters of the identifier are chosen.
SAMPLES_PER_FILE = 48


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The values of rows of so many values each, one after another."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    slots = -(-counts // 4) * 4
    begin = np.cumsum(slots) - slots
    full = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    lengths = lengths[full].astype(np.int64)
    places = np.cumsum(lengths) - lengths
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8))).astype(np.uint32)
    values = raw[places]
    for i in (1, 2, 3):
        values |= np.where(lengths > i, raw[places + i] << np.uint32(8 * i), np.uint32(0))
    return values


def _byte_characters() -> list[str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = itertools.count(256)
    return [chr(b if b in plain else next(others)) for b in range(256)]


#: The rule by which a text is cut before the merges, as the vocabulary's file spells it.
SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Runs that are one token of that rule whatever stands beside them: lower-case Latin letters.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")

_DIGIT, _LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:127] = ~(_DIGIT | _LETTER)[33:127]


def _sure_breaks(data: np.ndarray) -> np.ndarray:
    """Places between bytes where SPLIT_RULE always cuts: beside a digit, from a letter to a mark, and from a mark but ' to a letter."""
    out = np.zeros(len(data), bool)
    before, after = data[:-1], data[1:]
    out[1:] = _DIGIT[before] | _DIGIT[after] | (_LETTER[before] & _MARK[after]) | (_MARK[before] & (before != 39) & _LETTER[after])
    return out


class _Encoder:
    """A vocabulary with what a worker remembers of it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[bytes, tuple[int, ...]] = {}
        shape = json.loads(self.library.to_str())
        rules = [p.get("pattern", {}).get("Regex") for p in (shape["pre_tokenizer"] or {}).get("pretokenizers", [])]
        steps = [n["type"] for n in (shape["normalizer"] or {}).get("normalizers", [])]
        self.by_rule = rules == [SPLIT_RULE, None] and steps == ["NFC", "Replace", "Lowercase"]
        self.special = [t["content"].lower().encode() for t in shape["added_tokens"]]
        self.character = _byte_characters()
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def part(self, raw: bytes) -> tuple[int, ...] | None:
        """Ids of a part that is one token of the rule, by the library's merges alone; None for others."""
        if (text := raw.decode()).isascii() or (text := text.lower()):
            if _LETTERS.fullmatch(text):
                return tuple(t.id for t in self.library.model.tokenize("".join(self.character[b] for b in text.encode()) if not text.isascii() else text))
        return None

    def parts(self, distinct: list[bytes], fast: bool) -> list[tuple[int, ...]]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known if fast else {}
        rest = []
        for raw in distinct:
            if raw not in known:
                ids = self.part(raw) if fast else None
                if ids is None:
                    rest.append(raw)
                else:
                    known[raw] = ids
        for start in range(0, len(rest), 4096):
            some = rest[start : start + 4096]
            found = self.library.encode_batch_fast([x.decode() for x in some], add_special_tokens=False)
            known.update(zip(some, (tuple(e.ids) for e in found), strict=True))
        return [known[x] for x in distinct]


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _Encoder(path)


def encode_texts(path: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and how many each has.

    The vocabulary drops white space, so a text's ids are its words' ids, and by its rule words
    fall into parts with ids of their own; each distinct part of the batch is encoded once by the
    library. Where a text may spell a special token, words are not cut and not lower-cased here.
    """
    encoder = _encoder(path)
    texts = Texts(column)
    low = encoder.lower[texts.bytes]
    fast = encoder.by_rule and not any(s in low.tobytes() for s in encoder.special)
    if fast:
        texts.bytes = low
    words = Words(texts, _sure_breaks if fast else None)
    lists = encoder.parts(words.distinct.to_pylist(), fast)
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(sizes.sum()))
    begin = np.cumsum(sizes) - sizes
    per = sizes[words.code]
    ends = np.cumsum(per)
    ids = flat[np.repeat(begin[words.code] - (ends - per), per) + np.arange(ends[-1] if len(ends) else 0)]
    return ids, np.bincount(words.doc, weights=per, minlength=len(column)).astype(np.int64)[: len(column)]


def splits_by_word(path: str) -> bool:
    """The vocabulary's pre-tokenizer drops white space, as encode_texts() needs."""
    tokenizer = _encoder(path).library
    probe = ["a b", "a  b", " a\tb\n", "a\x0b\x0cb\r"]
    want = [i for w in "ab" for i in tokenizer.encode(w, add_special_tokens=False).ids]
    return all(tokenizer.encode(p, add_special_tokens=False).ids == want for p in probe)


def encoded(docs: DataFrame, tokenizer: str, ident: str, text: str, end_id: int | None) -> tuple[DataFrame, np.ndarray]:
    """A table of doc, h (digest of the text), n and ids (little-endian) for each row, and how often the corpus has each id.

    The texts are encoded once; each task also writes its counts as one more row.
    """
    size = _encoder(tokenizer).library.get_vocab_size(with_added_tokens=True) + 1
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    slim = docs.select(named(ident).cast("long").alias("__ident"), F.xxhash64(named(text)).alias("__h"), named(text).alias("__text"))
    names = ["doc", "h", "n", "ids", "id", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for part in slices(batch, "__text"):
                ids, n = encode_texts(tokenizer, part.column("__text"))
                counts += np.bincount(ids, minlength=size)
                if end_id is not None:
                    counts[end_id] += part.num_rows
                ends = np.concatenate(([0], np.cumsum(n) * kind.itemsize)).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([part.column("__ident"), part.column("__h"), pa.array(n), raw, *(pa.nulls(part.num_rows, pa.list_(k)) for k in (pa.int32(), pa.int64()))], names=names)
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.binary())), pa.array([some], pa.list_(pa.int32())), pa.array([counts[some]], pa.list_(pa.int64()))], names=names)

    table = materialise(slim.mapInArrow(run, "doc long, h long, n long, ids binary, id array<int>, count array<bigint>"), "token-ids", "zstd")

    counted = table.where(F.col("id").isNotNull()).select(F.explode(F.arrays_zip("id", "count")).alias("c"))
    sums = counted.groupBy("c.id").agg(F.sum("c.count").alias("n")).toArrow()  # a row an id of the vocabulary
    counts = np.zeros(size, np.int64)
    counts[sums["id"].to_numpy()] = sums["n"].to_numpy()
    return table.where(F.col("id").isNull()).drop("id", "count"), counts


class _Writer:
    """One file of blocks; it gets its name when it is whole."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        self.files, root = fs.FileSystem.from_uri(folder)
        self.path, self.part = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.rows, self.control, self.data, self.held, self.docs, self.ids = [], [], [], 0, 0, 0

    def add(self, doc: int | None, n: int, control: bytes, data: bytes) -> None:
        self.docs, self.ids = self.docs + 1, self.ids + n
        if n > BLOCK_IDS:  # rows of several blocks
            values = unpack(control, data, np.array([n]))
            cuts = range(0, n, BLOCK_IDS)
            for at in cuts:
                part = values[at : at + BLOCK_IDS]
                self._row(doc, at == cuts[-1], len(part), *pack(part))
        else:
            self._row(doc, True, n, control, data)

    def _row(self, doc: int | None, last: bool, n: int, control: bytes, data: bytes) -> None:
        if self.held + n > BLOCK_IDS and self.rows:
            self._flush()
        self.rows.append((doc or 0, doc is None, last, n))
        self.control.append(control)
        self.data.append(data)
        self.held += n
        if len(self.rows) >= BLOCK_IDS:
            self._flush()

    def _flush(self) -> None:
        control, data = b"".join(self.control), b"".join(self.data)
        self.out.write(np.array([len(self.rows), len(control), len(data)], HEAD).tobytes() + np.array(self.rows, ROW).tobytes())
        self.out.write(control)
        self.out.write(data)
        self.rows, self.control, self.data, self.held = [], [], [], 0

    def close(self) -> None:
        if self.rows:
            self._flush()
        self.out.close()
        try:
            self.files.move(self.part, self.path)
        except OSError:  # another attempt of the task was first, with the same bytes
            self.files.delete_file(self.part)


def blocks(uri: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and values of each block of a file; one block at a time is in memory."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_stream(path) as source:
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no token-id file")
        while head := source.read(12):
            n, control, data = np.frombuffer(head, HEAD).tolist()
            rows = np.frombuffer(source.read(n * ROW.itemsize), ROW)
            yield rows, unpack(source.read(control), source.read(data), rows["n"].astype(np.int64))


def write_ids(docs: DataFrame, tokenizer: str, folder: str, ident: str = "doc_id", text: str = "text", end_id: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """Write the ids of docs in ascending identifier order; the manifest (number, file, docs, start, ids) and the ids by rank.

    Null texts count as empty; null identifiers come first; rows with one identifier are ordered
    by a digest of their texts. An empty table gives no file.
    """
    spark = docs.sparkSession
    if not splits_by_word(tokenizer):
        raise ValueError("this vocabulary's ids depend on white space between words")
    table, counts = encoded(docs, tokenizer, ident, text, end_id)
    id_of_rank = np.lexsort((np.arange(len(counts)), -counts)).astype(np.int64)
    rank_of_id = np.empty_like(id_of_rank)
    rank_of_id[id_of_rank] = np.arange(len(id_of_rank))
    ranks = spark.sparkContext.broadcast(rank_of_id.astype(np.uint32))  # the size of the vocabulary
    kind = np.dtype("<u2" if len(counts) <= 1 << 16 else "<u4")

    files = partitions(spark)
    rows = table.count()
    key = F.struct(F.coalesce("doc", F.lit(-(2**63))).alias("d"), F.col("h"))
    share = min(1.0, SAMPLES_PER_FILE * files / max(rows, 1))
    keys = sorted((r["k"]["d"], r["k"]["h"]) for r in (table if share == 1.0 else table.sample(share, seed=5)).select(key.alias("k")).collect())
    cuts = sorted({keys[i * len(keys) // files] for i in range(1, files) if keys})

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([ranks.value[end_id]] if end_id is not None else [], np.uint32)
        for batch in batches:
            coded = [pack(np.concatenate((ranks.value[np.frombuffer(raw, kind)], last))) for raw in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("h"), pc.add(batch.column("n"), len(last)), pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())],
                names=["doc", "h", "n", "control", "data"],
            )

    coded = table.mapInArrow(code, "doc long, h long, n long, control binary, data binary")
    splitters = F.from_json(F.lit("[" + ",".join(f'{{"d":{d},"h":{h}}}' for d, h in cuts) + "]"), "array<struct<d:bigint,h:bigint>>")
    sorted_rows = (
        coded.withColumn("file", ranges_below(splitters, key, len(cuts)))
        .repartitionById(len(cuts) + 1, F.col("file"))
        .sortWithinPartitions("file", F.col("doc").asc_nulls_first(), "h", "n")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, number = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("file", "doc", "n", "control", "data")]
            for file, doc, n, control, data in zip(*columns, strict=True):
                if file != number:
                    if writer:
                        yield _line(number, writer)
                    writer, number = _Writer(folder, f"ids-{file:06d}.tsr"), file
                writer.add(doc, n, control, data)
        if writer:
            yield _line(number, writer)

    def _line(number: int, writer: _Writer) -> pa.RecordBatch:
        writer.close()
        return pa.RecordBatch.from_pydict({"file": pa.array([number], pa.int32()), "docs": pa.array([writer.docs], pa.int64()), "ids": pa.array([writer.ids], pa.int64())})

    _make_dir(spark, folder)
    written = sorted((r["file"], r["docs"], r["ids"]) for r in sorted_rows.mapInArrow(write, "file int, docs long, ids long").collect())  # a row a file
    starts = [0, *itertools.accumulate(n for _, _, n in written)]
    manifest = [(i, f"{folder}/ids-{f:06d}.tsr", d, s, n) for i, ((f, d, n), s) in enumerate(zip(written, starts, strict=False))]
    return spark.createDataFrame(manifest, "number int, file string, docs long, start long, ids long"), id_of_rank


def _make_dir(spark: SparkSession, folder: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)


def read_ids(manifest: DataFrame, id_of_rank: np.ndarray, ident: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """ident, start, n_tokens, ids_crc32 [, ids] of each document of the files."""
    spark = manifest.sparkSession
    table = spark.sparkContext.broadcast(id_of_rank.astype("<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                at, crc, begun = file["start"], 0, 0
                for rows, values in blocks(file["file"]):
                    ids, done, out = table.value[values], 0, []
                    for doc, null, last, n in rows.tolist():
                        own = ids[done : done + n]
                        crc, begun, done = zlib.crc32(own.tobytes(), crc), begun + n, done + n
                        if last:
                            out.append((None if null else doc, at, begun, crc))
                            at, begun, crc = at + begun, 0, 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[ident, "start", "n_tokens", "ids_crc32"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                at, held = file["start"], []
                for rows, values in blocks(file["file"]):
                    ids, done = table.value[values], 0
                    for doc, null, last, n in rows.tolist():
                        held.append(ids[done : done + n])
                        done += n
                        if last:
                            own, held = np.concatenate(held), []
                            line = {ident: pa.array([None if null else doc], pa.int64()), "start": pa.array([at], pa.int64()), "n_tokens": pa.array([len(own)], pa.int64())}
                            line |= {"ids_crc32": pa.array([zlib.crc32(own.tobytes())], pa.int64()), "ids": pa.array([own.tolist()], pa.list_(pa.int64()))}
                            yield pa.RecordBatch.from_pydict(line)
                            at += len(own)

    shape = f"`{ident}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    files = max(1, manifest.count())
    dealt = manifest.repartitionById(files, F.col("number"))
    return dealt.mapInArrow(lists if with_ids else run, shape)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_ids(*write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), work_dir(spark, "ids"), end_id=1))
