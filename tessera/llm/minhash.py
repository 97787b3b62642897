"""Near duplicates by fast similarity sketching, banding and verification of whole sets.

A sketch has SIZE coordinates. In each round every token is placed in one bin by a hash of the
round and offers the hash as the bin's value; a bin that an earlier round filled takes no more, and
of the offers of one round it keeps the smallest. Large sets fill all bins in a round or two, which
costs one hash a token and samples without replacement, so that the number of coordinates in which
two sketches agree is as concentrated as that of independent ones or better. After SIZE rounds, bin
i takes the smallest offer of one more round of all tokens, so every coordinate is filled whatever
the set. BANDS groups of ROWS coordinates are the index keys. Sets of similarity 0.8 share none of
the keys with a chance of (1 - 0.8^6)^64, 4 in a billion, and less above; candidates are verified
by linking.py on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import named
from tessera.llm.ngram_join import KEYED, KEYED_SHAPE, components_of, slim_of, token_sets
from tessera.llm.words import mixed, slices

#: Words in a shingle, least similarity of a link in hundredths, bands and coordinates in a band.
WORDS, PERCENT, BANDS, ROWS = 2, 80, 64, 6
#: Sketches that are made at once.
SKETCHED = 2_048

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _offers(token: np.ndarray, round_: int) -> np.ndarray:
    """A hash of each token for a round."""
    with np.errstate(over="ignore"):
        value = token + np.uint64((round_ + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        value ^= value >> np.uint64(30)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(27)
        value *= np.uint64(0x94D049BB133111EB)
        value ^= value >> np.uint64(31)
    return value


def sketches(doc: np.ndarray, token: np.ndarray, docs: int, size: int = BANDS * ROWS) -> np.ndarray:
    """docs x size coordinates; documents without tokens keep empty ones. doc is ascending."""
    out = np.full(docs * size, _EMPTY, np.uint64)
    table = out.reshape(docs, size)
    for round_ in range(size):
        if not len(doc):
            return table
        offer = _offers(token, round_)
        at = doc * size + ((offer >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        free = out[at] == _EMPTY
        np.minimum.at(out, at[free], offer[free])
        unfilled = (table == _EMPTY).any(1) if round_ == 0 else unfilled & (table == _EMPTY).any(1)
        some = unfilled[doc]
        doc, token = doc[some], token[some]
    if len(doc):
        starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        owners = doc[starts]
        for place in range(size):
            free = table[owners, place] == _EMPTY
            if free.any():
                least = np.minimum.reduceat(_offers(token, size + place), starts)
                table[owners[free], place] = least[free]
    return table


def band_keys(table: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """docs x bands hashes of each band's coordinates."""
    rows = table.shape[1] // bands
    keys = [mixed(np.full(len(table), band), *(table[:, band * rows + k] for k in range(rows))) for band in range(bands)]
    return np.stack(keys, 1) if len(table) else np.zeros((0, bands), np.uint64)


def _keyed(slim: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole in slices(batch, "text"):
                for start in range(0, whole.num_rows, SKETCHED):
                    part = whole.slice(start, SKETCHED)
                    count = part.num_rows
                    doc, token = token_sets(part.column("text"), width)
                    n = np.bincount(doc, minlength=count)
                    ends = np.cumsum(n)
                    digests = [xxhash.xxh3_128_digest(token[e - k : e].tobytes()) for e, k in zip(ends, n, strict=True)]
                    own = band_keys(sketches(doc, token, count, bands * rows), bands).view(np.int64)[n > 0]
                    offsets = pa.array(np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32))
                    keys = pa.ListArray.from_arrays(offsets, pa.array(own.ravel()))
                    columns = [part.column("ident"), part.column("h"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(count, pa.float32()), keys]
                    yield pa.RecordBatch.from_arrays(columns, names=KEYED)

    return slim.mapInArrow(run, KEYED_SHAPE)


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """ident, h (digest of the text), n_shingles, component_id, kept for each row of docs.

    A-Z are lower-cased; words are runs without space and \\t\\n\\v\\f\\r of whole texts of any length; with
    fewer than width words the whole sequence is one shingle. Null texts and texts without words
    have none and link with nothing. component_id is the smallest identifier that links reach, and
    kept says whether it is the row's own. Rows with one identifier are one node of the links; each
    keeps its own n_shingles, and those of a kept identifier are all kept. A row with a null identifier has the
    component of the rows with an equal set, or null, and isn't kept in the first case. An empty
    table gives an empty result. Other columns are not looked at. Sets of equal similarity need
    no order: every link counts. n_shingles counts distinct 64-bit hashes.
    """
    slim = slim_of(docs, ident, text)
    found = components_of(_keyed(slim, width, bands, rows), slim, width, percent, ident, scored=False)
    return found.withColumn("kept", named(ident).eqNullSafe(F.col("component_id")))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("h")
