"""Token counts of whole texts, huge ones by overlapping chunks.

A text up to HUGE code points is encoded at once. A longer one is encoded in overlapping
chunks with offsets, and two chunks are spliced at a boundary that both have in their overlap
and that is proven stable: no piece of the vocabulary holds the two code points beside it, so
no merge can cross it, whatever is on either side. If the overlap has none, it is widened, and
with it the chunk, up to the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import named
from tessera.llm.words import slices

#: Code points of a text that is encoded at once, of a chunk, and of the first overlap.
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 256
TOKEN_LIMIT = 4096
MARK = "▁"


@lru_cache(maxsize=2)
def _load(model: str):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [processor.id_to_piece(i) for i in range(processor.get_piece_size()) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i))]
    pairs = {piece[i : i + 2] for piece in texts for i in range(len(piece) - 1)}
    return processor, pairs, any(processor.is_byte(i) for i in range(processor.get_piece_size()))


class Counter:
    """Counts the tokens of a text as the library does, with memory bounded by the chunk."""

    def __init__(self, model: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.processor, self.pairs, self.byte_fallback = _load(model)
        self.huge, self.chunk, self.overlap = huge, chunk, overlap

    def stable(self, text: str, at: int) -> bool:
        """No piece can cover both code points beside the place. Without byte fallback only places before white space are asked for, since unknown code points are joined."""
        pair = text[at - 1 : at + 1].replace(" ", MARK)
        return pair not in self.pairs and (self.byte_fallback or pair[1] == MARK)

    def _tokens(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """Where each token of the chunk begins and ends, in code points of the text (the library counts bytes)."""
        spans = self.processor.encode(chunk := text[start:end], return_type="proto").pieces
        if chunk.isascii():
            return [(start + p.begin, start + p.end) for p in spans]
        leads = (np.frombuffer(chunk.encode(), np.uint8) & 0xC0) != 0x80
        at = (start + np.concatenate(([0], np.cumsum(leads)))).tolist()
        return [(at[p.begin], at[p.end]) for p in spans]

    def long(self, text: str) -> int:
        total, done, start, chunk = 0, 0, 0, self.chunk
        while True:
            end = min(len(text), start + chunk)
            tokens = self._tokens(text, start, end)
            if end == len(text):
                return total + sum(b >= done for b, _ in tokens)
            overlap, at = self.overlap, 0
            while not at and end - overlap > done:
                following = end - overlap
                other = {b for b, _ in self._tokens(text, following, min(len(text), end + overlap)) if b > following}
                at = next((e for _, e in reversed(tokens) if following < e < end and e > done and e in other and self.stable(text, e)), 0)
                overlap *= 2
            if not at:
                chunk *= 2
                continue
            total += sum(done <= b < at for b, _ in tokens)  # byte pieces of one code point start together
            # The next chunk starts before the splice, so that the begin marker it gets isn't beside what counts.
            done, start, chunk = at, max(0, at - self.overlap), self.chunk

    def counts(self, texts: list[str]) -> list[int]:
        short = [t for t in texts if len(t) <= self.huge]
        lengths = iter([len(x) for x in self.processor.encode(short, num_threads=1)] if short else [])
        return [next(lengths) if len(t) <= self.huge else self.long(t) for t in texts]


def token_counts(docs: DataFrame, model: str, ident: str = "doc_id", text: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """ident, n_bytes, n_tokens and over_limit for each row of docs.

    Null and empty texts have 0 tokens. Repeated rows are counted each, an empty table gives an
    empty result, and other columns are not looked at.
    """
    slim = docs.select(named(ident).alias("__ident"), F.coalesce(named(text), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model)
        for batch in batches:
            for part in slices(batch, "__text"):
                column = part.column("__text")
                n = pa.array(counter.counts(column.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("__ident"), pc.binary_length(column).cast(pa.int64()), n, pc.greater(n, limit)], names=["ident", "n_bytes", "n_tokens", "over_limit"])

    kind = slim.schema["__ident"].dataType.simpleString()
    return slim.mapInArrow(run, f"ident {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("ident", ident)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
