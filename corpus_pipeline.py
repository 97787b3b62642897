"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing and encoding of documents.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.

In every stage null texts count as empty, repeated rows are rows of their own until a stage that
drops copies meets them, null identifiers and sources are allowed, an empty table gives an empty
result, and columns beside those of documents are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop_dir, scratch, work_dir
from tessera.llm.content_sort import drop_equal
from tessera.llm.host_quality import keep_good
from tessera.llm.mixing import mix
from tessera.llm.ngram_join import one_of_each
from tessera.llm.pieces import encode_pieces

MODEL = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host isn't rejected."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the smallest doc_id."""
    return drop_equal(docs, keep="smallest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 Jaccard similarity over five-word shingles connect, the one with the smallest doc_id."""
    return one_of_each(docs, width=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one a source may be cut at the budget."""
    return mix(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and counts of each document."""
    import public_tokenizers

    return encode_pieces(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", near_dedup),
    ("source_mix", source_mix),
    ("sentencepiece", encode),
]

#: N-gram joins and piece encoding have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote for itself, and its predecessor's result, go once its own result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = work_dir(spark, f"stage-{name}")
        with scratch(spark, but=path):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            drop_dir(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
