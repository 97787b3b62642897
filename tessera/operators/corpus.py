"""Corpus cleaning and auditing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import checkpoint


def cleaned(docs: DataFrame, ident: str = "doc_id", source: str = "source") -> DataFrame:
    """ident, source, text (normalised), reason (drop reason or null) of documents that have a text."""
    read = docs.where(F.col("text").isNotNull()).select(ident, source, T.clean(F.col("text")).alias("__c"))
    return read.select(ident, source, F.col("__c.text").alias("text"), F.col("__c.reason").alias("reason"))


def drop_reasons(docs: DataFrame, ident: str = "doc_id", source: str = "source") -> DataFrame:
    """ident, source, reason of each document, `dup` where an earlier good row has the prefix.

    The texts are read once: what is known of them is a small checkpoint. The first row of each
    prefix is a pre-aggregated minimum that is joined back, so a hot prefix is no hot task.
    """
    good = F.col("reason").isNull()
    slim = checkpoint(cleaned(docs, ident, source).select(ident, source, "reason", F.when(good, T.prefix_hash(F.col("text"))).alias("__p")))
    first = slim.where(F.col("__p").isNotNull()).groupBy("__p").agg(F.min(ident).alias("__first"))
    later = F.col("__p").isNotNull() & (F.col(ident) != F.col("__first"))
    return slim.join(first, "__p", "left").select(ident, source, F.when(later, "dup").otherwise(F.col("reason")).alias("reason"))


def clean_documents(docs: DataFrame, ident: str = "doc_id", source: str = "source") -> DataFrame:
    """ident, source, normalised text of the documents that are kept.

    Rows of one identifier are kept or dropped together. Texts are normalised in a second pass, so that none is written in between.
    """
    kept = drop_reasons(docs, ident, source).where(F.col("reason").isNull()).select(ident)
    return cleaned(docs.join(kept, ident, "left_semi"), ident, source).drop("reason")


def clean_counters(docs: DataFrame, ident: str = "doc_id", source: str = "source") -> DataFrame:
    """Seen, kept and dropped by reason for each source."""
    reasons = {"drop_short": "short", "drop_long": "long", "drop_ratio": "low_alnum_cjk_ratio", "drop_singlechar": "single_char", "drop_linerepeat": "line_repeat", "drop_dup": "dup"}
    return drop_reasons(docs, ident, source).groupBy(source).agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(F.col("reason").isNull()).alias("kept"),
        *(F.count_if(F.col("reason") == value).alias(name) for name, value in reasons.items()),
    )


def audit_rows(docs: DataFrame, ident: str = "doc_id", file: str = "source", simhash: bool = False) -> DataFrame:
    """Length, reason and duplicate flags of each non-empty document; the texts are read once and don't travel on."""
    from tessera.functions.verifiers import simhash64

    norm = cleaned(docs, ident, file).where(F.col("text") != "")
    text = F.col("text")
    keys = {"exact": T.exact_hash(text), "prefix": T.prefix_hash(text)} | ({"simhash": simhash64(text)} if simhash else {})
    slim = checkpoint(norm.select(ident, file, F.char_length("text").alias("chars"), "reason", *(v.alias(f"k_{k}") for k, v in keys.items())))
    rows = slim
    for k in keys:
        first = slim.groupBy(f"k_{k}").agg(F.min(ident).alias("__first"))
        rows = rows.join(first, f"k_{k}").withColumn(f"dup_{k}", F.col(ident) != F.col("__first")).drop("__first")
    return rows


def audit_by_file(rows: DataFrame, file: str = "source") -> DataFrame:
    flags = [c for c in rows.columns if c.startswith("dup_")]
    return rows.groupBy(file).agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(F.col("reason").isNotNull()).alias("low_quality"),
        *(F.count_if(F.col(c)).alias(f"{c.removeprefix('dup_')}_duplicates") for c in flags),
        F.round(F.sum("chars") / F.count(F.lit(1)), 3).alias("avg_chars"),
    )


def issue_rates(audits: DataFrame) -> DataFrame:
    """Low-quality, prefix and simhash duplicates (not exact ones) a document."""
    issues = F.col("low_quality") + F.col("prefix_duplicates") + (F.col("simhash_duplicates") if "simhash_duplicates" in audits.columns else F.lit(0))
    return audits.withColumn("issue_rate", F.coalesce(F.try_divide(issues, F.col("docs")), F.lit(0.0)))


def audit_files(files: DataFrame, rows: DataFrame, simhash: bool = False) -> DataFrame:
    """One row a file: bytes, docs, parse errors, empty texts, low quality, duplicates by kind, average length, issue rate.

    files has file and bytes, rows what audit_jsonl() gives with lines. A file without rows counts as well; its issue rate is 1 if it has
    no bytes. Of rows with one key all but the first, by file and line, are duplicates. The texts are read once.
    """
    from tessera.functions.verifiers import simhash64

    place = F.regexp_replace("file", "^file:/+", "file:/").alias("file")  # local files are named with one slash or three
    files, read = files.select(place, "bytes"), rows.select(place, "line", "parse_error", T.clean(F.col("text")).alias("__c"))
    text, empty = F.col("__c.text"), F.coalesce(F.col("__c.text"), F.lit("")) == ""
    keys = {"exact": T.exact_hash(text), "prefix": T.prefix_hash(text)} | ({"simhash": simhash64(text)} if simhash else {})
    kept = [F.when(~empty, v).alias(f"k_{k}") for k, v in keys.items()]
    reason = F.when(~empty, F.when(F.col("__c.reason") == "single_char", "single_char_dominant").otherwise(F.col("__c.reason")))
    slim = checkpoint(read.select("file", "line", "parse_error", (empty & ~F.col("parse_error")).alias("empty"), F.char_length(text).alias("chars"), reason.alias("reason"), *kept))
    docs = slim.where("NOT empty AND NOT parse_error").withColumn("__at", F.struct("file", "line"))
    for k in keys:
        first = docs.groupBy(f"k_{k}").agg(F.min("__at").alias("__first"))
        docs = docs.join(first, f"k_{k}").withColumn(f"dup_{k}", F.col("__at") != F.col("__first")).drop("__first")
    dropped = slim.groupBy("file").agg(F.count_if("parse_error").alias("parse_errors"), F.count_if("empty").alias("empty_text"))
    every = files.join(dropped, "file", "left").join(audit_by_file(docs.drop("line", "__at"), "file"), "file", "left")
    every = every.na.fill(0, [c for c in every.columns if c not in ("file", "avg_chars")]).na.fill(0.0, ["avg_chars"])
    issues = F.col("parse_errors") + F.col("empty_text") + F.col("low_quality") + F.col("prefix_duplicates") + (F.col("simhash_duplicates") if simhash else F.lit(0))
    return every.withColumn("issue_rate", F.when(F.col("docs") > 0, issues / F.col("docs")).when(F.col("bytes") == 0, 1.0).otherwise(0.0))


def audit_totals(audits: DataFrame) -> DataFrame:
    """One row over all files: files, zero_byte_files, total_bytes, total_docs and the sums of the counts."""
    counts = [c for c in audits.columns if c in ("parse_errors", "empty_text", "low_quality") or c.endswith("_duplicates")]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("bytes", "total_bytes"), ("docs", "total_docs"), *((c, c) for c in counts))]
    return audits.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("bytes") == 0).alias("zero_byte_files"), *sums)


#: Logarithm of a sketch's registers: a standard error of 0.8 %.
SKETCH_BITS = 14


def distinct_sketches(rows: DataFrame, group: list[str], key: Column, bits: int = SKETCH_BITS) -> DataFrame:
    """group, sketch: what each group has of distinct keys, in a few kilobytes that can be stored and merged. Null keys don't count."""
    return rows.groupBy(*group).agg(F.hll_sketch_agg(key, F.lit(bits)).alias("sketch"))


def merged_sketches(sketches: DataFrame, group: list[str]) -> DataFrame:
    """group, sketch of the union of all sketches of a group; no group gives the union of all."""
    return (sketches.groupBy(*group) if group else sketches).agg(F.hll_union_agg("sketch").alias("sketch"))
