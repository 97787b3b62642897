"""Exact dedup by sorting contents.

Sampled splitters range-partition the normalised bytes, each range is sorted externally so
that equal texts are adjacent, full comparisons of neighbours delimit the runs of equal texts,
and each run retains one identifier. Everything is a DataFrame expression.

A splitter is (leading bytes, digest of the whole, identifier), so it stays small whatever the
texts are, and may fall inside a group of copies: a group that fills a third of the table is
dealt over a third of the ranges. Such a group is a run in each of its ranges; the heads of
the runs that a splitter cuts (two a range at most) are compared whole and joined back.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, materialise, named, release
from tessera.session import partitions

#: Leading bytes in a splitter, and sampled rows for each range.
LEAD_BYTES, SAMPLES_PER_RANGE = 32, 48


def _key(norm: Column, ident: Column) -> list[Column]:
    return [
        F.hex(F.substring(norm.cast("binary"), 1, LEAD_BYTES)).alias("p"),
        F.xxhash64(norm).alias("h"),
        F.coalesce(ident.cast("long"), F.lit(-(2**63))).alias("d"),
    ]


def sampled_splitters(docs: DataFrame, ident: str, text: str, ranges: int) -> list[tuple[str, int, int]]:
    """ranges - 1 keys that cut the sorted table into even ranges; SAMPLES_PER_RANGE x ranges rows are sampled."""
    rows = docs.count()
    if not rows or ranges < 2:
        return []
    share = min(1.0, SAMPLES_PER_RANGE * ranges / rows)
    sample = docs if share == 1.0 else docs.sample(share, seed=7)
    keys = sorted((r["p"], r["h"], r["d"]) for r in sample.select(*_key(ascii_lower(named(text)), named(ident))).collect())
    cuts = [keys[i * len(keys) // ranges] for i in range(1, ranges) if keys]
    return sorted(set(cuts))


def ranges_below(splitters: Column, key: Column, count: int) -> Column:
    """How many of the sorted splitters are at or below the key: a binary search."""
    if not count:
        return F.lit(0)
    steps = F.array(*[F.lit(2**i) for i in range(math.ceil(math.log2(count + 1)) - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(splitters, at + step - 1) <= key, at + step).otherwise(at))


def _runs(source: DataFrame, cuts: list[tuple[str, int, int]], keep: str, only_kept: bool) -> DataFrame:
    """The rows of source (__id, __norm [, __row]) in their ranges, with the run of equal texts that each is in."""
    splitters = F.from_json(F.lit(json.dumps([{"p": p, "h": h, "d": d} for p, h, d in cuts])), "array<struct<p:string,h:bigint,d:bigint>>")
    dealt = (
        source.withColumn("__key", F.struct(*_key(F.col("__norm"), F.col("__id"))))
        .withColumn("__range", ranges_below(splitters, F.col("__key"), len(cuts)))
        .repartitionById(len(cuts) + 1, F.col("__range"))
    )
    beside = lambda at: F.coalesce((F.get(splitters, at)["p"] == F.col("__key.p")) & (F.get(splitters, at)["h"] == F.col("__key.h")), F.lit(False))
    order = Window.partitionBy("__range").orderBy("__key.p", "__key.h", "__norm", F.col("__id").asc_nulls_first())
    runs = (
        dealt.withColumns(
            {
                "__pos": F.row_number().over(order),
                "__before": F.lag("__norm").over(order),
                "__repeat": F.coalesce((F.lead("__norm").over(order) == F.col("__norm")) & F.lead("__id").over(order).eqNullSafe(F.col("__id")), F.lit(False)),
            }
        )
        .withColumn("__head", ~F.col("__before").eqNullSafe(F.col("__norm")))
        .withColumn("__cut", beside(F.col("__range") - 1) | beside(F.col("__range")))
        .withColumn("__cut_text", F.when(F.col("__head") & F.col("__cut"), F.col("__norm")))
        .withColumn("__text_sha256", F.sha2(F.col("__norm"), 256))
        .drop("__before", "__norm", "__key")
        .withColumn("__run", F.sum(F.col("__head").cast("long")).over(Window.partitionBy("__range").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)))
    )
    of_run = Window.partitionBy("__range", "__run")
    chosen = F.min if keep == "smallest" else F.max
    runs = runs.withColumns({"__keep": chosen("__id").over(of_run), "__n": F.count(F.lit(1)).over(of_run)})
    if only_kept:  # the row that a group keeps is the one that its run keeps
        runs = runs.withColumn("__row", F.when(F.col("__id").eqNullSafe(F.col("__keep")) & ~F.col("__repeat"), F.col("__row")))
    return materialise(runs, "content-sort")


def _sorted(docs: DataFrame, ident: str, text: str, keep: str, ranges: int | None, payload: bool, only_kept: bool = False) -> DataFrame:
    cuts = sampled_splitters(docs.select(named(ident), named(text)), ident, text, ranges or partitions(docs.sparkSession))
    row = [F.struct(*map(named, docs.columns)).alias("__row")] if payload else []
    runs = _runs(docs.select(named(ident).alias("__id"), ascii_lower(named(text)).alias("__norm"), *row), cuts, keep, only_kept)
    release(docs.sparkSession)
    chosen = F.min if keep == "smallest" else F.max
    heads = runs.where(F.col("__cut_text").isNotNull()).select("__range", "__run", "__cut_text", "__keep", "__n")
    whole = heads.groupBy("__cut_text").agg(chosen("__keep").alias("__whole_keep"), F.sum("__n").alias("__whole_n"))
    # At most two runs a range are cut, of a few numbers each: the size is bound by the number of ranges.
    joined = F.broadcast(heads.join(whole, "__cut_text").select("__range", "__run", "__whole_keep", "__whole_n"))
    out = runs.join(joined, ["__range", "__run"], "left").withColumns(
        {
            "keep_id": F.when(F.col("__whole_n").isNotNull(), F.col("__whole_keep")).otherwise(F.col("__keep")),
            "group_size": F.coalesce("__whole_n", "__n"),
            "text_sha256": F.col("__text_sha256"),
        }
    )
    return out.withColumn("kept", F.col("__id").eqNullSafe(F.col("keep_id")) & ~F.col("__repeat"))


def content_sort(docs: DataFrame, ident: str = "doc_id", text: str = "text", keep: str = "smallest", payload: bool = False, ranges: int | None = None) -> DataFrame:
    """One row for each row of docs: ident, keep_id, group_size, kept, text_sha256; with payload, row beside the last four.

    keep: which identifier of equal texts stays, "smallest" or "largest". Texts are equal when
    identical after lower-casing A-Z; null counts as empty. Null identifiers sort lowest and stay
    only in a group without others; of repeated rows with one identifier and text one is kept.
    An empty table gives an empty result. row is a struct of docs' columns, whatever their names.
    """
    out = _sorted(docs, ident, text, keep, ranges, payload)
    first = F.col("__row").alias("row") if payload else F.col("__id").alias(ident)
    return out.select(first, "keep_id", "group_size", "kept", "text_sha256")


def drop_equal(docs: DataFrame, ident: str = "doc_id", text: str = "text", keep: str = "smallest", ranges: int | None = None) -> DataFrame:
    """The rows of docs that content_sort() keeps, with docs' columns; only these rows are written after the sort."""
    return _sorted(docs, ident, text, keep, ranges, True, only_kept=True).where("kept").select(*(F.col("__row")[c].alias(c) for c in docs.columns))


def op6_content_sort(spark, sf_dir: str) -> DataFrame:
    return content_sort(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


OP6_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
