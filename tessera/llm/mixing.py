"""Mixing of sources to target weights with exact budgets.

Each document gets a hash-random key. Keys are even over their range, so equal slices of it
are even ranges of each source: a large source is dealt over as many ranges as its rows need,
and no source is sorted in one task. Sizes are summed by range, the ranges' sums are added up
within a source (a few numbers a range), and the sums within ranges give each document the
words before it in its source's order. A source is taken from the start of that order, round
after round, until its budget is met to the word.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD_PATTERN, materialise, named
from tessera.operators.order import with_ordinal

#: Weights of the sources in code point order, repeating, and the share of all words that is taken.
WEIGHTS, SHARE, MOST_ROUNDS = (5, 2, 1), 1.5, 2.0
#: About so many rows of a source go to one range.
RANGE_ROWS = 2_000
#: Up to this count the sources' numbers come to the driver and are broadcast; beyond it they stay a table.
BROADCAST_SOURCES = 200_000


def _level(total: float, share: float, sums: Callable[[float], tuple[float, float]]) -> float:
    """The words for a weight of 1 that the sources which aren't full take; infinite where all are full.

    A source is full where its cap is not above the level x its weight. The level rises until no further source is
    full. sums gives, for a level, the caps of the full sources and the weights of the others.
    """
    level = -1.0
    while True:
        taken, weight = sums(level)
        following = (share * total - taken) / weight if weight else math.inf
        if following <= level or math.isinf(following):
            return max(level, following) if math.isinf(following) else level
        level = following


def budgets(sizes: list[tuple], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, rounds: float = MOST_ROUNDS) -> dict:
    """Each source's target, from (source, size): by weight, at most rounds x its size, the excess shared again."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    rows = [(source, float(weights[i % len(weights)]), rounds * size) for i, (source, size) in enumerate(ordered)]

    def sums(level: float) -> tuple[float, float]:
        return sum(cap for _, w, cap in rows if cap <= level * w), sum(w for _, w, cap in rows if cap > level * w)

    level = _level(sum(size for _, size in sizes), share, sums)
    return {source: float(cap if math.isinf(level) else min(cap, level * w)) for source, w, cap in rows}


def budget_table(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, rounds: float = MOST_ROUNDS) -> DataFrame:
    """budgets() for any number of sources: __source, size, rows with __target; the sums are taken by Spark, once a round."""
    ranked = with_ordinal(sources, [F.col("__source").asc_nulls_last()], name="__rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = materialise(ranked.withColumn("__weight", weight).withColumn("__cap", rounds * F.col("size")), "sources")

    def sums(level: float) -> tuple[float, float]:
        full = F.col("__cap") <= level * F.col("__weight")
        found = ranked.agg(F.sum(F.when(full, F.col("__cap")).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("__weight"))).alias("weight")).first()
        return found["taken"] or 0.0, found["weight"] or 0.0

    level = _level(ranked.agg(F.sum("size")).first()[0] or 0, share, sums)
    last = F.col("__cap") if math.isinf(level) else F.least(F.col("__cap"), level * F.col("__weight"))
    return ranked.select("__source", "size", "rows", last.cast("double").alias("__target"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def plan_mix(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix", payload: bool = False, **how) -> DataFrame:
    """ident, size, source_size, target, taken for each row of docs [payload: __row, a struct of docs' columns, beside __size, __taken].

    Null texts have size 0, null sources are one source, the last one. Repeated rows and equal
    keys are ordered by identifier and size; such rows are alike, so any order gives the same
    rows. A source without words has target 0. A very long text is counted whole and may be cut by the
    budget. An empty table gives an empty result. The sums of taken are the targets' whole parts.
    """
    known = named(ident).cast("string")
    # Rows without an identifier are dealt by their texts.
    key = F.md5(F.concat(F.coalesce(known, F.lit("")), F.lit(f":{seed}"), F.when(known.isNull(), F.sha2(F.coalesce(named(text), F.lit("")), 256)).otherwise("")))
    columns = {"__size": word_count(named(text)), "__key": key, "__ident": named(ident), "__source": named(source)}
    if payload:
        columns["__row"] = F.struct(*map(named, docs.columns))
    sized = materialise(docs.select(*(v.alias(k) for k, v in columns.items())), "mix")
    sources = materialise(sized.groupBy("__source").agg(F.sum("__size").alias("size"), F.count(F.lit(1)).alias("rows")), "sizes")  # a row a source
    of = sized.schema["__source"].dataType
    if sources.count() <= BROADCAST_SOURCES:
        rows = sources.collect()
        target = budgets([(r["__source"], r["size"]) for r in rows], **how)
        shape = "__m_source string, __source_size long, __target double, __ranges int"
        numbers = [(r["__source"], r["size"], float(target[r["__source"]]), max(1, math.ceil(r["rows"] / RANGE_ROWS))) for r in rows]
        per_source = F.broadcast(docs.sparkSession.createDataFrame(numbers, shape).withColumn("__m_source", F.col("__m_source").cast(of)))
    else:
        ranges = F.greatest(F.lit(1), F.ceil(F.col("rows") / RANGE_ROWS)).cast("int")
        per_source = budget_table(sources, **how).select(F.col("__source").alias("__m_source"), F.col("size").alias("__source_size"), "__target", ranges.alias("__ranges"))
    joined = sized.join(per_source, F.col("__source").eqNullSafe(F.col("__m_source"))).drop("__m_source")
    ranged = joined.withColumn("__range", F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * F.col("__ranges") / F.lit(2**32)).cast("int"))
    in_range = Window.partitionBy("__source", "__range").orderBy("__key", "__ident", "__size").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__source", "__range").agg(F.sum("__size").alias("__range_size"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__range_size").over(Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col("__source").alias("__b_source"), F.col("__range").alias("__b_range"), "__before")
    within = ranged.withColumn("__within", F.coalesce(F.sum("__size").over(in_range), F.lit(0)))
    placed = within.join(before, F.col("__source").eqNullSafe(F.col("__b_source")) & (F.col("__range") == F.col("__b_range")))
    # Whole rounds of the source, then what is left of the budget from the start of its order.
    budget, whole = F.floor("__target").cast("long"), F.col("__source_size")
    rounds = F.when(whole > 0, F.floor(budget / whole)).otherwise(0).cast("long")
    rest = budget - rounds * whole - (F.col("__before") + F.col("__within"))
    placed = placed.withColumn("__taken", rounds * F.col("__size") + F.least(F.greatest(rest, F.lit(0)), F.col("__size")))
    if payload:
        return placed.select("__row", "__size", "__taken")
    return placed.select(
        F.col("__ident").alias(ident),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__taken").alias("taken"),
    )


def mix(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix", **how) -> DataFrame:
    """The rows of docs as often as the mix takes them, with docs' columns.

    A document that the budget cuts also comes with its first words only, up to the cut;
    documents without words are not in a mix that counts words. Columns may have any names.
    """
    planned = plan_mix(docs, ident, source, text, seed, payload=True, **how)
    copies = F.when(F.col("__size") > 0, F.ceil(F.col("__taken") / F.col("__size"))).otherwise(0).cast("int")
    repeated = planned.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).where(F.col("__taken") > 0)
    part = F.col("__taken") - (F.col("__copy") - 1) * F.col("__size")
    whole = F.col("__row")[text]
    words = F.regexp_extract_all(whole, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(part < F.col("__size"), F.array_join(F.slice(words, F.lit(1), part.cast("int")), "")).otherwise(whole)
    return repeated.select(*((cut if c == text else F.col("__row")[c]).alias(c) for c in docs.columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix' || CASE WHEN doc_id IS NULL THEN sha256(coalesce(text, '')) ELSE '' END) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS weight
  FROM sized GROUP BY source),
capped AS (
  SELECT *, sum(2 * source_size) OVER o AS full_below, sum(weight) OVER () - sum(weight) OVER o AS weight_above, 2 * source_size / weight AS ratio,
         row_number() OVER o AS rank
  FROM sources WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST)),
levels AS (
  SELECT rank, ratio, (1.5 * (SELECT sum(source_size) FROM sources) - coalesce(lag(full_below) OVER (ORDER BY rank), 0))
         / (weight_above + weight) AS level FROM capped),
level AS (SELECT arg_min(level, rank) FILTER (WHERE level < ratio) AS level FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN (SELECT level FROM level) * weight < 2 * source_size THEN (SELECT level FROM level) * weight ELSE 2.0 * source_size END AS target
  FROM sources),
placed AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + least(greatest(CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END - before, 0), size))::BIGINT AS taken
FROM placed
"""
