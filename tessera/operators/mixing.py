"""Weighting, budgets, splits, interleaving and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.order import with_ordinal, with_running


def weighted_copies(ordinal: Column, weight: float) -> Column:
    """How often the row with a 1-based ordinal is emitted: the growth of floor(n * weight)."""
    w = F.lit(weight)
    return (F.floor(ordinal * w) - F.floor((ordinal - 1) * w)).cast("int")


def weighted_repeat(df: DataFrame, weight: float, ordinal: str = "ord") -> DataFrame:
    copies = df.withColumn("copies", weighted_copies(F.col(ordinal), weight)).where("copies > 0")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def running_before(df: DataFrame, size: str, group: list[str], order: list[str], name: str = "before") -> DataFrame:
    return with_running(df, size, group, order, name)


def byte_budget(df: DataFrame, size: str, group: list[str], order: list[str], budget: int) -> DataFrame:
    """Rows up to and with the one that crosses the budget of its group."""
    return running_before(df, size, group, order, "__before").where(F.col("__before") < budget).drop("__before")


def ordinal_split(df: DataFrame, every: int, ordinal: str = "ord") -> DataFrame:
    return df.withColumn("split", F.when((F.col(ordinal) - 1) % every == 0, "val").otherwise("train"))


def split_period(ratio: float) -> int:
    return max(2, round(1 / ratio))


def tail_split(df: DataFrame, fraction: float, order: list[str]) -> DataFrame:
    """The last int(n * fraction) rows are validation."""
    ordered = with_ordinal(df, order)
    total = df.count()
    return ordered.withColumn("split", F.when(F.col("ord") > total - int(total * fraction), "val").otherwise("train"))


def mix_targets(lead: int, ratios: tuple[float, float, float]) -> tuple[int, int, int]:
    """Rows of each part when the first is used up: the total is rounded up, the others half to even."""
    import math

    total = math.ceil(lead / ratios[0]) if lead and ratios[0] > 0 else 0
    return lead, round(total * ratios[1]), round(total * ratios[2])


def interleave(streams: list[DataFrame], order: str, limit: int | None = None) -> DataFrame:
    """Rows of the streams in turn: sort by (place in stream, stream)."""
    from functools import reduce

    placed = [with_ordinal(s, [order], name="place").withColumn("slot", F.lit(i)) for i, s in enumerate(streams)]
    out = reduce(DataFrame.unionByName, placed).orderBy("place", "slot")
    return out.limit(limit) if limit else out


def _pieces(df: DataFrame, column: str, piece: Column, name: str) -> DataFrame:
    """A row for each of an array of (number, piece): the pieces are cut before rows are made, so the whole isn't in each of them."""
    others = [c for c in df.columns if c != column]
    made = df.select(*others, F.explode(piece).alias("__piece"))
    return made.select(*(F.col("__piece.piece").alias(column) if c == column else F.col(c) for c in df.columns), F.col("__piece.number").alias(name))


def chunks(df: DataFrame, text: str = "text", size: int = 200_000) -> DataFrame:
    """One row for each chunk of size characters; an empty text has none."""
    count = F.ceil(F.char_length(text) / F.lit(size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("number"), F.substring(F.col(text), i * size + 1, F.lit(size)).alias("piece")))
    return _pieces(df.where(count > 0), text, cut, "chunk")


def windows(df: DataFrame, tokens: str, width: int, stride: int | None = None) -> DataFrame:
    """(n - (width + 1)) // stride + 1 windows of width tokens, each with one more token behind it."""
    stride = stride or width
    count = F.floor((F.size(tokens) - (width + 1)) / F.lit(stride)).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("number"), F.slice(F.col(tokens), i * stride + 1, F.lit(width)).alias("piece")))
    return _pieces(df.where(F.size(tokens) >= width + 1), tokens, cut, "window")


def with_end(tokens: Column, last: Column, end: Column) -> Column:
    """A chunk's tokens, with the end id behind a document's last chunk."""
    return F.when(last, F.array_append(tokens, end)).otherwise(tokens)


def token_tail(df: DataFrame, size: str, order: list[str], fraction: float) -> DataFrame:
    """train, val: how many of each row's tokens stand before the last int(total * fraction) of all, and in them.

    Rows are numbered by a range sort; sizes are added up by ranges of rows, and within a range,
    so no task sees all rows.
    """
    numbered = with_ordinal(df, order, name="__ord").withColumn("__range", F.floor(F.col("__ord") / 10_000))
    sums = numbered.groupBy("__range").agg(F.sum(size).alias("__sum"))
    upto = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a number for each 10,000 rows
    total = upto.agg(F.sum("__sum")).first()[0] or 0
    within = F.coalesce(F.sum(size).over(Window.partitionBy("__range").orderBy("__ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = numbered.withColumn("__within", within).join(upto.select("__range", "__before"), "__range")
    train = F.least(F.col(size), F.greatest(F.lit(0), F.lit(total - int(total * fraction)) - F.col("__before") - F.col("__within"))).cast("long")
    return placed.withColumn("train", train).withColumn("val", F.col(size) - F.col("train")).drop("__ord", "__range", "__within", "__before")


def tightened(own: Column, limit: Column) -> Column:
    """The smaller of a source's own limit and another; a missing one doesn't count."""
    return F.least(own, limit)
