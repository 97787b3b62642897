"""Order: the one place where rows get ordinals, and operators that depend on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpoint


def ranged(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """The rows range-sorted by keys, with their range (__part) and their place in it (__at), as a checkpoint: sorting anew may cut the ranges elsewhere."""
    numbered = df.orderBy(*keys).withColumn("__part", F.spark_partition_id())
    return checkpoint(numbered.withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33)))


def _with_range_totals(rows: DataFrame, group: list[str], totals: dict[str, Column]) -> DataFrame:
    """Beside each of the ranged() rows, what its group has in its range (totals) and, as before_<name>, in the ranges before it.

    A range has few groups or a group has few ranges, so the totals are a small table whatever
    group is hot; it is joined back by Spark's choice.
    """
    each = rows.groupBy("__part", *group).agg(*(c.alias(name) for name, c in totals.items()))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({f"before_{name}": F.coalesce(F.sum(name).over(earlier), F.lit(0)) for name in totals if not name.endswith("_first")})
    other = each.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__g{i}") for i, c in enumerate(group)), *(c for c in each.columns if c != "__part" and c not in group))
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return rows.join(other, same).drop("__p", *(f"__g{i}" for i in range(len(group))))


def with_ordinal(df: DataFrame, keys: list[str | Column], partition: list[str] | None = None, name: str = "ord") -> DataFrame:
    """1-based ordinal within each partition (or globally) in the order of keys.

    Rows are range-sorted and numbered by their place in their range, after the rows of the ranges
    before, so neither all rows nor a partition of any size is one task.
    """
    if partition:
        rows = _with_range_totals(ranged(df, [*partition, *keys]), partition, {"__n": F.count(F.lit(1)), "__n_first": F.min("__at")})
        return rows.withColumn(name, F.col("before___n") + F.col("__at") - F.col("__n_first") + 1).drop("__part", "__at", "__n", "__n_first", "before___n")
    rows = ranged(df, keys)
    counts = {r["__part"]: r["n"] for r in rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    before, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    starts = F.array(*map(F.lit, before)) if before else F.array(F.lit(0))
    return rows.withColumn(name, F.get(starts.cast("array<bigint>"), F.col("__part")) + F.col("__at") + 1).drop("__part", "__at")


def with_running(df: DataFrame, size: str, group: list[str], order: list[str], name: str = "before") -> DataFrame:
    """The sizes of the group's rows before each row in order: sums by ranges, and within a range."""
    rows = _with_range_totals(ranged(df, [*group, *order]), group, {"__s": F.sum(size)})
    within = F.sum(size).over(Window.partitionBy("__part", *group).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, F.col("before___s") + F.coalesce(within, F.lit(0))).drop("__part", "__at", "__s", "before___s")


def first_wins(df: DataFrame, key: list[str], order: str, payload: list[str]) -> DataFrame:
    """One row a key, the first by order: a pre-aggregated minimum, so a hot key is no hot task."""
    row = F.struct(order, *[c for c in payload if c != order])
    return df.groupBy(*key).agg(F.min(row).alias("__first")).select(*key, *(F.col(f"__first.{c}").alias(c) for c in dict.fromkeys([order, *payload]) if c not in key))


def latest_by(df: DataFrame, key: list[str], order: str, payload: list[str]) -> DataFrame:
    """One row a key, the last by order."""
    row = F.struct(*payload)
    return df.groupBy(*key).agg(F.max_by(row, order).alias("__last")).select(*key, *(F.col(f"__last.{c}").alias(c) for c in payload))


def first_n(df: DataFrame, group: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first n rows of each group: each task keeps n rows a group before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def last_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows in rising order: a top-k, then a sort of n rows."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)
