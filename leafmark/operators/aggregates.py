"""Aggregations with the contracts of page inference."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.storage import stage

#: Groups that are broadcast at most.
BROADCAST = 100_000


def lower_half_median(df: DataFrame, keys: list[str], value: str, name: str = "leading") -> DataFrame:
    """The median of the lower half (rounded up, one at least) of the values of each key; nulls don't count."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_rank", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    half = F.greatest(F.lit(1), F.floor((F.col("_n") + 1) / 2))
    return ranked.groupBy(*keys).agg(F.median(F.when(F.col("_rank") <= half, F.col(value))).alias(name))


def pitch(df: DataFrame, keys: list[str], value: str, factor: float = 1.15, name: str = "pitch") -> DataFrame:
    """The median of the values up to factor times the least."""
    least = F.min(value).over(Window.partitionBy(*keys))
    return df.withColumn("_least", least).where(F.col(value) <= F.col("_least") * factor).groupBy(*keys).agg(F.median(value).alias(name))


def weighted_mode(df: DataFrame, keys: list[str], value: str, order: str, weight: Column | None = None, name: str = "mode") -> DataFrame:
    """The value of the largest total weight; of equal ones, that seen first in the order."""
    totals = df.groupBy(*keys, value).agg(F.sum(weight if weight is not None else F.lit(1)).alias("_w"), F.min(order).alias("_first"))
    return totals.groupBy(*keys).agg(F.max_by(value, F.struct("_w", F.negative("_first"))).alias(name), F.max("_w").alias("weight"))


def keep_ties(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """All rows that equal the least of their key."""
    return df.withColumn("_rank", F.rank().over(Window.partitionBy(*keys).orderBy(*by))).where("_rank = 1").drop("_rank")


def boundary_groups(df: DataFrame, keys: list[str], ordinal: str, burden: list[str], distinct: list[str]) -> DataFrame:
    """A row for each row of least burden of a group, with its ordinal and burden, and the group's count, first and last ordinal, number of such rows and distinct counts.  Null burdens come last.

    Rows of one burden, and equal values, are put together before a group is, so that no task has all rows of a group.
    """
    alike = df.groupBy(*keys, *burden).agg(F.count("*").alias("n"), F.min(ordinal).alias("_min"), F.max(ordinal).alias("_max"))
    rank = F.struct(*[x for c in burden for x in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))])
    least = F.min(F.struct(rank.alias("_rank"), "n")).alias("_least")
    found = alike.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("_min").alias("first_ordinal"), F.max("_max").alias("last_ordinal"), least)
    found = found.select("*", F.col("_least.n").alias("n_least"), *[F.col("_least._rank")[c].alias(c) for c in burden]).drop("_least")
    alike_in = lambda names: reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names])
    for c in distinct:
        values = df.select(*keys, c).distinct().groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(c).alias(f"n_{c}"))
        found = found.join(values, alike_in(keys)).drop(*[f"_{k}" for k in keys])
    # groups are far fewer than rows: where they are few, no row is shuffled to meet its group
    found = stage(found, "groups")
    rows = df.select(*[F.col(c).alias(f"_{c}") for c in (*keys, *burden)], F.col(ordinal).alias("least_ordinal"))
    groups = F.broadcast(found) if found.count() <= BROADCAST else found
    return rows.join(groups, alike_in([*keys, *burden])).select(*found.columns, "least_ordinal")


def consensus(value: str, tolerance: float = 0.0) -> Column:
    """Aggregate: the common value if the spread is within the tolerance, else null."""
    return F.when(F.max(value) - F.min(value) <= tolerance, F.min(value))


def alignment(tolerance: float) -> Column:
    """Aggregate over lines x0, x1: what is the same in all of them."""
    left, right = F.max("x0") - F.min("x0") <= tolerance, F.max("x1") - F.min("x1") <= tolerance
    middle = F.max(F.col("x0") + F.col("x1")) - F.min(F.col("x0") + F.col("x1")) <= 2 * tolerance
    return F.when(left & right, F.lit("justify")).when(left, F.lit("left")).when(right, F.lit("right")).when(middle, F.lit("center")).otherwise(F.lit("unknown"))


def snapped_median(df: DataFrame, keys: list[str], value: str, tolerance: float, snap: float) -> DataFrame:
    """The median of each key, 0 if below snap; null where a value is farther off than the tolerance."""
    medians = df.groupBy(*keys).agg(F.median(value).alias("_m"))
    worst = df.join(medians, keys).groupBy(*keys).agg(F.first("_m").alias("_m"), F.max(F.abs(F.col(value) - F.col("_m"))).alias("deviation"))
    return worst.select(*keys, F.when(F.col("deviation") <= tolerance, F.when(F.abs("_m") < snap, F.lit(0.0)).otherwise(F.col("_m"))).alias("tracking"), "deviation")
