"""Ordered-row operators: runs, breaks, gaps, prefix counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """df with the number, from 0, of the island of each row; an island begins where `starts` holds, and at the first row."""
    w = _ordered(keys, order)
    flag = F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.coalesce(starts.cast("int"), F.lit(0)))
    return df.withColumn("_flag", flag).withColumn(name, F.sum("_flag").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_flag")


def changed(column: str, keys: list[str], order: list[str]) -> Column:
    """Whether a value differs from the row before, null-safely."""
    return ~F.col(column).eqNullSafe(F.lag(column).over(_ordered(keys, order)))


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Run-length encoding: keys, run, value, start (0-based place), length."""
    w = _ordered(keys, order)
    placed = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_changed", changed(value, keys, order))
    runs = islands(placed, keys, ["_at"], F.col("_changed"), "run")
    return runs.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min("_at").alias("start"), F.count("*").alias("length"))


def runs_are_partition(runs: DataFrame, keys: list[str], value: str | None = None) -> DataFrame:
    """For each key, whether runs (start, length) follow each other from 0 without gap or overlap, and differ from the next in value."""
    w = _ordered(keys, ["start"])
    ok = F.col("start") == F.coalesce(F.lag(F.col("start") + F.col("length")).over(w), F.lit(0))
    if value:
        ok &= (F.col("start") == 0) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return runs.withColumn("_ok", ok).groupBy(*keys).agg(F.bool_and("_ok").alias("contiguous"), F.sum("length").alias("total"))


def decode_runs(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows of run lengths: keys, at, value."""
    return runs.select(*keys, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at"), value)


def gutter_pieces(df: DataFrame, keys: list[str], order: list[str], size: Column, factor: float = 2.2) -> DataFrame:
    """df with `piece`: a new one where x0 is more than factor sizes beyond the largest x1 so far."""
    w = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return islands(df, keys, order, F.col("x0") - F.max("x1").over(w) > size * factor, "piece")


def prefix(column: Column, keys: list[str], order: list[str]) -> Column:
    """The running sum, this row included."""
    return F.sum(column).over(_ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def prefix_suffix(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """df with n_prefix (flagged rows up to this one) and n_suffix (after it)."""
    n = flag.cast("int")
    out = df.withColumn("n_prefix", prefix(n, keys, order))
    return out.withColumn("n_suffix", F.sum(n).over(Window.partitionBy(*keys)) - F.col("n_prefix"))


def numbered_lists(df: DataFrame, keys: list[str], order: list[str], text: str = "line") -> DataFrame:
    """Runs of lines whose leading numbers rise by one: keys, first_number, n_items, for runs of two or more."""
    number = F.regexp_extract(text, r"^\s*(\d{1,6})[.)]\s", 1)
    marked = df.withColumn("_number", F.when(number != "", number.cast("int"))).where("_number is not null")
    w = _ordered(keys, order)
    marked = marked.withColumn("_group", F.col("_number") - F.row_number().over(w)).withColumn("_starts", F.col("_number") != F.lag("_number").over(w) + 1)
    runs = islands(marked, keys, order, F.col("_starts"), "_run")
    return runs.groupBy(*keys, "_run").agg(F.min("_number").alias("first_number"), F.count("*").alias("n_items")).where("n_items >= 2").drop("_run")
