"""Nested scopes and trees: matching marks, what is open at each place, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.operators.graph import positions
from leafmark.storage import stage

#: Scopes around a place that a chain may have at most.
DEEPEST_CHAIN = 3


def _leveled(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """tokens (ord, kind) with depth after each, the level of the scope that it opens or closes (null: none), and unmatched closes.

    A close without anything open is unmatched and changes nothing.
    """
    w = Window.partitionBy(*keys).orderBy("ord")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    t = tokens.withColumn("_sum", F.sum(step).over(so_far)).withColumn("_low", F.least(F.lit(0), F.min("_sum").over(so_far)))
    t = t.withColumn("depth", F.col("_sum") - F.col("_low")).withColumn("unmatched", (F.col("kind") == "close") & (F.col("_low") < F.coalesce(F.lag("_low").over(w), F.lit(0))))
    level = F.when(F.col("kind") == "open", F.col("depth")).when((F.col("kind") == "close") & ~F.col("unmatched"), F.col("depth") + 1)
    return t.withColumn("level", level).drop("_sum", "_low")


def scopes(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scope, name, level, end): every opened scope (named by the place that opens it) and where it closes, null if nowhere.

    Rows of one level alternate between opening and closing, so a scope's end
    is the next row of its level.
    """
    t = _leveled(tokens, keys).where("level is not null")
    w = Window.partitionBy(*keys, "level").orderBy("ord")
    end = F.when(F.lead("kind").over(w) == "close", F.lead("ord").over(w))
    return t.withColumn("end", end).where("kind = 'open'").select(*keys, F.col("ord").alias("scope"), "name", "level", "end")


def active(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, name, kind, scope, at, outside): for every token the scopes that are open before it, one row each, at the level `at`.

    outside: how many there are; a token in none is a row with null scope.
    Of each level the scope is that opened last, so the work is in proportion to
    the depths.
    """
    t = _leveled(tokens, keys).withColumn("outside", F.when(F.col("kind") == "open", F.col("depth") - 1).when((F.col("kind") == "close") & ~F.col("unmatched"), F.col("depth") + 1).otherwise(F.col("depth")))
    asks = t.where("outside > 0").select(*keys, "ord", "name", "kind", "outside", F.explode(F.sequence(F.lit(1).cast("long"), F.col("outside").cast("long"))).alias("at"), F.lit(None).cast("int").alias("_open"))
    opens = t.where("kind = 'open'").select(*keys, "ord", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("outside"), F.col("level").cast("long").alias("at"), F.col("ord").cast("int").alias("_open"))
    w = Window.partitionBy(*keys, "at").orderBy("ord", F.col("_open").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = asks.unionByName(opens).withColumn("scope", F.last("_open", ignorenulls=True).over(w)).where("kind is not null").drop("_open")
    alone = t.where("outside = 0").select(*keys, "ord", "name", "kind", F.lit(0).cast("long").alias("outside"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("int").alias("scope"))
    return found.unionByName(alone)


def chains(tokens: DataFrame, keys: list[str], asked: Column) -> DataFrame:
    """(keys, ord, depth, outer, inner, reason): the chain of scopes around each asked token, or why there is none to rely on.

    A chain has DEEPEST_CHAIN scopes at most, and all of them close.
    """
    around = active(tokens, keys).where(asked)
    ends = scopes(tokens, keys).select(*keys, "scope", "end")
    rows = around.join(ends, [*keys, "scope"], "left").groupBy(*keys, "ord").agg(
        F.max("outside").alias("depth"), F.min_by("scope", "at").alias("_outer"), F.max_by("scope", "at").alias("_inner"), F.count_if(F.col("scope").isNotNull() & F.col("end").isNull()).alias("_loose")
    )
    reason = F.when(F.col("depth") > DEEPEST_CHAIN, F.lit("nested too deep")).when(F.col("_loose") > 0, F.lit("a scope doesn't close"))
    return rows.select(*keys, "ord", "depth", F.when(reason.isNull(), F.col("_outer")).alias("outer"), F.when(reason.isNull(), F.col("_inner")).alias("inner"), reason.alias("reason"))


def paths(edges: DataFrame, child: str, parent: str, order: str) -> DataFrame:
    """(node, depth, path) of every child of a tree: path is the places among siblings, from the top, joined by slashes.

    A node without a parent that is a node itself is a top.  Nodes on or below
    a cycle have no depth and no path.
    """
    nodes = edges.select(F.col(child).alias("node"), F.col(parent).alias("_parent"), F.col(order).alias("_order"))
    known = nodes.select(F.col("node").alias("_p"))
    nodes = nodes.join(known.hint("merge"), F.col("_parent") == F.col("_p"), "left")
    placed = nodes.withColumn("_place", F.row_number().over(Window.partitionBy("_p").orderBy("_order", "node")))
    return positions(stage(placed, "nodes"), [], "node", "_p", "_place").select("node", F.col("position").cast("int").alias("depth"), "path")
