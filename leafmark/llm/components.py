"""Connected components of an edge table, by alternating large and small stars; joins that split hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.shared import Scratch

#: A key with more than 1 / PARTS of all rows is hot; so there are fewer hot keys than PARTS.
PARTS = 2048
#: Rows of a table whose facts, which are no more, are broadcast.
SMALL = 100_000


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to facts (one row a key; count: how many of the `total` rows have it), whose count falls away.

    At most SMALL facts, as the total says, are broadcast all.  Of more, the
    facts of hot keys, of which there are fewer than PARTS whatever the data,
    are broadcast, so their rows stay where they are; all others are joined by
    a shuffle, in which no key of facts has more than 1 / PARTS of
    the rows.  how: inner, or left to keep rows without facts.
    """
    if total <= SMALL:
        return rows.join(F.broadcast(facts.drop(count)), keys, how)
    least = max(16, total // PARTS)
    hot, cold = facts.where(F.col(count) > least).drop(count), facts.where(F.col(count) <= least).drop(count)
    mine = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return mine.unionByName(others)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch | None = None, most: int | None = None) -> DataFrame:
    """(node, root) of every node of edges (u, v): root is the smallest node that links reach.

    Each round is two aggregations and two joins over the edges; the rounds
    grow with the logarithm of the longest chain.  Minima are combined before
    the shuffle, no list of neighbours is made, and nodes of many edges are
    split off before the joins.  Each round's edges are written to the shared
    folder; those of the round before go.  most: so many edges at most, if known.
    """
    own = scratch or Scratch(edges.sparkSession)
    edges = own.stage(edges.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct(), "edges", most)
    before = None
    while (now := _digest(edges)) != before:
        before = now
        both = edges.unionAll(edges.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).selectExpr("u", "least(u, m) m", "c")
        large = attach(both, least, ["u"], "c", 2 * now[0]).where("v > u").selectExpr("v u", "m v").distinct()
        large = own.stage(large, "large", now[0])
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = attach(large, least, ["u"], "c", now[0]).where("v <> m").selectExpr("v u", "m v").unionAll(least.selectExpr("u", "m v"))
        following = own.stage(small.distinct(), "edges", now[0])
        own.drop(edges, large)
        edges = following
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.selectExpr("u node", "v root").unionAll(roots)
