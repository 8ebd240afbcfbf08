"""Parents, orders and chains: pointer doubling, and level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.storage import stage

#: Pieces of the paths that a file holds at most, for a reader takes thousands of rows at once; rows of a file at least.
PIECES, LEAST_ROWS = 1 << 23, 64


def positions(links: DataFrame, keys: list[str], node: str, previous: str, piece: str | None = None, weight: str | None = None) -> DataFrame:
    """(keys, node, position, status[, path][, total]): how many nodes are before each along its chain of previous nodes.

    A node with no previous one is first.  status: ordered; gap, where the
    chain leads to a node that isn't there; cycle, where it never ends.  Forks
    are allowed: several nodes may have one before them.  path: the pieces of
    the nodes from the first to this, joined by slashes; total: the sum of
    their weights.  Pointers are doubled, so the rounds grow with the logarithm
    of the longest chain; a round writes only what it began with open, and where
    none of it is settled, the rest goes round.
    """
    more = {c: F.col(own).cast(kind).alias(c) for c, own, kind in (("path", piece, "string"), ("total", weight, "double")) if own}
    rows = links.select(*keys, F.col(node).alias("node"), F.col(previous).alias("_to"), *more.values())
    there = rows.select(*keys, F.col("node").alias("_to"), F.lit(True).alias("_there"))
    at = lambda n, status: (*keys, "node", "_to", F.lit(n).cast("long").alias("n"), status.cast("string").alias("status"), *more)
    first = rows.where("_to is null").select(*at(0, F.lit("ordered")))
    # staged tables are small on disk, not in memory: none is to be broadcast
    rest = rows.where("_to is not null").join(there.hint("merge"), [*keys, "_to"], "left").select(*at(1, F.when(F.col("_there").isNull(), F.lit("gap"))))
    step, found, reach = stage(first.unionAll(rest), "positions"), [], 1
    while True:
        settled, open_ = step.where("status is not null"), step.where("status is null")
        n_settled, n_open = step.agg(F.count("status"), F.count_if(F.col("status").isNull())).first()
        found.append(settled)
        if not n_open or not n_settled:
            break
        known = reduce(DataFrame.unionAll, [*found, open_])
        further = known.select(*keys, F.col("node").alias("_to"), F.col("_to").alias("_next"), *[F.col(c).alias("_" + c) for c in ("n", "status", *more)])
        both = open_.join(further.hint("merge"), [*keys, "_to"], "left")
        grown = {"path": F.concat_ws("/", "_path", "path"), "total": F.col("_total") + F.col("total")}
        reach *= 2
        step = stage(both.select(*keys, "node", F.col("_next").alias("_to"), (F.col("n") + F.col("_n")).alias("n"), F.col("_status").alias("status"), *[grown[c].alias(c) for c in more]), "positions", most=max(LEAST_ROWS, PIECES // reach) if piece else None)
    every = reduce(DataFrame.unionAll, [*found, open_])
    status = F.coalesce("status", F.lit("cycle"))
    ordered = status == "ordered"
    return every.select(*keys, F.col("node").alias(node), F.when(ordered, F.col("n")).alias("position"), status.alias("status"), *[F.when(ordered, F.col(c)).alias(c) for c in more])


def terminals(mapping: DataFrame, name: str, target: str) -> DataFrame:
    """(name, mapped, status) of a map of names: where each leads in the end, however long the chain; null with status cycle if nowhere.

    A target that the map doesn't name is the end.  Pointers are doubled; a
    round writes only the names that it began with open, and where it settles
    none, these go round.
    """
    step, found = stage(mapping.select(F.col(name).alias("name"), F.col(target).alias("to"), F.lit(False).alias("done")).distinct(), "names"), []
    n_open = step.count()
    while n_open:
        open_ = step.where("not done")
        known = reduce(DataFrame.unionAll, [*found, open_])
        ahead = known.select(F.col("name").alias("to"), F.col("to").alias("_next"), F.col("done").alias("_done"))
        # small on disk, not in memory: not to be broadcast
        both = open_.join(ahead.hint("merge"), "to", "left")
        step = stage(both.select("name", F.coalesce("_next", "to").alias("to"), (F.col("_next").isNull() | F.col("_done")).alias("done")), "names")
        found.append(step.where("done"))
        n_done, n_open = step.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
        if not n_done:
            break
    every = reduce(DataFrame.unionAll, [*found, step.where("not done")])
    return every.select("name", F.when(F.col("done"), F.col("to")).alias("mapped"), F.when(F.col("done"), "mapped").otherwise("cycle").alias("status"))


def ancestors(edges: DataFrame, child: str, parent: str, limit: int | None = None) -> DataFrame:
    """(node, ancestor, depth): all pairs over chains of parents, level by level, however deep; a cycle, or a chain over a given limit, is an error.

    A child has one parent.  Where only numbers are wanted, descendants() makes no pairs.
    """
    step = stage(edges.select(F.col(child).alias("_c"), F.col(parent).alias("_p")).where("_p is not null"), "edges")
    if not positions(step, [], "_c", "_p").where("status = 'cycle'").isEmpty():
        raise ValueError("the parents go round in a cycle")
    out = reached = step.select(F.col("_c").alias("node"), F.col("_p").alias("ancestor"), F.lit(1).alias("depth"))
    depth = 1
    while True:
        depth += 1
        reached = stage(reached.join(step, reached["ancestor"] == step["_c"]).select("node", F.col("_p").alias("ancestor"), F.lit(depth).alias("depth")), "ancestors")
        if reached.isEmpty():
            return out
        if limit is not None and depth > limit:
            raise ValueError(f"a chain is longer than {limit}")
        out = out.unionAll(reached)


def descendants(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(ancestor, depth, n_descendants): how many nodes are so far below each, counted level by level.

    A level holds one row an ancestor, not one a pair; there are as many levels
    as the tree has.  A child has one parent; a cycle is an error.
    """
    step = stage(edges.select(F.col(child).alias("_c"), F.col(parent).alias("_p")).where("_p is not null"), "edges")
    if not positions(step, [], "_c", "_p").where("status = 'cycle'").isEmpty():
        raise ValueError("the parents go round in a cycle")
    level = step.groupBy(F.col("_p").alias("ancestor")).agg(F.count("*").alias("n_descendants"))
    out, depth = None, 0
    while True:
        depth += 1
        level = stage(level, "level")
        if level.isEmpty():
            return out if out is not None else level.select("ancestor", F.lit(1).alias("depth"), "n_descendants")
        counted = level.select("ancestor", F.lit(depth).alias("depth"), "n_descendants")
        out = counted if out is None else out.unionAll(counted)
        level = level.join(step, F.col("ancestor") == F.col("_c")).groupBy(F.col("_p").alias("ancestor")).agg(F.sum("n_descendants").alias("n_descendants"))


def chains(links: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """(keys, head, n): for links of out-degree and in-degree one, where each chain begins and how many links it has.

    Pointers are doubled each round, so the rounds grow with the logarithm of
    the longest chain.
    """
    jump = stage(links.select(*keys, F.col(source).alias("at"), F.col(target).alias("to"), F.lit(1).cast("long").alias("n")), "links")
    heads = jump.join(jump.select(*keys, F.col("to").alias("at")), [*keys, "at"], "left_anti")
    while True:
        nxt = jump.select(*keys, F.col("at").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"))
        if heads.join(nxt, [*keys, "to"], "left_semi").isEmpty():
            return heads.select(*keys, F.col("at").alias("head"), "n")
        further = (*keys, "at", F.coalesce("_to", "to").alias("to"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
        heads = stage(heads.join(nxt, [*keys, "to"], "left").select(*further), "heads")
        jump = stage(jump.join(nxt, [*keys, "to"], "left").select(*further), "links")
