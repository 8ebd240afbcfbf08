"""What an edit kept: characters aligned before and after, joined to their positions on both sides.

Texts are aligned in Arrow batches, a text at a time; a match is a run of
equal characters, and only runs leave a task.  All counting is joins and
aggregations over characters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from leafmark.functions.text import matching_blocks
from leafmark.operators.typeset import _streamed

#: Points that a kept character may be off.  Fixed value.
OFF = 0.01


def matches(texts: DataFrame) -> DataFrame:
    """(key, i, j, n): the runs of n characters that a longest-match alignment of before and after (key, before, after) makes equal, from i and j on."""
    merged = lambda key, a, b: [(key, i, j, n) for i, j, n in _joined(matching_blocks(a or "", b or ""))]
    return _streamed(texts.select(F.col("key").cast("long").alias("key"), "before", "after"), ["key", "before", "after"], merged, "key long, i int, j int, n int")


def _joined(blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs that follow each other on both sides as one."""
    out: list[tuple[int, int, int]] = []
    for i, j, n in blocks:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            i, j, n = out[-1][0], out[-1][1], out.pop()[2] + n
        out.append((i, j, n))
    return out


def changed_runs(texts: DataFrame) -> DataFrame:
    """(key, start, end, new_start, new_end): the runs of before and after that lie between the runs of matches(); texts that are equal have none."""
    key = F.col("key").cast("long").alias("key")
    ends = texts.select(key, F.char_length(F.coalesce("before", F.lit(""))).alias("i"), F.char_length(F.coalesce("after", F.lit(""))).alias("j"), F.lit(0).alias("n"))
    w = Window.partitionBy("key").orderBy("i", "j", F.desc("n"))
    last = F.lag(F.struct((F.col("i") + F.col("n")).alias("i"), (F.col("j") + F.col("n")).alias("j"))).over(w)
    rows = matches(texts).unionAll(ends).withColumn("_l", last)
    begin = lambda c: F.coalesce(F.col(f"_l.{c}"), F.lit(0))
    found = rows.select("key", begin("i").alias("start"), F.col("i").alias("end"), begin("j").alias("new_start"), F.col("j").alias("new_end"))
    return found.where("start < end or new_start < new_end")


@F.pandas_udf(ArrayType(IntegerType()))
def _partners(before: pd.Series, after: pd.Series) -> pd.Series:
    """For each character of before: twice the place in after that it is aligned with, and 1 more if the place before that is aligned too; -1 if none."""

    def one(a: str, b: str) -> np.ndarray:
        to, taken = np.full(len(a), -1, np.int32), np.zeros(len(b) + 1, np.int32)
        for i, j, n in matching_blocks(a, b):
            to[i : i + n] = np.arange(j, j + n)
            taken[j + 1 : j + n + 1] = 1
        return np.where(to < 0, -1, 2 * to + taken[to])

    return pd.Series([one(a, b) for a, b in zip(before, after, strict=True)])


def fidelity(before: DataFrame, after: DataFrame, edits: DataFrame) -> DataFrame:
    """How the unchanged characters of each text came through an edit.

    before, after: (key, ord from 0, ch: one character, x, y, style, line);
    edits: (key, start, end), the edited range of before, where it is known.
    One row a key of before: n_before, n_after, unchanged (aligned pairs),
    kept (within OFF on both axes), moved, restyled, total_before and
    kept_before (pairs before the edit), max_delta, breaks (line ends outside
    the edit) and breaks_kept (those whose characters on both sides are
    aligned next to each other and still lie on two lines).
    """
    w = Window.partitionBy("key").orderBy("ord")
    # characters are packed so well in a shuffle that its size says little of them: the parts aren't to be merged by it
    parts = int(before.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = lambda d: d.repartition(parts, "key").withColumn("breaks", F.coalesce(F.lag("line").over(w) != F.col("line"), F.lit(False)))
    # a text is one row, so that nothing of its characters is joined; estimates of exploded texts are far too low, so nothing is broadcast
    whole = lambda d, name, *of: marked(d).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ord", *of))).alias(name))
    a, b = whole(before, "_a", "ch", "x", "y", "style", "breaks"), whole(after, "_b", "ch", "x", "y", "style", "breaks")
    texts = a.join(b.hint("merge"), "key", "left").join(edits.select("key", "start", "end").hint("merge"), "key", "left")
    text = lambda name: F.array_join(F.transform(F.col(name), lambda c: c["ch"]), "")
    texts = texts.withColumn("_to", _partners(text("_a"), F.coalesce(text("_b"), F.lit(""))))
    at = lambda i: F.when(F.get("_to", i) >= 0, F.shiftright(F.get("_to", i), 1))
    # the place before is aligned to some character, whichever: a break needs one on each side
    one = lambda c, i: F.struct(c["ord"].alias("ord"), c["x"].alias("x"), c["y"].alias("y"), c["style"].alias("style"), c["breaks"].alias("breaks"), at(i).alias("to"), (F.get("_to", i) % 2 == 1).alias("_left"), F.get("_b", at(i)).alias("_o"))
    rows = texts.select("key", "start", "end", F.when(F.col("_b").isNull(), 0).otherwise(F.size("_b")).cast("long").alias("n_after"), F.explode(F.transform("_a", one)).alias("_c"))
    rows = rows.select("key", "start", "end", "n_after", "_c.*").withColumns({"_" + c: F.col("_o")[c] for c in ("x", "y", "style", "breaks")})
    paired, delta = F.col("to").isNotNull(), F.greatest(F.abs(F.col("x") - F.col("_x")), F.abs(F.col("y") - F.col("_y")))
    rows = rows.withColumns({"_paired": paired, "_delta": delta, "_before": paired & (F.col("ord") < F.col("start")), "_fits": paired & (delta <= OFF)})
    outside = F.col("breaks") & (F.col("start").isNull() | (F.col("ord") <= F.col("start")) | (F.col("ord") > F.col("end")))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy("key").agg(
        F.count("*").alias("n_before"), n(paired).alias("unchanged"), n(F.col("_fits")).alias("kept"), n(paired & ~F.col("_fits")).alias("moved"), n(paired & ~F.col("style").eqNullSafe(F.col("_style"))).alias("restyled"),
        n(F.col("_before")).alias("total_before"), n(F.col("_before") & F.col("_fits")).alias("kept_before"), F.round(F.max("_delta"), 3).alias("max_delta"),
        n(outside).alias("breaks"), n(outside & F.col("_left") & F.col("_breaks")).alias("breaks_kept"), F.first("n_after").alias("n_after"),
    )
