"""From drawn rows to paragraphs: groups that the rows before decide.

A row joins the paragraph of the latest row of its column or begins one, by
structure element, size, indent, gap against the running median pitch, the
room that was left for its first word, paint style, list markers and hanging
labels.  Where no later row can join an earlier one a page is cut into strips
by windows; a task holds a strip, and never a page.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.operators.areas import meet, prefixed
from leafmark.operators.sequential import _kinds, _renumbered, _runs

# Fixed values, in sizes: the most that lines of a paragraph are apart, how far a line may begin before and after the one before,
# the share of the pitch that parts paragraphs, a space and what must be left beside a word, a hanging indent's least, and how far the right edge is looked for.
REACH, LEFT, RIGHT, PITCH, SPACE, ROOM, HANGING, AROUND = 2.25, 1.6, 0.2, 1.3, 0.25, 0.5, 0.5, 10.0
#: Sizes are equal if they differ by less than so many points.
SAME = 0.1
_COLUMNS = ("baseline", "x", "pen_end", "size", "parent", "styles", "first_word", "marker", "text_x", "moved", "_edge")


def _edges(rows: DataFrame, page: list[str]) -> DataFrame:
    """rows with _edge: the farthest end of rows of the same size around each row that begins with a label; null for others."""
    labelled = rows.where("text_x is not null").select(*page, "ord", "size", F.col("x").alias("x0"), F.col("pen_end").alias("x1"), (F.col("baseline") - F.col("size") * AROUND).alias("y0"), (F.col("baseline") + F.col("size") * AROUND).alias("y1"))
    ends = prefixed(rows.select(*page, "size", F.col("x").alias("x0"), F.col("pen_end").alias("x1"), F.col("baseline").alias("y0"), F.col("baseline").alias("y1")), page, "b")
    near = (F.abs(F.col("bsize") - F.col("size")) < SAME) & (F.col("bx0") < F.col("x1")) & (F.col("x0") < F.col("bx1")) & (F.col("by0") < F.col("y1")) & (F.col("y0") < F.col("by0"))
    found = meet(labelled, ends, page, 256.0).where(near).groupBy(*page, "ord").agg(F.max("bx1").alias("_edge"))
    return rows.join(found, [*page, "ord"], "left")


def _strips(rows: DataFrame, page: list[str]) -> DataFrame:
    """rows with strip: cut where all later rows lie out of reach below all earlier ones, or above them, and no structure element goes on."""
    w = Window.partitionBy(*page).orderBy("ord")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    reach = F.max("size").over(Window.partitionBy(*page)) * REACH
    below = F.min("baseline").over(after) - F.max("baseline").over(before) >= reach
    above = F.max("baseline").over(after) <= F.min("baseline").over(before)
    of_parent = Window.partitionBy(*page, "parent")
    known = F.col("parent").isNotNull()
    rows = rows.withColumn("_opens", F.when(known & (F.col("ord") == F.min("ord").over(of_parent)), 1).otherwise(0)).withColumn("_closes", F.when(known & (F.col("ord") == F.max("ord").over(of_parent)), 1).otherwise(0))
    going = F.coalesce(F.sum(F.col("_opens") - F.col("_closes")).over(before), F.lit(0)) > 0
    cut = F.coalesce(((below | above) & ~going).cast("int"), F.lit(0))
    return rows.withColumn("_cut", cut).withColumn("strip", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut", "_opens", "_closes")


class _Group:
    """A paragraph so far: its first and last row, its gaps in order, its widest end and the x of its hanging indent."""

    def __init__(self, row: dict):
        self.first = self.last = row
        self.gaps, self.right, self.hanging, self.n = [], row["pen_end"], None, 1

    def pitch(self) -> float:
        half = len(self.gaps) // 2
        return self.gaps[half] if len(self.gaps) % 2 else (self.gaps[half - 1] + self.gaps[half]) / 2

    def add(self, row: dict) -> None:
        insort(self.gaps, row["baseline"] - self.last["baseline"])
        self.last, self.right, self.n = row, max(self.right, row["pen_end"]), self.n + 1

    def _hangs(self, row: dict) -> float | None:
        """The x of the hanging indent at which a row continues a labelled first line that was broken at the right edge."""
        first, size = self.first, self.first["size"]
        x, gap = first["text_x"], row["baseline"] - first["baseline"]
        if x is None or abs(row["size"] - size) >= SAME or not 0 < gap < REACH * size:
            return None
        if x - first["x"] < HANGING * size or abs(row["x"] - x) >= RIGHT * size or not set(first["styles"] or ()) & set(row["styles"] or ()):
            return None
        return x if first["pen_end"] > first["_edge"] - 2 * size else None

    def parted(self, row: dict) -> bool:
        """Whether a row of the same column begins a paragraph."""
        last, size = self.last, row["size"]
        gap, step, alike = row["baseline"] - last["baseline"], row["x"] - last["x"], abs(size - last["size"]) < SAME
        beside = -LEFT * size <= step < RIGHT * size
        if row["moved"] != last["moved"]:
            return True
        if row["parent"] is not None:
            new = last["parent"] != row["parent"] or not (alike or beside)
        else:
            new = not (alike and 0 < gap < REACH * size and beside)
            new = new or bool(self.gaps) and gap > PITCH * self.pitch()
            if not new and row["first_word"] is not None:
                new = last["pen_end"] + SPACE * last["size"] + row["first_word"] < max(self.right, row["pen_end"]) - ROOM * last["size"]
            own, other = set(last["styles"] or ()), set(row["styles"] or ())
            new = new or bool(own and other and not own & other)
            if new and self.n == 1 and last["parent"] is None and (x := self._hangs(row)) is not None:
                new, self.hanging = False, x
        back = abs(row["x"] - self.first["x"]) < RIGHT * size
        item = row["marker"] is not None and row["marker"] == self.first["marker"]
        return new or back and (item or self.hanging is not None)


def _paragraphs_of_strip(rows: list[dict]) -> list[int]:
    groups, found = [], []
    for row in rows:
        at = next((k for k in range(len(groups) - 1, -1, -1) if groups[k].last["x"] < row["pen_end"] and row["x"] < groups[k].last["pen_end"]), None)
        if at is None or groups[at].parted(row):
            at = len(groups)
            groups.append(_Group(row))
        else:
            groups[at].add(row)
        found.append(at)
    return found


def observe(rows: DataFrame, page: list[str]) -> DataFrame:
    """rows with `paragraph`, numbered within the page as paragraphs begin.

    rows: ord (unique in a page), baseline, x, pen_end, size; parent: the one
    structure element of the row, or null; styles: an array of its paints;
    first_word: the width of its first word where it is letters and digits of
    ASCII, else null; marker: its list marker, or null; text_x: where the text
    after its label begins, or null; moved: what moved it before, or null.
    """
    import pyarrow as pa

    def work(batches):
        for run in _runs(batches, [*page, "strip"]):
            columns = {c: run[c].to_pylist() for c in _COLUMNS}
            found = _paragraphs_of_strip([dict(zip(_COLUMNS, values, strict=True)) for values in zip(*columns.values(), strict=True)])
            yield from run.append_column("paragraph", pa.array(np.array(found, np.int32))).to_batches()

    numeric = {c: F.col(c).cast("double") for c in ("baseline", "x", "pen_end", "size", "first_word", "text_x")}
    cut = _strips(_edges(rows.withColumns(numeric), page), page)
    sorted_rows = cut.repartition(*page, "strip").sortWithinPartitions(*page, "strip", "ord")
    return _renumbered(sorted_rows.mapInArrow(work, _kinds(cut, ", paragraph int")), page, "paragraph").drop("_edge")
