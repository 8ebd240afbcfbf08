"""Painted elements beside text: hints, anchors, frames, lines, provenance, reach, rasters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.geometry import Rect
from leafmark.operators import spans
from leafmark.operators.areas import meet
from leafmark.operators.sequential import _in_runs

#: Points of a grid cell in which drawn things meet.
CELL = 64.0

# Fixed values.
#: A paint thinner than so many points may be a decoration.
THIN = 2.0
#: A line's mark, in sizes: thickness, place below the baseline, and how far its ends may be from the text's.
MARK_THICK, MARK_BELOW, MARK_LEFT, MARK_RIGHT = 0.2, 0.3, 0.15, 0.3
#: Points that paint beside a column must be clear of it.
CLEAR = 0.5
#: Justified spaces are widened by one size at most.
WIDEST = 1.0
#: Differences of pixels that are counted apart.
SLIGHT = 8


def paint_hints(texts: DataFrame, paints: DataFrame, page: str) -> DataFrame:
    """(page, id, paint, hint): how the paints (paint, x0 to y1, kind, seq) of a page that meet a text (id, x0 to y1, first: its paint order) may relate to it.

    A fill that holds the text and is painted before it may be a background; a
    thin paint that isn't before it, a decoration; any other that meets it, an
    overlap or border.  All others are unrelated_paints().
    """
    p = paints.select(page, "paint", "kind", "seq", *[F.col(c).alias("p" + c) for c in ("x0", "y0", "x1", "y1")])
    text, paint = Rect.of(), Rect.of("p")
    hint = (
        F.when((F.col("kind") == "fill") & paint.contains(text) & (F.col("seq") < F.col("first")), "background")
        .when((F.col("py1") - F.col("py0") < THIN) & (F.col("seq") >= F.col("first")), "decoration")
        .otherwise("overlap or border")
    )
    met = meet(texts.select(page, "id", "first", "x0", "y0", "x1", "y1"), p, [page], CELL, "p")
    return met.where(paint.intersects(text)).select(page, "id", "paint", hint.alias("hint"))


def unrelated_paints(texts: DataFrame, paints: DataFrame, hints: DataFrame, page: str) -> DataFrame:
    """(id, n, first): how many paints of its page don't meet a text, and the least of them, by counts: texts and paints aren't paired.

    Paints of a page are numbered in the order of their ids (each once); the least
    that isn't among those of a text's hints is the first number that these leave out.
    Texts that share an id are one row: their numbers add up, and a paint counts as
    met where it meets them all.
    """
    numbered = paints.select(page, "paint").withColumn("_k", F.row_number().over(Window.partitionBy(page).orderBy("paint")))
    counts = numbered.groupBy(page).agg(F.count("*").alias("_all"))
    shared = texts.groupBy(page, "id").agg(F.count("*").alias("_texts"))
    met = hints.join(numbered, [page, "paint"]).groupBy(page, "id", "_k").agg(F.count("*").alias("_met"))
    whole = met.join(shared, [page, "id"]).withColumn("_by_all", (F.col("_met") == F.col("_texts")).cast("int"))
    w = Window.partitionBy(page, "id").orderBy("_k")
    at = whole.withColumn("_i", F.sum("_by_all").over(w)).groupBy(page, "id").agg(F.sum("_met").alias("_n"), F.sum("_by_all").alias("_by_all"), F.min(F.when((F.col("_by_all") == 0) | (F.col("_k") != F.col("_i")), F.col("_i") + 1 - F.col("_by_all"))).alias("_gap"))
    of_text = shared.join(counts, page).join(at, [page, "id"], "left").withColumn("_n", F.col("_all") * F.col("_texts") - F.coalesce("_n", F.lit(0)))
    rest = of_text.where("_n > 0").withColumn("_k", F.coalesce("_gap", F.coalesce("_by_all", F.lit(0)) + 1))
    return rest.join(numbered, [page, "_k"]).groupBy("id").agg(F.sum("_n").alias("n"), F.min("paint").alias("first"))


def line_anchors(lines: DataFrame, marks: DataFrame, page: str) -> DataFrame:
    """(mark, line, offset): the one line (line, x0, x1, baseline, size, seq) that a thin mark (mark, x0 to y1, seq) fits; marks that fit several or none have no row."""
    m = marks.select(page, "mark", F.col("seq").alias("mseq"), *[F.col(c).alias("m" + c) for c in ("x0", "y0", "x1", "y1")])
    offset, thick = F.col("my0") - F.col("baseline"), F.col("my1") - F.col("my0")
    fits = (thick > 0) & (thick < F.col("size") * MARK_THICK) & (offset >= 0) & (offset < F.col("size") * MARK_BELOW) & (F.col("mseq") > F.col("seq"))
    fits &= (F.abs(F.col("mx0") - F.col("x0")) <= F.col("size") * MARK_LEFT) & (F.abs(F.col("mx1") - F.col("x1")) <= F.col("size") * MARK_RIGHT)
    # a mark begins within a small box at the line's left end
    own = lines.select("*", (F.col("x0") - F.col("size") * MARK_LEFT).alias("_l"), (F.col("x0") + F.col("size") * MARK_LEFT).alias("_r"), (F.col("baseline") + F.col("size") * MARK_BELOW).alias("_b"))
    places = own.select(*[c for c in lines.columns if c != "x0"], F.col("x0").alias("_x0"), F.col("_l").alias("x0"), F.col("baseline").alias("y0"), F.col("_b").alias("y1"), F.col("_r").alias("_x1")).withColumnsRenamed({"x1": "_right", "_x1": "x1"})
    points = m.select("*", F.col("mx0").alias("qx0"), F.col("my0").alias("qy0"), F.col("mx0").alias("qx1"), F.col("my0").alias("qy1"))
    met = meet(places, points, [page], CELL, "q").withColumn("x0", F.col("_x0")).withColumn("x1", F.col("_right"))
    found = met.where(fits).groupBy(page, "mark").agg(F.count("*").alias("_n"), F.min("line").alias("line"), F.min(offset).alias("offset"))
    return found.where("_n = 1").select("mark", "line", "offset")


def frame_widths(boxes: DataFrame, drawings: DataFrame, page: str, most: float) -> DataFrame:
    """(id, width): what the narrowest drawing that holds a box, and is no wider than `most`, gives it from the box's left; null if none does.  Boxes that share an id are one row, of the least width."""
    d = drawings.select(page, *[F.col(c).alias("d" + c) for c in ("x0", "y0", "x1", "y1")])
    held = Rect.of("d").contains(Rect.of()) & (F.col("dx1") - F.col("dx0") <= most)
    best = meet(boxes, d.where(F.col("dx1") - F.col("dx0") <= most), [page], CELL, "d").where(held).groupBy("id").agg(F.min(F.col("dx1") - F.col("x0")).alias("width"))
    return boxes.select("id").distinct().join(best, "id", "left")


def beside_column(box: Rect, column: Rect, own: Rect, first_row: Column) -> Column:
    """Whether paint stands beside a column and not on a line of it: clear across of the column and of the line's own text, and from above the column's bottom to the line's first row."""
    left, right = F.least(column.x0, own.x0), F.greatest(column.x1, own.x1)
    clear = (box.x0 >= right + CLEAR) | (box.x1 <= left - CLEAR)
    return clear & (box.y0 <= column.y1) & (box.y1 >= first_row - CLEAR)


def _rows_to_lines(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """The line of each row: the first whose height it overlaps by more than half of the smaller."""
    tops, bottoms, found = np.empty(len(top)), np.empty(len(top)), np.empty(len(top), np.int64)
    n = 0
    for k in range(len(top)):
        common = np.minimum(bottoms[:n], bottom[k]) - np.maximum(tops[:n], top[k])
        small = np.minimum(max(bottom[k] - top[k], 0.1), np.maximum(bottoms[:n] - tops[:n], 0.1))
        hit = np.flatnonzero(common > small / 2)
        at = int(hit[0]) if len(hit) else n
        if at == n:
            tops[n], bottoms[n], n = top[k], bottom[k], n + 1
        tops[at], bottoms[at] = min(tops[at], top[k]), max(bottoms[at], bottom[k])
        found[k] = at
    return found


def visual_lines(rows: DataFrame, page: list[str]) -> DataFrame:
    """rows (top, bottom, ord) with `line`: in their order, each joins the first line that it overlaps by more than half a height, which grows by it."""
    return _in_runs(rows, page, ["ord"], "line", _rows_to_lines, ["top", "bottom"])


def line_ranges(texts: DataFrame, key: str, text: str, lines: str) -> DataFrame:
    """(key, line, start, end): where each line (an array of them) is found in its text, from the end of the one before; null where it isn't, and from there on."""
    import pyarrow as pa

    def work(batches) -> Iterator:
        for b in batches:
            out = []
            for k, t, own in zip(b.column("k").to_pylist(), b.column("t").to_pylist(), b.column("l").to_pylist(), strict=True):
                at = 0
                for i, line in enumerate(own or []):
                    line = (line or "").rstrip()
                    found = -1 if at is None or t is None else t.find(line, at)
                    at = None if found < 0 else found + len(line)
                    out.append((k, i, None if found < 0 else found, at))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], ["key", "line", "start", "end"])

    return texts.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.col(lines).alias("l")).mapInArrow(work, "key long, line int, start long, end long")


def provenance(n_first: Column, n: Column, start: Column, end: Column, inserted: Column, boundary: Column) -> tuple[dict[str, Column], Column]:
    """How many characters two owners keep, exchange and get after one edit of their joined text; and why it isn't allowed.

    The first owner has n_first of n characters; after the edit the boundary
    says how many are its own.  Only its tail may move, into the second.
    """
    owner = F.when((start < n_first) & (end <= n_first), 0).when(start > n_first, 1)
    after = n + inserted - (end - start)
    # characters of the first owner that outlive the edit, and where the inserted ones lie
    kept_first = F.greatest(n_first - F.greatest(F.least(end, n_first) - F.least(start, n_first), F.lit(0)), F.lit(0))
    own_inserted = F.when(owner == 0, inserted).otherwise(F.lit(0))
    moved = kept_first + own_inserted - boundary
    reason = (
        F.when((start <= 0) | (start > end) | (end >= n) | ((start == end) & (inserted == 0)), "no internal edit")
        .when(owner.isNull(), "across the owners")
        .when((boundary <= 0) | (boundary >= after), "an owner without text")
        .when((owner == 0) & (inserted > 0) & (start + inserted > boundary), "inserted text leaves its owner")
        .when(moved < 0, "into the first owner")
    )
    counts = {"first_retained": boundary - own_inserted, "relocated": moved, "second_retained": after - boundary - moved - (inserted - own_inserted), "inserted": inserted}
    return {k: F.when(reason.isNull(), v).cast("long") for k, v in counts.items()}, reason


def region_breaks(slots: DataFrame, keys: list[str], order: str, page: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """(keys, offset, before, after, kind): the breaks between neighbouring slots (start, end) of a paragraph that hold text: page or container breaks.  Slots of one place go by the columns `ties`."""
    held = slots.where("start <> end")
    w = Window.partitionBy(*keys).orderBy(order, *ties)
    kind = F.when(F.lead(page).over(w) != F.col(page), "page_break").otherwise("container_break")
    rows = held.select(*keys, F.col("end").alias("offset"), F.col(order).alias("before"), F.lead(order).over(w).alias("after"), kind.alias("kind"))
    return rows.where("after is not null")


def chain_reach(rows: DataFrame, keys: list[str], zone: Column) -> DataFrame:
    """rows (top, bottom, ord) of keys that a growing area takes in, from the first down: each begins within the zone below all before it."""
    w = Window.partitionBy(*keys).orderBy("top", "ord")
    reach = F.max("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = rows.withColumn("_apart", F.coalesce((F.col("top") >= reach + zone).cast("int"), F.lit(0)))
    return apart.withColumn("_gone", F.sum("_apart").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_gone = 0").drop("_apart", "_gone")


def space_share(width: Column, ink: Column, n_spaces: Column, size: Column) -> Column:
    """What each inner space of a justified line is widened by; 0 where it has none, is full, or would need more than a size for each."""
    slack = width - ink
    return F.when((n_spaces > 0) & (slack > 0) & (slack <= n_spaces * size * WIDEST), slack / n_spaces).otherwise(F.lit(0.0))


def pixel_differences(before: DataFrame, after: DataFrame, page: str, masked: DataFrame | None = None) -> DataFrame:
    """For each page: pixels (x, y, v) that differ at all and by more than SLIGHT, and the box around them; those of a mask (x, y) don't count."""
    both = before.select(page, "x", "y", F.col("v").alias("_b")).join(after.select(page, "x", "y", F.col("v").alias("_a")), [page, "x", "y"], "full_outer")
    if masked is not None:
        both = both.join(masked.select(page, "x", "y"), [page, "x", "y"], "left_anti")
    off = F.abs(F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0)))
    differs = lambda c: F.when(off > 0, F.col(c))
    return both.groupBy(page).agg(
        F.count_if(off > 0).alias("n_differ"), F.count_if(off > SLIGHT).alias("n_strong"), *[f(differs(c)).alias(n) for f, c, n in ((F.min, "x", "x0"), (F.min, "y", "y0"), (F.max, "x", "x1"), (F.max, "y", "y1"))]
    )


def weight_scores(glyphs: DataFrame, candidates: DataFrame, keys: list[str], most: int = 24) -> DataFrame:
    """(keys, face, distance, n): how far each candidate's glyph weights (face, ch, weight) are on average from those of the first `most` distinct glyphs (ord, ch, weight) of a text."""
    firsts = glyphs.groupBy(*keys, "ch").agg(F.min(F.struct("ord", "weight")).alias("_f"))
    w = Window.partitionBy(*keys).orderBy("_f.ord")
    sample = firsts.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).select(*keys, "ch", F.col("_f.weight").alias("_own"))
    pairs = sample.join(candidates, "ch")
    return pairs.groupBy(*keys, "face").agg(F.round(F.avg(F.abs(F.col("weight") - F.col("_own"))), 5).alias("distance"), F.count("*").alias("n"))


def contract_faults(json: Column, required: list[str], optional: list[str]) -> tuple[Column, Column]:
    """(missing, unknown) keys of a JSON object against a closed set; both null for what is no object."""
    keys = F.json_object_keys(json)
    names = lambda x: F.array(*[F.lit(k) for k in x])
    return F.array_except(names(required), keys), F.array_except(keys, names([*required, *optional]))


def occupancy_needs(inks: DataFrame, slots: DataFrame, page: list[str]) -> DataFrame:
    """(page, task, need): the other slots (slot, x0 to y1) whose text a slot's planned ink (slot, x0 to y1) meets, which must be rewritten before it."""
    a = inks.select(*page, F.col("slot").alias("task"), "x0", "y0", "x1", "y1")
    b = slots.select(*page, F.col("slot").alias("need"), *[F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")])
    return meet(a, b, page, CELL).where((F.col("task") != F.col("need")) & Rect.of().intersects(Rect.of("b"))).select(*page, "task", "need").distinct()


def mark_rectangles(glyphs: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mark, line, x0, x1, baseline): what each mark (mark, start, end) covers of every line of glyphs (line, at, x0, x1, baseline, blank), without the line's blanks at its ends; glyphs of one baseline each, else null."""
    g = spans.points_in(glyphs, marks, keys, "at", "start", "end")
    inked = lambda c: F.when(~F.col("blank"), F.col(c))
    found = g.groupBy(*keys, "mark", "line").agg(F.min(inked("x0")).alias("x0"), F.max(inked("x1")).alias("x1"), F.count_distinct(inked("baseline")).alias("_n"), F.min(inked("baseline")).alias("_b"))
    return found.where("x0 is not null").select(*keys, "mark", "line", "x0", "x1", F.when(F.col("_n") == 1, F.col("_b")).alias("baseline"))


def kept_outside(before: DataFrame, after: DataFrame, areas: DataFrame, page: str, value: list[str]) -> DataFrame:
    """(page, n_missing, n_extra): items (x0 to y1 and value) that aren't the same, with multiplicity, outside the areas of a page."""
    a = areas.select(page, *[F.col(c).alias("a" + c) for c in ("x0", "y0", "x1", "y1")])
    place = [page, "x0", "y0", "x1", "y1"]
    one = lambda d, sign: d.select(*place, *value, F.lit(sign).alias("_n"))
    left = one(before, 1).unionAll(one(after, -1)).groupBy(*place, *value).agg(F.sum("_n").alias("_n"))
    hit = meet(left.select(*place).distinct(), a, [page], CELL, "a").where(Rect.of().intersects(Rect.of("a"))).select(*place).distinct()
    return left.join(hit, place, "left_anti").groupBy(page).agg(F.sum(F.greatest("_n", F.lit(0))).alias("n_missing"), F.sum(F.greatest(-F.col("_n"), F.lit(0))).alias("n_extra"))


def placement_errors(planned: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, n_lost, worst): glyphs (at, ch, x, y) planned and drawn at the same places of a text, and the largest error of their positions."""
    p = planned.select(*keys, "at", F.col("ch").alias("_c"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    both = p.join(observed, [*keys, "at"], "left")
    same = F.coalesce(F.col("ch") == F.col("_c"), F.lit(False))
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~same).alias("n_lost"), F.max(F.when(same, F.greatest(F.abs(F.col("x") - F.col("_x")), F.abs(F.col("y") - F.col("_y"))))).alias("worst"))
