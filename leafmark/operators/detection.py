"""From drawn rows to paragraphs, columns and cells: gutters, owners, breaks, labels, blocks, spacing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.operators import aggregates, areas, islands
from leafmark.operators.sequential import LEFT_APART, RIGHT_APART, RIGHT_OVERLAP, SIZE_RATIO, _in_runs
from leafmark.storage import stage

# Fixed values.
#: Gaps that part columns, in sizes: always, and where the paint order jumps too.
GUTTER, NARROW_GUTTER = 1.8, 0.9
#: Paragraph breaks: gap in leadings; indent and what counts as none, in sizes; a short line's share of the widest.
GAP, INDENT, NO_INDENT, SHORT = 1.3, 0.75, 0.5, 0.72
#: Leading of text without a gap, in sizes.
LEADING = 1.4
#: Points that a gap's spacing may be off.
SPACING = 0.02
#: Points of a grid cell in which drawn things meet.
CELL = 64.0
#: Marks that may hang beyond a column's edge.
HANGING = "、。，．,."
#: List markers besides all other symbols (category So).
MARKERS = "•・‣⁃◦※"
#: A label: number, kanji numeral, roman numeral or letter, bracketed or not; 注 with a number.
LABEL_CORE = r"(?:[(（\[［]?(?:[0-9０-９]{1,3}|[一二三四五六七八九十]{1,3}|[ivxIVX]{1,4}|[a-zA-Zａ-ｚＡ-Ｚ])|注[0-9０-９]{0,2})"
#: What may end a label; labels that stand by themselves.
LABEL_END, LABEL_ALONE = r"[)）\]］.．、:：]", r"[①-⑳]|[*＊※†‡§]"


def split_gutters(glyphs: DataFrame, page: list[str], row: list[str], size: Column) -> DataFrame:
    """glyphs (x0, x1, paint, inked) of rows with `piece`: cut in the middle of gaps between columns.

    A gap over GUTTER sizes is a cut, and one over NARROW_GUTTER if the glyph
    on its right isn't the next inked glyph that the page paints.
    """
    by_paint = Window.partitionBy(*page, "inked").orderBy("paint")
    ranked = glyphs.withColumn("_painted", F.when(F.col("inked"), F.row_number().over(by_paint)))
    w = Window.partitionBy(*row).orderBy("x0", "paint")
    ink = ranked.where("inked").withColumn("_gap", F.col("x0") - F.lag("x1").over(w)).withColumn("_next", F.col("_painted") - F.lag("_painted").over(w) == 1)
    wide = (F.col("_gap") > size * GUTTER) | ((F.col("_gap") > size * NARROW_GUTTER) & ~F.col("_next"))
    cuts = ink.where(wide).select(*row, (F.col("x0") - F.col("_gap") / 2).alias("_x"), F.lit(1).alias("_cut"))
    both = ranked.drop("_painted").withColumn("_x", F.col("x0")).withColumn("_cut", F.lit(0)).unionByName(cuts, allowMissingColumns=True)
    so_far = Window.partitionBy(*row).orderBy("_x", "_cut").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("piece", F.sum("_cut").over(so_far)).where("_cut = 0").drop("_cut", "_x")


def split_owners(glyphs: DataFrame, row: list[str], order: list[str], owner: str) -> DataFrame:
    """glyphs with `piece`: a row is cut where the owner changes, if each owner's glyphs follow each other; glyphs without owner stay with what is before."""
    w = Window.partitionBy(*row).orderBy(*order)
    before = F.last(owner, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = glyphs.withColumn("_new", F.col(owner).isNotNull() & ~F.col(owner).eqNullSafe(before))
    counts = marked.groupBy(*row).agg(F.count_if("_new").alias("_runs"), F.count_distinct(owner).alias("_owners"), F.min_by(F.col(owner).isNotNull(), F.struct(*order)).alias("_first"))
    joined = marked.join(counts, row)
    at = F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_first").cast("int")
    piece = F.when((F.col("_runs") >= 2) & (F.col("_runs") == F.col("_owners")), at).otherwise(F.lit(0))
    return joined.withColumn("piece", piece).drop("_new", "_runs", "_owners", "_first")


def paragraphs(lines: DataFrame, box: list[str], size: Column) -> DataFrame:
    """lines (baseline, x0, x1, text) of boxes with `leading` and `paragraph`.

    A paragraph begins after a gap over GAP leadings, at an indent after a line
    without one, and after a short line that ends a sentence.  The leading is
    the median of the lower half of the gaps.
    """
    order = ["baseline", "x0"]
    w = Window.partitionBy(*box).orderBy(*order)
    gaps = lines.withColumn("_gap", F.col("baseline") - F.lag("baseline").over(w))
    leading = aggregates.lower_half_median(gaps, box, "_gap", "leading")
    every = Window.partitionBy(*box)
    rows = gaps.join(leading, box, "left").withColumn("leading", F.coalesce("leading", size * LEADING))
    rows = rows.withColumn("_left", F.min("x0").over(every)).withColumn("_widest", F.max(F.col("x1") - F.col("x0")).over(every))
    apart = F.col("_gap") > F.col("leading") * GAP
    indent = (F.col("x0") - F.col("_left") >= size * INDENT) & (F.lag("x0").over(w) - F.col("_left") < size * NO_INDENT)
    short = (F.lag(F.col("x1") - F.col("x0")).over(w) < F.col("_widest") * SHORT) & F.rtrim(F.lag("text").over(w)).rlike(r"[.!?。！？]$")
    marked = rows.withColumn("_starts", apart | indent | short)
    return islands.islands(marked, box, order, F.col("_starts"), "paragraph").drop("_gap", "_left", "_widest", "_starts")


def marker(text: Column) -> Column:
    """The list marker that a row begins with, or null."""
    first = F.left(F.ltrim(text), F.lit(1))
    return F.when(first.rlike(r"^\p{So}$") | ((first != "") & F.contains(F.lit(MARKERS), first)), first)


def label(text: Column) -> Column:
    """The label that a row begins with, set apart from its text, or null; a row with a gap of more than half a size in its text has none."""
    found = F.regexp_extract(text, rf"^ *({LABEL_ALONE}|{LABEL_CORE}{LABEL_END}|{LABEL_CORE}(?= ))(?= *[^ ])", 1)
    rest = F.substring(F.ltrim(text), F.char_length(found) + 1, F.char_length(text))
    return F.when((found != "") & ~F.ltrim(rest).rlike(r"[^ ](?:  +|　)[^ ]"), found)


def cell_edges(texts: DataFrame, rules: DataFrame, glyphs: DataFrame, page: str) -> DataFrame:
    """(id, edge): the right edge that a drawn cell gives each text (id, x0, y0, x1, y1, size), null if none.

    rules (x, top, bottom) that span the text: the nearest on its left within
    three sizes and the nearest on its right; the padding on the left is kept
    on the right.  No edge if it adds nothing, or if another text's inked glyph
    (owner, gx0, gy0, gx1, gy1) lies in what it adds.
    """
    own = ("x0", "y0", "x1", "y1")
    # the rule on the left is the last one before that spans the text, if it is near enough; a text goes with its places, so that none is joined
    before = texts.select(page, F.struct("id", *own, (F.col("x0") - F.col("size") * 3).alias("least")).alias("id"), (F.col("y0") + 1).alias("low"), F.greatest(F.col("y0") + 1, F.col("y1") - 1).alias("high"), F.col("x0").alias("at"))
    lines = rules.select(page, F.col("top").alias("low"), F.col("bottom").alias("high"), F.col("x").alias("edge"))
    near = areas.nearest_spanning(before, lines, [page], CELL).where(F.col("edge") >= F.col("id.least"))
    left = near.groupBy(page, *[F.col(f"id.{c}").alias(c) for c in ("id", *own)]).agg(F.max("edge").alias("_left"))
    left = stage(left, "left")
    asks = left.select(page, F.struct("id", *own, "_left").alias("id"), (F.col("y0") + 1).alias("low"), (F.col("y1") - 1).alias("high"), (-F.col("x1")).alias("at"))
    bars = rules.join(left.select(page).distinct(), page, "left_semi").select(page, F.col("top").alias("low"), F.col("bottom").alias("high"), (-F.col("x")).alias("edge"))
    right = areas.nearest_spanning(asks, bars, [page], CELL).select(page, "id.*", (-F.col("edge")).alias("_right"))
    edges = right.withColumn("edge", F.col("_right") - F.greatest(F.lit(0.5), F.col("x0") - F.col("_left"))).where(F.col("edge") > F.col("x1") + 0.05)
    edges = stage(edges, "edges")
    added = edges.select(page, "id", F.col("x1").alias("x0"), "y0", F.col("edge").alias("x1"), "y1")
    inside = (F.col("gx0") < F.col("x1")) & (F.col("gx1") > F.col("x0")) & (F.col("gy0") < F.col("y1")) & (F.col("gy1") > F.col("y0"))
    # of all glyphs, which are many, fewer lie in two cells of twice the size
    taken = areas.meet(added, glyphs, [page], 2 * CELL, "g").where(inside & (F.col("owner") != F.col("id"))).select("id").distinct()
    return texts.select("id").join(edges.join(taken, "id", "left_anti").select("id", "edge"), "id", "left")


def _columns_of_page(x0, x1, y, size, last_x0, last_x1, last_y, last_size) -> np.ndarray:
    """The column of each paragraph; all columns are scored at once."""
    n, found = len(y), np.empty(len(y), np.int64)
    head, tail, count = np.empty(n, np.int64), np.empty(n, np.int64), 0
    for k in range(n):
        b, a = tail[:count], head[:count]
        large = np.maximum(last_size[b], size[k])
        fits = (np.minimum(last_size[b], size[k]) >= SIZE_RATIO * large) & (y[k] > last_y[b])
        common = np.minimum(last_x1[b], x1[k]) - np.maximum(last_x0[b], x0[k])
        left = np.minimum(np.abs(x0[k] - last_x0[b]), np.abs(x0[k] - x0[a]))
        right = np.abs(x1[k] - last_x1[b])
        flush = (right <= RIGHT_APART * large) & (common >= RIGHT_OVERLAP * np.minimum(last_x1[b] - last_x0[b], x1[k] - x0[k]))
        cost = np.where(left <= LEFT_APART * large, left / large, np.where(flush, 1 + right / large, np.inf))
        cost = np.where(fits & (common > 0), cost, np.inf)
        at = int(cost.argmin()) if count and np.isfinite(cost.min()) else count
        if at == count:
            head[count] = k
            count += 1
        tail[at], found[k] = k, at
    return found


def columns(paragraphs_: DataFrame, page: list[str]) -> DataFrame:
    """paragraphs (first line: x0, x1, y, size; last line: last_x0 to last_size; ord) with `column`: chains from the top down.

    A paragraph joins the column below whose last line it is best aligned, of
    equal costs the first, or opens one.
    """
    names = ["x0", "x1", "y", "size", "last_x0", "last_x1", "last_y", "last_size"]
    return _in_runs(paragraphs_, page, ["y", "x0", "ord"], "column", _columns_of_page, names)


def _blocks_of_page(x, pen_end, first, last, size) -> np.ndarray:
    """The block of each paragraph: the one opened last of those that it continues."""
    tails, found = [], np.empty(len(x), np.int64)
    for k in range(len(x)):
        b = np.array(tails, np.int64)
        step = first[k] - last[b]
        fits = (np.abs(size[b] - size[k]) < 0.1) & (x[k] < pen_end[b]) & (x[b] < pen_end[k]) & (step > 0) & (step <= 3 * size[k]) & (np.abs(x[k] - x[b]) <= 2 * size[k])
        at = int(np.flatnonzero(fits)[-1]) if fits.any() else len(tails)
        if at == len(tails):
            tails.append(k)
        tails[at] = k
        found[k] = at
    return found


def blocks(groups: DataFrame, page: list[str]) -> DataFrame:
    """groups (x, pen_end, first, last, size, ord: a paragraph's left and right, first and last baseline) with `block`.

    Paragraphs of one size stack in a block where they overlap, begin at most
    three sizes below and are set at most two sizes aside; the block opened last is tried first.
    """
    return _in_runs(groups, page, ["ord"], "block", _blocks_of_page, ["x", "pen_end", "first", "last", "size"])


def describe_blocks(rows: DataFrame, block: list[str], group: str) -> DataFrame:
    """What a column block is like, from its rows (x, right, baseline, bottom, size, in groups that follow each other).

    left: of the lines after each group's first, or of all; pitch: the median
    of the gaps within groups that are near the least; gap: that between groups.
    """
    w = Window.partitionBy(*block).orderBy(group, "baseline")
    inner = F.lag(group).over(w) == F.col(group)
    step = F.col("baseline") - F.lag("baseline").over(w)
    rows = rows.withColumn("_inner", F.when(inner, step)).withColumn("_outer", F.when(~inner, step)).withColumn("_later", F.coalesce(inner, F.lit(False))).withColumn("_at", F.row_number().over(w))
    rows = rows.withColumn("_least", F.min("_inner").over(Window.partitionBy(*block)))
    return rows.groupBy(*block).agg(
        F.coalesce(F.min(F.when(F.col("_later"), F.col("x"))), F.min("x")).alias("left"), F.max("right").alias("right"), F.min_by("baseline", "_at").alias("top"), F.max("baseline").alias("bottom"),
        F.max("bottom").alias("ink_bottom"), F.min_by("size", "_at").alias("size"), F.median(F.when(F.col("_inner") <= F.col("_least") * 1.15, F.col("_inner"))).alias("pitch"), F.median("_outer").alias("gap"), F.count("*").alias("n_rows"),
    )


def line_ends(glyphs: DataFrame, page: list[str], low: Column, high: Column) -> DataFrame:
    """For each page: the column's right edge from the ends of its lines (glyphs: baseline, x1, ch; inked).

    An end in [low, high) that isn't a hanging mark supports an edge; two
    supports raise it to the largest, else it is `low`.
    """
    ends = glyphs.groupBy(*page, "baseline").agg(F.max_by(F.struct("x1", "ch"), F.struct("x1", "ch")).alias("e")).select(*page, F.col("e.x1").alias("x1"), F.col("e.ch").alias("ch"))
    hangs = F.contains(F.lit(HANGING), F.col("ch"))
    support = F.when((F.col("x1") >= low) & (F.col("x1") < high) & ~hangs, F.col("x1"))
    found = ends.groupBy(*page).agg(F.count(support).alias("n_supports"), F.max(support).alias("_last"), F.count_if(F.col("x1") >= high).alias("n_ignored"))
    return found.select(*page, "n_supports", "n_ignored", F.when(F.col("n_supports") >= 2, F.col("_last")).otherwise(low).alias("column_right"))


def spacing(glyphs: DataFrame, line: list[str], tracking: Column) -> DataFrame:
    """How the spacing above the tracking is spread over each line (glyphs: ord, x, nominal, tc, tw, tj, blank).

    A gap is what the next glyph's place leaves beside advance, character and
    word spacing and the adjustment before it: a repositioning.  Spacing by
    operators that is even over all gaps, or over those after blanks alone, is
    uniform; even repositioning is its own kind, however even it is.
    """
    w = Window.partitionBy(*line).orderBy("ord")
    g = glyphs.withColumn("_tj", F.lead("tj").over(w)).withColumn("_step", F.lead("x").over(w) - F.col("x"))
    g = g.withColumn("_moved", F.col("_step") - (F.col("nominal") + F.col("tc") + F.col("tw") + F.col("_tj")))
    g = g.withColumn("_excess", F.col("tc") - tracking + F.col("tw") + F.col("_tj") + F.col("_moved")).withColumn("_by_move", F.abs("_moved") > SPACING)

    def even(of: Column) -> Column:
        """Whether the excess of some gaps, one at least, is positive and the same."""
        value = F.when(of, F.col("_excess"))
        return F.coalesce((F.max(value) - F.min(value) <= SPACING) & (F.min(value) > SPACING), F.lit(False))

    def none(of: Column) -> Column:
        return F.count_if(of & (F.abs("_excess") > SPACING)) == 0

    some, moved, blank = F.col("_excess").isNotNull(), F.coalesce(F.col("_by_move"), F.lit(False)), F.col("blank")
    kind = (
        F.when(none(some), F.lit("none"))
        .when(F.count_if(moved) > 0, F.when(none(some & ~moved) & even(moved), F.lit("uniform_reposition")).otherwise(F.lit("irregular")))
        .when(even(some), F.lit("uniform_char"))
        .when(none(some & ~blank) & even(some & blank), F.lit("uniform_word"))
        .otherwise(F.lit("irregular"))
    )
    last = F.max_by(F.col("x") + F.col("nominal"), "ord")
    return g.groupBy(*line).agg(
        kind.alias("distribution"), F.coalesce(F.sum("_excess"), F.lit(0.0)).alias("excess"), F.sum("nominal").alias("natural_width"), (last - F.min_by("x", "ord")).alias("measured_width"),
        F.array_join(F.sort_array(F.collect_set("tc")), ",").alias("tc"), F.count("*").alias("n_glyphs"),
    )
