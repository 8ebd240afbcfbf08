"""Orders of changes, origins of characters, bands of a page, reachable definitions, rows merged beside each other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.operators.sequential import _in_runs
from leafmark.storage import stage

# Rows of one visual line differ by so many points at least and sizes at most in their baselines, and are so many sizes apart.
OFFSET_POINTS, OFFSET_MOST, TOUCH_LEAST, TOUCH_MOST = 0.05, 0.35, -0.05, 0.5
#: Rows of a page up to which lines are plain numbers, not arrays.
FEW_ROWS = 48


def application_order(mutations: DataFrame, keys: list[str]) -> DataFrame:
    """mutations (start, end, insertion: its order, null for replacements, ord) with `position`, from 0, in which they are applied: from the last place backward, so that none moves another."""
    w = Window.partitionBy(*keys).orderBy(F.desc("start"), F.desc("end"), F.desc(F.coalesce("insertion", F.lit(-1))), F.desc("ord"))
    return mutations.withColumn("position", F.row_number().over(w) - 1)


def renumbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """rows with stable numbers from 1 after an explicit order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def origins(texts: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """(key, start, end, origin): the pieces of a text (key, n characters) after disjoint edits (key, start, end, length), each with the offset that it had, null if it was inserted.

    A piece is known by its place and never by its text.
    """
    w = Window.partitionBy(key).orderBy("_s", "_e")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    e = edits.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("length").alias("_l"))
    last = texts.join(e.select(key).distinct(), key, "left_semi").select(key, F.col("n").alias("_s"), F.col("n").alias("_e"), F.lit(0).cast("long").alias("_l"))
    rows = e.unionByName(last.withColumn("_l", F.lit(None).cast("long"))).withColumn("_l0", F.coalesce("_l", F.lit(0)))
    rows = rows.withColumn("_from", F.coalesce(F.lag("_e").over(w), F.lit(0))).withColumn("_grown", F.coalesce(F.sum(F.col("_l0") - (F.col("_e") - F.col("_s"))).over(before), F.lit(0)))
    kept = F.struct((F.col("_from") + F.col("_grown")).alias("start"), (F.col("_s") + F.col("_grown")).alias("end"), F.col("_from").alias("origin"))
    put = F.struct((F.col("_s") + F.col("_grown")).alias("start"), (F.col("_s") + F.col("_grown") + F.col("_l0")).alias("end"), F.lit(None).cast("long").alias("origin"))
    pieces = rows.select(key, F.explode(F.array(kept, put)).alias("p")).select(key, "p.*").where("start < end")
    whole = texts.join(e.select(key).distinct(), key, "left_anti").where("n > 0").select(key, F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.lit(0).cast("long").alias("origin"))
    return pieces.unionByName(whole)


def kept_fields(json: Column, kept: list[str]) -> Column:
    """An object's fields of a closed list, as a map of their JSON values; others fall away."""
    return F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: k.isin(*kept))


def page_seams(lines: DataFrame, page: list[str]) -> DataFrame:
    """(page, n_above, n_below): lines (baseline, owned) of others before the first and behind the last owned line of a page; pages that own none aren't there."""
    owned = F.when(F.col("owned"), F.col("baseline"))
    w = Window.partitionBy(*page)
    rows = lines.withColumn("_first", F.min(owned).over(w)).withColumn("_last", F.max(owned).over(w)).where("_first is not null")
    return rows.groupBy(*page).agg(F.count_if(~F.col("owned") & (F.col("baseline") < F.col("_first"))).alias("n_above"), F.count_if(~F.col("owned") & (F.col("baseline") > F.col("_last"))).alias("n_below"))


def misplaced_lines(lines: DataFrame, top: Column, bottom: Column) -> DataFrame:
    """The lines (y0, y1, role) whose role contradicts the body band: headers and footers that reach into it, body lines that leave it."""
    inside = (F.col("y0") >= top) & (F.col("y1") <= bottom)
    outside = (F.col("y1") <= top) | (F.col("y0") >= bottom)
    fault = F.when(F.col("role").isin("header", "footer") & ~outside, "reaches into the body").when((F.col("role") == "body") & ~inside, "leaves the body")
    return lines.withColumn("fault", fault).where("fault is not null")


def free_regions(rows: DataFrame, keys: list[str], clip_top: Column, clip_bottom: Column) -> DataFrame:
    """rows (y0, y1, ord) with room_top and room_bottom: half way to the neighbours above and below, or to the clip where there is none."""
    w = Window.partitionBy(*keys).orderBy("y0", "ord")
    above, below = F.lag("y1").over(w), F.lead("y0").over(w)
    top = F.when(above.isNull(), clip_top).otherwise(F.greatest(clip_top, F.least((above + F.col("y0")) / 2, F.col("y0"))))
    bottom = F.when(below.isNull(), clip_bottom).otherwise(F.least(clip_bottom, F.greatest((F.col("y1") + below) / 2, F.col("y1"))))
    return rows.withColumn("room_top", top).withColumn("room_bottom", bottom)


def reachable(edges: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """(key, node, path): the nodes that edges (key, parent, child, name) reach from roots (key, node), each by its shortest path, of equals the first; definitions that recurse are entered once."""
    step = stage(roots.select(key, "node", F.lit("").alias("path")).distinct(), "reachable")
    edge, found = stage(edges.select(key, F.col("parent").alias("node"), "child", "name"), "edges"), step
    while True:
        below = step.join(edge, [key, "node"]).groupBy(key, F.col("child").alias("node")).agg(F.min(F.concat_ws("/", F.nullif("path", F.lit("")), "name")).alias("path"))
        step = stage(below.join(found.select(key, "node"), [key, "node"], "left_anti"), "reachable")
        if step.isEmpty():
            return found
        # each is written once, in the round that reached it
        found = found.unionByName(step)


def _merged(baseline, x0, x1, size, owner) -> np.ndarray:
    """The visual line of each row: the first, of those that it touches at a slightly different baseline, of its own owner; lines take the place and size of their larger part."""
    n, found = len(baseline), np.empty(len(baseline), np.int64)
    if n <= FEW_ROWS and not np.isnan(baseline + x0 + x1 + size + owner).any():
        return np.array(_merged_few(*[c.tolist() for c in (baseline, x0, x1, size, owner)]), np.int64)
    base, left, right, em, own, weight = (np.empty(n) for _ in range(6))
    count = 0
    for k in range(n):
        c = slice(0, count)
        apart, small, large = np.abs(base[c] - baseline[k]), np.minimum(em[c], size[k]), np.maximum(em[c], size[k])
        gap = np.maximum(x0[k] - right[c], left[c] - x1[k])
        fits = (apart > OFFSET_POINTS) & (apart <= OFFSET_MOST * small) & (gap >= TOUCH_LEAST * small) & (gap <= TOUCH_MOST * large) & (own[c] == owner[k])
        at = int(np.flatnonzero(fits)[0]) if fits.any() else count
        wide = x1[k] - x0[k]
        if at == count:
            base[at], left[at], right[at], em[at], own[at], weight[at], count = baseline[k], x0[k], x1[k], size[k], owner[k], wide, count + 1
        else:
            if wide > weight[at]:
                base[at], em[at] = baseline[k], size[k]
            left[at], right[at], weight[at] = min(left[at], x0[k]), max(right[at], x1[k]), weight[at] + wide
        found[k] = at
    return found


def _merged_few(baseline, x0, x1, size, owner) -> list[int]:
    """_merged of a few rows without null or infinite places, for which plain numbers are faster than arrays."""
    lines, found = [], []  # baseline, left, right, size, owner and width of the larger part
    for y, a, b, em, own in zip(baseline, x0, x1, size, owner, strict=True):
        for at, line in enumerate(lines):
            apart, small, large = abs(line[0] - y), min(line[3], em), max(line[3], em)
            gap = max(a - line[2], line[1] - b)
            if line[4] == own and OFFSET_POINTS < apart <= OFFSET_MOST * small and TOUCH_LEAST * small <= gap <= TOUCH_MOST * large:
                if b - a > line[5]:
                    line[0], line[3] = y, em
                line[1], line[2], line[5] = min(line[1], a), max(line[2], b), line[5] + (b - a)
                break
        else:
            at = len(lines)
            lines.append([y, a, b, em, own, b - a])
        found.append(at)
    return found


def merge_offset_rows(rows: DataFrame, page: list[str]) -> DataFrame:
    """rows (baseline, x0, x1, size, owner: a number, ord) with `visual`: rows drawn beside each other on slightly different baselines are one visual line.

    In their order each row joins the first line that it touches and whose
    baseline differs a little; rows on one baseline were parted before and stay
    so.  A line keeps the baseline and size of its wider part.
    """
    return _in_runs(rows, page, ["ord"], "visual", _merged, ["baseline", "x0", "x1", "size", "owner"])
