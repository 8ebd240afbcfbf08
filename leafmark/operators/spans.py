"""Intervals and rectangles: overlap joins, conflicts, and edits as interval replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.geometry import Rect
from leafmark.storage import stage


def overlap_pairs(df: DataFrame, keys: list[str], ident: str, low: str, high: str, cell: float) -> DataFrame:
    """Pairs (a, b), a < b, of intervals of one key that overlap strictly.

    Intervals meet in grid cells of the given width, in the first that both
    touch, so a key with many rows is dealt out and no pair comes twice.
    """
    side = lambda p: df.select(*keys, *[F.col(c).alias(p + c) for c in (ident, low, high)], F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))).alias("_cell"))
    pairs = side("a_").join(side("b_"), [*keys, "_cell"])
    first = F.floor(F.greatest(F.col("a_" + low), F.col("b_" + low)) / cell)
    meet = (F.col("a_" + ident) < F.col("b_" + ident)) & (F.col("a_" + low) < F.col("b_" + high)) & (F.col("b_" + low) < F.col("a_" + high))
    return pairs.where(meet & (first == F.col("_cell"))).select(*keys, F.col("a_" + ident).alias("a"), F.col("b_" + ident).alias("b"))


def conflicts(a_start: Column, a_end: Column, b_start: Column, b_end: Column, ordered: Column) -> Column:
    """Whether two replacements conflict: they overlap, or an insertion touches the other and the pair isn't ordered."""
    insertion = (a_start == a_end) | (b_start == b_end)
    return ((a_start < b_end) & (b_start < a_end)) | (insertion & (a_start <= b_end) & (b_start <= a_end) & ~ordered)


def _cells(low: Column, high: Column, cell: float) -> Column:
    """The grid cells that a closed interval touches."""
    return F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long"))


def conflict_pairs(df: DataFrame, keys: list[str], ident: str, low: str, high: str, ordered: str, cell: float) -> DataFrame:
    """Pairs (keys, a, b, a_ordered, b_ordered), a < b, of replacements of one key that conflict, met in the first grid cell that both touch."""
    side = lambda p: df.select(*keys, *[F.col(c).alias(p + n) for c, n in ((ident, "id"), (low, "lo"), (high, "hi"), (ordered, "o"))], F.explode(_cells(F.col(low), F.col(high), cell)).alias("_cell"))
    pairs = side("a_").join(side("b_"), [*keys, "_cell"])
    meet = conflicts(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"), F.col("a_o") & F.col("b_o"))
    first = F.floor(F.greatest("a_lo", "b_lo") / cell).cast("long") == F.col("_cell")
    return pairs.where((F.col("a_id") < F.col("b_id")) & first & meet).select(*keys, F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("a_o").alias("a_ordered"), F.col("b_o").alias("b_ordered"))


def points_in(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, cell: float = 256) -> DataFrame:
    """Points with the spans of their key that contain them, half open; they meet in grid cells, so a key with many rows is dealt out."""
    own = points.withColumn("_cell", F.floor(F.col(at) / cell).cast("long"))
    there = spans.where(F.col(start) < F.col(end)).withColumn("_cell", F.explode(_cells(F.col(start), F.col(end), cell)))
    return own.join(there, [*keys, "_cell"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_cell")


def _along(rows: list[DataFrame], keys: list[str], order: list) -> tuple[DataFrame, object]:
    """Tables as one, and the window over it in order."""
    both = rows[0]
    for more in rows[1:]:
        both = both.unionByName(more, allowMissingColumns=True)
    return both, Window.partitionBy(*keys).orderBy(*order)


def free_of(rows: DataFrame, others: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """The rows (intervals) that none of the others of their key overlaps strictly.

    In the order of starts, the farthest end of the others that begin before a
    row's end tells it; there are no pairs.
    """
    names = rows.columns
    probes = rows.select("*", F.col(high).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("_end"))
    marks = others.select(*keys, F.col(low).alias("_at"), F.lit(1).alias("_kind"), F.col(high).cast("double").alias("_end"))
    both, w = _along([probes, marks], keys, ["_at", "_kind"])
    reached = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("_end", reached).where((F.col("_kind") == 0) & (F.col("_end").isNull() | (F.col("_end") <= F.col(low)))).select(*names)


def clearance(a: DataFrame, b: DataFrame, keys: list[str], low: str, high: str, cell: float) -> DataFrame:
    """(keys, n_pairs, clearance, n_touching) of all pairs of a's and b's intervals of a key.

    clearance is the least gap, negative where pairs overlap.  Pairs that touch
    meet in grid cells; the gaps of all others are found along the sorted ends,
    and their number is a product of counts.
    """
    n = a.groupBy(*keys).agg(F.count("*").alias("_a")).join(b.groupBy(*keys).agg(F.count("*").alias("_b")), keys)
    side = lambda d, p: d.select(*keys, F.col(low).alias(p + "lo"), F.col(high).alias(p + "hi"), F.explode(_cells(F.col(low), F.col(high), cell)).alias("_cell"))
    gap = F.greatest(F.col("b_lo") - F.col("a_hi"), F.col("a_lo") - F.col("b_hi"))
    first = F.floor(F.greatest("a_lo", "b_lo") / cell).cast("long") == F.col("_cell")
    met = side(a, "a_").join(side(b, "b_"), [*keys, "_cell"]).where(first & (gap <= 0)).groupBy(*keys).agg(F.count("*").alias("n_touching"), F.min(gap).alias("_gap"))
    ends = lambda d, k: d.select(*keys, F.col(high).alias("_at"), F.lit(0).alias("_kind"), F.lit(k).alias("_side"))
    starts = lambda d, k: d.select(*keys, F.col(low).alias("_at"), F.lit(1).alias("_kind"), F.lit(k).alias("_side"))
    both, w = _along([ends(a, 0), starts(a, 0), ends(b, 1), starts(b, 1)], keys, ["_at", "_kind"])
    before = lambda k: F.max(F.when((F.col("_kind") == 0) & (F.col("_side") == k), F.col("_at"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    last = F.when(F.col("_side") == 0, before(1)).otherwise(before(0))
    apart = both.withColumn("_last", last).where("_kind = 1").groupBy(*keys).agg(F.min(F.col("_at") - F.col("_last")).alias("_apart"))
    return n.join(met, keys, "left").join(apart, keys, "left").select(*keys, (F.col("_a") * F.col("_b")).alias("n_pairs"), F.least("_gap", "_apart").alias("clearance"), F.coalesce("n_touching", F.lit(0)).alias("n_touching"))


def rectangle_cover(a: DataFrame, b: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """(keys, n_meet, n_inside, area, least_gap) of all pairs of a's and b's rectangles (x0, y0, x1, y1) of a key.

    Pairs meet in grid cells along x.  Those that touch are counted; where a
    key has none, rectangles are widened, twice as far each turn, until some
    meet: their least gap is the least of all.
    """
    both = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys)
    names = ("x0", "y0", "x1", "y1")
    left, right = Rect.of("a_"), Rect.of("b_")

    def pairs(of: DataFrame, reach: float) -> DataFrame:
        width = cell + 2 * reach
        side = lambda d, p, r: d.join(of, keys, "left_semi").select(*keys, *[F.col(c).alias(p + c) for c in names], F.explode(_cells(F.col("x0") - r, F.col("x1") + r, width)).alias("_cell"))
        met = side(a, "a_", reach).join(side(b, "b_", 0.0), [*keys, "_cell"])
        first = F.floor(F.greatest(F.col("a_x0") - reach, F.col("b_x0")) / width).cast("long") == F.col("_cell")
        return met.withColumn("_gap", left.gap(right)).where(first & (F.col("_gap") <= reach))

    touching = pairs(both, 0.0).groupBy(*keys).agg(
        F.count_if(left.intersects(right)).alias("n_meet"), F.count_if(left.contains(right)).alias("n_inside"), F.sum(left.overlap(right)).alias("area"), F.min("_gap").alias("least_gap")
    )
    touching = stage(touching, "touching")
    rest, out, reach = stage(both.join(touching, keys, "left_anti"), "rest"), touching, cell
    while not rest.isEmpty():
        near = stage(pairs(rest, reach).groupBy(*keys).agg(F.min("_gap").alias("least_gap")), "near")
        out = out.unionByName(near.select(*keys, F.lit(0).cast("long").alias("n_meet"), F.lit(0).cast("long").alias("n_inside"), F.lit(0.0).alias("area"), "least_gap"))
        rest, reach = stage(rest.join(near, keys, "left_anti"), "rest"), reach * 2
    return out


def map_offsets(points: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """(key, at, mapped): offsets after disjoint edits (key, start, end, length); null for offsets that an edit consumed.

    Along a text, what edits that ended before add and how many are open are
    running sums; nothing is paired.
    """
    grows = F.col("length") - (F.col("end") - F.col("start"))
    ends = edits.select(key, F.col("end").alias("_at"), F.lit(0).alias("_kind"), grows.cast("long").alias("_grows"), F.lit(-1).alias("_open"))
    starts = edits.select(key, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_grows"), F.lit(1).alias("_open"))
    asked = points.select(key, F.col("at").alias("_at")).distinct().withColumns({"_kind": F.lit(1), "_grows": F.lit(0).cast("long"), "_open": F.lit(0)})
    both, w = _along([ends, starts, asked], [key], ["_at", "_kind"])
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_sum", F.sum("_grows").over(so_far)).withColumn("_in", F.sum("_open").over(so_far)).where("_kind = 1")
    return found.select(key, F.col("_at").alias("at"), F.when(F.col("_in") == 0, F.col("_at") + F.col("_sum")).alias("mapped"))


def apply_edits(texts: DataFrame, edits: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, edited): texts after disjoint replacements (key, start, end, text), offsets in code points.

    Kept pieces lie between the edits, so a text is cut once for each edit and
    never into characters.
    """
    ordered = edits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", F.col("insert")))).alias("_edits"))
    joined = texts.join(ordered, key, "left")
    pieces = F.transform(
        F.col("_edits"),
        lambda e, i: F.concat(
            F.substring(F.col(text), F.coalesce(F.get(F.col("_edits"), i - 1)["end"], F.lit(0)) + 1, e["start"] - F.coalesce(F.get(F.col("_edits"), i - 1)["end"], F.lit(0))), e["insert"]
        ),
    )
    rest = F.substring(F.col(text), F.coalesce(F.element_at("_edits", -1)["end"], F.lit(0)) + 1, F.char_length(text))
    edited = F.when(F.col("_edits").isNull(), F.col(text)).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return joined.select(key, edited.alias("edited"))


def project_range(lo: Column, hi: Column, start: Column, end: Column, inserted: Column, inside: Column) -> tuple[Column, Column, Column]:
    """[lo, hi) after the replacement of [start, end): the new edges and whether the edit crosses an edge of the range.

    An insertion at an edge belongs to the range if `inside`.
    """
    delta = inserted - (end - start)
    crosses = ((start < lo) & (lo < end)) | ((start < hi) & (hi < end))
    before = (end < lo) | ((end == lo) & ~((start == end) & inside))
    after = (start > hi) | ((start == hi) & ~((start == end) & inside))
    new_lo = F.when(before, lo + delta).otherwise(lo)
    new_hi = F.when(before, hi + delta).when(after, hi).otherwise(hi + delta)
    return F.when(~crosses, new_lo), F.when(~crosses, new_hi), crosses


def tag_depths(tokens: DataFrame, keys: list[str], order: str, opens: Column, closes: Column) -> DataFrame:
    """tokens with depth after each: opened less closed so far."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("depth", F.sum(opens.cast("int") - closes.cast("int")).over(w))
