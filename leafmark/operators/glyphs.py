"""Positioned characters: observations of spans, boxes around them, and the spaces that their gaps stand for.

A span is a row with its characters in an array `chars` of structs (code,
glyph_id, x0, y0, x1, y1, origin_x, origin_y), in any order of positions.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.functions.geometry import union_of
from leafmark.functions.text import CLOSING

CHARS = "array<struct<code: int, glyph_id: int, x0: double, y0: double, x1: double, y1: double, origin_x: double, origin_y: double>>"
#: A gap is a space if it is wider than so many points, and than this share of the smaller size.  Fixed values.
GAP_POINTS, GAP_SHARE = 0.7, 0.2
#: First and last code points of the blocks whose characters aren't parted by spaces.  Fixed values.
UNSPACED = ((0x2E80, 0xA4CF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x20000, 0x323AF))
#: What a span says of all its characters.
STYLE = ("font", "size", "direction", "paint_type", "color", "opacity", "wmode", "layer")


def observations(spans: DataFrame, keys: list[str]) -> DataFrame:
    """One row a character of the spans: keys, ord, and the thirteen attributes of an observed glyph.

    unicode, glyph_id, origin, bbox and advance_bbox are the character's own,
    the rest (STYLE) its span's; a column that isn't used isn't made.
    """
    style = [c if c in spans.columns else F.lit(None).cast("string").alias(c) for c in STYLE]
    rows = spans.select(*keys, *style, F.posexplode("chars").alias("ord", "c"))
    own = [
        F.decode(F.unhex(F.lpad(F.hex("c.code"), 8, "0")), "UTF-32").alias("unicode"), F.col("c.glyph_id"), F.array("c.origin_x", "c.origin_y").alias("origin"),
        F.array("c.x0", "c.y0", "c.x1", "c.y1").alias("bbox"), (F.col("c.x1") - F.col("c.x0")).alias("advance_bbox"),
    ]
    return rows.select(*keys, "ord", *own, F.col("c.code").alias("code"), *STYLE)


def bounds(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x0, y0, x1, y1, n_glyphs): the smallest box around the glyphs (rows with x0 to y1) of a key."""
    return glyphs.groupBy(*keys).agg(*union_of(), F.count("*").alias("n_glyphs"))


def span_bounds(spans: DataFrame, keys: list[str]) -> DataFrame:
    """bounds() of spans, one a key, whose characters needn't become rows; spans without characters have no row."""
    ends = [f(f"chars.{c}").alias(c) for f, c in ((F.array_min, "x0"), (F.array_min, "y0"), (F.array_max, "x1"), (F.array_max, "y1"))]
    return spans.where(F.size("chars") > 0).select(*keys, *ends, F.size("chars").cast("long").alias("n_glyphs"))


def _classes(codes: np.ndarray, closing: str) -> tuple[np.ndarray, np.ndarray]:
    """Which characters are of words, and which may stand before a space: those and closing marks."""
    known, place = np.unique(codes, return_inverse=True)
    word = np.array([unicodedata.category(chr(c))[0] in "LN" and not any(lo <= c <= hi for lo, hi in UNSPACED) for c in known.tolist()], bool)
    before = word | np.isin(known, [ord(c) for c in closing])
    return word[place], before[place]


def word_gaps(spans: DataFrame, keys: list[str], closing: str = CLOSING) -> DataFrame:
    """(keys, after, before, x0, x1, gap): the spaces that stand for gaps, between the characters of places after and before.

    The characters of a span (a line: one row a key, with `size`) are taken by
    x0.  A gap is a space if it is wider than GAP_POINTS and GAP_SHARE of the
    size and its sides are characters of words, or a mark of `closing` and one.
    Characters overlap where they are kerned; those gaps are negative.
    """
    import pyarrow as pa

    def find(batches):
        for batch in batches:
            chars = batch.column("chars")
            counts = np.asarray(chars.value_lengths().fill_null(0)).astype(np.int64)
            flat = chars.flatten()
            x0, x1, code = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("x0", "x1", "code"))
            row = np.repeat(np.arange(len(counts)), counts)
            at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            if not ((row[1:] > row[:-1]) | (x0[1:] >= x0[:-1])).all():
                order = np.lexsort((at, x0, row))
                row, at, x0, x1, code = row[order], at[order], x0[order], x1[order], code[order]
            size = batch.column("size").to_numpy(zero_copy_only=False).astype(float)
            gap = x0[1:] - x1[:-1]
            wide = np.flatnonzero((row[1:] == row[:-1]) & (gap > np.maximum(GAP_POINTS, GAP_SHARE * size[row[1:]])))
            word, before = _classes(np.concatenate([code[wide], code[wide + 1]]), closing)
            wide = wide[before[: len(wide)] & word[len(wide) :]]
            own = [batch.column(k).take(pa.array(row[wide])) for k in keys]
            found = [pa.array(at[wide], pa.int32()), pa.array(at[wide + 1], pa.int32()), pa.array(x1[wide]), pa.array(x0[wide + 1]), pa.array(gap[wide])]
            yield pa.RecordBatch.from_arrays([*own, *found], [*keys, "after", "before", "x0", "x1", "gap"])

    kinds = ", ".join(f"`{k}` {spans.schema[k].dataType.simpleString()}" for k in keys)
    return spans.select(*keys, F.col("size").cast("double").alias("size"), "chars").mapInArrow(find, f"{kinds}, after int, before int, x0 double, x1 double, gap double")


def spans_of(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """Spans from a table of glyphs (code, glyph_id, x0 to y1, origin_x, origin_y, size, ord): one a key, its smallest size."""
    fields = [F.col(c).cast("int" if c in ("code", "glyph_id") else "double").alias(c) for c in ("code", "glyph_id", "x0", "y0", "x1", "y1", "origin_x", "origin_y")]
    rows = glyphs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", F.struct(*fields).alias("c")))).alias("_g"), F.min("size").alias("size"))
    return rows.select(*keys, "size", F.transform("_g", lambda g: g["c"]).alias("chars"))
