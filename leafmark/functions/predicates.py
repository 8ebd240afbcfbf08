"""Predicates on glyphs, regions, checks and stored records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DIRECTION = 0.001
OPAQUE = 0.999


def horizontal(dx: Column, dy: Column) -> Column:
    """Whether a writing direction is that of horizontal text."""
    return (F.abs(dx - 1.0) <= DIRECTION) & (F.abs(dy) <= DIRECTION)


def visible(kind: Column, opacity: Column, layer: Column, wmode: Column) -> Column:
    """Whether a glyph is painted filled, opaque, on no layer, in horizontal mode; a missing layer or mode is none."""
    return (kind == 0) & (opacity >= OPAQUE) & (F.coalesce(layer, F.lit("")) == "") & (F.coalesce(wmode, F.lit(0)) == 0)


def uneditable(rotated: Column, dx: str, dy: str, seen: str, text: str, glyph_id: str, style: Column, redacted: Column) -> Column:
    """Aggregate over a region's glyphs: the first reason that forbids editing it, null if there is none."""
    every = [
        ("rotated page", rotated),
        ("no text", F.count(text) == 0),
        ("not horizontal", F.count_if(~horizontal(F.col(dx), F.col(dy))) > 0),
        ("not visible", F.count_if(~F.col(seen)) > 0),
        ("unmapped glyph", F.count_if((F.col(text) == "�") | (F.col(glyph_id) == -1)) > 0),
        ("mixed styles", F.count_distinct(style) != 1),
        ("pending redaction", redacted),
    ]
    return F.coalesce(*[F.when(found, F.lit(reason)) for reason, found in every])


def check_value(json: Column) -> Column:
    """What a measured check says: a truth value is itself, an object its ok, identical or exact (the first it has), an empty list is true, else null."""
    value = F.try_parse_json(json)
    kind = F.schema_of_variant(value)
    said = [(F.is_variant_null(F.try_variant_get(value, f"$.{k}", "variant")), F.try_variant_get(value, f"$.{k}", "variant")) for k in ("ok", "identical", "exact")]
    truth = F.lit(None).cast("boolean")
    for null, field in reversed(said):
        truth = F.when(field.isNull(), truth).when(null, F.lit(False)).otherwise(_truthy(field))
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind.startswith("OBJECT"), truth)
        .when(kind.startswith("ARRAY"), F.to_json(value) == "[]")
    )


def _truthy(value: Column) -> Column:
    """Whether a JSON value counts as true: not false, 0, an empty text, list or object."""
    return ~F.to_json(value).isin("false", "0", "0.0", "-0.0", '""', "[]", "{}", "null")


def required_width(explicit: Column, inferred: Column) -> tuple[Column, Column]:
    """(width, provenance) by precedence: what was supplied, what was inferred; else unknown, which must be refused."""
    where = F.when(explicit.isNotNull(), F.lit("explicit")).when(inferred.isNotNull(), F.lit("inferred")).otherwise(F.lit("unknown"))
    return F.coalesce(explicit, inferred), where


def within(value: Column, low: Column | float, high: Column | float) -> Column:
    """Whether a number is finite and in a closed range; null isn't."""
    return F.coalesce(~F.isnan(value) & (value >= low) & (value <= high), F.lit(False))


def valid_line(text: Column, x: Column, end: Column, baseline: Column, width: Column, height: Column) -> Column:
    """Whether a stored line has a text and lies on its page, edges with a point to spare."""
    there = F.coalesce(text != "", F.lit(False)) & within(x, F.lit(-1.0), width + 1) & within(end, F.lit(-1.0), width + 1)
    return there & within(baseline, F.lit(0.0), height) & F.coalesce(end >= x, F.lit(False))


def follow_baseline(first: Column, floor: Column, same_page: Column, last: Column, gap: Column, descent: Column, ascent: Column, approved: Column) -> Column:
    """The first baseline of a paragraph that follows another.

    first: the region's own first baseline, used where nothing is before
    (last is null) or where an accepted break has a page between.  Else the
    gap, at least what descent and ascent need (ascent may be null), is added
    to the last baseline before; a break on one page keeps the region's own as
    a floor.  approved: a floor of its own, or null.
    """
    resets = last.isNull() | (floor & ~same_page)
    added = last + F.greatest(gap, F.coalesce(descent + ascent, gap))
    own = F.when(resets, first).when(floor, F.greatest(first, added)).otherwise(added)
    return F.greatest(own, approved)


def remapped(lo: Column, hi: Column, start: Column, end: Column, inserted: Column) -> tuple[Column, Column]:
    """[lo, hi) after the replacement of [start, end), where a range shrinks: null if nothing is left.

    What the edit deletes leaves; what it inserts belongs to the range only
    where the edit lies inside (an insertion, strictly inside).
    """
    shift = inserted - (end - start)
    inside = F.when(start < end, (lo <= start) & (end <= hi)).otherwise((lo < start) & (start < hi))
    new_lo = F.when(lo < start, lo).when(inside, start).otherwise(F.greatest(lo, end) + shift)
    new_hi = F.when(hi > end, hi + shift).when(inside, start + inserted).otherwise(F.least(hi, start))
    return F.when(new_hi > new_lo, new_lo), F.when(new_hi > new_lo, new_hi)


def kept_edge(left: Column, right: Column, start: Column, end: Column) -> Column:
    """Whether an edge between neighbours outlives an edit: it neither deletes an end nor inserts between them."""
    return ~(((start <= right) & (end > left)) | ((start == end) & (end == right)))
