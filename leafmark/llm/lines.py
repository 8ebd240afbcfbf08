"""Line deduplication by site-relative frequency, with built-in functions only.

Rows are grouped by host; a line's ratio is the number of the host's rows that
contain it over the number of all rows of the host, and lines over the ratio
are boilerplate, dropped wherever the host has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm.components import attach
from leafmark.llm.shared import Scratch, stage

#: A line goes if it is in more than this share of its host's rows,
RATIO = 0.1
#: and in so many of them at least: what one row alone has is no repetition.
MIN_ROWS = 2
#: Boilerplate lines, or positions of lines that go (60 bytes each), that are broadcast at most; more are joined by a shuffle.
BROADCAST = 500_000


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a final dot; null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1)
    return F.nullif(F.rtrim(F.lower(host), F.lit(".")), F.lit(""))


#: Bytes of a line whose tags are looked for without asking whether they end.
_SHORT = 512
#: Stands for a `<` that nothing closes, while marks are searched; and the mark itself, where a text has it.
_MARK, _OPEN, _OWN = "\ufdd0", "\ufdd01", "\ufdd00"


def _bind(value: Column, use) -> Column:
    """use(value), with value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _mask_tail(text: Column, tail: Column, opening: str) -> Column:
    """text whose openings in its tail are masked."""
    return F.concat(F.left(text, F.char_length(text) - F.char_length(tail)), F.regexp_replace(tail, opening, _OPEN))


def _masked(text: Column) -> Column:
    """text without marks that open a comment, script or style and have no closing mark: each would be searched to the end of the text."""

    def comments(t: Column) -> Column:
        return _bind(F.substring_index(t, "-->", -1), lambda tail: F.when(F.contains(tail, F.lit("<!--")), _mask_tail(t, tail, "<(?=!--)")).otherwise(t))

    def elements(name: str):
        tail_of = lambda t: F.when(F.rlike(t, F.lit(rf"(?i)</{name}\s*>")), F.regexp_extract(t, rf"(?is)^.*</{name}\s*>(.*)$", 1)).otherwise(t)
        masked = lambda t: _bind(tail_of(t), lambda tail: _mask_tail(t, tail, rf"(?i)<(?={name}\b)"))
        return lambda t: F.when(F.rlike(t, F.lit(rf"(?i)<{name}\b")), masked(t)).otherwise(t)

    own = F.replace(text, F.lit(_MARK), F.lit(_OWN))
    return _bind(_bind(_bind(own, comments), elements("script")), elements("style"))


def html_lines(html: Column) -> Column:
    """The visible lines of a page: block tags break lines, other tags go, white space is squeezed.

    Comments, scripts and styles go; an opening mark that nothing closes is
    text.  Such marks are masked first, so that the work is in proportion to
    the page whatever it holds.
    """
    open_, own, mark, less = (F.lit(x) for x in (_OPEN, _OWN, _MARK, "<"))
    block = r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|td|th|table|nav|article|section|header|footer|title|head|body|html|blockquote|pre|hr)\b[^>]*>|\n"

    def closed(text: Column) -> Column:
        """text with all tags behind its last `>` masked."""
        return _bind(F.substring_index(text, ">", -1), lambda tail: F.when(F.contains(tail, less), _mask_tail(text, tail, "<")).otherwise(text))

    def bare(line: Column) -> Column:
        tags = lambda x: F.regexp_replace(x, "<[^>]*>", "")
        # within so few characters it doesn't matter whether a tag ends
        return F.when(F.octet_length(line) <= _SHORT, tags(line)).otherwise(_bind(closed(line), lambda x: F.replace(tags(x), open_, less)))

    def squeezed(line: Column) -> Column:
        return F.trim(F.regexp_replace(line, r"[\x20\x09\x0B-\x0D]+", " "))

    def plain(text: Column) -> Column:
        return F.transform(F.split(text, block), lambda x: squeezed(bare(x)))

    def masked(text: Column) -> Column:
        return F.transform(F.split(closed(text), block), lambda x: squeezed(F.replace(bare(F.replace(x, open_, less)), own, mark)))

    hidden = r"(?s)<!--.*?-->|<(?i:(script|style))\b.*?</(?i:\1)\s*>"
    # what nothing closes is taken to the end of the page at once, and then still there
    stripped = F.regexp_replace(html, hidden + r"|((?:<!--|<(?i:script|style)\b).*)", " $2")
    some = lambda t: F.contains(t, F.lit("<!--")) | F.rlike(t, F.lit(r"(?i)<s(?:cript|tyle)\b")) | F.contains(t, mark) | F.contains(F.substring_index(t, ">", -1), less)
    exact = _bind(F.regexp_replace(_masked(html), hidden, " "), masked)
    return F.filter(_bind(stripped, lambda t: F.when(some(t), exact).otherwise(plain(t))), lambda x: x != "")


def _key(line: Column) -> Column:
    """What lines are compared by: a digest of their trimmed text; null for blank lines, which stay."""
    bare = F.btrim(line, F.lit(" \t\x0b\x0c\r"))
    return F.when(bare != "", F.md5(bare))


def boilerplate(rows: DataFrame, scratch: Scratch, ratio: float = RATIO, min_rows: int = MIN_ROWS) -> DataFrame:
    """(host, key, n) of the boilerplate lines of a table (row, host, keys); n: the rows that have the line.

    Counts are combined before each shuffle, so a host or line of a third of
    all rows is a few partial sums.
    """
    pages = scratch.stage(rows.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    often = rows.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
    total = pages.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    known = attach(often, pages.withColumn("c", F.col("pages")), ["host"], "c", total)
    return known.where(F.col("n") > F.lit(float(ratio)) * F.col("pages")).select("host", "key", "n")


def _first_of_each(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Of the rows (row, host, keys) of a host with the same lines, the first."""
    same = sets.groupBy("host", F.xxhash64("keys").alias("a"), F.xxhash64(F.lit(1), F.reverse("keys")).alias("b"))
    groups = scratch.stage(same.agg(F.min("row").alias("first"), F.count("*").alias("c")).where("c > 1"), "copies")
    total = groups.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    marked = sets.select("row", "host", F.xxhash64("keys").alias("a"), F.xxhash64(F.lit(1), F.reverse("keys")).alias("b"))
    later = scratch.stage(attach(marked, groups, ["host", "a", "b"], "c", total[1]).where("row <> first").select("row"), "later")
    return sets.join(F.broadcast(later) if total[1] <= BROADCAST else later, "row", "left_anti")


def dedup(table: DataFrame, host: Column, lines: Column, ratio: float = RATIO, min_rows: int = MIN_ROWS, keep: list[str] | None = None, once: bool = False) -> DataFrame:
    """table (or its columns `keep`) with kept_lines (array), n_lines and n_dropped.

    Blank lines stay and aren't counted.  A null or empty text has no lines;
    rows without host form one host; repeated rows count as rows, or, with
    `once`, rows of a host with the same lines count as one, so that copies
    don't make their own lines boilerplate.  Columns of table with the names of
    the new ones are replaced.

    The lines of a row are split once and written with a number of the row;
    what is to go is found by joins on (host, line) as positions, and the rows
    are cut there: the work is in proportion to a row's lines.
    """
    own = [c for c in keep or table.columns if c not in ("kept_lines", "n_lines", "n_dropped")]
    base = table.select(F.struct(*own).alias("own"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(lines, F.array().cast("array<string>")).alias("lines"))
    with Scratch(table.sparkSession) as scratch:
        base = stage(base.withColumn("row", F.monotonically_increasing_id()), "lines")  # lines are made once and read thrice
        keyed = base.select("row", "host", F.transform("lines", _key).alias("keys"))
        sets = keyed.select("row", "host", F.array_compact(F.array_distinct("keys")).alias("keys"))
        drop = scratch.stage(boilerplate(_first_of_each(sets, scratch) if once else sets, scratch, ratio, min_rows), "boilerplate")
        n = drop.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        at = keyed.select("row", "host", F.posexplode("keys").alias("pos", "key")).where("key is not null")
        # positions counted from 1; a line that many rows have is split off before a shuffle
        found = at.join(F.broadcast(drop), ["host", "key"]) if n[0] <= BROADCAST else attach(at, drop, ["host", "key"], "n", n[1])
        gone = stage(found.groupBy("row").agg(F.sort_array(F.collect_list(F.col("pos") + 1)).alias("gone")), "gone")
        few = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    out = base.join(F.broadcast(gone) if sum(few) <= BROADCAST else gone, "row", "left")
    # what lies between the positions that go
    gaps = F.arrays_zip(F.concat(F.array(F.lit(0)), "gone").alias("after"), F.concat("gone", F.array(F.size("lines") + 1)).alias("before"))
    parts = F.transform(gaps, lambda g: F.slice("lines", g["after"] + 1, g["before"] - g["after"] - 1))
    blank = F.size(F.filter("lines", lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) == ""))
    return out.select(
        "own.*",
        F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.flatten(parts)).alias("kept_lines"),
        (F.size("lines") - blank).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
