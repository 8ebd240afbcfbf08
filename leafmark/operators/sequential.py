"""Order-dependent page operators: baselines, boxes of lines, wrapping, allocation.

Where a page falls into strips that can't touch is decided by windows.  The
sorted rows are streamed in Arrow batches, strips that are one line are found
by array operations, and only the rest is gone through in order, so that a task
holds one strip, one text or a flow's state, and never a page.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the line, box and wrapping rules.

#: A glyph belongs to a line whose baseline is so near: points, or a share of the smaller size.
BASELINE_POINTS, BASELINE_SHARE = 0.65, 0.15
#: Lines of one box: least ratio of sizes; the gap in points and sizes, at least, and in the smaller size, at most.
SIZE_RATIO, GAP_POINTS, GAP_LEAST, GAP_MOST = 0.82, 1.0, 0.5, 2.6
#: How far left edges, or right edges with so much overlap, may be apart, in sizes.
LEFT_APART, RIGHT_APART, RIGHT_OVERLAP = 1.35, 0.65, 0.65
#: Blanks that are dropped where a line ends.
SPACES = " \t　"
#: Characters that no line may begin with.
NO_START = "、。，．・：；？！!?,.:;)]}｝〕〉》」』】〙〗〟’”｠»ヽヾゝゞ々ーｰァィゥェォッャュョヮヵヶぁぃぅぇぉっゃゅょゎゕゖㇰㇱㇲㇳㇴㇵㇶㇷㇸㇹㇺㇻㇼㇽㇾㇿ"
#: Characters that no line may end with.
NO_END = "([{｛〔〈《「『【〘〖〝‘“｟«"


def _kinds(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + more


def _whole_runs(batches, keys: list[str]):
    """(Arrow table, places where runs begin and its end): rows that are equal in keys, none of them cut, of batches sorted by them."""
    import pyarrow as pa

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        columns = [table[k].combine_chunks() for k in keys]
        new = np.zeros(table.num_rows, bool)
        for c in columns:
            codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        if cuts[-1]:
            yield table.slice(0, cuts[-1]), cuts
        held = table.slice(cuts[-1])
    if held is not None:
        yield held, [0, held.num_rows]


def _runs(batches, keys: list[str]):
    """Arrow tables of the rows that are equal in keys, of batches sorted by them."""
    for table, cuts in _whole_runs(batches, keys):
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield table.slice(lo, hi - lo)


def _in_runs(rows: DataFrame, keys: list[str], order: list[str], name: str, number: Callable[..., np.ndarray], columns: list[str]) -> DataFrame:
    """rows with a column `name`: number(arrays of columns) of each run of equal keys, its rows in the given order."""

    def work(batches):
        # runs may be short: columns are taken out, and rows sent on, once for all runs of a batch
        for table, cuts in _whole_runs(batches, keys):
            own = [table[c].cast("float64").to_numpy() for c in columns]
            found = [number(*[c[lo:hi] for c in own]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
            yield from table.append_column(name, [np.concatenate(found).astype(np.int32)]).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, _kinds(rows, f", {name} int"))


def _strips(rows: DataFrame, page: list[str], order: list[str], reach) -> DataFrame:
    """rows with strip: cut where the step in y from the row before is over a reach that no decision crosses."""
    w = Window.partitionBy(*page).orderBy(*order)
    cut = F.coalesce((F.col("y") - F.lag("y").over(w) > reach).cast("int"), F.lit(0))
    return rows.withColumn("_cut", cut).withColumn("strip", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def _renumbered(rows: DataFrame, page: list[str], name: str) -> DataFrame:
    """Numbers within strips as numbers within the page."""
    n = rows.groupBy(*page, "strip").agg((F.max(name) + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*page).orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = n.select(*[F.col(p).alias(f"_{p}") for p in page], F.col("strip").alias("_strip"), before.alias("_before"))
    same = F.col("strip") == F.col("_strip")
    for p in page:
        same &= F.col(p).eqNullSafe(F.col(f"_{p}"))
    kept = [c for c in rows.columns if c not in ("strip", name)]
    return rows.join(offsets, same).select(*kept, (F.col(name) + F.col("_before")).cast("int").alias(name))


def _in_strips(rows: DataFrame, page: list[str], order: list[str], reach: Callable[[Window], Column], name: str, number: Callable[..., np.ndarray], columns: list[str], plain: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """rows with a column `name`: numbers that number(arrays of columns) gives in each strip, going on within the page.

    reach(window of a page) is the most that a step in y within a strip may be.
    plain(arrays, places where strips begin) says which strips have but one
    number.  A page is sorted once and streamed; the state is a strip and how
    many numbers the page has had.
    """
    w = Window.partitionBy(*page).orderBy(*order)
    cut = _strips(rows, page, order, reach(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))

    def work(batches):
        given = 0
        for table, cuts in _whole_runs(batches, [*page, "strip"]):
            own = [table[c].cast("float64").to_numpy() for c in columns]
            starts, sizes = np.array(cuts[:-1]), np.diff(cuts)
            found, counts = np.zeros(table.num_rows, np.int64), np.ones(len(starts), np.int64)
            for k in np.flatnonzero(~plain(*own, starts)).tolist() if plain else range(len(starts)):
                lo, hi = cuts[k], cuts[k + 1]
                found[lo:hi] = number(*[c[lo:hi] for c in own])
                counts[k] = found[lo:hi].max() + 1
            first = table["strip"].to_numpy()[starts] == 0
            before = given + np.cumsum(counts) - counts
            base = np.maximum.accumulate(np.where(first, before, 0))
            given = int(before[-1] + counts[-1] - base[-1])
            numbers = found + np.repeat(before - base, sizes)
            yield from table.drop_columns("strip").append_column(name, [numbers.astype(np.int32)]).to_batches()

    return cut.sortWithinPartitions(*page, *order).mapInArrow(work, _kinds(rows, f", {name} int"))


def _lines_of_strip(ys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The line of each glyph of a strip, glyphs in ascending order of y.

    A line's baselines come in ascending order, so its median is a lookup; its
    sizes are kept sorted.
    """
    lines: list[tuple[list[float], list[float]]] = []
    found = np.empty(len(ys), np.int64)

    def middle(values):
        half = len(values) // 2
        return values[half] if len(values) % 2 else (values[half - 1] + values[half]) / 2

    first = 0  # lines before are out of reach for good: their baselines can't rise again
    reach = max(BASELINE_POINTS, BASELINE_SHARE * float(sizes.max()))
    for k, (y, size) in enumerate(zip(ys.tolist(), sizes.tolist(), strict=True)):
        while first < len(lines) and lines[first][0][-1] < y - reach:
            first += 1
        options = []
        for at in range(first, len(lines)):
            baselines, own = lines[at]
            distance = abs(y - middle(baselines))
            if distance <= max(BASELINE_POINTS, BASELINE_SHARE * min(size, middle(own))):
                options.append((distance, -at))
        at = -min(options)[1] if options else len(lines)
        if at == len(lines):
            lines.append(([], []))
        lines[at][0].append(y)
        insort(lines[at][1], size)
        found[k] = at
    return found


def cluster_baselines(glyphs: DataFrame, page: list[str]) -> DataFrame:
    """glyphs (x0, y, size, ord) with `line`: each joins the line whose median baseline is nearest and within the tolerance, or opens one.

    Glyphs are taken by (y, x0, ord), so the result doesn't depend on the order
    of rows; of lines equally near the last opened is taken; lines are
    numbered as they open.  A step in y over the page's largest tolerance
    divides it into strips; a strip no taller than its least tolerance is one
    line, and its glyphs aren't gone through.
    """

    def plain(y, size, starts):
        ends = np.append(starts[1:], len(y)) - 1
        return y[ends] - y[starts] <= np.maximum(BASELINE_POINTS, np.minimum.reduceat(size, starts) * BASELINE_SHARE)

    reach = lambda w: F.greatest(F.lit(BASELINE_POINTS), F.max("size").over(w) * BASELINE_SHARE)
    return _in_strips(glyphs, page, ["y", "x0", "ord"], reach, "line", _lines_of_strip, ["y", "size"], plain)


def _boxes_of_strip(x0: np.ndarray, x1: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The box of each line of a strip: all open boxes are scored at once."""
    n, found = len(y), np.empty(len(y), np.int64)
    last, first, count = np.empty(n, np.int64), np.empty(n, np.int64), 0  # of each box: its last and its first line
    for k in range(n):
        score = np.full(count, np.inf)
        if count:
            b, a = last[:count], first[:count]
            small, large, gap = np.minimum(size[b], size[k]), np.maximum(size[b], size[k]), y[k] - y[b]
            common = np.minimum(x1[b], x1[k]) - np.maximum(x0[b], x0[k])
            left = np.minimum(np.abs(x0[k] - x0[b]), np.abs(x0[k] - x0[a]))
            right = np.abs(x1[k] - x1[b])
            aligned = left <= LEFT_APART * large
            flush = (right <= RIGHT_APART * large) & (common >= RIGHT_OVERLAP * np.minimum(x1[b] - x0[b], x1[k] - x0[k]))
            apart = np.where(aligned, left / large, np.where(flush, 1 + right / large, np.inf))
            near = (small >= SIZE_RATIO * large) & (gap > np.maximum(GAP_POINTS, GAP_LEAST * size[k])) & (gap <= GAP_MOST * small) & (common > 0)
            score = np.where(near, gap / size[k] + apart, np.inf)
        at = int(score.argmin()) if count and np.isfinite(score.min()) else count
        if at == count:
            first[count] = k
            count += 1
        last[at], found[k] = k, at
    return found


def group_lines(lines: DataFrame, page: list[str]) -> DataFrame:
    """lines (x0, x1, y, size, ord) with `box`: each joins the open box of least cost, or opens one.

    The cost is the gap in sizes plus the misalignment; boxes of other sizes,
    too near, too far or beside are no candidates; of equal costs the first box
    is taken.  Lines are taken by (y, x0, ord).  A step in y over the most that
    a gap may be divides a page into strips.
    """
    return _in_strips(lines, page, ["y", "x0", "ord"], lambda w: F.max("size").over(w) * GAP_MOST, "box", _boxes_of_strip, ["x0", "x1", "y", "size"])


class Refusal(ValueError):
    """Why a text can't be wrapped."""


_POINTS = {kind: np.array(sorted(map(ord, marks)), np.uint32) for kind, marks in (("space", SPACES), ("start", NO_START), ("end", NO_END))}
#: What a code point is (1: blank, 2: no start, 4: no end); those from 0xFFFF on are none of these.
_KINDS = sum(np.isin(np.arange(1 << 16), _POINTS[kind]) * np.uint8(bit) for bit, kind in ((1, "space"), (2, "start"), (4, "end")))


def _cluster_starts(text: str, points: np.ndarray) -> np.ndarray:
    """Where a grapheme cluster begins: everywhere, unless the text has code points that may join."""
    starts = np.ones(len(points) + 1, bool)
    plain = (points < 0x300) | ((points >= 0x3000) & (points < 0x302A)) | ((points >= 0x3030) & (points < 0x3099)) | ((points >= 0x309B) & (points < 0xA000))
    if not plain.all() or "\r" in text:
        import regex

        starts[:] = False
        starts[[m.start() for m in regex.finditer(r"\X", text)]] = True
        starts[-1] = True
    return starts


class _Measured:
    """A text's advances, blanks and breaks as arrays; lines are then found by binary search."""

    def __init__(self, text: str, advance: Callable[[np.ndarray], np.ndarray]):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        steps = advance(points).astype(float)
        self.text, self.n, self.to = text, n, np.concatenate([[0.0], np.cumsum(steps)])
        kinds = _KINDS[np.minimum(points, 0xFFFF)]
        blank = kinds & 1 > 0
        self.visible = np.flatnonzero(~blank)  # ascending places of what isn't blank
        at = np.arange(n + 1)
        here = np.searchsorted(self.visible, at)
        right, left = np.full(n + 1, -1), np.full(n + 1, -1)  # the visible character after and before each place
        right[here < len(self.visible)] = self.visible[here[here < len(self.visible)]]
        left[here > 0] = self.visible[here[here > 0] - 1]
        no_start, no_end = np.append(kinds & 2 > 0, False), np.append(kinds & 4 > 0, False)
        clusters = _cluster_starts(text, points)
        self.ends = np.append(np.flatnonzero(clusters)[1:], n) if n else np.empty(0, np.int64)
        fine = clusters & ~(no_start[right] & (right >= 0)) & ~(no_end[left] & (left >= 0))
        wide = np.append(steps > 6, False)
        blank = np.append(blank, False)
        inner = np.zeros(n + 1, bool)
        if n:
            after_blank = blank[:-1] & ~blank[1:]
            between = ~blank[:-1] & ~blank[1:] & (wide[:-1] | wide[1:])
            inner[1:] = after_blank | between
        fine[0] = False
        self.legal, self.forced = np.flatnonzero(inner & fine), np.flatnonzero(fine)
        self.no_start = no_start
        # numbers are looked up one at a time: as views, without an array operation for each
        self.views = tuple(memoryview(np.ascontiguousarray(a)) for a in (self.visible, self.to, self.legal, self.forced))

    def lines(self, lo: int, hi: int, width: float, first: float | None = None) -> Iterator[tuple[int, int, float]]:
        """(from, to, width) of the lines of the paragraph between two places; first: the width of the first line, if it is another."""
        v, to, legal, forced = self.views
        k = bisect_left(v, lo)
        if k < len(v) and v[k] < hi and self.no_start[v[k]]:
            raise Refusal("a line would begin with a closing mark")
        start, done = lo, False
        while not done:
            # the first visible character that doesn't fit any more, if there is one
            over = bisect_right(to, to[start] + (width if first is None or start > lo else first) + 1e-7) - 1
            k = bisect_left(v, over)
            over = v[k] if k < len(v) and v[k] < hi else hi
            end, done = over, over == hi
            if not done:
                for breaks in (legal, forced):
                    k = bisect_right(breaks, over) - 1
                    if k >= 0 and breaks[k] > start:
                        end = breaks[k]
                        break
                else:
                    raise Refusal("the line is too narrow for a cluster or an unbreakable group of marks")
            k = bisect_left(v, end) - 1
            stop = v[k] + 1 if k >= 0 and v[k] >= start else start
            yield start, stop, to[stop] - to[start]
            if not done:
                start = v[k + 1] if k + 1 < len(v) else hi
                done = start >= hi


def _advances(points: np.ndarray) -> np.ndarray:
    return np.where(points < 128, 6, 12)


def wrap_text(text: str, width: float, advance: Callable[[np.ndarray], np.ndarray] = _advances) -> list[tuple[str, float]]:
    """Lines (text, width): greedy, at spaces and around wide characters, at grapheme clusters where nothing else fits.

    No line begins with a closing or ends with an opening mark; where that
    can't be kept, or a cluster is wider than the line, it is a Refusal.
    advance gives the advances of an array of code points.
    """
    if not text:
        return [("", 0.0)]
    return [(text[a:b], w) for a, b, w in _Measured(text, advance).lines(0, len(text), width)]


def wrap(texts: DataFrame, key: str, text: str, width: float) -> DataFrame:
    """(key, paragraph, line, n_chars, width, refusal): the wrapped lines of every line of the texts, texts in Arrow batches.

    A null text is one empty line.  A paragraph that can't be wrapped is one
    row with its characters and the reason, and the others of the text are
    wrapped all the same.
    """
    import pyarrow as pa

    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string())
    names = ["key", "paragraph", "line", "n_chars", "width", "refusal"]

    def lay(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                t = t or ""
                measured, lo = _Measured(t, _advances), 0
                for p, part in enumerate(t.split("\n")):
                    hi = lo + len(part)
                    try:
                        found = [(k, p, i, b - a, w, None) for i, (a, b, w) in enumerate(measured.lines(lo, hi, width) if part else [(lo, lo, 0.0)])]
                    except Refusal as why:
                        found = [(k, p, 0, len(part), None, str(why))]
                    rows += found
                    lo = hi + 1
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "key long, paragraph int, line int, n_chars int, width double, refusal string"
    return texts.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(lay, schema)


def allocate(paragraphs: DataFrame, flow: str, order: str, lines: str, capacity: int, keep: str | None = None) -> DataFrame:
    """(flow, order, region, first_line, n_lines): paragraphs' lines dealt to regions of so many lines, in order.

    Paragraphs flagged by `keep` that fit an empty region aren't split: they
    begin a new one; null and 0 are no lines.  Flows are streamed in order; the state is the place
    reached, so a flow may be of any length.
    """
    import pyarrow as pa

    together = F.col(keep) if keep else F.lit(False)
    rows = paragraphs.select(F.col(flow).alias("flow"), F.col(order).cast("long").alias("ordinal"), F.col(lines).cast("int").alias("n"), together.alias("t"))
    kind = paragraphs.schema[flow].dataType.simpleString()

    def plan(batches):
        before, region, used = (), 0, 0
        for batch in batches:
            out = []
            for f, o, n, whole in zip(*[batch.column(c).to_pylist() for c in ("flow", "ordinal", "n", "t")], strict=True):
                if (f,) != before:
                    before, region, used = (f,), 0, 0
                if whole and 0 < used and capacity - used < (n or 0) <= capacity:
                    region, used = region + 1, 0
                while n and n > 0:
                    if used == capacity:
                        region, used = region + 1, 0
                    take = min(n, capacity - used)
                    out.append((f, o, region, used, take))
                    used, n = used + take, n - take
            if out:
                kinds = (batch.column("flow").type, pa.int64(), pa.int32(), pa.int32(), pa.int32())
                columns = [pa.array(c, x) for c, x in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["flow", "ordinal", "region", "first_line", "n_lines"])

    return rows.repartition("flow").sortWithinPartitions("flow", "ordinal").mapInArrow(plan, f"flow {kind}, ordinal long, region int, first_line int, n_lines int")
