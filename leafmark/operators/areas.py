"""Areas of a page: rectangles that meet, what fills cover, the nearest content in four directions, outlines of glyphs.

No rows are paired on a page alone.  Rectangles meet in grid cells; coverage
is a sweep over slabs; the nearest content of a band is found in one sorted
pass over a page, which holds a skyline and not the page.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SIDES = ("x0", "y0", "x1", "y1")


def _cell(at: Column, cell: float) -> Column:
    return F.floor(at.cast("double") / cell).cast("long")


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(_cell(low, cell), _cell(high, cell))


def meet(a: DataFrame, b: DataFrame, keys: list[str], cell: float, other: str = "b") -> DataFrame:
    """Rows of a (x0 to y1) beside those of b (<other>x0 to <other>y1) of equal keys whose closed rectangles touch.

    Both are dealt to the cells of a grid; a pair comes once, in the first
    cell that both touch.  No other column of b may have the name of one of a.
    """
    mine = a.withColumn("_cx", F.explode(_cells(F.col("x0"), F.col("x1"), cell))).withColumn("_cy", F.explode(_cells(F.col("y0"), F.col("y1"), cell)))
    o = {c: F.col(other + c) for c in _SIDES}
    theirs = b.withColumn("_cx", F.explode(_cells(o["x0"], o["x1"], cell))).withColumn("_cy", F.explode(_cells(o["y0"], o["y1"], cell)))
    first = lambda p, q, c: _cell(F.greatest(F.col(p), F.col(q)), cell) == F.col(c)
    touch = (F.col("x0") <= o["x1"]) & (o["x0"] <= F.col("x1")) & (F.col("y0") <= o["y1"]) & (o["y0"] <= F.col("y1"))
    met = mine.join(theirs, [*keys, "_cx", "_cy"]).where(touch & first("x0", other + "x0", "_cx") & first("y0", other + "y0", "_cy"))
    return met.drop("_cx", "_cy")


def prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """df with a prefix before every column but the keys."""
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def fill_cover(queries: DataFrame, fills: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """(keys, query, paint, area, holds): how much of each query (query, x0 to y1) a paint's fill covers, and whether all of it.

    A fill is a union of rectangles (paint, x0 to y1, weight: 1 or -1 by their
    direction, even_odd): a point is filled where the weights around it don't
    add up to 0, or, with even_odd, where an odd number of rectangles holds it.
    Overlaps count once.  Paints that cover nothing of a query have no row;
    queries without area have none.

    The rectangles are cut to the query; between two neighbouring edges along
    y the filled lengths are running sums along x.
    """
    own = [*keys, "query", "paint"]
    met = meet(queries.select(*keys, "query", *_SIDES), prefixed(fills.select(*keys, "paint", "weight", "even_odd", *_SIDES), keys, "b").withColumnsRenamed({"bpaint": "paint", "bweight": "weight", "beven_odd": "even_odd"}), keys, cell)
    cut = met.select(
        *own, "weight", "even_odd", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("whole"), F.greatest("x0", "bx0").alias("l"), F.greatest("y0", "by0").alias("t"), F.least("x1", "bx1").alias("r"), F.least("y1", "by1").alias("b"),
    ).where("l < r and t < b")
    # all that follows is by the query and paint: it stays where this shuffle puts it
    cut = cut.withColumn("_r", F.monotonically_increasing_id()).repartition(*own)
    w = Window.partitionBy(*own).orderBy("y")
    rest = ["weight", "even_odd", "whole", "l", "r"]
    edges = cut.select(*own, "_r", *rest, F.explode(F.array("t", "b")).alias("y")).withColumns({"slab": F.dense_rank().over(w), "height": F.lead("y").over(w) - F.col("y")})
    ranked = edges.groupBy(*own, "_r").agg(F.min("slab").alias("from"), F.max("slab").alias("to"), *[F.first(c).alias(c) for c in rest])
    rows = ranked.select(*own, *rest, F.explode(F.expr("sequence(`from`, `to` - 1)")).alias("slab"))
    end = lambda x, sign: F.struct(F.col(x).cast("double").alias("x"), (F.col("weight") * sign).alias("w"), F.lit(sign).alias("n"))
    ends = rows.select(*own, "even_odd", "whole", "slab", F.explode(F.array(end("l", 1), end("r", -1))).alias("e")).select(*own, "even_odd", "whole", "slab", "e.*")
    # of the edges at one place only the last has the next behind it; it says how high the slab is, before all ends
    heights = edges.where("height > 0").select(*own, "slab", F.lit(float("-inf")).alias("x"), F.lit(0).alias("w"), F.lit(0).alias("n"), "height")
    along = Window.partitionBy(*own, "slab").orderBy("x")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    both = ends.unionByName(heights, allowMissingColumns=True)
    filled = F.when(F.col("even_odd"), F.pmod(F.sum("n").over(so_far), F.lit(2)) == 1).otherwise(F.sum("w").over(so_far) != 0)
    lengths = both.select(*own, "whole", F.max("height").over(so_far).alias("height"), F.when(filled, F.lead("x").over(along) - F.col("x")).alias("length")).where("length > 0")
    summed = lengths.groupBy(*own).agg(F.sum(F.col("length") * F.col("height")).alias("area"), F.first("whole").alias("_whole"))
    return summed.select(*own, "area", (F.abs(F.col("area") - F.col("_whole")) < 1e-6).alias("holds"))


class _Skyline:
    """What was painted last on each stretch of an axis.

    Places are (value, 0) for a point and (value, 1) for what follows it, so
    an open interval leaves out its ends and a point is a stretch of its own.
    """

    def __init__(self):
        self.starts, self.values = [(float("-inf"), 0)], [float("-inf")]

    @staticmethod
    def stretch(low: float, high: float):
        return ((low, 1), (high, 0)) if low < high else ((low, 0), (low, 1))

    def paint(self, low: float, high: float, value: float) -> None:
        lo, hi = self.stretch(low, high)
        i, j = bisect_left(self.starts, lo), bisect_left(self.starts, hi)
        rest = [] if j < len(self.starts) and self.starts[j] == hi else [(hi, self.values[j - 1])]
        self.starts[i:j] = [lo, *(k for k, _ in rest)]
        self.values[i:j] = [value, *(v for _, v in rest)]

    def largest(self, low: float, high: float) -> float:
        if low >= high:
            return float("-inf")
        lo, hi = self.stretch(low, high)
        return max(self.values[bisect_right(self.starts, lo) - 1 : bisect_left(self.starts, hi)])


#: Rows of a key in a batch that are held against all rows before them at once, at most.
FEW_ROWS = 512


def _sweep(rows: DataFrame, keys: list[str], state, meets) -> DataFrame:
    """(keys, id, edge) of rows (keys, own, low, high, at, id) that are dealt by keys: each own row's largest `at` of the others, at most its own, that meets it.

    Keys are streamed, sorted by `at`, and what was painted into state() is
    asked for the largest.  Keys of few rows that lie within a batch are held
    against the rows before them by meets(arrays low, high, own low, own high).
    """
    import numpy as np
    import pyarrow as pa

    def work(batches):
        sky, last = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            low, high, at = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("low", "high", "at"))
            own, new = batch.column("own").to_numpy(zero_copy_only=False), np.zeros(n, bool)
            for c in keys:
                codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            name = tuple(batch.column(c)[0].as_py() for c in keys)
            new[0] = name != last
            last = tuple(batch.column(c)[n - 1].as_py() for c in keys)
            cuts = np.union1d(np.flatnonzero(new), [0, n])
            # the last key may go on in the next batch, the first may be that of the one before
            within = (np.diff(cuts) <= FEW_ROWS) & new[cuts[:-1]] & (cuts[1:] < n)
            asked = np.flatnonzero(own & np.repeat(within, np.diff(cuts)))
            since = np.repeat(cuts[:-1], np.diff(cuts))[asked]
            count = asked - since
            which = np.repeat(np.arange(len(asked)), count)
            other = np.arange(len(which)) - np.repeat(np.cumsum(count) - count - since, count)
            hit = np.flatnonzero(~own[other] & (at[other] == at[other]) & meets(low[other], high[other], low[asked][which], high[asked][which]))
            ends = hit[np.append(which[hit][1:] != which[hit][:-1], True)] if len(hit) else hit
            places, edges = asked[which[ends]].tolist(), at[other[ends]].tolist()
            for k in np.flatnonzero(~within).tolist():
                lo, hi = int(cuts[k]), int(cuts[k + 1])
                if new[lo] or sky is None:
                    sky = state()
                for i, mine, l, h, e in zip(range(lo, hi), *(x[lo:hi].tolist() for x in (own, low, high, at)), strict=False):
                    if l != l or h != h or e != e:
                        continue  # without a place
                    if not mine:
                        sky.paint(l, h, e)
                    elif (best := sky.largest(l, h)) > float("-inf"):
                        places.append(i)
                        edges.append(best)
            took = batch.select([*keys, "id"]).take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(edges, pa.float64())], [*keys, "id", "edge"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*keys, "id"))
    sorted_rows = rows.select(*keys, "own", "low", "high", "at", "id").sortWithinPartitions(*keys, "at", "own")
    return sorted_rows.mapInArrow(work, f"{kinds}, edge double")


def _bands_meet(low, high, own_low, own_high):
    """Whether open intervals meet; an interval without length is a point, an own one meets nothing."""
    import numpy as np

    return (own_low < own_high) & (low < own_high) & (np.maximum(low, high) > own_low)


def surroundings(columns: DataFrame, foreign: DataFrame, keys: list[str]) -> DataFrame:
    """columns (id, x0 to y1) with above, below, leftward and rightward: the nearest edges of foreign content (x0 to y1) beside them, null where there is none.

    Foreign content is beside a column where open intervals meet across the
    side: one without length meets those that hold it inside, and a column
    without length has none.  For two sides edges are negated, so that the
    nearest is the largest; along them, what was seen last on each stretch of
    the band is the nearest: one sorted pass, whose state is the stretches.
    """
    sides = (("above", "x", "y0", "y1", 1), ("below", "x", "y1", "y0", -1), ("leftward", "y", "x0", "x1", 1), ("rightward", "y", "x1", "x0", -1))
    one = lambda d, mine, ident: d.select(*keys, F.lit(mine).alias("own"), ident, *[F.col(c).cast("double").alias(c) for c in _SIDES])
    both = one(columns, True, F.col("id")).unionAll(one(foreign, False, F.lit(None).cast(columns.schema["id"].dataType).alias("id")))
    # rectangles are dealt once, not for each side; what comes of them is four times as much, so the parts aren't to be merged by their size
    dealt = both.repartition(int(columns.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    of = lambda side, band, own, edge, sign: F.struct(F.lit(side).alias("side"), F.col(band + "0").alias("low"), F.col(band + "1").alias("high"), (F.when(F.col("own"), F.col(own)).otherwise(F.col(edge)) * sign).alias("at"))
    rows = dealt.select(*keys, "own", "id", F.explode(F.array(*[of(i, band, own, edge, sign) for i, (_, band, own, edge, sign) in enumerate(sides)])).alias("s")).select(*keys, "own", "id", "s.*")
    found = _sweep(rows, [*keys, "side"], _Skyline, _bands_meet)
    near = found.groupBy(*keys, "id").agg(*[F.max(F.when(F.col("side") == i, F.col("edge") * sign)).alias(name) for i, (name, *_, sign) in enumerate(sides)])
    return columns.join(near, [*keys, "id"], "left")


class _Bars:
    """The bars so far that no nearer one hides."""

    def __init__(self):
        self.bars = []

    def paint(self, low: float, high: float, value: float) -> None:
        # a farther bar within a nearer one is never needed again
        while self.bars and low <= self.bars[-1][0] and self.bars[-1][1] <= high:
            self.bars.pop()
        self.bars.append((low, high, value))

    def largest(self, low: float, high: float) -> float:
        return next((e for lo, hi, e in reversed(self.bars) if lo <= low and high <= hi), float("-inf"))


def nearest_spanning(own: DataFrame, bars: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """(keys, id, edge): for each own row (id, low, high, at) the largest edge at most `at` of the bars (low, high, edge) of equal keys that hold all of [low, high].

    Bars go to every cell of a grid that they touch, own rows to the first of
    theirs; within a cell one sorted pass keeps the bars that no nearer one
    hides.  For the nearest on the other side, edges and places are negated.
    """
    one = lambda d, mine, at, cells, ident: d.select(*keys, cells.alias("cell"), F.lit(mine).alias("own"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), F.col(at).cast("double").alias("at"), ident)
    rows = one(own, True, "at", F.floor(F.col("low") / cell).cast("long"), F.col("id")).unionAll(one(bars.where("low <= high"), False, "edge", F.explode(_cells(F.col("low"), F.col("high"), cell)), F.lit(None).cast(own.schema["id"].dataType).alias("id")))
    spans = lambda low, high, own_low, own_high: (low <= own_low) & (own_high <= high)
    return _sweep(rows.repartition(*keys, "cell"), [*keys, "cell"], _Bars, spans).drop("cell")


def region_of(height: Column, content_top: Column) -> tuple[Column, Column]:
    """(top, bottom) as structs (value, evidence) of a column (y0, y1, above, below) on a page of this height: by foreign content, else by the page; the bottom is the nearest of its options."""
    option = lambda v, e: F.struct(v.cast("double").alias("value"), F.lit(e).alias("evidence"))
    top = F.when(F.col("above").isNotNull(), option(F.col("above"), "foreign-content-boundary")).otherwise(option(F.lit(0), "page-edge"))
    symmetric = height - content_top
    options = F.array(option(height, "page-edge"), F.when(F.col("below").isNotNull(), option(F.col("below"), "foreign-content-boundary")), F.when(symmetric > F.col("y1"), option(symmetric, "margin-symmetry")))
    return top, F.array_min(F.array_compact(options))


def width_of(page_width: Column, lower: Column, upper: Column) -> Column:
    """The width (value, evidence) of a column (x0, rightward), or null: the first option that holds its widest line, breaks all its wrapped lines (upper, null if there is none) and ends before foreign content and the page.

    Symmetric margins where the column begins in the left half, then the
    foreign boundary, then the middle between what holds and what breaks.
    """
    x, cap = F.col("x0"), F.least(page_width, F.col("rightward")) - F.col("x0")
    option = lambda v, e, known: F.when(known & (v >= lower) & (v <= cap) & (upper.isNull() | (v < upper)), F.struct(v.cast("double").alias("value"), F.lit(e).alias("evidence")))
    middle = (lower + upper) / 2
    between = F.when(upper.isNotNull() & (lower <= middle) & (middle <= cap), F.struct(middle.cast("double").alias("value"), F.lit("wrapped-line-interval-midpoint").alias("evidence")))
    return F.coalesce(option(page_width - 2 * x, "margin-symmetry", x < page_width / 2), option(cap, "foreign-content-boundary", F.col("rightward").isNotNull()), between)


def outlines(glyphs: DataFrame, inks: DataFrame, keys: list[str], tolerance: float = 0.002) -> DataFrame:
    """(keys, id, ink, status): the one outline (ink, x, y) of equal keys within the tolerance, on both axes, of each glyph (id, x, y).

    Status: matched, none, several, or shared where another glyph has the same
    outline; only matched rows have an ink.  Glyphs that share an id count as
    one, wherever they are, and so do outlines that share an ink.  Equal places
    are counted before places meet, in grid cells of two tolerances.
    """
    cell = 2 * tolerance
    a = glyphs.groupBy(*keys, "x", "y").agg(F.count("*").alias("_n"))
    b = inks.groupBy(*keys, F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.count("*").alias("_m"), F.min("ink").alias("ink"))
    mine = a.withColumn("_cx", F.floor(F.col("x") / cell).cast("long")).withColumn("_cy", F.floor(F.col("y") / cell).cast("long"))
    reach = lambda c: F.explode(_cells(F.col(c) - tolerance * 1.001, F.col(c) + tolerance * 1.001, cell))
    theirs = b.withColumn("_cx", reach("_x")).withColumn("_cy", reach("_y"))
    near = mine.join(theirs, [*keys, "_cx", "_cy"]).where((F.abs(F.col("x") - F.col("_x")) <= tolerance) & (F.abs(F.col("y") - F.col("_y")) <= tolerance))
    claims = near.groupBy(*keys, "_x", "_y").agg(F.sum("_n").alias("_claims"))
    best = near.groupBy(*keys, "x", "y").agg(F.sum("_m").alias("_inks"), F.min("ink").alias("ink"))
    own = Window.partitionBy("id")
    found = glyphs.select(*keys, "id", "x", "y").join(best, [*keys, "x", "y"], "left")
    found = found.select(*keys, "id", F.sum("_inks").over(own).alias("_inks"), F.min("ink").over(own).alias("ink"))
    of_ink = inks.select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y"), "ink").join(claims, [*keys, "_x", "_y"]).groupBy("ink").agg(F.sum("_claims").alias("_claims"))
    found = found.join(of_ink, "ink", "left")
    status = F.when(F.col("_inks").isNull(), "none").when(F.col("_inks") > 1, "several").when(F.col("_claims") > 1, "shared").otherwise("matched")
    return found.select(*keys, "id", F.when(status == "matched", F.col("ink")).alias("ink"), status.alias("status"))


#: Pairs of places that are compared at a time.
MET = 1 << 20


def _groups(*columns):
    """The number of the group that each row is in, of rows equal in all columns, and a row of each group."""
    import numpy as np

    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _met(key, x, y, other_key, other_x, other_y, tolerance):
    """Pairs (places of the one, places of the other), in pieces of about MET, that are equal in key and within the tolerance on both axes; through the cells of a grid, by hashes."""
    import numpy as np

    cell = 3 * tolerance  # a reach touches two cells of an axis at most
    at = lambda v: np.floor(v / cell) + 0.0
    mixed = lambda k, p, q: (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ p.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9) + q.view(np.uint64) * np.uint64(0x85EBCA77C2B2AE63)
    cx, cy = at(x), at(y)
    reach = tolerance * 1.001
    ends = [(at(v - reach), at(v + reach)) for v in (other_x, other_y)]
    parts = []
    for i in (0, 1):
        for j in (0, 1):
            p, q = ends[0][i], ends[1][j]
            own = np.flatnonzero(((i == 0) | (p != ends[0][0])) & ((j == 0) | (q != ends[1][0])))
            parts.append((own, p[own], q[own]))
    other, ox, oy = (np.concatenate([p[k] for p in parts]) for k in range(3))
    hashes = mixed(other_key[other], ox, oy)
    order = np.argsort(hashes)
    asked, hashes = mixed(key, cx, cy), hashes[order]
    lo = np.searchsorted(hashes, asked, side="left")
    n = np.searchsorted(hashes, asked, side="right") - lo
    total = np.cumsum(n)
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + MET, side="right")))
        m = n[first:last]
        a = np.repeat(np.arange(first, last), m)
        slot = order[np.arange(len(a)) + np.repeat(lo[first:last] - (np.cumsum(m) - m), m)]
        b = other[slot]
        # rows of other cells may have one hash
        near = (ox[slot] == cx[a]) & (oy[slot] == cy[a]) & (key[a] == other_key[b]) & (np.abs(x[a] - other_x[b]) <= tolerance) & (np.abs(y[a] - other_y[b]) <= tolerance)
        yield a[near], b[near]
        first = last


def outlines_at_home(rows: DataFrame, home: list[str], keys: list[str], tolerance: float = 0.002) -> DataFrame:
    """outlines() of rows that hold a glyph (id, x, y; is_glyph), an outline (ink, ink_x, ink_y; is_ink) or both, where all rows of an id, and all of an ink, are equal in the keys `home`.

    rows are dealt by home already, so that ids are counted where places meet
    and nothing else is shuffled: the pages of an Arrow batch are worked at
    once.  Ids are integers; null ids, keys and places meet nothing.
    """
    from leafmark.operators.sequential import _whole_runs

    names = [*home, *keys]

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def column(table, name, kind):
            """Values, and where they are known."""
            c = table[name].combine_chunks()
            v = pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(kind)
            return v, pc.is_valid(c).to_numpy(zero_copy_only=False) & np.isfinite(v)

        def placed(table, ident, x, y, flag, known):
            """Rows, their ids and whether these are known, and of those that have a place: which, and x and y."""
            rows = np.flatnonzero(pc.fill_null(table[flag].combine_chunks(), False).to_numpy(zero_copy_only=False))
            (i, has), (x, has_x), (y, has_y) = column(table, ident, np.int64), column(table, x, np.float64), column(table, y, np.float64)
            at = np.flatnonzero((known & has_x & has_y)[rows])
            return rows, i[rows], has[rows], at, x[rows[at]], y[rows[at]]

        for table, cuts in _whole_runs(batches, home):
            page = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            key, known = page, np.ones(table.num_rows, bool)
            for k in names:
                c = table[k].combine_chunks()
                known &= pc.is_valid(c).to_numpy(zero_copy_only=False)
                if k not in home:
                    key, _ = _groups(key, c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False))
            g, ids, has_id, g_at, gx, gy = placed(table, "id", "x", "y", "is_glyph", known)
            k, inks, has_ink, k_at, kx, ky = placed(table, "ink", "ink_x", "ink_y", "is_ink", known)
            # equal places are counted before places meet
            g_place, g_one = _groups(key[g[g_at]], gx, gy)
            k_place, k_one = _groups(key[k[k_at]], kx, ky)
            none = np.iinfo(np.int64).max
            own = np.where(has_ink, inks, none)[k_at]
            n_glyphs, n_inks = np.bincount(g_place, minlength=len(g_one)), np.bincount(k_place, minlength=len(k_one))
            least = np.full(len(k_one), none)
            np.minimum.at(least, k_place, own)
            met, best, claims = np.zeros(len(g_one), np.int64), np.full(len(g_one), none), np.zeros(len(k_one), np.int64)
            for a, b in _met(key[g[g_at]][g_one], gx[g_one], gy[g_one], key[k[k_at]][k_one], kx[k_one], ky[k_one], tolerance):
                np.add.at(met, a, n_inks[b])
                np.minimum.at(best, a, least[b])
                np.add.at(claims, b, n_glyphs[a])
            of_id, _ = _groups(page[g], ids)
            n_ids = int(of_id.max(initial=-1)) + 1
            n, ink = np.zeros(n_ids, np.int64), np.full(n_ids, none)
            np.add.at(n, of_id[g_at], met[g_place])
            np.minimum.at(ink, of_id[g_at], best[g_place])
            n, ink = np.where(has_id, n[of_id], 0), ink[of_id]
            # what an outline is claimed by, asked for by the glyphs that have met it
            both, _ = _groups(np.concatenate([page[k[k_at]], page[g]]), np.concatenate([own, ink]))
            claimed = np.zeros(int(both.max(initial=-1)) + 1, np.int64)
            np.add.at(claimed, both[: len(k_at)], claims[k_place])
            claimed = np.where(ink == none, 0, claimed[both[len(k_at) :]])
            status = np.select([n == 0, n > 1, claimed > 1], ["none", "several", "shared"], "matched")
            shown = (status == "matched") & (ink != none)
            out = [table[c].combine_chunks().take(pa.array(g)) for c in (*names, "id")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(ink, pa.int64(), mask=~shown), pa.array(status.tolist(), pa.string())], [*names, "id", "ink", "status"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*names, "id"))
    asked = rows.select(*names, *[F.col(c).cast("long").alias(c) if c in ("id", "ink") else c for c in ("id", "x", "y", "ink", "ink_x", "ink_y", "is_glyph", "is_ink")])
    return asked.sortWithinPartitions(*home).mapInArrow(work, f"{kinds.rsplit(', ', 1)[0]}, id long, ink long, status string")
