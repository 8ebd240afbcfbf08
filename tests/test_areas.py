"""Coverage, nearest content, regions, outlines and glyph boxes against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from leafmark.operators import areas, glyphs
from leafmark.sources import tables

RECT = "x0 double, y0 double, x1 double, y1 double"


def rect(rng, n, most=9):
    x, y = rng.randrange(n), rng.randrange(n)
    return float(x), float(y), float(x + rng.randrange(1, most)), float(y + rng.randrange(1, most))


def test_glyphs_of_irregular_positions(spark):
    """Kerning, overlaps and shuffled rows: boxes and spaces come from positions alone."""
    rng = random.Random(1)
    rows = []
    for line in range(40):
        x = 10.0
        for ord_ in range(30):
            step = rng.choice([5.0, 5.5, 7.0, 4.2])
            x += rng.choice([0.0, -1.5, 0.3, 2.0, 2.5, 9.0])
            rows.append((line, ord_, ord(rng.choice("ab1,.漢(é")), rng.randrange(9), x, 50.0 - rng.random(), x + step, 52.0, x, 50.0, rng.choice([9.0, 12.0])))
            x += step
    names = "line int, ord int, code int, glyph_id int, x0 double, y0 double, x1 double, y1 double, origin_x double, origin_y double, size double"
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, names).repartition(3)
    spans = glyphs.spans_of(df, ["line"])
    want = {}
    for r in rows:
        b = want.setdefault(r[0], [1e9, 1e9, -1e9, -1e9, 0])
        want[r[0]] = [min(b[0], r[4]), min(b[1], r[5]), max(b[2], r[6]), max(b[3], r[7]), b[4] + 1]
    for found in (glyphs.bounds(df, ["line"]), glyphs.span_bounds(spans, ["line"])):
        assert {r.line: list(r)[1:] for r in found.collect()} == want
    gaps = set()
    for line in range(40):
        own = sorted((r for r in rows if r[0] == line), key=lambda r: (r[4], r[1]))
        size = min(r[10] for r in own)
        for a, b in zip(own, own[1:], strict=False):
            word = lambda c: c in "ab1é"
            if b[4] - a[6] > max(0.7, 0.2 * size) and word(chr(b[2])) and (word(chr(a[2])) or chr(a[2]) in ",."):
                gaps.add((line, a[1], b[1], round(b[4] - a[6], 9)))
    assert {(r.line, r.after, r.before, round(r.gap, 9)) for r in glyphs.word_gaps(spans, ["line"]).collect()} == gaps and gaps


def test_thirteen_attributes_of_observed_glyphs(spark):
    docs = spark.createDataFrame([(1, "aé\n\n𝒳 b"), (2, None), (3, "")], "doc_id long, text string")
    rows = glyphs.observations(tables.line_spans(docs), ["doc_id", "line_no"]).orderBy("line_no", "ord").collect()
    assert [(r.line_no, r.unicode) for r in rows] == [(0, "a"), (0, "é"), (2, "𝒳"), (2, " "), (2, "b")]
    names = {"unicode", "glyph_id", "origin", "bbox", "advance_bbox", "font", "size", "direction", "paint_type", "color", "opacity", "wmode", "layer"}
    assert names <= set(rows[0].asDict()) and rows[1].bbox == [46.0, 48.0, 58.0, 62.0] and rows[1].advance_bbox == 12.0


def test_fill_cover_against_unit_cells(spark):
    rng = random.Random(2)
    queries = [(p, i, *rect(rng, 20, 6)) for p in range(4) for i in range(12)]
    fills = [(p, k, rng.choice([1, -1]), k % 2 == 0, *rect(rng, 20)) for p in range(4) for k in range(5) for _ in range(6)] + [(0, 99, 1, False, -50.0, -50.0, 90.0, 90.0)]
    got = {(r.page, r.query, r.paint): (r.area, r.holds) for r in areas.fill_cover(spark.createDataFrame(queries, f"page int, query int, {RECT}"), spark.createDataFrame(fills, f"page int, paint int, weight int, even_odd boolean, {RECT}"), ["page"], 7.0).collect()}
    want = {}
    for p, q, x0, y0, x1, y1 in queries:
        for k in {f[1] for f in fills if f[0] == p}:
            own = [f for f in fills if f[:2] == (p, k)]
            n = 0
            for x in range(int(x0), int(x1)):
                for y in range(int(y0), int(y1)):
                    held = [f[2] for f in own if f[4] <= x < f[6] and f[5] <= y < f[7]]
                    n += len(held) % 2 if own[0][3] else sum(held) != 0
            if n:
                want[p, q, k] = (float(n), n == (x1 - x0) * (y1 - y0))
    assert got == want and any(h for _, h in want.values())


def test_surroundings_against_all_pairs(spark):
    rng = random.Random(3)
    columns = [(p, i, *rect(rng, 60, 12)) for p in range(3) for i in range(25)]
    foreign = [(p, *rect(rng, 60, 10)) for p in range(3) for _ in range(40)] + [(1, 5.0, 9.0, 5.0, 9.0)]
    got = {(r.page, r.id): (r.above, r.below, r.leftward, r.rightward) for r in areas.surroundings(spark.createDataFrame(columns, f"page int, id int, {RECT}"), spark.createDataFrame(foreign, f"page int, {RECT}"), ["page"]).collect()}
    for p, i, x0, y0, x1, y1 in columns:
        own = [f[1:] for f in foreign if f[0] == p]
        wide, high = [f for f in own if f[0] < x1 and f[2] > x0], [f for f in own if f[1] < y1 and f[3] > y0]
        want = (max((f[3] for f in wide if f[3] <= y0), default=None), min((f[1] for f in wide if f[1] >= y1), default=None), max((f[2] for f in high if f[2] <= x0), default=None), min((f[0] for f in high if f[0] >= x1), default=None))
        assert got[p, i] == want


def test_a_page_of_very_many_rows(spark):
    """20,000 columns and as many foreign rows on one page; pairs would be 400 million."""
    n = 20_000
    rows = spark.range(n).selectExpr("1 page", "id", "double(id % 200 * 10) x0", "double(id div 200 * 10) y0", "double(id % 200 * 10 + 8) x1", "double(id div 200 * 10 + 8) y1")
    began = time.time()
    found = areas.surroundings(rows, rows.drop("id"), ["page"])
    row = found.where("id = 4010").first()
    assert (row.above, row.below, row.leftward, row.rightward) == (198.0, 210.0, 98.0, 110.0)
    assert time.time() - began < 120


def test_regions_and_widths_by_evidence(spark):
    cases = [(50.0, 100.0, 300.0, None, None, None, 200.0, 260.0), (50.0, 100.0, 300.0, 90.0, 320.0, 240.0, 150.0, None), (350.0, 100.0, 300.0, 10.0, None, None, 100.0, 180.0), (350.0, 1.0, 580.0, None, None, None, 100.0, None)]
    df = spark.createDataFrame(cases, "x0 double, y0 double, y1 double, above double, below double, rightward double, lower double, upper double")
    top, bottom = areas.region_of(F.lit(600.0), F.lit(30.0))
    got = df.select(top.alias("t"), bottom.alias("b"), areas.width_of(F.lit(400.0), F.col("lower"), F.col("upper")).alias("w")).collect()
    assert [tuple(r.t) for r in got] == [(0.0, "page-edge"), (90.0, "foreign-content-boundary"), (10.0, "foreign-content-boundary"), (0.0, "page-edge")]
    assert [tuple(r.b) for r in got] == [(570.0, "margin-symmetry"), (320.0, "foreign-content-boundary"), (570.0, "margin-symmetry"), (600.0, "page-edge")]
    assert [r.w and tuple(r.w) for r in got] == [(230.0, "wrapped-line-interval-midpoint"), (190.0, "foreign-content-boundary"), None, None]


def test_outlines_against_all_pairs(spark):
    rng = random.Random(4)
    near = lambda v: v + rng.choice([0.0, 0.0015, -0.002, 0.0021, 0.004])
    glyph = [(1, k % 3, k, float(rng.randrange(30)), float(rng.randrange(3))) for k in range(120)]
    inks = [(1, k % 3, k, near(float(rng.randrange(30))), near(float(rng.randrange(3)))) for k in range(110)]
    inks += [(1, 0, 1000 + k, 500.0, 500.0) for k in range(300)]
    glyph += [(1, 0, 1000 + k, 500.0, 500.0) for k in range(300)] + [(1, 1, 2000, 700.0, 1.0)]
    inks += [(1, 1, 2000, 700.001, 0.999)]
    got = {r.id: (r.ink, r.status) for r in areas.outlines(spark.createDataFrame(glyph, "page int, gid int, id int, x double, y double"), spark.createDataFrame(inks, "page int, gid int, ink int, x double, y double"), ["page", "gid"]).collect()}
    found = {g[2]: [i[2] for i in inks if i[1] == g[1] and max(abs(i[3] - g[3]), abs(i[4] - g[4])) <= 0.002] for g in glyph}
    claims = {}
    for own in found.values():
        for i in own:
            claims[i] = claims.get(i, 0) + 1
    for g, own in found.items():
        want = (None, "none") if not own else (None, "several") if len(own) > 1 else (None, "shared") if claims[own[0]] > 1 else (own[0], "matched")
        assert got[g] == want
    assert got[2000] == (2000, "matched")


def test_outlines_at_home_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(areas, "MET", 50)
    rng = random.Random(9)
    near = lambda v: v + rng.choice([0.0, 0.0015, -0.002, 0.0021, 0.004])
    place = lambda: rng.choice([None, float("nan"), 1e12, *[float(x) for x in range(-3, 20)]])
    rows = []
    for k in range(900):
        page, x, y = rng.choice([None, 1, 2, 3, 4, 5, 6, 7]), place(), place()
        one = rng.choice([None, *[(page or 0) * 1000 + i for i in range(60)]])
        rows.append((page, rng.choice(["a", "b", None]), one, x, y, one if k % 3 else (page or 0) * 1000 + k % 70, x if x is None else near(x), y if y is None else near(y), k % 11 > 0, k % 7 > 0))
    rows += [(9, "a", 9000 + k, 1.0, 1.0, 9000 + k, 1.0, 1.0, True, k > 0) for k in range(80)] + [(10, "a", 10000, 5.0, 2.0, 10000, 5.001, 1.999, True, True)]
    df = spark.createDataFrame(rows, "page int, ch string, id long, x double, y double, ink long, ink_x double, ink_y double, is_glyph boolean, is_ink boolean")
    pairs = [(g[2], i[5]) for g in rows if g[8] for i in rows if i[9] and None not in (*g[:2], *g[3:5], *i[6:8]) and g[:2] == i[:2] and abs(g[3] - i[6]) <= 0.002 and abs(g[4] - i[7]) <= 0.002]
    own, claims = {}, {}
    for g, i in pairs:
        own.setdefault(g, []).append(i)
        claims[i] = claims.get(i, 0) + 1
    want = []
    for g in (r for r in rows if r[8]):
        met = own.get(g[2], []) if g[2] is not None else []
        ink = met[0] if len(met) == 1 else None
        status = "none" if not met else "several" if len(met) > 1 else "shared" if ink is not None and claims[ink] > 1 else "matched"
        want.append((g[0], g[1], g[2], ink if status == "matched" else None, status))
    got = areas.outlines_at_home(df.repartition(3, "page"), ["page"], ["ch"]).collect()
    order = lambda found: sorted((tuple(r) for r in found), key=repr)
    assert order(got) == order(want) and {r.status for r in got} == {"none", "several", "shared", "matched"}
