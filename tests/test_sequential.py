"""Order-dependent operators against plain loops over the same rules."""

import random
from statistics import median

import numpy as np
import pytest
import regex

from leafmark.operators import detection, elements, orders
from leafmark.operators import sequential as S


def plain_lines(glyphs):
    """glyphs (x0, y, size, ord) -> line of each ord, by looking at every line that there is."""
    lines, out = [], {}
    for x0, y, size, ord_ in sorted(glyphs, key=lambda g: (g[1], g[0], g[3])):
        near = []
        for i, own in enumerate(lines):
            d = abs(y - median(o[0] for o in own))
            if d <= max(0.65, 0.15 * min(size, median(o[1] for o in own))):
                near.append((d, -i))
        i = -min(near)[1] if near else len(lines)
        if i == len(lines):
            lines.append([])
        lines[i].append((y, size))
        out[ord_] = i
    return out


@pytest.mark.parametrize("seed", range(4))
def test_baselines_against_every_line(spark, seed):
    """Jitter within and around the tolerance, dense lines, several sizes and pages."""
    rng, rows = random.Random(seed), []
    for page in range(3):
        rows += [(page, float(rng.randrange(300)), round(60 + rng.randrange(8) * (2.0 if page else 16.8) + rng.uniform(-1.2, 1.2), 2), rng.choice([8.0, 12.0, 30.0]), k) for k in range(120)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page int, x0 double, y double, size double, ord int")
    got = {(r.page, r.ord): r.line for r in S.cluster_baselines(df, ["page"]).collect()}
    assert got == {(p, o): line for p in range(3) for o, line in plain_lines([r[1:] for r in rows if r[0] == p]).items()}


def plain_boxes(lines):
    """lines (x0, x1, y, size, ord) -> box of each ord."""
    boxes, out = [], {}
    for line in sorted(lines, key=lambda r: (r[2], r[0], r[4])):
        x0, x1, y, size, ord_ = line
        costs = []
        for i, box in enumerate(boxes):
            a0, a1, ay, asize, _ = box[-1]
            big, gap, common = max(size, asize), y - ay, min(x1, a1) - max(x0, a0)
            if min(size, asize) < 0.82 * big or gap <= max(1, size / 2) or gap > 2.6 * min(size, asize) or common <= 0:
                continue
            left = min(abs(x0 - a0), abs(x0 - box[0][0]))
            if left <= 1.35 * big:
                costs.append((gap / size + left / big, i))
            elif abs(x1 - a1) <= 0.65 * big and common >= 0.65 * min(x1 - x0, a1 - a0):
                costs.append((gap / size + (1 + abs(x1 - a1) / big), i))
        i = min(costs)[1] if costs else len(boxes)
        if i == len(boxes):
            boxes.append([])
        boxes[i].append(line)
        out[ord_] = i
    return out


@pytest.mark.parametrize("seed", range(4))
def test_boxes_against_every_box(spark, seed):
    rng, rows = random.Random(seed), []
    for page in range(2):
        for k in range(80):
            x0 = rng.choice([40.0, 52.0, 300.0, 310.0])
            rows.append((page, x0, x0 + rng.choice([90.0, 180.0, 200.0, 430.0]), 60 + 8.4 * (k // 2) + (60 if k > 40 else 0), rng.choice([12.0, 12.0, 13.0, 20.0]), k))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page int, x0 double, x1 double, y double, size double, ord int")
    got = {(r.page, r.ord): r.box for r in S.group_lines(df, ["page"]).collect()}
    assert got == {(p, o): box for p in range(2) for o, box in plain_boxes([r[1:] for r in rows if r[0] == p]).items()}


def plain_columns(rows):
    """rows (x0, x1, y, size, ord): one-line paragraphs -> column of each ord."""
    columns, out = [], {}
    for x0, x1, y, size, ord_ in sorted(rows, key=lambda r: (r[2], r[0], r[4])):
        costs = []
        for i, column in enumerate(columns):
            a0, a1, ay, asize, _ = column[-1]
            big, common = max(size, asize), min(x1, a1) - max(x0, a0)
            if min(size, asize) < 0.82 * big or y <= ay or common <= 0:
                continue
            left = min(abs(x0 - a0), abs(x0 - column[0][0]))
            if left <= 1.35 * big:
                costs.append((left / big, i))
            elif abs(x1 - a1) <= 0.65 * big and common >= 0.65 * min(x1 - x0, a1 - a0):
                costs.append((1 + abs(x1 - a1) / big, i))
        i = min(costs)[1] if costs else len(columns)
        if i == len(columns):
            columns.append([])
        columns[i].append((x0, x1, y, size, ord_))
        out[ord_] = i
    return out


def plain_blocks(rows):
    """rows (x, pen_end, first, last, size, ord) -> block of each ord, the latest that fits."""
    blocks, out = [], {}
    for row in sorted(rows, key=lambda r: r[5]):
        x, end, first, _, size, ord_ = row
        fits = [i for i, b in enumerate(blocks) if abs(b[-1][4] - size) < 0.1 and x < b[-1][1] and b[-1][0] < end and 0 < first - b[-1][3] <= 3 * size and abs(x - b[-1][0]) <= 2 * size]
        i = fits[-1] if fits else len(blocks)
        if i == len(blocks):
            blocks.append([])
        blocks[i].append(row)
        out[ord_] = i
    return out


@pytest.mark.parametrize("seed", range(3))
def test_columns_and_blocks_against_plain_loops(spark, seed):
    rng = random.Random(seed)
    rows = [(p, float(rng.choice([40, 45, 52, 200, 204, 360])), 0.0, float(rng.randrange(60)) * 9, rng.choice([12.0, 12.0, 13.0, 20.0]), k) for p in range(2) for k in range(70)]
    rows = [(p, x, x + rng.choice([90.0, 140.0, 300.0]), y, s, k) for p, x, _, y, s, k in rows]
    df = spark.createDataFrame(rows, "page int, x0 double, x1 double, y double, size double, ord int")
    df = df.selectExpr("*", *[f"{c} AS last_{c}" for c in ("x0", "x1", "y", "size")])
    got = {(r.page, r.ord): r.column for r in detection.columns(df, ["page"]).collect()}
    assert got == {(p, o): i for p in range(2) for o, i in plain_columns([r[1:] for r in rows if r[0] == p]).items()}
    stacks = [(p, x, x1, y, y + rng.choice([0.0, 12.0, 30.0]), s, k) for p, x, x1, y, s, k in rows]
    df = spark.createDataFrame(stacks, "page int, x double, pen_end double, first double, last double, size double, ord int")
    got = {(r.page, r.ord): r.block for r in detection.blocks(df, ["page"]).collect()}
    assert got == {(p, o): i for p in range(2) for o, i in plain_blocks([r[1:] for r in stacks if r[0] == p]).items()}


def test_visual_lines_and_line_ranges_against_plain_loops(spark):
    rng = random.Random(3)
    rows = [(p, float(t := rng.randrange(200)), float(t + rng.choice([0, 5, 9, 14, 40])), k) for p in range(2) for k in range(60)]
    want = {}
    for page in range(2):
        lines = []
        for p, top, bottom, k in rows:
            if p != page:
                continue
            at = next((i for i, (a, b) in enumerate(lines) if min(b, bottom) - max(a, top) > 0.5 * min(max(bottom - top, 0.1), max(b - a, 0.1))), len(lines))
            if at == len(lines):
                lines.append((top, bottom))
            lines[at] = (min(lines[at][0], top), max(lines[at][1], bottom))
            want[page, k] = at
    got = elements.visual_lines(spark.createDataFrame(rows, "page int, top double, bottom double, ord int"), ["page"]).collect()
    assert {(r.page, r.ord): r.line for r in got} == want
    texts = [(1, "one two one", ["one ", "one", "two"]), (2, None, ["x"]), (3, "ab", ["", "b", None]), (4, "ab", None)]
    got = sorted(tuple(r) for r in elements.line_ranges(spark.createDataFrame(texts, "id long, t string, l array<string>"), "id", "t", "l").collect())
    assert got == [(1, 0, 0, 3), (1, 1, 8, 11), (1, 2, None, None), (2, 0, None, None), (3, 0, 0, 0), (3, 1, 1, 2), (3, 2, 2, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_offset_rows_against_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(float(20 * rng.randrange(3)) + rng.choice([0, 0.03, 0.8, 2, 5]), float(x := rng.randrange(0, 120, 10)), float(x + rng.choice([8, 10, 14])), rng.choice([8.0, 12.0]), rng.randrange(2), k) for k in range(80)]
    lines, want = [], {}
    for base, x0, x1, size, owner, k in rows:
        def beside(m):
            gap = max(x0 - m["x1"], m["x0"] - x1)  # noqa: B023
            return 0.05 < abs(m["base"] - base) <= 0.35 * min(m["size"], size) and -0.05 * min(m["size"], size) <= gap <= 0.5 * max(m["size"], size) and m["owner"] == owner  # noqa: B023
        mate = next((m for m in lines if beside(m)), None)
        if mate is None:
            mate = {"base": base, "x0": x0, "x1": x1, "size": size, "owner": owner, "wide": x1 - x0, "id": len(lines)}
            lines.append(mate)
        else:
            if x1 - x0 > mate["wide"]:
                mate.update(base=base, size=size)
            mate.update(x0=min(mate["x0"], x0), x1=max(mate["x1"], x1), wide=mate["wide"] + x1 - x0)
        want[k] = mate["id"]
    df = spark.createDataFrame([(1, *r) for r in rows], "page int, baseline double, x0 double, x1 double, size double, owner int, ord int")
    assert {r.ord: r.visual for r in orders.merge_offset_rows(df, ["page"]).collect()} == want


def step(c):
    return 6 if ord(c) < 128 else 12


def plain_wrap(text, width):
    """Lines by trying every end from the longest line down, at characters first as words, then as clusters."""
    out, at = [], 0
    if text.lstrip(S.SPACES)[:1] and text.lstrip(S.SPACES)[0] in S.NO_START:
        return None
    ends = [m.end() for m in regex.finditer(r"\X", text)]

    def kept(start, end):
        left, right = text[start:end].rstrip(S.SPACES), text[end:].lstrip(S.SPACES)
        return not (left and left[-1] in S.NO_END) and not (right and right[0] in S.NO_START)

    def word(end):
        a, b = text[end - 1], text[end]
        return (a in S.SPACES and b not in S.SPACES) or (a not in S.SPACES and b not in S.SPACES and (step(a) > 6 or step(b) > 6))

    def fits(start, end):
        return sum(map(step, text[start:end].rstrip(S.SPACES))) <= width

    while at < len(text):
        found = None
        if fits(at, len(text)):
            found = len(text)
        for rule in (lambda e: word(e), lambda e: True):
            if found is None:
                found = next((e for e in reversed(ends) if at < e < len(text) and fits(at, e) and rule(e) and kept(at, e)), None)
        if found is None:
            return None
        line = text[at:found].rstrip(S.SPACES)
        out.append((line, float(sum(map(step, line)))))
        at = found
        while at < len(text) and text[at] in S.SPACES and found < len(text):
            at += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_wrapping_against_every_end(seed):
    rng = random.Random(seed)
    for _ in range(400):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "語", "日", "、", "「", "」", "(", ")", "ー", "é", "é", "👩‍👧", "\t", "."]) for _ in range(rng.randrange(25)))
        width = rng.choice([12, 24, 30, 60, 90])
        want = plain_wrap(text, width) if text else [("", 0.0)]
        try:
            got = S.wrap_text(text, width)
        except S.Refusal:
            got = None
        # blanks alone at the end of a text make no line of their own
        assert got == want, (text, width)


def test_wrapping_refuses_a_paragraph_and_goes_on(spark):
    rows = [(1, "fine text\na" + "́" * 40 + "\nmore"), (2, None), (3, ")"), (4, "")]
    got = sorted(tuple(r) for r in S.wrap(spark.createDataFrame(rows, "id long, t string"), "id", "t", 60).select("key", "paragraph", "line", "n_chars", "refusal").collect())
    assert [r[:4] for r in got] == [(1, 0, 0, 9), (1, 1, 0, 41), (1, 2, 0, 4), (2, 0, 0, 0), (3, 0, 0, 1), (4, 0, 0, 0)]
    assert [r[4] is None for r in got] == [True, False, True, True, False, True]


def test_wrapping_of_a_long_text_is_quick():
    import time

    text = " ".join(f"word{i}" for i in range(200_000))
    began = time.time()
    lines = S.wrap_text(text, 360)
    assert time.time() - began < 20 and " ".join(t for t, _ in lines) == text


def test_marks_are_those_of_both_sets():
    assert not set(S.NO_START) & set(S.NO_END) and len(S.NO_START) == len(set(S.NO_START))
    assert np.all(np.diff(S._POINTS["start"].astype(np.int64)) > 0)
