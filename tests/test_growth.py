"""What steps write and hold, and rows that share an id."""


import difflib
import hashlib
import os
import random
import unicodedata

import duckdb
import pyarrow as pa
import pytest
from compare import same_rows
from pyspark.sql import functions as F

from leafmark import storage
from leafmark.functions import text as T
from leafmark.operators import areas, detection, graph, matching, orders, results, sequential, structure, typeset
from leafmark.plans import composition, elements, evaluation
from leafmark.plans import results as results_plan
from leafmark.storage import stage


@pytest.fixture
def staged(monkeypatch):
    """(columns, rows) of every table that pointer doubling writes."""
    seen = []

    def kept(df, name, *args, **more):
        out = stage(df, name, *args, **more)
        seen.append((out.columns, out.count(), out.inputFiles()))
        return out

    monkeypatch.setattr(graph, "stage", kept)
    return seen


def test_positions_write_no_paths_that_nobody_asks_for(spark, staged):
    links = spark.createDataFrame([(i, i - 1 if i else None) for i in range(500)] + [(1000, 1001), (1001, 1000)], "a int, b int")
    got = {r.a: (r.position, r.status) for r in graph.positions(links, [], "a", "b").collect()}
    assert got == {i: (i, "ordered") for i in range(500)} | {1000: (None, "cycle"), 1001: (None, "cycle")}
    assert all("path" not in columns and "total" not in columns for columns, *_ in staged)


def test_settled_positions_are_written_once(spark, staged):
    links = spark.createDataFrame([(i, i - 1 if i % 4 else None, 1.0) for i in range(4000)] + [(5000 + i, 5000 + (i + 1) % 3, 1.0) for i in range(3)], "a int, b int, w double")
    got = graph.positions(links, [], "a", "b", weight="w").collect()
    assert {(r.position, r.status, r.total) for r in got if r.a < 4000} == {(k, "ordered", k + 1.0) for k in range(4)} and sum(r.status == "cycle" for r in got) == 3
    assert sum(rows for _, rows, _ in staged) < 2.5 * 4003 and len(staged) < 6


def test_settled_positions_do_not_meet_in_one_task(spark, staged):
    links = spark.createDataFrame([(i, i - 1 if i % 40 else None, 1.0) for i in range(8000)], "a long, b long, w double")
    # as on large tables: partitions aren't merged, nothing is broadcast
    large = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in large}
    try:
        for k, v in large.items():
            spark.conf.set(k, v)
        got = graph.positions(links, [], "a", "b", weight="w").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.a, r.position, r.status, r.total) for r in got} == {(i, i % 40, "ordered", i % 40 + 1.0) for i in range(8000)}
    # a task writes one file, so a file has as many rows as met in a task
    db, met = duckdb.connect(), []
    for _, rows, files in staged:
        met.append((max(db.sql(f"SELECT count(*) FROM '{name.removeprefix('file://')}'").fetchall()[0][0] for name in files), rows))
    assert len(met) > 5 and all(most < 0.4 * rows for most, rows in met if rows > 400)


def test_mapped_names_are_written_once(spark, staged):
    names = spark.createDataFrame([(f"n{i}", f"n{i + 1}" if i % 4 < 3 else "end") for i in range(4000)] + [("x", "y"), ("y", "x")], "a string, b string")
    got = {r.name: (r.mapped, r.status) for r in graph.terminals(names, "a", "b").collect()}
    assert got == {f"n{i}": ("end", "mapped") for i in range(4000)} | {"x": (None, "cycle"), "y": (None, "cycle")}
    assert sum(rows for _, rows, _ in staged) < 3.5 * 4002 and len(staged) < 6


def test_long_paths_lie_in_small_files(spark, staged, monkeypatch):
    monkeypatch.setattr(graph, "PIECES", 1 << 14)
    edges = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None, i) for i in range(900)], "node string, parent string, place long")
    found = structure.paths(edges, "node", "parent", "place")
    assert {r.node: (r.depth, r.path) for r in found.collect()} == {f"n{i}": (i, "/".join(["1"] * (i + 1))) for i in range(900)}
    db = duckdb.connect()
    for _, _, files in staged:
        for name in files:
            [(rows, size)] = db.sql(f"SELECT count(*), coalesce(sum(length(path)), 0) FROM '{name.removeprefix('file://')}'").fetchall()
            assert rows <= graph.LEAST_ROWS or size <= 4 * graph.PIECES


@pytest.fixture(scope="module")
def shared_ids(small, tmp_path_factory):
    """The smallest tables with lines whose order and price are those of another line: of one page, place or letter, or of others; and lines that are there twice."""
    folder = tmp_path_factory.mktemp("shared") / "sf"
    folder.mkdir()
    db = duckdb.connect()
    for name in os.listdir(small):
        rows = f"SELECT * FROM '{small}/{name}'"
        if name == "lineitem.parquet":
            twin = "l_partkey + 3 AS l_partkey, l_suppkey + 1 AS l_suppkey, l_linenumber % 7 + 1 AS l_linenumber"
            rows = f"""{rows} UNION ALL SELECT * REPLACE ({twin}) FROM ({rows}) WHERE l_orderkey % 3 = 0 UNION ALL {rows} WHERE l_orderkey % 7 = 1
            UNION ALL SELECT * REPLACE ('R' AS l_returnflag, l_quantity + 0.001 AS l_quantity, l_partkey + 1 AS l_partkey) FROM ({rows}) WHERE l_orderkey % 5 = 2"""
        db.sql(f"COPY (SELECT * FROM ({rows})) TO '{folder}/{name}' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["frame_widths", "outline_matches", "paint_hints", "placement_errors"])
def test_lines_of_one_price(spark, shared_ids, name):
    plan = composition if name == "outline_matches" else elements
    same_rows(spark, shared_ids, plan.QUERIES[name], plan.ORACLES[name])


def test_breaks_between_slots_of_one_place(spark, shared_ids, tmp_path):
    """The SQL leaves the order of equal slots open: rows in any order give the same breaks, and those of orders without equal slots are the SQL's."""
    lines = spark.read.parquet(f"{shared_ids}/lineitem.parquet")
    found = []
    for k, order in enumerate(("l_partkey", "l_suppkey", "l_tax")):
        lines.coalesce(1).orderBy(order, F.desc("l_quantity")).repartition(1 + 2 * k).write.parquet(str(tmp_path / f"{k}" / "lineitem.parquet"))
        found.append(sorted(map(tuple, elements.region_breaks(spark, str(tmp_path / f"{k}")).collect())))
    assert found[0] == found[1] == found[2]
    (tmp_path / "alone").mkdir()
    alone = f"SELECT * FROM '{shared_ids}/lineitem.parquet' WHERE l_orderkey IN (SELECT l_orderkey FROM '{shared_ids}/lineitem.parquet' GROUP BY 1 HAVING count(*) = count(DISTINCT l_extendedprice))"
    duckdb.connect().sql(f"COPY ({alone}) TO '{tmp_path}/alone/lineitem.parquet' (FORMAT parquet)")
    same_rows(spark, str(tmp_path / "alone"), elements.region_breaks, elements.ORACLES["region_breaks"])


def test_normal_forms_and_clusters(spark):
    rng = random.Random(5)
    texts = ["", None, "a\r\nb\n\r", "e\u0301x", "\U0001f468\u200d\U0001f469", "ﬁ ｘ"] + ["".join(rng.choice("aé\u0301\r\n ｆ가") for _ in range(rng.randrange(40))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    want = {r.k: r.n for r in rows.select("k", (F.size(T.grapheme_starts("t")) - 1).alias("n")).collect()}
    for r in T.normalized(rows, "k", "t").collect():
        t = texts[r.key]
        digest = None if t is None else hashlib.sha256("".join(unicodedata.normalize("NFKC", t).split()).encode()).hexdigest()
        assert (r.nfkc_sha256, r.n_graphemes) == (digest, None if t is None else want[r.key])
    plan = T.normalized(rows, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "array<int>" not in plan


def test_fidelity_joins_no_characters(spark, small):
    plan = composition.edit_fidelity(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Join") <= 2


def test_substrings_are_compared_by_hashes(monkeypatch):
    """Texts of more than PAIRS pairs are aligned as difflib does, without leaving large ranges to it."""
    rng, plain, largest = random.Random(9), difflib.SequenceMatcher, []

    def watched(junk, a, b, autojunk):
        largest.append(len(a) * len(b))
        return plain(junk, a, b, autojunk)

    monkeypatch.setattr(T.difflib, "SequenceMatcher", watched)
    for n in (200, 400, 900):
        for letters in ("ab", "abcdefghij ", "aé가 "):
            a = "".join(rng.choice(letters) for _ in range(n))
            b = a[: n // 3] + "new " + a[n // 3 + 5 : n // 2] + a[n // 5 :]
            for x, y in ((a, b), (b, a), (a, a[::-1])):
                got = T.matching_blocks(x, y)
                want = [k for k in plain(None, x, y, False).get_matching_blocks() if k.size]
                assert [(i + k, j + k) for i, j, m in got for k in range(m)] == [(i + k, j + k) for i, j, m in want for k in range(m)]
    assert max(largest) <= T.PAIRS


def test_composed_maps_are_sorted_once_and_dealt_by_rows(spark, small, monkeypatch):
    monkeypatch.setattr(storage, "ROWS_A_TASK", 20)
    found = composition.revision_maps(spark, small)
    assert found.rdd.getNumPartitions() >= 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    assert plan.count("Sort [") <= 5 and "Join" not in plan

def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_groups_are_not_gathered(spark, small):
    assert "Window" not in _plan(evaluation.QUERIES["boundary_groups"](spark, small))


def test_items_outside_meet_areas_once(spark, small):
    assert _plan(elements.kept_outside(spark, small)).count("Join") <= 2


def test_reached_definitions_are_written_once(spark, monkeypatch):
    written = []

    def kept(df, name, *args, **more):
        out = stage(df, name, *args, **more)
        written.append(out.count() if "path" in out.columns else 0)
        return out

    monkeypatch.setattr(orders, "stage", kept)
    edges = spark.createDataFrame([(p, i, i + 1, f"n{i}") for p in range(3) for i in range(12)], "page long, parent long, child long, name string")
    roots = edges.select("page", F.lit(0).cast("long").alias("node")).distinct()
    got = {(r.page, r.node): r.path for r in orders.reachable(edges, roots, "page").collect()}
    assert got == {(p, k): "/".join(f"n{i}" for i in range(k)) for p in range(3) for k in range(13)}
    assert sum(written) == len(got)


def test_recorded_glyphs_ask_in_few_cells(spark):
    rng = random.Random(3)
    rows = [(p, rng.choice("ab"), rng.randrange(40) * 0.004 + rng.choice((0, 0, 0.64, 1e6)), rng.randrange(3) * 0.008) for p in range(4) for _ in range(60)] + [(9, "a", None, 1.0), (9, "b", float("nan"), 1.0)]
    drawn = spark.createDataFrame(rows, "page int, ch string, x double, y double")
    kept = spark.createDataFrame([(p, i % 9, c, None if x is None else x + rng.choice((0, 0.005, -0.0125)), y) for i, (p, c, x, y) in enumerate(rows)], "page int, entry int, ch string, x double, y double")
    near = lambda a, b: a is not None and b is not None and abs(a - b) <= 0.01
    want = {}
    for p, e, c, x, y in kept.collect():
        n = sum(q == p and d == c and near(u, x) and near(v, y) for q, d, u, v in rows)
        want[p, e] = want.get((p, e), True) and n == 1
    found = results.relocated(kept, drawn, ["page"], 0.01)
    assert {(r.page, r.entry): r.moved for r in found.collect()} == want
    asked = [n for n in _plan(found).split("\n") if "Generate" in n]
    assert asked and not any("explode(array(" in n for n in asked)


def test_spans_are_dealt_by_rows_and_not_shuffled(spark, small, monkeypatch):
    monkeypatch.setattr(storage, "SORTED_A_TASK", 2000)
    found = results_plan.styled_edits(spark, small)
    assert found.rdd.getNumPartitions() >= 8
    assert _plan(found).count("Exchange hashpartitioning") <= 2 and _plan(found).count("Join") == 1


def test_style_spans_are_sorted_few_times(spark, small, monkeypatch):
    monkeypatch.setattr(storage, "SORTED_A_TASK", 2000)
    found = composition.styled_edit_lists(spark, small)
    assert found.rdd.getNumPartitions() >= 8
    assert "ENSURE_REQUIREMENTS" not in _plan(found) and "SortAggregate" not in _plan(found)


def test_fills_stay_where_they_are_dealt(spark, small):
    """Besides the meeting of queries and fills, one shuffle by query and paint."""
    assert _plan(composition.fill_coverage(spark, small)).count("Join") <= 2


def test_short_runs_leave_a_task_together(monkeypatch):
    """Pages of a few rows aren't batches of their own, and plain numbers give the lines that arrays give."""
    rng = random.Random(4)
    pages = [(p, o, rng.randrange(4) * 0.8, rng.randrange(5) * 20.0, rng.choice((18.0, 38.0, 41.0)), 12.0, rng.randrange(2)) for p in range(300) for o in range(rng.randrange(1, 9))]
    columns = [[float(r[2]) for r in pages], [r[3] for r in pages], [r[3] + r[4] for r in pages], [r[5] for r in pages], [float(r[6]) for r in pages]]
    table = pa.table({"page": [r[0] for r in pages], **dict(zip(("baseline", "x0", "x1", "size", "owner"), columns, strict=True))})
    runs = [(t, cuts) for t, cuts in sequential._whole_runs(table.to_batches(max_chunksize=500), ["page"])]
    assert sum(t.num_rows for t, _ in runs) == len(pages) and len(runs) <= len(pages) // 500 + 2
    parts = [t.slice(lo, hi - lo) for t, cuts in runs for lo, hi in zip(cuts, cuts[1:], strict=False)]
    assert [set(p["page"].to_pylist()) for p in parts] == [{p} for p in range(300)]
    for part in parts:
        own = [part[c].to_numpy() for c in table.column_names[1:]]
        few = orders._merged(*own).tolist()
        with monkeypatch.context() as m:
            m.setattr(orders, "FEW_ROWS", 0)
            assert orders._merged(*own).tolist() == few


def test_lengths_and_spans_of_a_text_are_made_once(spark, small):
    """A text's length isn't counted for each of its spans, and spans come as arrays, nulls and empty lists among them."""
    found = composition.styled_lines(spark, small)
    assert _plan(found).count("char_length(") == 1
    spans = pa.array([[{"start": 0, "end": 2}], None, [], [{"start": 3, "end": 4}, {"start": 4, "end": 9}]], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    got = list(typeset._values(spans.slice(1)))
    assert [{k: v.tolist() for k, v in s.items()} for s in got] == [{"start": [], "end": []}, {"start": [], "end": []}, {"start": [3, 4], "end": [4, 9]}]


def test_equal_runs_are_listed_once(monkeypatch):
    """Texts of some hundred characters are aligned as difflib does, from one list of their equal runs, of many runs and of few."""
    rng, plain = random.Random(11), difflib.SequenceMatcher
    monkeypatch.setattr(T, "_hashes", None)
    monkeypatch.setattr(T.difflib, "SequenceMatcher", None)
    for n in (130, 260, 350):
        for letters in ("a", "ab", "abcdefghij ", "aé가\U0001f600 "):
            a = "".join(rng.choice(letters) for _ in range(n))
            for b in (a[: n // 3] + "new " + a[n // 3 + 5 :], a[::-1] + "x", "x" * n):
                got = T.matching_blocks(a, b)
                want = [k for k in plain(None, a, b, False).get_matching_blocks() if k.size]
                assert [(i + k, j + k) for i, j, m in got for k in range(m)] == [(i + k, j + k) for i, j, m in want for k in range(m)]


def test_strips_are_matched_in_one_stream(spark, monkeypatch):
    """Strips aren't groups of their own, and those of few rows leave what those of many leave; null and NaN meet nothing."""
    rng = random.Random(8)
    side = lambda n: spark.createDataFrame([(k, i, rng.choice((None, float("nan"))) if i % 9 == 4 else round(rng.uniform(0, n), 1)) for k in range(4) for i in range(n)], "k int, o int, v double")
    want, have = side(30), side(25)
    found = matching.tolerant_residue(want, have, "k", "v", "o", 0.5)
    assert "CoGroups" not in _plan(found) and _plan(found).count("Sort [") == 1
    few = sorted(map(tuple, found.collect()))
    nothing = [(r.k, r.o, s) for d, s in ((want, "missing"), (have, "extra")) for r in d.collect() if r.v is None or r.v != r.v]
    assert set(nothing) <= set(few)
    monkeypatch.setattr(matching, "FEW", 0)
    assert sorted(map(tuple, matching.tolerant_residue(want, have, "k", "v", "o", 0.5).collect())) == few


@pytest.mark.parametrize("size", [12.0, 2.0])
def test_strips_of_a_page_are_numbered_in_one_pass(spark, size):
    """Rows are sorted once and joined to nothing; pages that go on over batches, and strips of one line and of several, are numbered on."""
    rng = random.Random(3)
    glyphs = [(p, i, rng.random() * 50, rng.randrange(60) * 5 + rng.choice((0.0, 0.4, 0.9, 1.7)), size) for p in (None, 1, 2, 3) for i in range(rng.randrange(80, 200))]
    rows = spark.createDataFrame(glyphs, "page int, ord int, x0 double, y double, size double")
    found = sequential.cluster_baselines(rows, ["page"])
    assert "Join" not in _plan(found) and _plan(found).count("Sort [") == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r.page, r.ord): r.line for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for page in (None, 1, 2, 3):
        own = sorted((g for g in glyphs if g[0] == page), key=lambda g: (g[3], g[2], g[1]))
        whole = sequential._lines_of_strip(pa.array([g[3] for g in own]).to_numpy(), pa.array([g[4] for g in own]).to_numpy())
        assert [got[page, g[1]] for g in own] == whole.tolist()


def test_rectangles_are_dealt_once_for_all_sides(spark, small, monkeypatch):
    """No row is written as JSON, sides are made after the shuffle, and keys of few rows give what a skyline gives, also across batches."""
    found = composition.column_regions(spark, small)
    plan = _plan(found)
    assert "to_json" not in plan and plan.index("Generate") < plan.index("REPARTITION_BY_NUM")
    want = sorted(map(str, found.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "101")
    try:
        assert sorted(map(str, composition.column_regions(spark, small).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(areas, "FEW_ROWS", 0)
    assert sorted(map(str, composition.column_regions(spark, small).collect())) == want


def test_texts_go_with_their_rules(spark, small):
    """The rule on either side is found in a sorted pass that takes the text along: only its glyphs and its edge are joined to anything."""
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    texts = lines.selectExpr("l_orderkey div 8 AS page", "l_linenumber + l_orderkey * 10 AS id", "l_quantity * 8 AS x0", "l_linenumber * 40.0 AS y0", "l_quantity * 8 + 30 AS x1", "l_linenumber * 40.0 + 12 AS y1", "12 AS size")
    rules = texts.selectExpr("page", "x0 - 5 AS x", "0.0 AS top", "400.0 AS bottom")
    glyphs = texts.selectExpr("page", "id AS owner", "x0 AS gx0", "y0 AS gy0", "x1 AS gx1", "y1 AS gy1")
    written = []

    def kept(df, name, *args, **more):
        written.append((name, _plan(df)))
        return stage(df, name, *args, **more)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(detection, "stage", kept)
        detection.cell_edges(texts, rules, glyphs, "page").count()
    plans = dict(written)
    assert "Join" not in plans["left"] and plans["edges"].count("Join") == 1


def test_all_rows_of_least_burden(spark, tmp_path):
    rows = [(7, 1, 1, 5, 5.0, "A", "O"), (9, 2, 1, 5, 5.0, "A", "O"), (7, 3, 2, 5, 5.0, "A", "O"), (8, 3, 2, 6, 5.0, "A", "O"), (2, 3, 2, 6, None, "A", "O"), (4, 1, 1, None, None, None, "F"), (5, 1, 1, None, None, None, "F"), (6, None, 1, 1, 3.0, "N", None)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "t").mkdir()
    duckdb.connect().sql(f"COPY (SELECT * FROM '{tmp_path}/written/*.parquet') TO '{tmp_path}/t/lineitem.parquet' (FORMAT parquet)")
    same_rows(spark, str(tmp_path / "t"), evaluation.QUERIES["boundary_groups"], evaluation.ORACLES["boundary_groups"])
    found = evaluation.QUERIES["boundary_groups"](spark, str(tmp_path / "t")).collect()
    assert sorted((r.l_returnflag or "", r.least_ordinal) for r in found) == [("", 4), ("", 5), ("A", 7), ("A", 7), ("A", 9), ("N", 6)]
    assert {(r.n, r.first_ordinal, r.last_ordinal, r.n_least, r.n_l_partkey) for r in found if r.l_returnflag == "A"} == {(5, 2, 9, 3, 3)}


def test_lines_are_shuffled_once_to_their_page(spark, small, tmp_path):
    plan = _plan(composition.outline_matches(spark, small))
    assert plan.count("Exchange") == 1 and "Join" not in plan
    # a price that has no room in an id: pages share ids
    twin = "* REPLACE (l_orderkey + 8 AS l_orderkey, l_extendedprice - 8000000 AS l_extendedprice)"
    duckdb.connect().sql(f"COPY (FROM '{small}/lineitem.parquet' UNION ALL SELECT {twin} FROM '{small}/lineitem.parquet' WHERE l_orderkey % 5 = 1) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    same_rows(spark, str(tmp_path), composition.outline_matches, composition.ORACLES["outline_matches"])


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_texts_are_sent_once_for_a_pair_and_copies_not_at_all(spark, monkeypatch, broadcast):
    monkeypatch.setattr(matching, "BROADCAST", broadcast)
    monkeypatch.setattr(matching, "STAR", 3)
    monkeypatch.setattr(matching, "PAIRS_A_TASK", 5)
    monkeypatch.setattr(matching, "CHARS_A_TASK", 500)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}é" for _ in range(60)]
    texts = [" ".join(base), "x", None, "", "", " ".join(base), "x"] + [" ".join(w if rng.random() > 0.02 else "edit" for w in base) for _ in range(14)]
    df = spark.createDataFrame([(100 - k, t) for k, t in enumerate(texts)], "id long, text string")
    by_id = {r.id: r.text for r in df.collect()}
    found = matching.aligned_copies(df, "id", "text")
    got = {tuple(r)[:2]: tuple(r)[2:] for r in found.collect()}
    pairs = [tuple(r) for r in matching.near_copies(df, "id", "text").collect()]
    assert len(got) == found.count() == len(pairs) > 10 and set(got) == set(pairs)
    for (k, f), counts in got.items():
        want = [0, 0, 0, 0]
        for tag, i, j, m, n in difflib.SequenceMatcher(None, by_id[f], by_id[k], autojunk=False).get_opcodes():
            want[("equal", "delete", "insert", "replace").index(tag)] += j - i if tag in ("equal", "delete") else n - m
        assert counts == tuple(want)
    if broadcast:
        assert _plan(found).count("Exchange hashpartitioning") == 1
        # equal texts come from their digests
        plan = _plan(matching.copies_and_links(df, "id", "text")[0])
        assert "Exchange" not in plan and "text" not in plan


def test_slots_of_one_place_go_by_page_and_text(spark, shared_ids):
    sql = elements.ORACLES["region_breaks"]
    ordered = sql.replace("AS page FROM lineitem", "AS page, l_partkey FROM lineitem").replace("ORDER BY slot)", "ORDER BY slot, page, l_partkey, en)")
    assert ordered.count("l_partkey,") == sql.count("l_partkey,") + 1
    same_rows(spark, shared_ids, elements.region_breaks, ordered)
