import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.functions import verdicts as V
from leafmark.functions.geometry import Rect, rgb, union_of
from leafmark.operators import aggregates, graph, islands, matching, records, sequential, spans
from leafmark.sources import sinks, tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rectangles_are_strict_or_closed(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 2.0, 1.0)], "ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double")
    a, b = Rect.of("a"), Rect.of("b")
    got = df.select(a.intersects(b), a.contains(a), a.contains(b), a.gap(b), a.overlap(a), a.union(b).x1, a.intersects(a, 1.0)).first()
    assert tuple(got) == (False, True, False, 0.0, 1.0, 2.0, False)
    assert tuple(df.selectExpr("ax0 x0", "ay0 y0", "bx1 x1", "by1 y1").agg(*union_of()).first()) == (0.0, 0.0, 2.0, 1.0)


def test_colours(spark):
    df = spark.createDataFrame([([0.5],), ([0.1, 0.2, 0.3],), ([0.0, 1.0, 0.0, 0.5],), ([1.0, 1.0],)], "c array<double>")
    assert [r[0] for r in df.select(rgb(F.col("c"))).collect()] == [[0.5] * 3, [0.1, 0.2, 0.3], [0.5, 0.0, 0.5], [1.0, 1.0]]


@pytest.mark.parametrize(
    "checks, expected",
    [([(True, "required")], True), ([(None, "required"), (True, "shown")], None), ([(None, "required"), (False, "must_not_fail")], False), ([(False, "shown"), (True, "required")], True), ([(None, "must_not_fail")], True)],
)
def test_verdict_keeps_what_was_not_measured(spark, checks, expected):
    assert spark.createDataFrame(checks, "ok boolean, role string").agg(V.verdict()).first()[0] is expected


def test_runs_round_trip(spark):
    values = ["a", "a", None, None, "b", "a"]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, v string")
    runs = islands.run_lengths(df, ["k"], ["i"], "v")
    assert rows(islands.decode_runs(runs, ["k"], "v").select("at", "v")) == sorted(enumerate(values), key=str)
    assert islands.runs_are_partition(runs, ["k"]).first().contiguous
    broken = runs.where("run <> 1")
    assert not islands.runs_are_partition(broken, ["k"]).first().contiguous


def test_lower_half_median(spark):
    random.seed(8)
    values = [random.random() for _ in range(7)]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, None)], "k int, v double")
    assert rows(aggregates.lower_half_median(df, ["k"], "v")) == [(1, median(sorted(values)[:4]))]


def test_mode_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "b", 4), (1, "a", 3)], "k int, v string, o int")
    assert aggregates.weighted_mode(df, ["k"], "v", "o").first().mode == "a"
    assert aggregates.keep_ties(df, ["k"], ["v"]).count() == 2


def test_several_partners_are_no_match(spark):
    pairs = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (4, 3)], "a int, b int")
    assert rows(matching.unique_pairs(pairs, ["a"], ["b"])) == [(1, 1)]
    with pytest.raises(ValueError, match="twice"):
        matching.assert_empty(matching.offenders(pairs, ["a"]), "twice")


def test_residue_of_a_table_with_itself_is_empty(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    assert matching.residue(df, df).isEmpty()
    assert rows(matching.residue(df, df.distinct())) == [(1, "missing")]


def test_tolerant_residue_takes_rows_in_order(spark):
    want = spark.createDataFrame([("k", 0, 1.0), ("k", 1, 1.4), ("k", 2, 9.0)], "k string, o int, v double")
    have = spark.createDataFrame([("k", 0, 1.4), ("k", 1, 1.0), ("x", 5, 0.0)], "k string, o int, v double")
    # the first wanted row takes 1.4, so the second takes 1.0
    assert rows(matching.tolerant_residue(want, have, "k", "v", "o", 0.5)) == [("k", 2, "missing"), ("x", 5, "extra")]


def test_division_needs_all(spark):
    facts = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "g string, i int")
    need = spark.createDataFrame([(1,), (2,)], "i int")
    assert [r.g for r in matching.divide(facts, ["g"], ["i"], need).collect()] == ["a"]


def test_overlap_pairs_against_brute_force(spark):
    random.seed(32)
    spans_ = [(1, i, random.randrange(500), random.randrange(1, 90)) for i in range(80)]
    df = spark.createDataFrame([(k, i, lo, lo + n) for k, i, lo, n in spans_], "k int, id int, lo int, hi int")
    want = sorted((a[1], b[1]) for a in spans_ for b in spans_ if a[1] < b[1] and a[2] < b[2] + b[3] and b[2] < a[2] + a[3])
    assert sorted((r.a, r.b) for r in spans.overlap_pairs(df, ["k"], "id", "lo", "hi", 16).collect()) == want


@pytest.mark.parametrize("a, b, ordered, expected", [((0, 2), (2, 4), False, False), ((0, 3), (2, 4), False, True), ((2, 2), (2, 4), False, True), ((2, 2), (2, 2), True, False), ((5, 5), (2, 4), False, False)])
def test_conflicts(spark, a, b, ordered, expected):
    assert spark.range(1).select(spans.conflicts(*map(F.lit, (*a, *b)), F.lit(ordered))).first()[0] is expected


def test_edits_against_slices(spark):
    random.seed(5)
    text = "añb😀cdefghijklmnop"
    edits = [(1, 2, "X"), (3, 3, "ins"), (5, 9, ""), (len(text), len(text), "!")]
    docs = spark.createDataFrame([(1, text), (2, "same"), (3, None)], "id int, text string")
    rows_ = spark.createDataFrame([(1, *e) for e in edits], "id int, start int, end int, insert string")
    want = text
    for start, end, insert in reversed(edits):
        want = want[:start] + insert + want[end:]
    assert dict(spans.apply_edits(docs, rows_, "id").collect()) == {1: want, 2: "same", 3: None}


def test_range_projection(spark):
    def project(lo, hi, start, end, n, inside=False):
        return tuple(spark.range(1).select(*spans.project_range(*map(F.lit, (lo, hi, start, end, n, inside)))).first())

    assert project(5, 9, 0, 2, 4) == (7, 11, False)
    assert project(5, 9, 6, 7, 0) == (5, 8, False)
    assert project(5, 9, 4, 6, 0) == (None, None, True)
    assert project(5, 9, 9, 9, 3, True)[:2] == (5, 12)
    assert project(5, 9, 9, 9, 3, False)[:2] == (5, 9)


def test_compare_separates_gone_from_not_run(spark):
    base = spark.createDataFrame([("e", "c", 1, "x"), ("e", "c", 2, None), ("e", "d", 1, "x")], "evaluation string, case string, step int, v string")
    now = spark.createDataFrame([("e", "c", 1, "y"), ("e", "c", 3, "x")], "evaluation string, case string, step int, v string")
    got = {(r.case, r.step): r.status for r in records.compare(base, now, records.KEY, ["v"], ("evaluation", "case")).collect()}
    assert got == {("c", 1): "changed", ("c", 2): "only_baseline", ("c", 3): "only_current", ("d", 1): "case_not_run"}
    assert {r.status for r in records.compare(base, base, records.KEY, ["v"], ("evaluation", "case")).collect()} == {"same"}
    assert records.upsert(base, now.limit(0)).count() == 3


def test_chains_and_ancestors(spark):
    links = spark.createDataFrame([(1, i, i + 1) for i in range(1, 12)] + [(1, 20, 21)], "k int, a int, b int")
    assert rows(graph.chains(links, ["k"], "a", "b")) == [(1, 1, 11), (1, 20, 1)]
    assert graph.ancestors(links, "a", "b").where("node = 1").count() == 11
    with pytest.raises(ValueError, match="cycle"):
        graph.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "a int, b int"), "a", "b", 5)


def test_clusters_do_not_depend_on_row_order(spark):
    glyphs = [(1, float(x * 12), 60 + line * 16.8 + (x % 3) * 0.3, 12.0, line * 50 + x) for line in range(4) for x in range(9)]
    found = []
    for seed in (8, 32):
        random.Random(seed).shuffle(glyphs)
        df = spark.createDataFrame(glyphs, "page int, x0 double, y double, size double, ord int")
        found.append({r.ord: r.line for r in sequential.cluster_baselines(df, ["page"]).collect()})
    assert found[0] == found[1] == {line * 50 + x: line for line in range(4) for x in range(9)}


def test_two_columns_are_two_boxes(spark):
    lines = [(1, x, x + 100.0, 60 + i * 16.8, 12.0, int(x) + i) for x in (40.0, 300.0) for i in range(4)] + [(1, 40.0, 90.0, 400.0, 12.0, 999)]
    random.Random(8).shuffle(lines)
    df = spark.createDataFrame(lines, "page int, x0 double, x1 double, y double, size double, ord int")
    assert sorted(r["count"] for r in sequential.group_lines(df, ["page"]).groupBy("box").count().collect()) == [1, 4, 4]


def test_wrapping():
    assert [t for t, _ in sequential.wrap_text("ab cd ef", 30)] == ["ab cd", "ef"]
    assert [t for t, _ in sequential.wrap_text("abcdefgh", 24)] == ["abcd", "efgh"]
    lines = sequential.wrap_text("日本語です。はい", 60)
    assert all(w <= 60 and t[0] not in sequential.NO_START for t, w in lines) and "".join(t for t, _ in lines) == "日本語です。はい"
    assert sequential.wrap_text("", 10) == [("", 0.0)]
    with pytest.raises(ValueError):
        sequential.wrap_text("語", 6)


def test_allocation_keeps_together(spark):
    df = spark.createDataFrame([("f", 0, 3, False), ("f", 1, 2, True), ("f", 2, 5, False)], "f string, o int, n int, keep boolean")
    got = rows(sequential.allocate(df, "f", "o", "n", 4, "keep"))
    assert got == [("f", 0, 0, 0, 3), ("f", 1, 1, 0, 2), ("f", 2, 1, 2, 2), ("f", 2, 2, 0, 3)]


def test_ready_order_takes_the_first_that_can_be_done(spark):
    from leafmark.operators import results

    rng, tasks, needs = random.Random(2), [], []
    for flow in range(4):
        tasks += [(flow, t) for t in range(40)]
        needs += [(flow, t, n) for t in range(40) for n in rng.sample(range(40), rng.randrange(3)) if (n < t or flow == 3) and n != t]
    needs += [(0, 39, 777)]
    want = {}
    for flow in range(4):
        wants, done = {t: {n for f, x, n in needs if f == flow and x == t} for t in range(40)}, []
        while (found := next((t for t in range(40) if t not in done and wants[t] <= set(done)), None)) is not None:
            done.append(found)
        want |= {(flow, t): done.index(t) if t in done else None for t in range(40)}
    got = results.ready_order(spark.createDataFrame(tasks, "flow int, task long"), spark.createDataFrame(needs, "flow int, task long, need long"), ["flow"], "task")
    assert {(r.flow, r.task): r.position for r in got.collect()} == want


def test_deep_chains_and_cycles(spark):
    links = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)] + [(1000, 1001), (1001, 1000), (2000, 1999), (2001, 2000)], "a int, b int")
    got = {r.a: (r.position, r.status) for r in graph.positions(links, [], "a", "b").collect()}
    assert all(got[i] == (i, "ordered") for i in range(300)) and got[1000] == (None, "cycle") and got[2001] == (None, "gap")
    edges = spark.createDataFrame([(i + 1, i) for i in range(140)], "c int, p int")
    counts = {(r.ancestor, r.depth): r.n_descendants for r in graph.descendants(edges, "c", "p").where("ancestor = 0").collect()}
    assert counts == {(0, d): 1 for d in range(1, 141)}
    with pytest.raises(ValueError, match="cycle"):
        graph.descendants(links, "a", "b")


def test_text_functions(spark):
    df = spark.createDataFrame([("aaaa.a", "ﬁ ｘ"), (None, None)], "a string, b string")
    got = df.select(T.occurrences(F.col("a"), F.lit("aa")), T.occurrences(F.col("a"), F.lit(".")), T.nfkc("b"), T.grapheme_starts(F.lit("éx")), T.width(F.lit("aé"))).collect()
    assert tuple(got[0]) == (3, 1, "fix", [0, 2, 3], 18) and got[1][2] is None
    assert df.limit(1).select(T.alignment(F.lit("one two end"), F.lit("one 2 end")).alias("x")).select("x.*").first() == (8, 0, 0, 1)
    joins = [("Hello,", "world", " "), ("日本", "語", ""), ("a", "", ""), ("x ", "y", " ")]
    for left, right, want in joins:
        assert spark.range(1).select(T.separator(F.lit(left), F.lit(right))).first()[0] == want


def test_sinks_never_overwrite(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.check_new(spark, [path], [])
    sinks.write_json(spark.range(2), path)
    with pytest.raises(FileExistsError):
        sinks.check_new(spark, [path], [])
    with pytest.raises(ValueError):
        sinks.check_new(spark, ["a", "a"], [])
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_json(spark.range(2), path)


def test_stream_keeps_the_baseline_current(spark, tmp_path):
    from leafmark.streaming.records import maintain_baseline

    schema = "evaluation string, step int, v int"
    base, source = str(tmp_path / "base"), str(tmp_path / "in")
    spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], schema).write.partitionBy("evaluation").parquet(base)
    spark.createDataFrame([("a", 1, 5)], schema).coalesce(1).write.parquet(source)
    maintain_baseline(spark.readStream.schema(schema).parquet(source), base, str(tmp_path / "state")).awaitTermination()
    assert rows(spark.read.parquet(base).select("evaluation", "step", "v")) == [("a", 1, 5), ("b", 1, 0)]


def test_stream_rows_of_one_run_in_several_batches(spark, tmp_path):
    """The second batch of a run adds to the first; a later run replaces all; a replay changes nothing."""
    from leafmark.streaming.records import maintain_baseline

    schema = "evaluation string, step int, run int, v int"
    base, source = str(tmp_path / "base"), str(tmp_path / "in")
    spark.createDataFrame([("a", 1, 0, 0), ("b", 1, 0, 0)], schema).write.partitionBy("evaluation").parquet(base)
    feed = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    go = lambda: maintain_baseline(spark.readStream.schema(schema).parquet(source), base, str(tmp_path / "state")).awaitTermination()
    read = lambda: rows(spark.read.parquet(base).select("evaluation", "step", "run", "v"))
    feed([("a", 2, 1, 5)])
    go()
    feed([("a", 3, 1, 6), ("a", 2, 1, 5)])
    go()
    assert read() == [("a", 2, 1, 5), ("a", 3, 1, 6), ("b", 1, 0, 0)]
    feed([("a", 7, 2, 9)])
    go()
    assert read() == [("a", 7, 2, 9), ("b", 1, 0, 0)]


def test_sources_of_records_and_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"step": 1, "v": "x"}, {"step": 2, "v": null}]')
    assert rows(tables.json_records(spark, str(tmp_path / "a.json"), "step int, v string")) == [(1, "x"), (2, None)]
    (tmp_path / "b.json").write_text('[{"step": "no number"}]')
    with pytest.raises(Exception):
        tables.json_records(spark, str(tmp_path / "b.json"), "step int, v string").collect()
    for name in ("z/One.TTF", "a/two.otf", "a/three.txt"):
        path = tmp_path / "fonts" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())
    found = tables.faces(spark, str(tmp_path / "fonts")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["two.otf", "One.TTF"] and found[0].length == 9


def test_every_character_is_placed(spark):
    docs = spark.createDataFrame([(1, "ab\n\n日 c")], "doc_id long, text string")
    got = sorted(tuple(r) for r in tables.glyphs(docs).select("line_no", "ord", "ch", "x0", "x1").collect())
    assert got == [(0, 0, "a", 40, 46), (0, 1, "b", 46, 52), (2, 0, "日", 40, 52), (2, 1, " ", 52, 58), (2, 2, "c", 58, 64)]


def test_sinks_write_tables_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, t string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert rows(spark.read.option("header", "true").schema("id int, t string").csv(str(tmp_path / "csv"))) == [(1, "a,b"), (2, None)]


def test_changes_are_appended_and_baselines_are_new(spark, tmp_path):
    log, base = str(tmp_path / "log"), str(tmp_path / "base")
    for reason in ("first", "second"):
        sinks.append_changes(spark.createDataFrame([(1, "x")], "id int, what string"), reason, log)
    assert rows(spark.read.schema("id int, what string, reason string").json(log)) == [(1, "x", "first"), (1, "x", "second")]
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "evaluation string, step int, v int")
    sinks.save_baseline(old, spark.createDataFrame([("a", 2, 5)], old.schema), base)
    assert rows(spark.read.parquet(base)) == [("a", 2, 5), ("b", 1, 0)]


def test_colours_as_rgb(spark):
    from leafmark.functions.geometry import rgb

    cases = {(0.5,): [0.5] * 3, (0.5, 0.0, 0.0, 0.5): [0.0, 0.5, 0.5], (1.0, 0.25, 0.0, 0.0): [0.0, 0.75, 1.0], (0.1, 0.2, 0.3): [0.1, 0.2, 0.3], (0.1, 0.2): [0.1, 0.2], (0.1, 0.2, 0.3, 0.4, 0.5): [0.1, 0.2, 0.3]}
    got = spark.createDataFrame([(list(k),) for k in cases], "c array<double>").select("c", rgb(F.col("c")).alias("r")).collect()
    assert all(r.r == pytest.approx(cases[tuple(r.c)]) for r in got)


def test_sorted_passes_against_all_pairs(spark):
    rng = random.Random(9)
    spans_ = [(k % 3, i, lo, lo + rng.randrange(0, 30), i % 4 == 0) for i, (k, lo) in enumerate((rng.randrange(9), rng.randrange(2000)) for _ in range(150))]
    df = spark.createDataFrame(spans_, "k int, id int, lo long, hi long, o boolean")
    a, b = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    pa, pb = [r for r in spans_ if r[1] % 2 == 0], [r for r in spans_ if r[1] % 2]
    pairs = [(x, y) for x in pa for y in pb if x[0] == y[0]]
    want = {x[1] for x in pa if not any(x[0] == y[0] and x[2] < y[3] and y[2] < x[3] for y in pb)}
    assert {r.id for r in spans.free_of(a, b, ["k"], "lo", "hi").collect()} == want
    gap = lambda x, y: max(y[2] - x[3], x[2] - y[3])
    got = {r.k: (r.n_pairs, r.clearance, r.n_touching) for r in spans.clearance(a, b, ["k"], "lo", "hi", 16).collect()}
    assert got == {k: (len(p), min(gap(*q) for q in p), sum(gap(*q) <= 0 for q in p)) for k in range(3) if (p := [q for q in pairs if q[0][0] == k])}
    near = {(r.id, r.other, r.distance) for r in matching.nearest_along(a, b.withColumnRenamed("id", "other"), ["k"], "id", "lo", "other", "lo").collect()}
    assert near == {(x[1], *min((y[1], abs(y[2] - x[2])) for y in pb if y[0] == x[0] and abs(y[2] - x[2]) == min(abs(z[2] - x[2]) for z in pb if z[0] == x[0]))) for x in pa if any(y[0] == x[0] for y in pb)}
    rects = [(k, float(lo), float(i % 17), float(lo + i % 23), float(i % 17 + i % 5)) for k, i, lo, _, _ in spans_]
    ra, rb = rects[::2][:20], rects[1::2][:15]
    frame = lambda r: spark.createDataFrame(r, "k int, x0 double, y0 double, x1 double, y1 double")
    least = {r.k: r.least_gap for r in spans.rectangle_cover(frame(ra), frame(rb), ["k"], 8.0).collect()}
    away = lambda x, y: max(max(y[1] - x[3], x[1] - y[3]), max(y[2] - x[4], x[2] - y[4]))
    assert least == {k: min(away(x, y) for x in ra for y in rb if x[0] == y[0] == k) for k in {x[0] for x in ra} & {y[0] for y in rb}}


def test_tolerant_matches_against_a_plain_pool(spark):
    rng = random.Random(4)
    want, have = ([(k, i, round(rng.uniform(0, 6), 1)) for k in range(3) for i in range(40)] for _ in range(2))
    out = []
    for k in range(3):
        pool = [(i, v) for x, i, v in have if x == k]
        for _, i, v in (r for r in want if r[0] == k):
            hit = next((p for p in pool if abs(v - p[1]) <= 0.5), None)
            out += [(k, i, "missing")] if hit is None else []
            pool = [p for p in pool if p != hit]
        out += [(k, i, "extra") for i, _ in pool]
    df = lambda r: spark.createDataFrame(r, "k int, o int, v double")
    assert rows(matching.tolerant_residue(df(want), df(have), "k", "v", "o", 0.5)) == sorted(out)


def test_alignment_is_that_of_difflib_on_characters(spark):
    import difflib

    assert spark.range(1).select(T.alignment(F.lit("abcd"), F.lit("abXd")).alias("x")).select("x.*").first() == (3, 0, 0, 1)
    rng = random.Random(5)
    base = "".join(rng.choice("abcde \n") for _ in range(900))
    near = list(base)
    for _ in range(25):
        near[rng.randrange(len(near))] = rng.choice(["", "x", "ab", "日😀"])
    texts = [base, "".join(near), base[300:] + base[:300], base[:40] + "new words " + base[40:-5], "a" * 400, "a" * 350 + "b" + "a" * 90, "", "zzz" * 90]
    pairs = [(a, b) for a in texts for b in texts]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.alignment("a", "b").alias("x")).select("a", "b", "x.*").collect()
    for a, b, *counts in got:
        want = dict.fromkeys(("equal", "delete", "insert", "replace"), 0)
        for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            want[tag] += j - i if tag in ("equal", "delete") else m - k
        assert counts == list(want.values())


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    texts = [" ".join(base), " ".join(base), " ".join(base[:30] + ["added"] + base[30:]), " ".join(base[:50] + base[51:]), " ".join(base[:40]), "One two", "one  TWO", "", "", None]
    texts += [" ".join(w if rng.random() > 0.04 else "edit" for w in base) for _ in range(20)]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    want = []
    for k, t in enumerate(texts):
        if t is not None and texts.index(t) < k:
            want.append((k, texts.index(t)))
        else:
            want += [(k, f) for f in range(k) if sets[k] and texts.index(texts[f]) == f and 100 * len(sets[k] & sets[f]) >= 75 * len(sets[k] | sets[f])]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {(1, 0), (2, 0), (3, 0), (6, 5), (8, 7)} <= set(want)  # lengths differ in most of these
    assert sorted(map(tuple, matching.near_copies(df, "id", "text").collect())) == sorted(want)
