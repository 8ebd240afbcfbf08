"""Mixing, quality rules and line dedup: built-in functions only."""

import random
import re
from collections import Counter, defaultdict

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from leafmark.llm import components, lines, mixing, quality


def test_targets_stop_at_the_cap_and_share_the_rest(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000, "d": 5, None: 300}
    sized = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    weights = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    want, full = {}, set()
    while True:  # the rule as it is told: reshare until none is above
        rest = sum(sizes.values()) - sum(3 * sizes[k] for k in full)
        want = {k: 3 * sizes[k] if k in full else rest * weights[k] / sum(w for s, w in weights.items() if s not in full) for k in sizes}
        above = {k for k in sizes if want[k] > 3 * sizes[k] + 1e-9}
        if not above:
            break
        full |= above
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_emits_what_the_plan_says_and_reruns_agree(spark):
    docs = fx.docs(spark, clash=True)
    plan = mixing.plan(docs)
    rows = plan.select("doc_id", "text", "source", "size", "source_size", "target", "copies").collect()
    assert len(rows) == docs.count()
    assert all(r["size"] == len(fx.plain(r.text)) and r["size"] * r.copies <= 3 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan(docs.repartition(3)).select("doc_id", "text", "source", "size", "source_size", "target", "copies").collect()))
    mixed = mixing.mix(fx.docs(spark))
    assert mixed.columns == [*fx.docs(spark).columns, "copy"]
    assert mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(fx.empty(spark)).count() == 0


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 30 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    for r in mixing.plan(docs).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.06)


def test_sources_too_many_to_broadcast_are_joined_alike(spark, monkeypatch):
    docs = fx.docs(spark)
    want = sorted(map(str, mixing.plan(docs).select("doc_id", "copies", "target").collect()))
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    monkeypatch.setattr(components, "SMALL", 0)
    assert sorted(map(str, mixing.plan(docs).select("doc_id", "copies", "target").collect())) == want


def measured(text):
    words = fx.plain(text)
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    covered = {p for at in places.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    own = [x for x in (text or "").split("\n") if fx.plain(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(own) - len(set(own)), len(covered)


def test_measures_against_brute_force(spark):
    judged = quality.judge(fx.docs(spark, clash=True)).collect()
    assert len(judged) == len(fx.rows())
    for r in judged:
        want = measured(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept is False or not r.base_failed
    assert quality.judge(fx.empty(spark)).count() == 0


def test_quality_plan_is_one_stage_without_python(spark):
    plan = quality.judge(fx.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_rules_judge_their_ratio(spark):
    good = "The house is in the old town and it was built by the people of that place for their families to live in it all year."
    texts = [good, good.upper(), good.replace(" ", "## "), " ".join(["qqqq"] + [f"zz{i}" for i in range(30)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert got[0].kept and not got[1].rule_upper_case and not got[2].rule_symbols and not got[3].rule_stop_words


def brute_lines(rows, ratio, least):
    pages, seen = Counter(), Counter()
    for host, own in rows:
        pages[host or ""] += 1
        seen.update({(host or "", x.strip(" \t\x0b\x0c\r")) for x in own or [] if x.strip(" \t\x0b\x0c\r")})
    gone = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return [[x for x in own or [] if (host or "", x.strip(" \t\x0b\x0c\r")) not in gone] for host, own in rows]


@pytest.mark.parametrize("most", [500_000, 0])
def test_line_dedup_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(lines, "BROADCAST", most)
    monkeypatch.setattr(components, "SMALL", most)
    rng = random.Random(3)
    rows = [(i, rng.choice(["h1", "h1", "h1", "h2", None]), None if i % 17 == 0 else "\n".join(rng.choice(["menu", " menu ", "foot", "", "rare"]) if rng.random() < 0.4 else f"line{i}-{k}" for k in range(6))) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, host string, text string").withColumn("_lines", F.lit(1)).withColumn("n_lines", F.lit("x"))
    got = {r.id: r for r in lines.dedup(df, F.col("host"), F.split("text", "\n"), 0.1, 4).collect()}
    want = brute_lines([(h, t.split("\n") if t is not None else []) for _, h, t in rows], 0.1, 4)
    for (i, _, _), kept in zip(rows, want, strict=True):
        assert got[i].kept_lines == kept
    assert any(r.n_dropped for r in got.values())


@pytest.mark.parametrize("once", [False, True])
def test_lines_of_a_hot_host_and_of_copies(spark, monkeypatch, once):
    """A host with most rows, lines in most of them, shuffle joins; copies count once where asked."""
    monkeypatch.setattr(lines, "BROADCAST", 0)
    monkeypatch.setattr(components, "SMALL", 0)
    texts = [f"menu\n  foot\nown {i}\n\nmenu" for i in range(60)] + ["copy one\ncopy two"] * 30
    rows = [(i, "big", t) for i, t in enumerate(texts)]
    got = {r.id: r for r in lines.dedup(spark.createDataFrame(rows, "id long, host string, text string"), F.col("host"), F.split("text", "\n"), once=once).collect()}
    assert all((got[i].kept_lines, got[i].n_lines, got[i].n_dropped) == ([f"own {i}", ""], 4, 3) for i in range(60))
    assert all(got[i].kept_lines == (["copy one", "copy two"] if once else []) for i in range(60, 90))


def test_a_row_of_very_many_lines(spark):
    """The work is in proportion to the lines: 200,000 of them, half of which go."""
    import time

    text = "\n".join(f"line {i % 150_000}" if i % 2 else f"shared {i}" for i in range(200_000))
    rows = [(1, "h", text), (2, "h", "\n".join(f"shared {i}" for i in range(0, 200_000, 2))), (3, "h", None), (4, "h", "")]
    began = time.time()
    got = {r.id: r for r in lines.dedup(spark.createDataFrame(rows, "id long, host string, text string"), F.col("host"), F.split("text", "\n")).collect()}
    assert time.time() - began < 60
    assert got[1].kept_lines == [x for x in text.split("\n") if x.startswith("line")] and got[1].n_dropped == 100_000
    assert got[2].kept_lines == [] and got[3].kept_lines == [] and (got[4].kept_lines, got[4].n_lines) == ([""], 0)


def test_lines_over_the_ratio_go_from_small_hosts_too(spark):
    """Two or three pages of fifteen are over a tenth; one page of five is no repetition."""
    rows = [(i, "big", f"own {i}\nfooter" if i < 3 else f"own {i}\nmenu" if i < 5 else f"own {i}") for i in range(15)] + [(20 + i, "small", f"alone {i}") for i in range(5)]
    got = lines.dedup(spark.createDataFrame(rows, "id long, host string, text string"), F.col("host"), F.split("text", "\n")).collect()
    assert {r.id: r.kept_lines for r in got} == {i: [t.split("\n")[0]] for i, _, t in rows}
    assert sum(r.n_dropped for r in got) == 5


def test_hosts_and_visible_lines(spark):
    urls = {"http://User@Ex.COM:80/a?b": "ex.com", "https://[::1]/x": "[::1]", "nothing": None, None: None, "ftp://a.b./": "a.b"}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", lines.host_of(F.col("u")).alias("h"))
    assert {r.u: r.h for r in df.collect()} == urls
    html = "<html><title>T</title><script>var a='<p>';</script><body><p>One <b>two</b><br>three</p><!-- x --><li>four"
    assert spark.range(1).select(lines.html_lines(F.lit(html))).first()[0] == ["T", "One two", "three", "four"]


def visible(html: str) -> list[str]:
    """The visible lines by the rule as it is told."""
    text = re.sub(r"(?s)<!--.*?-->|<((?i:script|style))\b.*?</(?i:\1)\s*>", " ", html)
    block = r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|td|th|table|nav|article|section|header|footer|title|head|body|html|blockquote|pre|hr)\b[^>]*>|\n"
    squeezed = (re.sub(r"[\x20\x09\x0B-\x0D]+", " ", re.sub("<[^>]*>", "", x)).strip(" ") for x in re.split(block, text))
    return [x for x in squeezed if x]


def test_visible_lines_of_marks_that_nothing_closes(spark):
    rng = random.Random(6)
    bits = ["<!--", "-->", "<script", "<SCRIPT>", "</script>", "</Script >", "<style>", "</style", "</style>", "<", ">", "<p>", "<b", "</b>", "\n", " ", "text", "\ufdd0", "\ufdd01", "<!-->", "<!--->", "<scripty>", "x", "y" * 600]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string").select("id", lines.html_lines(F.col("html")).alias("own"))
    assert {r.id: r.own for r in df.collect()} == {i: visible(p) for i, p in enumerate(pages)}


@pytest.mark.parametrize("unit", ["<!-- x", "<script>x", "<style x", "<p ", "<b", "</script ", "<!-- a --> b"])
def test_work_is_in_proportion_to_a_page(spark, unit):
    """Ten times as many unclosed marks take ten times as long at most, and not a hundred times."""
    import time

    def seconds(n):
        began = time.time()
        df = spark.range(1).select(F.repeat(F.concat(F.lit(unit), F.substring(F.col("id").cast("string"), 2, 1)), n).alias("h"))
        assert df.select(F.size(lines.html_lines(F.col("h")))).first()[0] >= 0
        return time.time() - began

    seconds(1000)
    assert seconds(160_000) < 12 * max(seconds(16_000), 0.3)
