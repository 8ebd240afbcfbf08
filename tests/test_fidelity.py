"""What an edit kept against a plain loop, and publication that fails at each step."""

import difflib
import random

import pytest

from leafmark.operators import fidelity
from leafmark.sources import sinks

GLYPH = "key long, ord int, ch string, x double, y double, style string, line int"


def page(rng, key, text):
    x, y, line, out = 40.0, 60.0, 0, []
    for i, ch in enumerate(text):
        if rng.random() < 0.1:
            x, y, line = 40.0, y + 14, line + 1
        out.append((key, i, ch, x, y, rng.choice("aaab"), line))
        x += 6
    return out


def cases(seed):
    rng = random.Random(seed)
    before, after, edits = [], [], []
    for key in range(40):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60)))
        start = rng.randrange(len(text) + 1)
        end = min(len(text), start + rng.randrange(6))
        other = text[:start] + "".join(rng.choice("abcx") for _ in range(rng.randrange(5))) + text[end:]
        own = page(rng, key, text)
        before += own
        if key % 7:
            state = rng.getstate()
            moved = page(rng, key, other)
            rng.setstate(state)
            after += [(k, i, ch, own[i][3] if i < start and key % 2 else x, own[i][4] if i < start and key % 2 else y, s, line) for k, i, ch, x, y, s, line in moved]
        if key % 3:
            edits.append((key, start, end))
    return before, after, edits


def plain(before, after, edits, key):
    a, b = [g for g in before if g[0] == key], [g for g in after if g[0] == key]
    span = next(((s, e) for k, s, e in edits if k == key), None)
    blocks = difflib.SequenceMatcher(None, "".join(g[2] for g in a), "".join(g[2] for g in b), autojunk=False).get_matching_blocks()
    pairs = [(i + k, j + k) for i, j, n in blocks for k in range(n)]
    deltas = [max(abs(a[i][3] - b[j][3]), abs(a[i][4] - b[j][4])) for i, j in pairs]
    early = [d for (i, _), d in zip(pairs, deltas, strict=True) if span and i < span[0]]
    outside = [i for i in range(1, len(a)) if a[i][6] != a[i - 1][6] and (not span or not span[0] < i <= span[1])]
    index, used = dict(pairs), {j for _, j in pairs}
    kept = sum(1 for i in outside if i in index and index[i] > 0 and index[i] - 1 in used and b[index[i]][6] != b[index[i] - 1][6])
    fits = sum(d <= 0.01 for d in deltas)
    return (len(a), len(pairs), fits, len(pairs) - fits, sum(a[i][5] != b[j][5] for i, j in pairs), len(early), sum(d <= 0.01 for d in early), round(max(deltas), 3) if deltas else None, len(outside), kept, len(b))


def test_fidelity_against_a_plain_loop(spark):
    before, after, edits = cases(1)
    found = fidelity.fidelity(spark.createDataFrame(before, GLYPH).repartition(3), spark.createDataFrame(after, GLYPH), spark.createDataFrame(edits, "key long, start int, end int"))
    got = {r.key: tuple(r)[1:] for r in found.collect()}
    keys = {g[0] for g in before}
    assert got == {k: plain(before, after, edits, k) for k in keys}
    assert sum(v[9] for v in got.values()) > 5 and sum(v[2] for v in got.values()) > 50


def test_changed_runs_are_the_opcodes(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randrange(12))), "".join(rng.choice("abc") for _ in range(rng.randrange(12)))) for i in range(80)] + [(90, None, "x"), (91, "same", "same"), (92, None, None)]
    got = {}
    for r in fidelity.changed_runs(spark.createDataFrame(rows, "key long, before string, after string")).collect():
        got.setdefault(r.key, set()).add((r.start, r.end, r.new_start, r.new_end))
    for key, a, b in rows:
        ops = difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).get_opcodes()
        assert got.get(key, set()) == {o[1:] for o in ops if o[0] != "equal"}


def test_bundles_are_published_whole(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    found = sinks.publish(spark, f"{tmp_path}/bundle", {"page.bin": b"\x00\x01", "side.json": b"{}", "rows": table})
    assert (tmp_path / "bundle" / "page.bin").read_bytes() == b"\x00\x01" and spark.read.parquet(f"{tmp_path}/bundle/rows").count() == 2
    assert {n.split("/")[0] for n in found} == {"page.bin", "side.json", "rows"}
    with pytest.raises(FileExistsError):
        sinks.publish(spark, f"{tmp_path}/bundle", {"page.bin": b"other"})
    for wrong in ({}, {"_hidden": b""}, {"../out": b""}):
        with pytest.raises(ValueError):
            sinks.publish(spark, f"{tmp_path}/other", wrong)
    assert [p.name for p in tmp_path.iterdir()] == ["bundle"]


@pytest.mark.parametrize("step", ["write", "staged", "rename", "published"])
def test_a_failure_at_any_step_publishes_nothing(spark, tmp_path, monkeypatch, step):
    files, read = {"a.bin": b"aa", "b.bin": b"bb"}, sinks._files
    if step == "write":
        bad = spark.range(3).selectExpr("assert_true(id < 0) v")
        files["rows"] = bad
    elif step == "staged":
        monkeypatch.setattr(sinks, "_files", lambda s, f: {"a.bin": "wrong", "b.bin": "wrong"})
    elif step == "rename":
        def taken(s, f):
            (tmp_path / "bundle").mkdir()
            (tmp_path / "bundle" / "theirs").write_text("kept")
            return read(s, f)
        monkeypatch.setattr(sinks, "_files", taken)
    else:
        monkeypatch.setattr(sinks, "_files", lambda s, f: read(s, f) if "staged" in f else {})
    with pytest.raises(Exception):  # noqa: B017
        sinks.publish(spark, f"{tmp_path}/bundle", files)
    left = [p.name for p in tmp_path.iterdir()]
    assert left == (["bundle"] if step == "rename" else [])
    if step == "rename":
        assert [p.name for p in (tmp_path / "bundle").iterdir()] == ["theirs"]
