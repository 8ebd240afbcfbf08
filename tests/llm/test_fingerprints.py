"""One-permutation MinHash against plain sets, and the edits of neighbours against plain slices."""

import hashlib
import random

import fixtures as fx
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmark.llm import fingerprints as fp
from leafmark.llm.words import LOWER, Words, mix, window_hashes, window_hashes_at


def shingles(text) -> set:
    words = fx.plain(fx.lower(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def jaccard(a, b) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def slow(text: str) -> list[int] | None:
    """The stored bits, bin by bin."""
    words = Words([text.encode()], LOWER)
    ids, full = words.hashes(0), {}
    if not len(ids):
        return None
    hashes = window_hashes(ids, 5) if len(ids) >= 5 else window_hashes_at(ids, np.array([0]), len(ids))
    for h in hashes.tolist():
        b, v = h >> 55, h & ((1 << 55) - 1)
        full[b] = min(v, full.get(b, v))
    order = fp._order(512)
    own = np.array([full[b if b in full else next(int(o) for o in order[b] if int(o) in full)] for b in range(512)], np.uint64)
    return (mix(own + mix(np.arange(1, 513, dtype=np.uint64))) & np.uint64(15)).tolist()


def texts() -> list[str]:
    rng = random.Random(4)
    base = fx.words(1, 400, 100000)
    out = ["", " \t", "one", "One", "a b c", "日本 語の　文 ñandú x y", " ".join(base), " ".join(base[:300] + fx.words(9, 100, 100000)), " ".join(fx.words(3, 3000, 100000))]
    return out + [" ".join(fx.words(100 + i, rng.randrange(1, 60), 50)) for i in range(40)]


def test_bits_against_a_plain_loop(spark):
    own = texts()
    low, some = fp.low_bits([t.encode() for t in own])
    for t, row, has in zip(own, low, some, strict=True):
        want = slow(t)
        assert has == (want is not None) and (want is None or row.tolist() == want)


def test_pieces_of_a_long_text_give_the_same(monkeypatch):
    text = (" ".join(fx.words(5, 4000, 9000)) + "\n\n " + "x" * 700 + " end").encode()
    want = fp.bins([text])
    monkeypatch.setattr(fp, "PIECE", 300)
    assert (fp.bins([b"short one", text])[1] == want[0]).all()
    few = b"a" * 2000 + b" " + b"b" * 2000
    got = fp.bins([few])
    monkeypatch.setattr(fp, "PIECE", 1 << 20)
    assert (got == fp.bins([few])).all()


def test_likeness_comes_near_jaccard(spark):
    rng = random.Random(8)
    pairs = []
    for k in range(60):
        base = fx.words(200 + k, rng.choice([40, 200, 1500]), 10**6)
        cut = rng.randrange(len(base))
        pairs.append((" ".join(base), " ".join(base[:cut] + fx.words(900 + k, len(base) - cut, 10**6))))
    df = spark.createDataFrame(pairs, "a string, b string").select("*", fp.fingerprint("a").alias("x"), fp.fingerprint("b").alias("y"))
    off = [r.likeness - jaccard(r.a, r.b) for r in df.select("*", fp.likeness("x", "y").alias("likeness")).collect()]
    assert max(map(abs, off)) < 0.12 and abs(sum(off)) / len(off) < 0.02


def edges(spark):
    pairs = [("", ""), ("", "ab"), (None, "ab")]
    return [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(fp.likeness("a", F.when(F.col("b") == "", "").otherwise(fp.fingerprint("b")))).collect()]


def test_likeness_of_empty_fingerprints(spark):
    assert edges(spark) == [1.0, 0.0, None]


def rows() -> list[tuple]:
    own = [(i * 7 % 101 - 20, t) for i, t in enumerate(texts() * 2)]
    return [*own, (None, "no id, but words of its own here"), (None, None), (500, None), (501, "x"), (502, "ab" * 5), (503, "ñ日本" * 50), *[(600, "all of these rows are equal to each other")] * 30]


def plain(rows):
    own = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for i, (d, t) in enumerate(own):
        following = own[(i + 1) % len(own)][1]
        m = len(t) // 4
        edited = t[: len(t) - m] + following[:m]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, following))
    return out


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("hot", [False, True])
def test_edits_against_plain_slices(spark, monkeypatch, parts, hot):
    """Distinct ids but for equal rows: the order of all others is given."""
    base = {d: t for d, t in rows() if d is not None}
    own = [*base.items(), *[(600, base[600])] * 9, (None, "no id, but words of its own here")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    if hot:
        monkeypatch.setattr(fp, "max", lambda a, b: 2 if a == 1000 else max(a, b), raising=False)
    try:
        df = spark.createDataFrame(own, "doc_id long, text string").repartition(5).withColumn("part", F.lit("clash")).withColumn("h", F.lit(1))
        got = fp.edits(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain(own)
    assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == sorted(str(w[:3]) for w in want)
    by = {}
    for w in want:
        by.setdefault((w[0], w[2]), w)
    for r in got:
        _, _, _, t, edited, following = by[(r.doc_id, r.edited_sha256)]
        assert (r.fingerprint == r.edited_fingerprint) if t == edited else True
        assert abs(r.near_edited - jaccard(t, edited)) < 0.16
        assert 0 <= r.near_next <= 1 and (t == following or r.doc_id == 600 or abs(r.near_next - jaccard(t, following)) < 0.16)
    assert len({r.fingerprint for r in got}) <= len({x for _, x in own})


def test_rows_of_one_id_and_empty_tables(spark):
    own = rows()
    got = fp.edits(spark.createDataFrame(own, "doc_id long, text string")).collect()
    assert len(got) == len(own) and sorted(r.n_chars for r in got) == sorted(len(t or "") for _, t in own)
    assert fp.edits(fx.empty(spark)).count() == 0
    one = fp.edits(spark.createDataFrame([(1, "only one text of words here")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
