"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from leafmark.llm import variants


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near(words: dict[str, int]) -> dict:
    out = {}
    for w in words:
        others = [v for v in words if one_edit(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        out[w] = (words[w], len(others), words.get(best), best)
    return out


def counted(rows) -> dict[str, int]:
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def plain(rows):
    found = near(counted(rows))
    form = {w: best for w, (n, _, m, best) in found.items() if m is not None and m >= 10 * n}
    out = []
    for w, (n, k, m, _) in found.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, k, m if w in form else None))
    return sorted(out)


def tangle(seed: int, letters: str = "ab") -> dict[str, int]:
    """Words of few letters, so that runs, prefixes and suffixes are shared by many."""
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.choice([7, 7, 8, 8, 9, 12]))) for _ in range(700)}
    words |= {"a" * k for k in range(7, 14)} | {"a" * k + "b" for k in range(6, 12)} | {"b" + "a" * k for k in range(6, 12)}
    return {w: rng.choice([2, 3, 30, 400]) for w in words}


@pytest.mark.parametrize("most", [65_536, 40, 3])
@pytest.mark.parametrize("letters", ["ab", "aéÿz"])
def test_near_words_against_all_pairs(spark, monkeypatch, most, letters):
    """Tries whole, and cut deeper where more than so many words share a prefix."""
    monkeypatch.setattr(variants, "SMALL_TRIE", most)
    words = tangle(1, letters)
    got = variants.near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r.word: tuple(r)[1:] for r in got} == near(words)


def texts() -> list[tuple]:
    rng = random.Random(5)
    pool = ["".join(rng.choice("aeioulnrstéÀ") for _ in range(rng.randrange(5, 14))) for _ in range(60)]
    rows = [(i if i % 50 else None, " ".join(rng.choice(pool[: 1 + i % 60]).title() for _ in range(120))) for i in range(160)]
    return [*rows, (7, None), (8, ""), (9, "12 3- ab×cdefg÷hij " * 3), (10, "z" * 5000 + " " + "z" * 5000 + " " + "z" * 4999 + " " + "z" * 4999)]


def test_groups_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted(map(tuple, variants.group(df).collect()), key=lambda r: r[0])
    want = plain(rows)
    assert got == want and any(r[1] for r in want) and any(r[4] > 3 for r in want)


def test_whole_small_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    found = counted(rows)
    got = variants.group(spark.read.parquet(f"{small}/documents.parquet")).collect()
    assert {r.word: r.n for r in got} == found
    sample = {w: found[w] for w in sorted(found, key=lambda w: zlib.crc32(w.encode()))[:150]}
    by = {r.word: r for r in got}
    for w, n in sample.items():
        others = [v for v in found if abs(len(v) - len(w)) < 2 and one_edit(w, v)]
        assert by[w].n_near == len(others)
        best = min(others, key=lambda v: (-found[v], v), default=None)
        assert by[w].form == (best if best and found[best] >= 10 * n else None)


def test_chains_are_followed_to_the_last(spark):
    rng = random.Random(2)
    form = {f"w{i}": f"w{rng.randrange(i + 1, min(i + 9, 200))}" for i in range(199)}
    got = {r.word: r.root for r in variants.follow(spark.createDataFrame(list(form.items()), "word string, root string")).collect()}
    assert got == {w: "w199" for w in form}


def test_empty_tables(spark):
    assert variants.group(fx.empty(spark)).count() == 0
    assert variants.group(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).count() == 0
