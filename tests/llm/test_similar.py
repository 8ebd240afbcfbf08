"""Jaccard join and substring dedup against brute force."""

import hashlib
import random

import fixtures as fx
import numpy as np
import pytest

from leafmark.llm import exchange as ex
from leafmark.llm import components as joins
from leafmark.llm import jaccard, substrings
from leafmark.llm.components import components
from leafmark.llm.words import ALNUM, PLAIN, Words


def shingles(text):
    w = fx.plain(fx.lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    ids = sorted({i for i, _ in sets if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if None not in (i, j) and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def joined(df):
    return sorted((tuple(r) for r in jaccard.join(df).collect()), key=str)


def test_join_on_hard_cases(spark):
    assert joined(fx.docs(spark, clash=True)) == brute_components(fx.rows())


def test_join_of_nothing(spark):
    assert jaccard.join(fx.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_join_near_the_threshold(spark, seed):
    """Sets of few common words around 75 hundredths, so that groups, prefixes and bounds all matter."""
    rng, rows = random.Random(seed), []
    for c in range(12):
        base = [f"c{c}w{k}" for k in range(60)]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(60)] = f"x{rng.randrange(5)}"
            rows.append((len(rows), " ".join(w[rng.randrange(8) : 60 - rng.randrange(8)])))
    rng.shuffle(rows)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


def test_join_where_an_id_has_two_texts(spark):
    """Both texts stand for their copies; what either links with is in the id's component."""
    long, short = fx.words(31, 90, 9000), fx.words(32, 25, 9000)
    rows = [(1, " ".join(long)), (1, " ".join(short)), (2, " ".join(long)), (3, " ".join(short)), (4, " ".join([*long[:70], "x", *long[71:]])), (5, " ".join([*short, "y"])), (6, None), (1, None)]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, n): 6 if i == 6 else 1 for i, n in got} and len(got) == 8


def test_join_of_similar_texts_that_do_not_link(spark):
    """Many texts around one passage, which few of them share enough of."""
    rng, passage = random.Random(7), fx.words(41, 60, 9000)
    rows = [(k, " ".join(passage[: rng.randrange(40, 60)] + [f"own{k}_{j}" for j in range(rng.randrange(3, 30))])) for k in range(60)]
    rows += [(k + 100, text + f" end{k % 2}") for k, text in rows[::3]]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


@pytest.mark.parametrize("rounds", [1, 8])
def test_join_leaves_what_rounds_of_pivots_miss_to_the_matrix(spark, monkeypatch, rounds):
    """Groups of a few tokens, tasks of a few classes and shuffle joins, so that every split is used."""
    monkeypatch.setattr(joins, "SMALL", 0)
    for name, value in (("ROUNDS", rounds), ("GROUP", 120), ("QUERIES", 3), ("MEETINGS", 4), ("BROADCAST", 0)):
        monkeypatch.setattr(jaccard, name, value)
    rng, rows = random.Random(3), []
    for c in range(4):
        base = [f"c{c}w{k}" for k in range(50)]
        rows += [(100 * c + j, " ".join(f"x{rng.randrange(4)}" if rng.random() < 0.03 else w for w in base)) for j in range(20)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


def test_join_finds_all_links_of_a_whole_table(spark):
    """Every link between any two documents of sf0.01, by an inverted list of all shingles."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets, holders, parent = {i: shingles(t) for i, t in rows}, {}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in sets.items():
        shared = {}
        for g in own:
            for j in holders.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            holders[g].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    want = {(i, len(own), find(i)) for i, own in sets.items()}
    got = joined(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert set(got) == want and len(got) == len(rows) and any(c != i for i, _, c in got)


@pytest.mark.parametrize("small", [100_000, 0])
def test_components_of_a_star(spark, monkeypatch, small):
    """A node of most edges is split off before the joins."""
    monkeypatch.setattr(joins, "SMALL", small)
    edges = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(300 + i, i) for i in range(1, 300, 7)], "u long, v long")
    assert {r.root for r in components(edges).collect()} == {0}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    assert {r.node: r.root for r in components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_substrings(rows, length):
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    seen, out = set(), []
    for doc_id, text, *_ in ordered:
        w = fx.plain(text)
        gone = set()
        for i in range(len(w) - length + 1):
            if tuple(w[i : i + length]) in seen:
                gone.update(range(i, i + length))
            seen.add(tuple(w[i : i + length]))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("cells", [4, 0])
def test_substrings_against_brute_force(spark, cells):
    """Also where the sketch is so small that most windows are estimated repeated."""
    rows = [r for r in fx.rows() if r[0] is not None]
    got = substrings.dedup(fx.docs(spark, clash=True).where("doc_id is not null"), cells_per_window=cells)
    assert sorted(map(tuple, got.collect()), key=str) == brute_substrings(rows, 20)


def test_substrings_of_rows_without_id_and_of_nothing(spark):
    got = substrings.dedup(fx.docs(spark))
    assert got.count() == len(fx.rows()) and got.where("doc_id is null and n_removed = n_words and n_words > 0").count() == 1
    assert substrings.dedup(fx.empty(spark)).count() == 0


def test_rows_without_id_are_in_the_order_of_their_texts_at_every_size(spark):
    repeated = [(None, " ".join(fx.words(50, 60, 9000) + [w])) for w in ("b", "a", "c")] + [(None, "few"), (7, "some words")]
    filler = [(k, " ".join(fx.words(k, 4000, 90000))) for k in range(100, 140)]
    for rows in (repeated, repeated + filler):
        got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(map(tuple, got.collect()), key=str) == brute_substrings(rows, 20)


def _scaled(spark, n):
    return spark.createDataFrame([(k, " ".join(fx.words(k, 1500, 3000))) for k in range(n)], "doc_id long, text string")


def test_a_deep_tree_answers_like_a_flat_one(spark, monkeypatch):
    from leafmark.llm import lmscore

    docs = _scaled(spark, 60).unionAll(fx.docs(spark).where("doc_id is not null").select("doc_id", "text"))
    targets = docs.where("doc_id % 3 = 0").select("doc_id")
    run = lambda: [sorted((str(r) for r in df.collect()), key=str) for df in (substrings.dedup(docs), jaccard.join(docs), lmscore.score(docs, targets))]
    flat = run()
    monkeypatch.setattr(ex, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(ex, "FANOUT", 3)
    assert ex.plan_chunks(docs).levels >= 3
    assert run() == flat


def test_pieces_grow_as_the_corpus(spark, monkeypatch):
    """Rows between chunks and blocks over sizes four times the one before: in proportion to the chunks, at each level."""
    monkeypatch.setattr(ex, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(ex, "FANOUT", 6)
    sent, resolve = [], ex.Reduction.resolve

    def counted(self, asked, plan, level=1):
        sent.append((level, asked.count()))
        return resolve(self, asked, plan, level)

    monkeypatch.setattr(ex.Reduction, "resolve", counted)
    for n in (25, 100, 400):
        docs, chunks = _scaled(spark, n), None
        chunks = ex.plan_chunks(docs).chunks
        sent.clear()
        substrings.dedup(docs)
        assert {level for level, _ in sent} == set(range(1, ex.plan_chunks(docs).levels + 1))
        for level, rows in sent:
            nodes = ex.plan_chunks(docs).fan ** (level - 1) * -(-chunks // ex.plan_chunks(docs).fan ** (level - 1))  # a level's nodes
            assert rows <= nodes * ex.FANOUT <= 2 * chunks * ex.FANOUT


def test_packed_values_come_back():
    rng = np.random.default_rng(5)
    for n in (0, 1, 1000):
        for top in (2, 1 << 20, 1 << 63):
            values = rng.integers(0, top, n, dtype=np.uint64)
            assert (ex.unpack(ex.pack(values), n) == values).all()
            assert (ex.unpack(ex.pack(np.sort(values), True), n, True) == np.sort(values)).all()
        bits = rng.random(n) < 0.3
        assert (ex.unpack_bits(ex.pack_bits(bits), n) == bits).all()


def test_words_of_bytes():
    texts = ["a\x1fb c d e\x0bF", None, "", "  Z-9é_x  ", "y" * 700 + " q"]
    raw = [None if t is None else t.encode() for t in texts]
    words, letters = Words(raw, PLAIN), Words(raw, ALNUM)
    for i, t in enumerate(texts):
        assert [w.decode() for w in words.of(i)] == fx.plain(t)
        assert words.first[i + 1] - words.first[i] == len(fx.plain(t))
    assert [w.decode() for w in letters.of(3)] == ["z", "9é", "x"]
    hashes = words.hashes()
    assert len(set(hashes.tolist())) == len({w for i in range(len(texts)) for w in words.of(i)})
