"""Allocation of lines to regions and normal forms, held against plain Python."""

import random
import unicodedata

from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.operators import sequential


def plain_allocation(paragraphs, capacity):
    """Line by line: each takes the next free line of the regions."""
    out, free = [], 0
    for order, n, keep in paragraphs:
        n, room = n or 0, capacity - free % capacity
        if keep and room < n <= capacity and free % capacity:
            free += room
        for _ in range(n):
            out.append((order, free // capacity, free % capacity))
            free += 1
    fragments = {}
    for order, region, line in out:
        first, n = fragments.get((order, region), (line, 0))
        fragments[order, region] = first, n + 1
    return sorted((order, region, first, n) for (order, region), (first, n) in fragments.items())


def test_allocation_against_line_by_line(spark):
    rng = random.Random(1)
    flows = {k: [(i, rng.choice([1, 1, 2, 3, 5, 7, 12, 40, 0, None]), rng.random() < 0.4) for i in range(rng.randrange(1, 40))] for k in range(25)}
    rows = [(k, *p) for k, own in flows.items() for p in own]
    rng.shuffle(rows)
    found = sequential.allocate(spark.createDataFrame(rows, "flow int, ord int, n int, keep boolean").repartition(3), "flow", "ord", "n", 12, "keep")
    got = {}
    for r in found.collect():
        got.setdefault(r.flow, []).append((r.ordinal, r.region, r.first_line, r.n_lines))
    for k, own in flows.items():
        assert sorted(got.get(k, [])) == plain_allocation(own, 12)


def test_normal_forms_and_clusters(spark):
    import regex

    rng = random.Random(2)
    pool = ["ｆ", "ﬁ", "é", "é", "가", "각", " ", "　", "\t", "👨‍👩‍👧", "🇩🇪", "①", "㎏", "\r\n", "a", "ß", "ำ", "क्षि"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 30))) for _ in range(200)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.nfkc("t").alias("n"), T.grapheme_starts("t").alias("g"))
    for r in rows.collect():
        t = texts[r.i]
        if t is None:
            assert r.n is None and r.g is None
            continue
        assert r.n == "".join(c for c in unicodedata.normalize("NFKC", t) if not c.isspace())
        assert r.g == [0, *[sum(map(len, regex.findall(r"\X", t)[: k + 1])) for k in range(len(regex.findall(r"\X", t)))]]
    assert rows.where(F.col("n") != "").count() > 100
