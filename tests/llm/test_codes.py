"""Vector codes against plain k-means on integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmark.llm import codes, components

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n: int = 300, width: int = 32) -> list[tuple]:
    rng = random.Random(7)
    middles = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(9)]
    rows = [(i * 3 % 1000, [float(np.float32(m + rng.gauss(0, 0.2))) for m in rng.choice(middles)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [rows[0], (5, rows[1][1], 1), (None, rows[2][1], 1)]  # a repeated row, a repeated vector, no id
    return [*rows, (1001, None, 1), (1002, [0.5, None] * (width // 2), 1), (1003, [math.nan] + [0.0] * (width - 1), 2), (1004, [math.inf] * width, 2), (-7, [0.0] * width, None), (-6, [0.0] * width, None)]


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, j: v[j * width : (j + 1) * width]
    books = [[cut(v, j) for _, v, _ in kept[:entries]] for j in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda j, x: min((square(x, e), i) for i, e in enumerate(books[j]))
    for _ in range(rounds):
        owned = [[[] for _ in b] for b in books]
        for _, v, _ in kept:
            for j in range(parts):
                owned[j][nearest(j, cut(v, j))[1]].append(cut(v, j))
        books = [[[sum(c) // len(o) for c in zip(*o, strict=True)] if o else e for o, e in zip(owned[j], books[j], strict=True)] for j in range(parts)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = [(i, [nearest(j, cut(v, j)) for j in range(parts)], label) for i, v, label in kept]
    totals = {}
    for _, found, label in coded:
        totals[label] = totals.get(label, 0) + sum(d for d, _ in found)
    return [(i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), totals[label], digest) for i, found, label in coded]


def test_codes_against_plain_kmeans(spark):
    rows = vectors()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("code", F.lit("clash")).withColumn("v", F.lit(1))
    assert sorted(map(str, map(tuple, codes.compress(table).collect()))) == sorted(map(str, plain(rows)))


@pytest.mark.parametrize("entries", [1, 5, 256])
def test_few_and_many_entries(spark, entries):
    rows = vectors(60, 8)
    got = codes.compress(spark.createDataFrame(rows, SCHEMA), parts=4, entries=entries, rounds=3)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows, 4, entries, 3)))


def test_labels_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(components, "SMALL", 0)
    rows = vectors(100)
    assert sorted(map(str, map(tuple, codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()))) == sorted(map(str, plain(rows)))


def test_empty_tables_and_errors(spark):
    empty = codes.compress(spark.createDataFrame([(1, None, 1)], SCHEMA))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    with pytest.raises(Exception, match="different lengths|inhomogeneous"):
        codes.compress(spark.createDataFrame([(1, [0.0] * 16, 1), (2, [0.0] * 32, 1)], SCHEMA)).collect()
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark.createDataFrame([(1, [0.0] * 15, 1)], SCHEMA))


def test_search_looks_at_few_entries():
    """Exponion search: the radius holds the nearest entry and leaves most others out."""
    rng = np.random.default_rng(1)
    book = codes.Codebook(rng.integers(-500, 500, (2, 64, 4)))
    x, part = rng.integers(-500, 500, (4000, 4)), np.repeat([0, 1], 2000)
    full = ((x[:, None, :] - book.entries[part]) ** 2).sum(axis=2)
    best = full.argmin(axis=1)
    for start in (np.zeros(4000, np.int64), best):
        at, distance = book.assign(x, part, start)
        assert (at == best).all() and (distance == full.min(axis=1)).all()
    looked = (book.far[part * 64 + best] <= 4 * full.min(axis=1)[:, None]).sum(axis=1)
    assert looked.mean() < 32
