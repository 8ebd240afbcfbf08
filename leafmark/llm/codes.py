"""Vector code compression: product codes from integer k-means with an exponion search.

A vector is cut into PARTS parts; each part position has a codebook of ENTRIES
entries.  The nearest entry is searched from the previous one, a: with u the
squared distance to it, every entry as near lies within 2 sqrt(u) of a, so of
the other entries, sorted by their distance to a, only those with a squared
distance of 4 u at most are looked at.  All distances are integers, and of
equally near entries the lowest wins.

A round is one pass over the vectors: tasks assign their parts and add them up
by entry, Spark adds the partial sums, and the driver divides (a codebook is
ENTRIES vectors, whatever the data).  Nothing is written between rounds: a
task replays the earlier assignments, each from the one before, which look at
few entries.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.components import attach
from leafmark.llm.shared import lean, stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of the integer vectors are smaller than this, so that no distance overflows.
LARGEST = 1 << 27
#: Vectors that a task holds at a time.
ROWS = 8192

_SUMS = "place int, n long, sums array<long>"
_CODED = "vec_id long, label int, code string, error long"


def integers(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of each component, without the rows whose vector is null or has a null or non-finite component."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    kept = table.where(F.col("embedding").isNotNull() & fine)
    return kept.select("vec_id", "label", F.transform(x, lambda e: F.floor(e * F.lit(float(scale)))).alias("v"))


def matrix(column) -> np.ndarray:
    """The rows of an Arrow list column; all must have one length, and components below LARGEST."""
    lengths = np.asarray(column.value_lengths())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    values = np.asarray(column.flatten()).astype(np.int64)
    if len(values) and np.abs(values).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST} or more")
    return values.reshape(len(lengths), -1)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    d = x - entries
    return np.einsum("ij,ij->i", d, d)


class Codebook:
    """The entries (part, entry, component) of one round, and for each entry the others by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        parts, n, self.width = entries.shape
        d = entries[:, :, None, :] - entries[:, None, :, :]
        squares = (d * d).sum(axis=3)
        squares[:, np.arange(n), np.arange(n)] = -1  # itself comes first, even before its equals
        self.near = np.argsort(squares, axis=2, kind="stable").reshape(parts * n, n)
        self.far = np.take_along_axis(squares.reshape(parts * n, n), self.near, 1)
        self.flat = entries.reshape(parts * n, self.width)
        self.n = n

    def assign(self, x: np.ndarray, part: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of x, and its squared distance, from the entries before."""
        start = part * self.n + before
        best, least = before.copy(), _squares(x, self.flat[start])
        radius, active = 4 * least, np.arange(len(x))
        for k in range(1, self.n):
            active = active[self.far[start[active], k] <= radius[active]]
            if not len(active):
                break
            other = self.near[start[active], k]
            d = _squares(x[active], self.flat[part[active] * self.n + other])
            nearer = (d < least[active]) | ((d == least[active]) & (other < best[active]))
            hit = active[nearer]
            best[hit], least[hit] = other[nearer], d[nearer]
        return best, least


def _cut(vectors: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts of all vectors end to end, and their positions."""
    return vectors.reshape(len(vectors) * parts, vectors.shape[1] // parts), np.tile(np.arange(parts), len(vectors))


def _replay(books: list[Codebook], x: np.ndarray, part: np.ndarray):
    """The assignment to the last codebook, each from that to the one before; the first starts at entry 0."""
    at = np.zeros(len(x), np.int64)
    for book in books:
        at, distance = book.assign(x, part, at)
    return at, distance


def _slices(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def _sums(vectors: DataFrame, books: list[Codebook], parts: int) -> dict[int, tuple[int, list[int]]]:
    """By entry (part * entries + entry) how many parts it has and their sums."""
    import pyarrow as pa

    places, width = len(books[-1].flat), books[-1].width

    def add(batches):
        n, total = np.zeros(places, np.int64), np.zeros((places, width), np.int64)
        for batch in _slices(batches):
            x, part = _cut(matrix(batch.column("v")), parts)
            at = part * books[-1].n + _replay(books, x, part)[0]
            n += np.bincount(at, minlength=places)
            np.add.at(total, at, x)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own]), pa.array(total[own].tolist(), pa.list_(pa.int64()))], ["place", "n", "sums"])

    partial = vectors.select("v").mapInArrow(add, _SUMS)
    wide = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return {r[0]: (r[1], [int(s) for s in r[2:]]) for r in partial.groupBy("place").agg(F.sum("n"), *wide).collect()}


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[Codebook]:
    """The codebooks of integer vectors (vec_id, v) before the first round and after each; none if there is no vector.

    The first is the parts of the vectors with the smallest vec_ids (null
    last, equal ids by their components); it has fewer entries than asked for
    where there are fewer vectors.
    """
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not first:
        return []
    start = np.array([r.v for r in first], np.int64)
    if start.shape[1] % parts:
        raise ValueError(f"vectors of {start.shape[1]} components aren't cut into {parts} equal parts")
    books = [Codebook(start.reshape(len(start), parts, -1).swapaxes(0, 1).copy())]
    for _ in range(rounds):
        following = books[-1].flat.copy()
        for place, (n, sums) in _sums(vectors, books, parts).items():
            following[place] = [s // n for s in sums]
        books.append(Codebook(following.reshape(books[-1].entries.shape)))
    return books


def digest(book: Codebook) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.entries.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[Codebook], parts: int = PARTS) -> DataFrame:
    """(vec_id, label, code, error) by the last codebook: two hex digits a part, and the squared distances summed."""
    import pyarrow as pa

    def code(batches):
        for batch in _slices(batches):
            x, part = _cut(matrix(batch.column("v")), parts)
            at, distance = _replay(books, x, part)
            codes = [r.tobytes().hex() for r in at.astype(np.uint8).reshape(-1, parts)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(distance.reshape(-1, parts).sum(axis=1))], ["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(code, _CODED)


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row (vec_id, embedding, label) with a finite vector.

    Rows whose vector is null or has null or non-finite components go; an
    empty table, or one without any other row, gives no rows.  Repeated rows
    are coded each; null ids come last where ids decide; null labels form one
    label.  Vectors of different lengths, of a length that parts doesn't
    divide, or of components of 2 ** 27 / 256 or more are errors.  At most 256
    entries.  Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("from 1 to 256 entries")
    vectors = integers(lean(table).select("vec_id", F.col("label").cast("int").alias("label"), "embedding"))
    books = train(vectors, parts, entries, rounds)
    if not books:
        return vectors.selectExpr("vec_id", "'' code", "0L error", "0L label_error", "'' codebooks_sha256").limit(0)
    coded = stage(encode(vectors, books, parts), "codes")
    key = [F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("of")]
    totals = coded.groupBy(*key).agg(F.sum("error").alias("label_error"), F.count("*").alias("c"))
    n = coded.count()
    found = attach(coded.select("vec_id", "code", "error", *key), totals, ["none", "of"], "c", n)
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books[-1])).alias("codebooks_sha256"))
