"""One-permutation MinHash fingerprints of whole texts.

Each shingle (five words, A to Z as lower case) is hashed once; the high bits
of the hash choose one of BINS bins, and a bin keeps the smallest rest.  An
empty bin takes the value of the first full bin in a pseudo-random order of
its own, the same in every text (optimal densification).  A bin's value is mixed
with the bin's number, so that values that fill several bins agree by chance
in each of them anew, and its BITS low bits are stored, packed.  Two fingerprints agree in a share p of their
bins; bins whose values differ agree by chance in 1 of 2 ** BITS, so the
likeness is (p - c) / (1 - c) with c = 2 ** -BITS, and 0 at least.

Bins are minima, so a text longer than PIECE is taken in pieces that share
four words: memory doesn't grow with a text's shingles.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from leafmark.llm.shared import lean, stage
from leafmark.llm.words import LOWER, Words, inner_windows, mix, window_hashes, window_hashes_at

SHINGLE = 5
BINS = 512
BITS = 4
#: Bytes of texts, and texts, that are fingerprinted at a time.
PIECE, TEXTS = 2 << 20, 1024
#: Bytes of text in a range of documents; ranges at most (their first keys go through the driver).
RANGE_BYTES, RANGES = 32 << 20, 16_384

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, repeats long"


def _hashes(words: Words, length: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles, and the text of each; texts of fewer words are one shingle, if short says so."""
    ids, first = words.hashes(0), words.first
    starts = inner_windows(first, length)
    h = [window_hashes(ids, length)[starts]]
    doc = [np.searchsorted(first, starts, side="right") - 1]
    counts = np.diff(first)
    for n in range(1, length) if short else ():
        own = np.flatnonzero(counts == n)
        if len(own):
            h.append(window_hashes_at(ids, first[own], n))
            doc.append(own)
    return np.concatenate(h), np.concatenate(doc)


def _lowest(out: np.ndarray, h: np.ndarray, doc: np.ndarray) -> None:
    """Take hashes into the bins of their texts."""
    bits = np.uint64(64 - (out.shape[1] - 1).bit_length())
    at = doc * out.shape[1] + (h >> bits).astype(np.int64)
    np.minimum.at(out.reshape(-1), at, h & ((np.uint64(1) << bits) - np.uint64(1)))


def _pieces(text: bytes, length: int):
    """A long text in pieces that end between words; each brings the last words of the piece before."""
    at, tail = 0, b""
    while at < len(text):
        end = at + PIECE
        found = _BLANK.search(text, end) if end < len(text) else None
        end = found.end() if found else len(text)
        piece = tail + text[at:end]
        yield piece
        tail, at = b" ".join(piece.split()[-(length - 1) :]) + b" ", end


def bins(texts: list[bytes], length: int = SHINGLE, n: int = BINS) -> np.ndarray:
    """The smallest value of each text in each bin."""
    out = np.full((len(texts), n), _EMPTY, np.uint64)
    long = [i for i, t in enumerate(texts) if len(t) > 2 * PIECE]
    for i in long:
        few = len(texts[i].split(None, length)) <= length
        for piece in [texts[i]] if few else _pieces(texts[i], length):
            h, doc = _hashes(Words([piece], LOWER), length, few)
            _lowest(out[i : i + 1], h, doc)
    rest = [b"" if len(t) > 2 * PIECE else t for t in texts] if long else texts
    _lowest(out, *_hashes(Words(rest, LOWER), length))
    return out


@cache
def _order(n: int) -> np.ndarray:
    """For each bin, the order in which it looks for a full one."""
    return np.argsort(mix(np.arange(1, n * n + 1, dtype=np.uint64)).reshape(n, n), axis=1, kind="stable")


def densify(values: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each text that has a full one."""
    out, full = values.copy(), values != _EMPTY
    row, column = np.nonzero(~full & full.any(axis=1)[:, None])
    order = _order(values.shape[1])
    for step in range(values.shape[1]):
        if not len(row):
            break
        other = order[column, step]
        hit = full[row, other]
        out[row[hit], column[hit]] = values[row[hit], other[hit]]
        row, column = row[~hit], column[~hit]
    return out


def low_bits(texts: list[bytes], length: int = SHINGLE, n: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The low-order bits of each text's bins, and which texts have shingles."""
    values = bins(texts, length, n)
    mixed = mix(densify(values) + mix(np.arange(1, n + 1, dtype=np.uint64)))
    return (mixed & np.uint64((1 << bits) - 1)).astype(np.uint8), (values != _EMPTY).any(axis=1)


def packed(low: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    """As hex digits; a text without shingles has none."""
    planes = (low[:, :, None] >> np.arange(bits, dtype=np.uint8)) & np.uint8(1)
    rows = np.packbits(planes.reshape(len(low), -1), axis=1)
    return [r.tobytes().hex() if s else "" for r, s in zip(rows, some, strict=True)]


def agreement(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The likeness of each pair: 1 where neither text has shingles, 0 where one has none."""
    chance = 2.0**-bits
    p = np.maximum(0.0, ((a == b).mean(axis=1) - chance) / (1 - chance))
    return np.where(some_a & some_b, p, (~some_a & ~some_b).astype(float))


@pandas_udf(StringType())
def fingerprint(text: pd.Series) -> pd.Series:
    """The fingerprint of each text; null and texts without words have the empty one."""
    own, out, at = [(t or "").encode("utf-8", "surrogatepass") for t in text], [], 0
    while at < len(own):
        to, size = at, 0
        while to < len(own) and to - at < TEXTS and (to == at or size + len(own[to]) <= PIECE):
            size, to = size + len(own[to]), to + 1
        out += packed(*low_bits(own[at:to]))
        at = to
    return pd.Series(out, dtype=object)


@pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """The likeness of two fingerprints; null if either is null."""

    def planes(column: pd.Series):
        rows = np.frombuffer(b"".join(bytes.fromhex(x) if x else bytes(BINS * BITS // 8) for x in column), np.uint8).reshape(len(column), -1)
        return np.unpackbits(rows, axis=1).reshape(len(column), BINS, BITS) @ (1 << np.arange(BITS)), np.array([bool(x) for x in column], bool)

    if not len(a):
        return pd.Series([], dtype=float)
    (x, some_x), (y, some_y) = planes(a), planes(b)
    return pd.Series(agreement(x, y, some_x, some_y)).where((a.notna() & b.notna()).to_numpy())


def _range_of(firsts: list, key: Column) -> Column:
    """The number of the range of a key, given the first key of each: found among every s-th of them, then within s."""
    step = max(1, math.isqrt(len(firsts)))
    structs = F.array(*[F.struct(F.lit(r[0]), F.lit(r[1]).cast("long"), F.lit(r[2])) for r in firsts])
    coarse = F.size(F.filter(F.array(*[F.struct(F.lit(r[0]), F.lit(r[1]).cast("long"), F.lit(r[2])) for r in firsts[::step]]), lambda b: b <= key))
    fine = F.slice(structs, F.greatest(coarse - 1, F.lit(0)) * step + 1, F.lit(step))
    return (F.greatest(coarse - 1, F.lit(0)) * step + F.size(F.filter(fine, lambda b: b <= key)) - 1).cast("int")


def in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text, copies, ahead, part) in ascending order of doc_id within each partition; and the number of partitions.

    Each partition is a range of the order and ends with the first row of the
    next one (ahead: 1), the last with the first of all, so every row's
    successor follows it.  Ids that are null come last; rows of one id are in
    the order of a hash of their text.  Rows equal in both that are over
    1 / 1024 of all come once, with their number in copies.  Texts are
    shuffled once; the driver sees the first key of each range.
    """
    spark = docs.sparkSession
    key = [F.col("doc_id").isNull().alias("a"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("b"), F.xxhash64("text").alias("h")]
    keys = stage(lean(docs).groupBy(*key).agg(F.count("*").alias("c"), F.sum(F.octet_length("text")).alias("size")), "keys")
    rows, size = keys.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES)))
    ranged = keys.select("a", "b", "h").repartitionByRange(parts, "a", "b", "h").groupBy(F.spark_partition_id().alias("p"))
    firsts = sorted(tuple(r.m) for r in ranged.agg(F.min(F.struct("a", "b", "h")).alias("m")).collect())
    if not firsts:
        return docs.select("doc_id", "text").limit(0).selectExpr("doc_id", "text", "1L copies", "0 ahead", "0 part"), 1
    keyed = docs.select("doc_id", "text", F.lit(1).cast("long").alias("copies"), *key)
    hot = keys.where(F.col("c") > max(1000, rows // 1024)).select("a", "b", "h", "c")
    if not hot.isEmpty():  # fewer than 1024 keys
        hot = F.broadcast(hot)
        once = keyed.join(hot, ["a", "b", "h"]).groupBy("a", "b", "h", "doc_id").agg(F.first("text").alias("text"), F.first("c").alias("copies"))
        keyed = keyed.join(hot, ["a", "b", "h"], "left_anti").unionByName(once)
    dealt = keyed.withColumn("part", _range_of(firsts, F.struct("a", "b", "h")))
    starts = spark.createDataFrame([(*f, (i - 1) % len(firsts)) for i, f in enumerate(firsts)], "a boolean, b long, h long, before int")
    # of equal rows one is enough: a first key's rows are a thousand at most
    ahead = keyed.join(F.broadcast(starts), ["a", "b", "h"]).groupBy("a", "b", "h", "before").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    both = dealt.withColumn("ahead", F.lit(0)).unionByName(ahead.select("a", "b", "h", "doc_id", "text", F.lit(1).cast("long").alias("copies"), F.col("before").alias("part"), F.lit(1).alias("ahead")))
    sorted_rows = both.repartitionById(len(firsts), F.col("part")).sortWithinPartitions("ahead", "a", "b", "h", "text")
    return sorted_rows.select("doc_id", "text", "copies", "ahead", "part"), len(firsts)


def _edited(text: str, following: str) -> str:
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def _compared(rows: list[tuple], following: tuple) -> list[tuple]:
    """A result for each row (doc_id, text, copies) and what follows it; the last is followed by `following`."""
    texts = [r[1] for r in rows] + [following[1]]
    edited = [_edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    many = [i for i, r in enumerate(rows) if r[2] > 1]
    alone = [_edited(texts[i], texts[i]) for i in many]  # copies are followed by themselves
    own = [t.encode("utf-8", "surrogatepass") for t in texts]
    other = [t.encode("utf-8", "surrogatepass") for t in edited + alone]
    low, some = low_bits(own)
    changed, changed_some = low_bits(other)
    n = len(rows)
    back = np.concatenate([np.arange(n), np.array(many, np.int64)])
    near = agreement(low[back], changed, some[back], changed_some)
    onward = agreement(low[:-1], low[1:], some[:-1], some[1:])
    prints, changed_prints = packed(low, some), packed(changed, changed_some)
    out = []
    for k, i in enumerate(back.tolist()):
        doc_id, text, copies = rows[i]
        out.append((doc_id, len(text), hashlib.sha256(other[k]).hexdigest(), prints[i], changed_prints[k], float(near[k]), float(onward[i]) if k < n else 1.0, 1 if k < n else copies - 1))
    return out


def _table(rows: list[tuple]):
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
    names = [f.split()[0] for f in EDITS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _follow(batches):
    """Compare each row of a sorted partition to the row after it, a few MB of text at a time."""
    held, size = [], 0
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("doc_id", "text", "copies", "ahead")]
        for doc_id, text, copies, ahead in zip(*columns, strict=True):
            row = (doc_id, text or "", copies)
            if held and (ahead or size + 4 * len(row[1]) > PIECE or len(held) >= TEXTS):
                yield _table(_compared(held, row))
                held, size = [], 0
            if not ahead:
                held.append(row)
                size += len(row[1])


def edits(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside that of an edit of it, and their likeness.

    The edit replaces the last floor(n_chars / 4) code points by as many from
    the start of the next document in ascending doc_id (all, if it has fewer;
    after the last comes the first).  One row a document: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty.  Texts without words have the empty fingerprint,
    which is like itself alone.  Rows without doc_id come last; rows of one id
    are in the order of a hash of their text, so repeated rows follow each
    other.  Other columns are ignored; an empty table gives no rows.
    """
    rows, _ = in_order(docs.select("doc_id", "text"))
    found = rows.mapInArrow(_follow, EDITS)
    return found.withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), "repeats"))).drop("repeat", "repeats")
