"""Ask the whole corpus about keys without sending a row for each key.

Texts are dealt into chunks (by a hash of doc_id).  A chunk sends the sorted
distinct keys that it holds to blocks of the key space, as one packed piece
for each block; a block merges its pieces and answers each with its values,
in the same order; the chunk, which makes the same keys again, reads the
answers by position.  A key costs one to a few bytes on the way out and a bit
or a byte on the way back.  However often a key occurs, it reaches a block
once for each chunk, so no key is hot; no block or chunk holds more than its
share, and nothing goes through the driver.

A chunk sends to FANOUT blocks at most, however large the corpus is.  Where
that many blocks don't suffice, a block's pieces are merged in groups of as
many chunks, and each group sends what it merged on to as many narrower
blocks: levels of a tree, whose number is the logarithm of the chunks to the
base of FANOUT.  Answers return by the same way.  So the pieces are in
proportion to the chunks at each level, and no node of the tree merges more
than about a chunk's keys.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm.shared import lean
from leafmark.llm.words import places

ASK = "block long, chunk long, n int, keys binary, extra binary"
ANSWER = "chunk long, block long, answer binary"
#: Bytes of text that a chunk holds, about.
CHUNK_BYTES = 4 << 20
#: Blocks that a chunk, or a group of chunks, sends to at most.
FANOUT = 256
#: Bytes of text for each block of a small corpus, at least.
_LEAST_BLOCK = 64 << 10


@dataclass(frozen=True)
class Plan:
    """So many chunks, dealt to so many partitions; texts of so many bytes; levels of so many blocks a node."""

    chunks: int
    partitions: int
    text_bytes: int
    levels: int = 1
    fan: int = 1


def plan_chunks(docs: DataFrame, chunk_bytes: int | None = None, fanout: int | None = None) -> Plan:
    """Size the chunks by the bytes of all texts (one pass over the lengths)."""
    chunk_bytes, fanout = chunk_bytes or CHUNK_BYTES, fanout or FANOUT
    total = int(lean(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    chunks = max(1, math.ceil(total / chunk_bytes), min(32, math.ceil(total / (256 << 10))))
    levels = 1
    while fanout**levels < chunks:
        levels += 1
    fan = min(fanout, max(1, math.ceil(total / _LEAST_BLOCK))) if levels == 1 else math.ceil(round(chunks ** (1 / levels), 9))
    at_least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Plan(chunks, max(at_least, math.ceil(chunks / 3)), total, levels, max(fan, 1 if levels == 1 else 2))


def chunk_of(plan: Plan, doc_id: str = "doc_id", text: str | None = None) -> Column:
    """The chunk of a row: by doc_id; rows without one are dealt by their text."""
    key = F.xxhash64(doc_id) if text is None else F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id)).otherwise(F.xxhash64(text))
    return F.pmod(key, F.lit(plan.chunks)).cast("long")


def deal(docs: DataFrame, plan: Plan, *columns: str) -> DataFrame:
    """The rows with a column chunk, those of a chunk together in a partition."""
    return docs.select(*columns, chunk_of(plan, "doc_id", "text").alias("chunk")).repartition(plan.partitions, "chunk")


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Unsigned 64-bit values as byte planes (of the differences, if ascending), squeezed where that helps."""
    values, out = np.ascontiguousarray(values, np.uint64), []
    if ascending and len(values):
        out.append(int(values[0]).to_bytes(8, "little"))
        values = np.diff(values)
    top = int(values.max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    out.append(bytes([width]))
    for plane in values.view(np.uint8).reshape(-1, 8)[:, :width].T:
        raw, kind = plane.tobytes(), b"r"
        if len(zlib.compress(raw[:1024], 1)) < 0.9 * len(raw[:1024]):
            raw, kind = zlib.compress(raw, 1), b"z"
        out += [kind, len(raw).to_bytes(4, "little"), raw]
    return b"".join(out)


def unpack(data: bytes, n: int, ascending: bool = False) -> np.ndarray:
    first = ascending and n > 0
    at, n = (8, n - 1) if first else (0, n)
    planes, width = np.zeros((n, 8), np.uint8), data[at]
    at += 1
    for k in range(width):
        size = int.from_bytes(data[at + 1 : at + 5], "little")
        raw = data[at + 5 : at + 5 + size]
        planes[:, k] = np.frombuffer(zlib.decompress(raw) if data[at : at + 1] == b"z" else raw, np.uint8)
        at += 5 + size
    values = planes.reshape(-1).view(np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], np.uint64), values]), dtype=np.uint64) if first else values


def pack_bits(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=n).astype(bool)


def _pack_all(arrays: list[np.ndarray], kinds: str, lo: int, hi: int) -> bytes:
    """Slices of several arrays, each with its length: u for numbers, b for bits."""
    out = []
    for a, kind in zip(arrays, kinds, strict=True):
        raw = pack(a[lo:hi]) if kind == "u" else pack_bits(a[lo:hi])
        out += [len(raw).to_bytes(4, "little"), raw]
    return b"".join(out)


def _unpack_all(data: bytes, kinds: str, n: int) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = int.from_bytes(data[at : at + 4], "little")
        raw = data[at + 4 : at + 4 + size]
        out.append(unpack(raw, n) if kind == "u" else unpack_bits(raw, n))
        at += 4 + size
    return out


def block_of(keys: np.ndarray, fan: int, level: int, bits: int) -> np.ndarray:
    """The block at a level of keys below 2 ** bits; it doesn't fall as the key rises."""
    high = keys >> np.uint64(bits - 32) if bits >= 32 else keys << np.uint64(32 - bits)
    return (high * np.uint64(fan**level)) >> np.uint64(32)


def pieces(block: np.ndarray) -> list[tuple[int, int, int]]:
    """(block, from, to) of each run in an ascending array of blocks."""
    if not len(block):
        return []
    cut = np.flatnonzero(np.diff(block)) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(block)]])
    return [(int(block[a]), int(a), int(b)) for a, b in zip(starts, ends, strict=True)]


def _table(rows: list[tuple], names: str):
    import pyarrow as pa

    names = names.split()
    kinds = {"block": pa.int64(), "chunk": pa.int64(), "n": pa.int32()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array(c, kinds.get(k, pa.binary())) for c, k in zip(columns, names, strict=True)], names)


def answers(rows: list[tuple]):
    """The Arrow table of the answers (chunk, block, answer)."""
    return _table(rows, "chunk block answer")


class Reduction:
    """How the values of equal keys are merged, and what is answered.

    values, told: the kinds of what a key brings and of what it is told.  Keys
    are below 2 ** bits.  merge() must not depend on the grouping of its input.
    """

    values, told = "u", "u"

    def __init__(self, bits: int = 64):
        self.bits = bits

    def merge(self, keys: np.ndarray, values: list[np.ndarray]):
        """The distinct keys in order, their merged values, and the place of each key among them: here sums."""
        known, place = places(keys)
        return known, [np.bincount(place, weights=v, minlength=len(known)).astype(np.uint64) for v in values], place

    def answer(self, keys: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        """What all are told about the merged keys of the whole corpus."""
        return values

    def spread(self, answer, place, piece, values) -> list[np.ndarray]:
        """What each key of each piece is told, given the answers to the merged keys."""
        return [a[place] for a in answer]

    def also(self, keys: np.ndarray, values: list[np.ndarray]) -> bytes | None:
        """What a block says about its merged keys as a whole, besides."""
        return None

    def ask(self, plan: Plan, chunk: int, keys: np.ndarray, values: list[np.ndarray], level: int = 1) -> list[tuple]:
        """The pieces of ascending distinct keys."""
        found = pieces(block_of(keys, plan.fan, level, self.bits))
        return [(block, chunk, hi - lo, pack(keys[lo:hi], True), _pack_all(values, self.values, lo, hi)) for block, lo, hi in found]

    def read(self, plan: Plan, got: dict[int, bytes], keys: np.ndarray, level: int = 1, offset: int = 0) -> list[np.ndarray]:
        """The answers to ask(): an array for each kind."""
        out = [np.zeros(len(keys), np.uint64 if k == "u" else bool) for k in self.told]
        for block, lo, hi in pieces(block_of(keys, plan.fan, level, self.bits)):
            for o, v in zip(out, _unpack_all(got[block + offset], self.told, hi - lo), strict=True):
                o[lo:hi] = v
        return out

    def _gather(self, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        each = [_unpack_all(r["extra"], self.values, r["n"]) for r in rows]
        keys = np.concatenate([unpack(r["keys"], r["n"], True) for r in rows])
        values = [np.concatenate([e[k] for e in each]) for k in range(len(self.values))]
        return rows, keys, values, np.repeat(np.arange(len(rows)), [r["n"] for r in rows])

    def _answers(self, rows, told) -> list[tuple]:
        out, at = [], 0
        for r in rows:
            out.append((r["chunk"], r["block"], _pack_all(told, self.told, at, at + r["n"])))
            at += r["n"]
        return out

    def resolve(self, asked: DataFrame, plan: Plan, level: int = 1) -> DataFrame:
        """(chunk, block, answer) for every piece asked; chunk -1 has what also() says."""
        reduction = self

        def last(table):
            rows, keys, values, piece = reduction._gather(table)
            known, merged, place = reduction.merge(keys, values)
            out = reduction._answers(rows, reduction.spread(reduction.answer(known, merged), place, piece, values))
            more = reduction.also(known, merged)
            return answers(out if more is None else [*out, (-1, rows[0]["block"], more)])

        if level == plan.levels:
            return asked.groupBy("block").applyInArrow(last, ANSWER)
        grouped = asked.withColumn("grp", F.floor(F.col("chunk") / plan.fan).cast("long"))

        def up(key, table):
            _, keys, values, _ = reduction._gather(table)
            known, merged, _ = reduction.merge(keys, values)
            return asks(reduction.ask(plan, key[1].as_py(), known, merged, level + 1))

        above = reduction.resolve(grouped.groupBy("block", "grp").applyInArrow(up, ASK), plan, level + 1)

        def down(left, right):
            if not left.num_rows:
                return answers([])
            rows, keys, values, piece = reduction._gather(left)
            known, _, place = reduction.merge(keys, values)
            told = reduction.read(plan, by_block(right), known, level + 1)
            return answers(reduction._answers(rows, reduction.spread(told, place, piece, values)))

        back = above.where("chunk >= 0").selectExpr(f"block div {plan.fan} as parent", "chunk as grp", "chunk", "block", "answer")
        found = grouped.groupBy("block", "grp").cogroup(back.groupBy("parent", "grp")).applyInArrow(down, ANSWER)
        return found.unionAll(above.where("chunk < 0").select("chunk", "block", "answer"))


def asks(rows: list[tuple]):
    """The Arrow table of the pieces (block, chunk, n, keys, extra)."""
    return _table(rows, "block chunk n keys extra")


def by_block(table) -> dict[int, bytes]:
    """The answers that a chunk got, by block."""
    return dict(zip(table["block"].to_pylist(), table["answer"].to_pylist(), strict=True))


def told(texts: DataFrame, answered: DataFrame, use, schema: str) -> DataFrame:
    """use(texts of a chunk, its answers) -> Arrow table, for each chunk."""
    return texts.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(lambda left, right: use(left, right), schema)
