"""Exact substring deduplication behind a count-min prefilter.

A window is `length` consecutive words of one document; every word covered by
a window whose words also start earlier (in a smaller doc_id, or earlier in
the document) is removed.

First pass: each chunk of texts adds its windows to a count-min sketch of
`depth` rows and sends the touched cells; blocks of the sketch merge the cells
of all chunks and answer which of them were counted twice or more.  Cells only
overestimate, so no repeated window is lost.  Second pass: windows estimated
repeated, and only those, are grouped exactly (by 128 bits of hash), each
chunk sending a window once with its smallest doc_id; the block answers which
chunk holds the first.  The sketch grows with the corpus, so the share of
unrepeated windows in the second pass stays the same at every size.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm import exchange as ex
from leafmark.llm.shared import stage
from leafmark.llm.words import Words, inner_windows, mix, places, text_bytes, window_hashes, window_hashes_at

WINDOW = 20
DEPTH = 2
#: Cells in a row of the sketch for each window of the corpus.
CELLS_PER_WINDOW = 4

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


class _Chunk:
    """The documents of a chunk in order, and the hashes of their windows end to end."""

    def __init__(self, table, length: int):
        ids, place, texts = table["doc_id"].to_pylist(), table["place"].to_pylist(), text_bytes(table["text"])
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] is not None, texts[i] or b""))
        self.ids, self.place = [ids[i] for i in order], [place[i] for i in order]
        self.words = Words([texts[i] for i in order])
        first = self.words.first
        self.start = inner_windows(first, length)
        self.h1 = window_hashes(self.words.hashes(0), length, 0)[self.start]
        self.length = length
        self.doc = np.searchsorted(first, self.start, side="right") - 1

    def owner(self, windows: np.ndarray) -> list[np.ndarray]:
        """The order of the documents that have these windows: by id, then those without one by their place."""
        at = [p or 0 if i is None else i + (1 << 63) for i, p in zip(self.ids, self.place, strict=True)]
        doc = self.doc[windows]
        return [np.array(at, np.uint64)[doc], np.array([i is None for i in self.ids], bool)[doc]]

    def h2(self, candidates: np.ndarray) -> np.ndarray:
        """A second, independent hash of some windows."""
        return window_hashes_at(self.words.hashes(1), self.start[candidates], self.length, 1)


#: One for each row of the sketch.
_SALT = mix(np.arange(1, 9, dtype=np.uint64))


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each window in a row of the sketch; rows of 2 ** bits cells follow each other."""
    return (mix(h + _SALT[row]) >> np.uint64(64 - bits)) + (np.uint64(row) << np.uint64(bits))


class _Sketch(ex.Reduction):
    """Cells of the sketch: whether a chunk counts more than one window; told is whether all chunks do."""

    values, told = "b", "b"

    def merge(self, keys, values):
        known, place = places(keys)
        count = np.bincount(place, minlength=len(known))
        return known, [(count > 1) | (np.bincount(place, weights=values[0], minlength=len(known)) > 0)], place


def _sorted_groups(a: np.ndarray, b: np.ndarray):
    """An order in which equal pairs (a, b) follow each other, and where each group begins."""
    order = np.argsort(a)
    x, y = a[order], b[order]
    same = x[1:] == x[:-1]
    if (y[1:] != y[:-1])[same].any():  # two windows share 64 bits: sort by all 128
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    return order, np.concatenate([[0], np.flatnonzero(~same) + 1]) if len(a) else np.empty(0, np.int64)


class _First(ex.Reduction):
    """Windows by both hashes, with the first document that has each; told is which piece has the first window.

    values: the second hash, the document's order, and whether it has no id (such come last).
    """

    values, told = "uub", "b"

    def merge(self, keys, values):
        order, begin = _sorted_groups(keys, values[0])
        group = np.repeat(np.arange(len(begin)), np.diff(np.concatenate([begin, [len(keys)]])))
        place = np.empty(len(keys), np.int64)
        place[order] = group
        first = np.lexsort((values[1], values[2], place))[begin] if len(keys) else begin
        return keys[first], [v[first] for v in values], place

    def answer(self, keys, values):
        return [np.ones(len(keys), bool)]

    def spread(self, answer, place, piece, values):
        order = np.lexsort((piece, values[1], values[2], place))
        new = np.concatenate([[True], place[order][1:] != place[order][:-1]]) if len(order) else np.empty(0, bool)
        here = np.zeros(len(place), bool)
        here[order[new]] = True  # of the pieces that have the first document, the first
        return [here & answer[0][place]]


def _distinct(chunk: _Chunk, candidates: np.ndarray):
    """The distinct keys of candidate windows in order, and the first window of each."""
    a, b = chunk.h1[candidates], chunk.h2(candidates)
    order, begin = _sorted_groups(a, b)
    at = order[begin]
    return a[at], b[at], np.minimum.reduceat(candidates[order], begin) if len(a) else candidates


def _touched(chunk: _Chunk, depth: int, bits: int):
    """The distinct cells that a chunk touches, how often it does each, and the places of its windows in every row."""
    rows = [places(_cells(chunk.h1, row, bits)) for row in range(depth)]
    counts = [np.bincount(place, minlength=len(cells)) for cells, place in rows]
    return np.concatenate([c for c, _ in rows]), np.concatenate(counts), [place for _, place in rows]


def _likely(chunk: _Chunk, sketch: _Sketch, plan: ex.Plan, got: dict[int, bytes], depth: int, bits: int) -> np.ndarray:
    """The windows estimated repeated in every row."""
    cells, _, rows = _touched(chunk, depth, bits)
    told, before, likely = sketch.read(plan, got, cells)[0], 0, np.ones(len(chunk.h1), bool)
    for place in rows:
        likely &= told[before + place]
        before += int(place.max()) + 1 if len(place) else 0
    return np.flatnonzero(likely)


def _placed(docs: DataFrame) -> DataFrame:
    """docs with place: for rows without doc_id a number that rises with their text, null for all others."""
    plain = docs.where("doc_id is not null").withColumn("place", F.lit(None).cast("long"))
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return plain
    texts = nameless.select(F.col("text").alias("of")).where("of is not null").distinct().repartitionByRange("of").sortWithinPartitions("of")
    texts = stage(texts.withColumn("place", F.monotonically_increasing_id()), "nameless")
    return plain.unionAll(nameless.join(texts, F.col("text") == F.col("of"), "left").select("doc_id", "text", "place"))


def dedup(docs: DataFrame, length: int = WINDOW, depth: int = DEPTH, cells_per_window: int = CELLS_PER_WINDOW) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256, kept_text.

    Null and empty texts have no words and the hash of the empty string;
    documents of fewer than `length` words keep all.  Repeated rows are
    documents one after the other, so later ones lose what repeats.  Rows
    without doc_id come after all others, in the order of their texts.  Other
    columns are ignored.
    """
    plan = ex.plan_chunks(docs)
    bits = max(6, (cells_per_window * plan.text_bytes // 5).bit_length())
    sketch, exact = _Sketch(bits + (depth - 1).bit_length()), _First()
    texts = ex.deal(_placed(docs.select("doc_id", "text")), plan, "doc_id", "text", "place")

    def count(key, table):
        cells, counts, _ = _touched(_Chunk(table, length), depth, bits)
        return ex.asks(sketch.ask(plan, key[0].as_py(), cells, [counts > 1]))

    estimated = sketch.resolve(texts.groupBy("chunk").applyInArrow(count, ex.ASK), plan)

    def candidates(table, told):
        if not table.num_rows:
            return ex.asks([])
        chunk = _Chunk(table, length)
        a, b, first = _distinct(chunk, _likely(chunk, sketch, plan, ex.by_block(told), depth, bits))
        return ex.asks(exact.ask(plan, table["chunk"][0].as_py(), a, [b, *chunk.owner(first)]))

    decided = exact.resolve(ex.told(texts, estimated, candidates, ex.ASK), plan)
    both = estimated.select("chunk", "block", "answer").unionAll(decided.selectExpr("chunk", f"block + {plan.fan} as block", "answer"))

    def remove(table, answered):
        import pyarrow as pa

        chunk, got = _Chunk(table, length), ex.by_block(answered)
        likely = _likely(chunk, sketch, plan, got, depth, bits)
        a, _, first = _distinct(chunk, likely)
        told = exact.read(plan, got, a, offset=plan.fan)[0]
        repeats = np.ones(len(likely), bool)
        repeats[np.searchsorted(likely, first[told])] = False
        later = likely[repeats]
        words, first = chunk.words, chunk.words.first
        covered = np.zeros(len(words) + 1, np.int32)
        np.add.at(covered, chunk.start[later], 1)
        np.add.at(covered, chunk.start[later] + length, -1)
        keep = np.cumsum(covered[:-1]) == 0
        kept = np.concatenate([[0], np.cumsum(keep)])[first]
        out = []
        for i, doc_id in enumerate(chunk.ids):
            n, n_kept, own = int(first[i + 1] - first[i]), int(kept[i + 1] - kept[i]), words.of(i)
            if n_kept < n:
                own = itertools.compress(own, keep[first[i] : first[i + 1]].tolist())
            text = b" ".join(own)
            out.append((doc_id, n, n - n_kept, hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace")))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return ex.told(texts, both, remove, RESULT)
