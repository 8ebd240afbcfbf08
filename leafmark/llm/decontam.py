"""Benchmark decontamination with an FM-index per shard of training text.

The words of a shard are indexed once: suffix array, Burrows-Wheeler
transform, ranks by a wavelet matrix, every so many suffix positions kept.
All benchmark phrases are searched backward together, their occurrences are
located by walking to kept positions, and the spans they cover are merged.

Words that no phrase has can't be part of an occurrence, so only stretches of
benchmark words, as long as the shortest phrase at least, enter the index.
A shard is a slice of a partition; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.shared import lean, stage
from leafmark.llm.words import ALNUM, Words, bounded, text_bytes

WINDOW = 10
#: Bytes of text in a shard, and of benchmark text that is broadcast at a time.
SHARD_BYTES, BENCHMARK_BYTES = 4 << 20, 16 << 20
SAMPLE = 8


class FMIndex:
    """An FM-index of an array of symbols from 1 to sigma - 1; 0 separates and isn't searched."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        text, sigma = np.append(symbols + 1, 0), sigma + 1  # the end is a symbol of its own
        n = len(text)
        order = self._suffixes(text)
        self.bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        # the wavelet matrix: for each bit from the highest, how many ones stand before each place
        self.levels, row = [], self.bwt
        for bit in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            ones = (row >> bit) & 1
            self.levels.append((bit, n - int(ones.sum()), np.concatenate([[0], np.cumsum(ones)]).astype(np.int32)))
            row = np.concatenate([row[ones == 0], row[ones == 1]])
        kept = order % SAMPLE == 0
        self.kept, self.kept_rank, self.kept_at = kept, np.cumsum(kept) - 1, order[kept]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """The suffix array, by sorting on twice as many symbols each time."""
        n = len(text)
        rank, width = text.astype(np.int64), 1
        while True:
            key = rank * (n + int(rank.max()) + 2)
            key[: n - width] += rank[width:] + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            width *= 2
            if width >= n or rank[order[-1]] == n - 1:
                return order

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """before[symbol] + the occurrences of symbol in the transform before row."""
        at, begin = row.copy(), np.zeros_like(row)
        for bit, zeros, ones in self.levels:
            one = (symbol >> bit) & 1 == 1
            at, begin = np.where(one, zeros + ones[at], at - ones[at]), np.where(one, zeros + ones[begin], begin - ones[begin])
        return self.before[symbol] + at - begin

    def search(self, phrases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The rows [lo, hi) of each phrase."""
        longest = max(map(len, phrases))
        padded = np.zeros((len(phrases), longest), np.int64)
        for i, p in enumerate(phrases):
            padded[i, : len(p)] = p[::-1] + 1
        length = np.array([len(p) for p in phrases])
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for k in range(longest):
            at = np.flatnonzero((length > k) & (lo < hi))
            lo[at], hi[at] = self.step(padded[at, k], lo[at]), self.step(padded[at, k], hi[at])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of the suffixes of some rows."""
        out, open_, row, walked = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            done = self.kept[row]
            out[open_[done]] = self.kept_at[self.kept_rank[row[done]]] + walked
            open_, row, walked = open_[~done], row[~done], walked + 1
            if len(open_):
                row = self.step(self.bwt[row], row)
        return out


class Phrases:
    """The distinct windows of benchmark items, as symbols, and the items that have each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        words = Words([t for _, t in items], ALNUM)
        ids, first = words.hashes(), words.first
        self.words = np.unique(ids)
        symbols = np.searchsorted(self.words, ids) + 1
        found: dict[bytes, set[str]] = {}
        for i, (item, _) in enumerate(items):
            own = symbols[first[i] : first[i + 1]]
            width = min(window, len(own))
            for k in range(len(own) - width + 1 if width else 0):
                found.setdefault(own[k : k + width].tobytes(), set()).add(item)
        self.phrases = [np.frombuffer(k, symbols.dtype) for k in found]
        self.items = [sorted(v) for v in found.values()]
        self.shortest = min(map(len, self.phrases), default=0)
        self.lengths = np.array([len(p) for p in self.phrases], np.int64)


def _occurrences(words: Words, bench: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(number of the phrase, number of its first word) of all occurrences in a shard."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not bench.phrases or not len(words):
        return none
    ids = words.hashes()
    symbol = np.searchsorted(bench.words, ids)
    symbol = np.where(bench.words[np.minimum(symbol, len(bench.words) - 1)] == ids, symbol + 1, 0)
    # stretches of benchmark words within a text, long enough
    text = words.text_of()
    cut = np.flatnonzero((symbol[1:] == 0) | (symbol[:-1] == 0) | (text[1:] != text[:-1])) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(symbol)]])
    good = (end - begin >= bench.shortest) & (symbol[begin] > 0)
    begin, end = begin[good], end[good]
    if not len(begin):
        return none
    size = end - begin + 1  # with a separator after each
    total = int(size.sum())
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)
    last = np.cumsum(size) - 1
    indexed = symbol[np.minimum(at, len(symbol) - 1)]
    indexed[last] = 0
    index = FMIndex(indexed, len(bench.words) + 1)
    lo, hi = index.search(bench.phrases)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return which, at[index.locate(rows)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans [from, to) in order, those that overlap or touch as one."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


_MADE = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text"]
_SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, clean_text string"


def _search(docs: DataFrame, items: list[tuple[str, bytes]], window: int, last: bool) -> DataFrame:
    """docs with what this block of items adds to _spans (words) and _items; with the results, if it is the last."""
    import pyarrow as pa
    from pyspark.sql.types import StructType, _parse_datatype_string

    own = [c for c in docs.columns if c not in ("_spans", "_items")]
    bench = docs.sparkSession.sparkContext.broadcast(items)
    kept = StructType([docs.schema[c] for c in own])
    added = _parse_datatype_string(_SCHEMA if last else "_spans array<struct<lo:long,hi:long>>, _items array<string>")

    def shard(batches):
        phrases = Phrases(bench.value, window)
        for b in bounded(batches, most=SHARD_BYTES):
            texts = text_bytes(b.column("text"))
            words = Words(texts, ALNUM)
            which, at = _occurrences(words, phrases)
            spans = [[(s["lo"], s["hi"]) for s in row or []] for row in b.column("_spans").to_pylist()]
            found = [set(row or []) for row in b.column("_items").to_pylist()]
            text_at = np.searchsorted(words.first, at, side="right") - 1
            for text, phrase, word in zip(text_at.tolist(), which.tolist(), at.tolist(), strict=True):
                lo = word - int(words.first[text])
                spans[text].append((lo, lo + int(phrases.lengths[phrase])))
                found[text].update(phrases.items[phrase])
            spans = [merged(s) for s in spans]
            columns = [b.column(c) for c in own]
            if not last:
                rows = [pa.array([[{"lo": lo, "hi": hi} for lo, hi in s] for s in spans], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))]
                yield pa.RecordBatch.from_arrays([*columns, *rows, pa.array([sorted(f) for f in found], pa.list_(pa.string()))], [*own, "_spans", "_items"])
                continue
            clean = []
            for i, text in enumerate(texts):
                if text is not None and spans[i]:
                    first, begin = int(words.first[i]), int(words.begin[i])
                    out, done = [], 0
                    for lo, hi in spans[i]:
                        out.append(text[done : int(words.starts[first + lo]) - begin])
                        done = int(words.ends[first + hi - 1]) - begin
                    text = b"".join([*out, text[done:]])
                clean.append(None if text is None else text.decode("utf-8", "replace"))
            n = np.diff(words.first).tolist()
            columns += [
                pa.array(n, pa.int64()),
                pa.array([sum(hi - lo for lo, hi in s) for s in spans], pa.int64()),
                pa.array([len(f) for f in found], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in found]),
                pa.array([bool(s) for s in spans], pa.bool_()),
                pa.array(clean, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*own, *_MADE])

    return docs.mapInArrow(shard, StructType([*kept.fields, *added.fields]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and clean_text.

    clean_text is the text without the merged spans of its hit words, spans
    from the first to the last character of their words.  Null texts have no
    words and stay null; items without words and items without an id never
    occur; equal items count by their distinct ids; repeated rows are judged
    alike.  Columns of docs with the names of the new ones are replaced.

    The benchmark is read in blocks of a bounded size (a single item is in one
    block), each of which searches all documents; with more than one, what was found is kept in the shared
    folder in between.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BENCHMARK_BYTES))
    docs = lean(docs).drop(*_MADE, "_spans", "_items").withColumn("_spans", F.lit(None).cast("array<struct<lo:long,hi:long>>")).withColumn("_items", F.lit(None).cast("array<string>"))
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).distinct()  # the rows of an id may be in several
        docs = _search(docs, [(r.item, bytes(r.text)) for r in mine.collect()], window, k == blocks - 1)
        if k < blocks - 1:
            docs = stage(docs, "searched")
    return docs
