"""Spelling variants: all pairs of words that differ by one code point, by merging errata into tries.

Words of at least LEAST code points that differ by one inserted, deleted or
replaced code point share their first ROOT code points or their last: so the
words are put into tries by their first ROOT, and, read backwards, into tries
by their last; the latter count only pairs whose edit lies in the first ROOT.
A pair with the edit in a run of equal letters counts at the end of the run.

In a trie (a sorted array of its words) the largest child of a node is heavy,
the others are light.  Words of light children are merged into the node with
one character replaced (they meet each other and the heavy child where the
rest coincides), with their own character skipped, and with the heavy
character skipped; the heavy child itself is never moved.  A word is in a
light child at most log2(words) times, so the work is words times that.

A trie of too many words is cut deeper, and the nodes above the cut are merged
by a shuffle on the errata themselves, each of which has at most as many words
as the alphabet has letters.  No list of pairs is made: what leaves a trie is,
for each word, how many near words it has and which of them is the most frequent.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.components import attach
from leafmark.llm.shared import Scratch, lean, stage
from leafmark.llm.words import LOWER, bounded, text_bytes

#: Code points of a word, occurrences of it, and how many times as frequent a form is, at least.
LEAST, TWICE, RATIO = 7, 2, 10
#: Of 31 hash values one deletes a code point.
ERRATUM = 31
#: Code points that the words of a trie share at least; 2 * ROOT < LEAST.
ROOT = 3
#: Words of a trie (a word counts once more for each 64 bytes), at most and, for a share of 1 / 64 of all words, at least.
TRIE, SMALL_TRIE = 65_536, 4096
#: Words that a task counts before it hands them on.
HELD = 200_000

_NEAR = "word string, n long, near long, best_n long, best string"


#: Bytes of runs of letters after lower-casing A to Z: a to z, and 0xC3 with the byte after it, which are U+00C0 to U+00FF.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), 0xC3]] = True


def _runs(texts: list[bytes | None]):
    """For each text its runs of at least LEAST letters, in lower case, as UTF-8."""
    data = (b"\n".join(t or b"" for t in texts) + b"\n").translate(LOWER)
    values = np.frombuffer(data, np.uint8)
    inside, lead = _LETTER[values], values == 0xC3
    inside[1:] |= lead[:-1]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    wide = np.flatnonzero(lead)
    points = ends - starts - (np.searchsorted(wide, ends) - np.searchsorted(wide, starts))
    starts, ends = starts[points >= LEAST], ends[points >= LEAST]
    begin = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
    own = np.searchsorted(starts, begin)
    for lo, hi in zip(own, own[1:], strict=False):
        yield [data[a:b] for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]


def _count(batches):
    """The words of texts, with the errata that the hash asks for, and how often each occurs here."""
    import pyarrow as pa

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    found: Counter[bytes] = Counter()
    for batch in bounded(batches):
        for doc_id, runs in zip(batch.column("doc_id").to_pylist(), _runs(text_bytes(batch.column("text"))), strict=True):
            seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(runs).items():
                h = zlib.crc32(run, seed)
                if h % ERRATUM == 0:
                    word = run.decode()
                    k = h % len(word)
                    if len(word) == LEAST:
                        continue
                    run = (word[:k] + word[k + 1 :]).encode()
                found[run] += n
            if len(found) > HELD:
                yield out(found)
                found = Counter()
    yield out(found)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct words of at least LEAST code points and TWICE occurrences; counts are combined before the shuffle."""
    counted = lean(docs).select("doc_id", "text").mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TWICE)


def _deeper(depth: int) -> int:
    return depth + max(1, depth // 2)


def _early(word: str, at: int) -> bool:
    """Whether a word read backwards that loses its character there has lost one of its first ROOT, counted at the end of the run."""
    low = len(word) - ROOT
    return at >= low and word[low - 1 : at + 1] != word[at] * (at + 2 - low)


class Trie:
    """A trie as its sorted words; near, best: how many near words each has, and the most frequent (-n, word)."""

    def __init__(self, words: list[str], counts: list[int], backwards: bool):
        self.words, self.counts, self.backwards = words, counts, backwards
        self.index = {w: i for i, w in enumerate(words)}
        self.near, self.best = [0] * len(words), [None] * len(words)

    def _meet(self, i: int, j: int) -> None:
        for a, b in ((i, j), (j, i)):
            self.near[a] += 1
            # read backwards the words are compared as they are read forwards
            own = (-self.counts[b], self.words[b][::-1] if self.backwards else self.words[b])
            if self.best[a] is None or own < self.best[a]:
                self.best[a] = own

    def _skipped(self, shorter: int, longer: str, depth: int) -> None:
        j = self.index.get(longer)
        if j is not None and (not self.backwards or _early(longer, depth)):
            self._meet(shorter, j)

    def _merge(self, i: int, depth: int, heavy: str, merged: dict[str, list[int]]) -> None:
        """A word of a light child goes into the node: replaced, its own character skipped, the heavy one skipped."""
        word = self.words[i]
        if self.backwards and depth < len(word) - ROOT:
            return
        before, own, rest = word[:depth], word[depth], word[depth + 1 :]
        j = self.index.get(before + heavy + rest)
        if j is not None:
            self._meet(i, j)
        others = merged.setdefault(rest, [])  # one for each letter at most
        for j in others:
            self._meet(i, j)
        others.append(i)
        if rest[:1] != own:
            j = self.index.get(before + rest)
            if j is not None and (not self.backwards or _early(word, depth)):
                self._meet(i, j)
        self._skipped(i, before + heavy + word[depth:], depth)

    def merge(self, root: int) -> None:
        """Find all near pairs whose edit lies at this depth or deeper."""
        words, stack = self.words, [(0, len(self.words), root)]
        while stack:
            lo, hi, depth = stack.pop()
            if hi - lo < 2:
                continue
            first, last = words[lo], words[hi - 1]
            most = min(len(first), len(last))
            while depth < most and first[depth] == last[depth]:
                depth += 1
            ends = len(first) == depth
            prefix, children, at = first[:depth], [], lo + ends
            while at < hi:
                letter = words[at][depth]
                to = bisect_left(words, prefix + chr(ord(letter) + 1), at, hi)
                children.append((to - at, at, to, letter))
                at = to
            _, heavy_lo, _, heavy = max(children)
            if ends:
                self._skipped(lo, first + heavy, depth)
            merged: dict[str, list[int]] = {}
            for _, at, to, _ in children:
                if at != heavy_lo:
                    for i in range(at, to):
                        self._merge(i, depth, heavy, merged)
                stack.append((at, to, depth))


def _near(batches):
    """The near words of each trie in rows (back, trie, depth, w, n) that are sorted by trie and word."""
    import pyarrow as pa

    def out(key, words, counts):
        trie = Trie(words, counts, key[0])
        trie.merge(key[2])
        hit = [i for i, k in enumerate(trie.near) if k]
        own = [words[i][::-1] if key[0] else words[i] for i in hit]
        columns = [own, [0] * len(hit), [trie.near[i] for i in hit], [-trie.best[i][0] for i in hit], [trie.best[i][1] for i in hit]]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n", "near", "best_n", "best"])

    key, words, counts = None, [], []
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("back", "trie", "depth", "w", "n")), strict=True)
        for back, trie, depth, w, n in rows:
            if (back, trie, depth) != key:
                if len(words) > 1:
                    yield out(key, words, counts)
                key, words, counts = (back, trie, depth), [], []
            words.append(w)
            counts.append(n)
    if len(words) > 1:
        yield out(key, words, counts)


def _errata(batches):
    """For the words of tries that are cut deeper, their errata at the depths above the cut: (erratum, role, word, n)."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for back, depth, w, n in zip(*(batch.column(c).to_pylist() for c in ("back", "depth", "w", "n")), strict=True):
            word, side = w[::-1] if back else w, "b" if back else "f"
            out.append((f"{side}-{w}", "shorter", word, n))
            for d in range(ROOT, min(depth, len(w))):
                if back and d < len(w) - ROOT:
                    continue
                out.append((f"{side}{d}:{w[:d]} {w[d + 1 :]}", "equal", word, n))
                if w[d + 1 : d + 2] != w[d] and (not back or _early(w, d)):
                    out.append((f"{side}-{w[:d]}{w[d + 1 :]}", "longer", word, n))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["erratum", "role", "word", "n"])


def _above(cut: DataFrame) -> DataFrame:
    """Near words by errata that coincide, for words of tries that are cut deeper; an erratum has as many words as there are letters, at most, for each of its places."""
    errata = cut.select("back", "depth", "w", "n").mapInArrow(_errata, "erratum string, role string, word string, n long")
    one = F.struct((-F.col("n")).alias("n"), "word")
    met = errata.groupBy("erratum").agg(F.sort_array(F.collect_list(F.when(F.col("role") != "shorter", one))).alias("many"), F.min(F.when(F.col("role") == "shorter", one)).alias("shorter"), F.first("role").alias("role"))
    equal = met.where("shorter is null and role = 'equal' and size(many) > 1").select("many", F.explode("many").alias("own"))
    other = F.when(F.col("own.word") == F.col("many")[0]["word"], F.col("many")[1]).otherwise(F.col("many")[0])
    equal = equal.select(F.col("own.word").alias("word"), (F.size("many") - 1).cast("long").alias("near"), other.alias("best"))
    skipped = met.where("shorter is not null and size(many) > 0")
    short = skipped.select("shorter.word", F.size("many").cast("long").alias("near"), F.col("many")[0].alias("best"))
    long = skipped.select("shorter", F.explode("many").alias("own")).select("own.word", F.lit(1).cast("long").alias("near"), F.col("shorter").alias("best"))
    return equal.unionAll(short).unionAll(long).select("word", F.lit(0).cast("long").alias("n"), "near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, best_n, best) of distinct words (word, n) of LEAST code points and more: how many near words each has, and of these the most frequent (of equals the first by code points)."""
    own = stage(words.select("word", "n"), "words")
    rows = own.select("n", F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("w")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("w")))).alias("x")).select("x.*", "n")
    weight = 1 + F.octet_length("w") / 64
    total = float(rows.agg(F.sum(weight)).first()[0] or 0) / 2
    most = max(SMALL_TRIE, min(TRIE, total / 64))
    dealt, depth = rows.withColumn("depth", F.lit(ROOT)), ROOT
    cut = False
    while True:  # by the logarithm of the longest prefix that too many words share
        at = dealt.where(F.col("depth") == depth).groupBy("back", F.substring("w", 1, depth).alias("p")).agg(F.sum(weight).alias("size")).where(F.col("size") > most).select("back", "p")
        hot = stage(at, "prefixes", 1)
        if hot.isEmpty():
            break
        cut = True
        hot = F.broadcast(hot.withColumn("hot", F.lit(True)))  # fewer than words / most
        found = dealt.withColumn("p", F.when(F.col("depth") == depth, F.substring("w", 1, depth))).join(hot, ["back", "p"], "left")
        depth = _deeper(depth)
        dealt = found.select("back", "w", "n", F.when(F.col("hot"), F.lit(depth)).otherwise(F.col("depth")).alias("depth"))
    keyed = dealt.withColumn("trie", F.expr("substring(w, 1, depth)"))
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(2 * total / 200_000))
    tries = keyed.repartition(parts, "back", "trie").sortWithinPartitions("back", "trie", "depth", "w")
    near = tries.select("back", "trie", "depth", "w", "n").mapInArrow(_near, _NEAR)
    if cut:
        near = near.unionAll(_above(dealt.where(F.col("depth") > ROOT)))
    every = own.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")).unionAll(near)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))))
    merged = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("near"), best.alias("b"))
    return merged.select("word", "n", "near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def follow(links: DataFrame) -> DataFrame:
    """(word, root) from links (word, root) without cycles: each link is followed to its last, twice as far a round."""
    with Scratch(links.sparkSession) as scratch:
        links = scratch.stage(links, "links")
        total = links.count()
        while True:
            often = links.groupBy(F.col("root").alias("at")).agg(F.count("*").alias("c"))
            facts = scratch.stage(links.select(F.col("word").alias("at"), F.col("root").alias("next")).join(often, "at"), "next")
            if facts.isEmpty():
                return stage(links, "roots")
            longer = attach(links.select("word", F.col("root").alias("at")), facts, ["at"], "c", total, "left")
            following = scratch.stage(longer.select("word", F.coalesce("next", "at").alias("root")), "links")
            scratch.drop(links, facts)
            links = following


def group(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n.

    Words are runs of letters of whole texts, those that the hash of
    `<doc_id>:<run>` chooses with one code point deleted.  A word's form is its
    most frequent near word where that has `ratio` times its n; root is where
    the forms lead.  Null and empty texts have no words; a null doc_id counts
    as an empty one in the hash; repeated rows are counted each; other columns
    are ignored; an empty table gives no rows.
    """
    found = stage(near_words(vocabulary(docs)), "near")
    formed = F.col("best_n") >= ratio * F.col("n")
    roots = follow(found.where(formed).select("word", F.col("best").alias("root")))
    words = found.select("word", F.when(formed, F.col("best")).alias("form"), "n", F.col("near").alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n"))
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
