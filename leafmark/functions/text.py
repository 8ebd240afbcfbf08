"""Text functions; those below the line need Python and run on Arrow batches."""

from __future__ import annotations

import difflib
import hashlib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: Advance widths of the metric that all layout here uses: characters of ASCII, and all others.
NARROW, WIDE = 6, 12


#: Marks after which a word on the next line is parted by a space.  Fixed values.
CLOSING = ",;:!?.)]}\"'”’"


def width(text: Column) -> Column:
    """The sum of the advances."""
    return F.lit(WIDE) * F.char_length(text) - F.lit(WIDE - NARROW) * F.char_length(F.regexp_replace(text, r"[^\x00-\x7F]+", ""))


def occurrences(text: Column, needle: Column) -> Column:
    """How often the needle begins in the text; occurrences may overlap.  An empty needle: null."""
    quoted = F.regexp_replace(needle, r"([^\p{L}\p{N}\s])", r"\\$1")
    return F.when(needle != "", F.regexp_count(text, F.concat(F.lit("(?="), quoted, F.lit(")"))))


def digest(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of the columns: fields in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def separator(left: Column, right: Column) -> Column:
    """What joins two lines that a soft wrap parts: a space between words, nothing between others."""
    last, first = F.right(left, F.lit(1)), F.left(right, F.lit(1))
    word = r"^[\p{IsLatin}\p{N}]$"
    closing = F.array(*[F.lit(c) for c in CLOSING])
    return F.when((left == "") | (right == ""), F.lit("")).when(last.rlike(r"^\s$") | first.rlike(r"^\s$"), F.lit(" ")).when(
        first.rlike(word) & (last.rlike(word) | F.array_contains(closing, last)), F.lit(" ")
    ).otherwise(F.lit(""))


def first_match(text: Column, phrases: list[tuple[str, str]], default: str = "other") -> Column:
    """The class of the first phrase, in order, that the text contains."""
    out = F
    for phrase, name in phrases:
        out = out.when(F.contains(text, F.lit(phrase)), F.lit(name))
    return out.otherwise(F.lit(default))


# -- Python -----------------------------------------------------------------


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC without white space."""
    return text.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", t).split()))


@F.pandas_udf(ArrayType(IntegerType()))
def grapheme_starts(text: pd.Series) -> pd.Series:
    """The code-point offsets at which grapheme clusters begin, and the length."""
    import regex

    cluster = regex.compile(r"\X")
    return text.map(lambda t: None if t is None else [m.start() for m in cluster.finditer(t)] + [len(t)])


def normalized(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nfkc_sha256, n_graphemes): the digest of each text after NFKC without white space, and its grapheme clusters; a text at a time, and clusters are counted, not listed."""

    def work(batches):
        import pyarrow as pa
        import regex

        cluster = regex.compile(r"\X")
        for batch in batches:
            digests, counts = [], []
            for t in batch.column("text"):
                t = t.as_py()
                if t is None:
                    digests.append(None)
                    counts.append(None)
                    continue
                plain = t.isascii()  # of ASCII only CR LF is a cluster of two
                digests.append(hashlib.sha256("".join((t if plain else unicodedata.normalize("NFKC", t)).split()).encode()).hexdigest())
                counts.append(len(t) - t.count("\r\n") if plain else sum(1 for _ in cluster.finditer(t)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(digests, pa.string()), pa.array(counts, pa.int64())], ["key", "nfkc_sha256", "n_graphemes"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, f"key {kind}, nfkc_sha256 string, n_graphemes long")


_BLOCKS = StructType()
for _name in ("kept", "removed", "inserted", "replaced"):
    _BLOCKS = _BLOCKS.add(_name, IntegerType())


#: Ranges of fewer pairs of characters are left to difflib; those of up to so many have their equal runs listed once, and larger ones are searched by hashes.
PAIRS, LISTED = 1 << 14, 1 << 17
#: Runs that are gone through one by one.
FEW_RUNS = 48
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _hashes(text: str):
    """The code points of a text, and a function of (lo, hi, length): hashes of the substrings of that length that begin in lo..hi - length."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    power = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(points), base, np.uint64)]), dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * power(_BASE)[:-1], dtype=np.uint64)])
    back = power(_INVERSE)
    return lambda lo, hi, n: (total[lo + n : hi + 1] - total[lo : hi - n + 1]) * back[lo : hi - n + 1]


def _listed_blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """The blocks of two arrays of code points, found among all maximal runs of equal ones along their diagonals, which are cut where a block divides the range."""
    n, m = len(a), len(b)
    i, j = np.divmod(np.flatnonzero(a[:, None] == b[None, :]), m)
    along = np.sort((j - i + n) * (n + 1) + i)  # places of a diagonal follow each other; its ends are apart
    first = np.flatnonzero(np.diff(along, prepend=-2) != 1)
    d, i = np.divmod(along[first], n + 1)
    out, todo = [], [(i, d + i - n, np.diff(first, append=len(along)))]
    while todo:
        i, j, size = todo.pop()
        if len(size) > FEW_RUNS:
            # the longest, then the first in a, then in b
            at = int(np.argmax((size * (n + 1) + n - i) * (m + 1) + m - j))
            x, y, k = int(i[at]), int(j[at]), int(size[at])
            before, after = np.minimum(size, np.minimum(x - i, y - j)), np.maximum(0, np.maximum(x + k - i, y + k - j))
            lo, hi = before > 0, after < size
            todo += [(i[lo], j[lo], before[lo]), ((i + after)[hi], (j + after)[hi], (size - after)[hi])]
            out.append((x, y, k))
            continue
        small = [list(zip(i.tolist(), j.tolist(), size.tolist(), strict=True))]
        while small:
            runs = small.pop()
            if not runs:
                continue
            x, y, k = min(runs, key=lambda r: (-r[2], r[0], r[1]))
            out.append((x, y, k))
            if len(runs) > 1:
                small.append([(p, q, min(c, x - p, y - q)) for p, q, c in runs if p < x and q < y])
                cut = [(p, q, c, max(0, x + k - p, y + k - q)) for p, q, c in runs]
                small.append([(p + t, q + t, c - t) for p, q, c, t in cut if t < c])
    return out


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """The (start in a, start in b, length) that difflib.SequenceMatcher(None, a, b, autojunk=False) matches, adjacent ones unmerged.

    The longest match of a large range is searched by its length: substrings
    of a length are compared by hashes, and the match that is found letter by
    letter.  In a range of LISTED pairs it is taken from a list of all equal runs.
    """
    if a == b:
        return [(0, 0, len(a))] if a else []
    of_a = of_b = points = None
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        i, pairs = None, (a1 - a0) * (b1 - b0)
        if PAIRS < pairs <= LISTED:
            points = points or [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b)]
            out += [(a0 + i, b0 + j, n) for i, j, n in _listed_blocks(points[0][a0:a1], points[1][b0:b1])]
            continue
        if pairs > LISTED:
            of_a, of_b = of_a or _hashes(a), of_b or _hashes(b)
            low, high = 0, min(a1 - a0, b1 - b0)
            while low < high:
                n = (low + high + 1) // 2
                low, high = (n, high) if np.isin(of_a(a0, a1, n), of_b(b0, b1, n)).any() else (low, n - 1)
            if not low:
                continue
            left, right = of_a(a0, a1, low), of_b(b0, b1, low)
            x = int(np.argmax(np.isin(left, right)))
            y = int(np.argmax(right == left[x]))
            if a[a0 + x : a0 + x + low] == b[b0 + y : b0 + y + low]:
                i, j, n = a0 + x, b0 + y, low
        if i is None:
            out += [(a0 + i, b0 + j, n) for i, j, n in difflib.SequenceMatcher(None, a[a0:a1], b[b0:b1], autojunk=False).get_matching_blocks() if n]
            continue
        out.append((i, j, n))
        todo += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    return sorted(out)


def aligned(a: str | None, b: str | None) -> tuple[int, int, int, int]:
    """Characters kept, removed, inserted and replaced between two texts, in the blocks of a longest-match alignment."""
    a, b = a or "", b or ""
    kept = removed = inserted = replaced = i = j = 0
    for x, y, n in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        if i < x and j < y:
            replaced += y - j
        else:
            removed, inserted = removed + x - i, inserted + y - j
        kept, i, j = kept + n, x + n, y + n
    return kept, removed, inserted, replaced


@F.pandas_udf(_BLOCKS)
def alignment(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """aligned() of two columns."""
    return pd.DataFrame([aligned(a, b) for a, b in zip(before, after, strict=True)], columns=["kept", "removed", "inserted", "replaced"])
