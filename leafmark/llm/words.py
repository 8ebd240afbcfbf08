"""Words of many whole texts at once, their hashes, and hashes of windows of words.

Everything works on UTF-8 bytes: the separators of the operators' patterns
are ASCII, so no text is decoded, and lower-casing A to Z is a byte map.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers, one a position in a window, from a fixed seed.
_MULTIPLIERS = np.random.default_rng(20240229).integers(1 << 62, 1 << 63, size=(2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Separators of [^x20 x09-x0D]+.
PLAIN = bytes(range(256))
#: The same with A to Z as lower case.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: For [^x00-x2F x3A-x60 x7B-x7F]+ after lower-casing A to Z: all other characters become spaces.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words of more bytes than this are hashed one by one.
_LANES = 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Of a lane, the bytes that belong to the word.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_SALT = mix(np.arange(1, 65, dtype=np.uint64))


class Words:
    """The words of a list of UTF-8 texts (None: no words), end to end.

    starts, ends: where each word lies in data.  first: the number of the
    first word of each text, and at the end the number of all words.
    """

    def __init__(self, texts: list[bytes | None], alphabet: bytes = PLAIN):
        data = b"\n".join(t or b"" for t in texts) + b"\n"
        self.data = data if alphabet is PLAIN else data.translate(alphabet)
        space = _IS_SPACE[np.frombuffer(self.data, np.uint8)]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2].copy(), edge[1::2].copy()
        lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        self.begin = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.starts, self.begin)

    def __len__(self) -> int:
        return len(self.starts)

    def of(self, text: int) -> list[bytes]:
        """The words of a text."""
        return self.data[self.begin[text] : self.begin[text + 1]].split()

    def text_of(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, row: int = 0) -> np.ndarray:
        """64-bit hashes of the words, by eight bytes at a time; rows are independent."""
        size = self.ends - self.starts
        h = mix(size.astype(np.uint64) + _SALT[row])
        lanes = np.ndarray((len(self.data),), "<u8", self.data + bytes(8), strides=(1,))
        at = np.flatnonzero(size <= 8 * _LANES)
        at, starts, left, own = (None, self.starts, size, h) if len(at) == len(size) else (at, self.starts[at], size[at], h[at])
        for k in range(_LANES):
            if k:
                more = np.flatnonzero(left > 8)
                if not len(more):
                    break
                at = more if at is None else at[more]
                starts, left, own = starts[more] + 8, left[more] - 8, h[at]
            lane = lanes[starts] & _MASKS[np.minimum(left, 8)]
            lane ^= own
            lane *= _MULTIPLIERS[row, k]
            lane += _SALT[32 + k % 32]
            own = mix(lane)
            if at is None:
                h = own
            else:
                h[at] = own
        for i in np.flatnonzero(size > 8 * _LANES):
            h[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]], row)
        return h


def window_hashes(ids: np.ndarray, length: int, row: int = 0) -> np.ndarray:
    """64-bit hashes of all windows of so many ids; empty if there are fewer ids."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, term = np.zeros(n, np.uint64), np.empty(n, np.uint64)
    for j in range(length):
        np.multiply(ids[j : j + n], _MULTIPLIERS[row, j], out=term)
        h += term
    return mix(h)


def window_hashes_at(ids: np.ndarray, starts: np.ndarray, length: int, row: int = 0) -> np.ndarray:
    """window_hashes() of the windows that start there."""
    h = np.zeros(len(starts), np.uint64)
    for j in range(length):
        h += ids[starts + j] * _MULTIPLIERS[row, j]
    return mix(h)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order and how often each occurs."""
    values = np.sort(values)
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return values[begin], np.diff(np.concatenate([begin, [len(values)]]))


def places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and for each value its place among them."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(values) else np.empty(0, bool)
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def inner_windows(first: np.ndarray, length: int) -> np.ndarray:
    """The starts of all windows that lie within one text, given the first words of the texts."""
    counts = np.maximum(0, np.diff(first) - length + 1)
    if not counts.sum():
        return np.empty(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(first[:-1] - before, counts) + np.arange(counts.sum())


def text_bytes(column) -> list[bytes | None]:
    """The values of an Arrow string column as UTF-8, without decoding."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def bounded(batches, column: str = "text", most: int = 4 << 20):
    """The rows of Arrow batches in slices of about so many bytes of text, and of one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        part = np.cumsum(size) // most
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cut, cut[1:], strict=False):
            if hi > lo:
                yield batch.slice(lo, hi - lo)
