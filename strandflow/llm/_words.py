"""Words of whole texts as numpy arrays, read from Arrow's buffers.

A word is a run of bytes other than space and 0x09-0x0D; in UTF-8 these bytes never lie
inside another character, so a word of bytes is a word of code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MASK = (1 << 64) - 1
_PLACE = U(0x9E3779B97F4A7C15)
#: Texts are gathered up to about so many bytes; a longer text is read in pieces of this size.
PIECE = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hashes of words. Each eight bytes are mixed with their place before they are added up, so that no pattern of letters cancels out:
    different words are equal with a chance of about 2^-64 a pair."""
    if not len(starts):
        return np.zeros(0, U)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = _FOLD[buf] if fold else buf
    eight = np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))  # the eight bytes from every place on
    size = ends - starts
    parts = (size + 7) >> 3
    first = np.cumsum(parts) - parts
    number = np.arange(int(parts.sum())) - np.repeat(first, parts)
    x = eight[np.repeat(starts, parts) + 8 * number]
    last = first + parts - 1
    beyond = (8 * (8 * parts - size)).astype(U)  # bits after the word's end
    x[last] = (x[last] << beyond) >> beyond
    x = mix64(x + (number + 1).astype(U) * _PLACE)
    return mix64(np.add.reduceat(x, first) + size.astype(U) * U(0x2545F4914F6CDD1D))


@dataclass
class Texts:
    """Some consecutive rows: their bytes, the words' spans and hashes, and each row's first word."""

    first: int
    buf: np.ndarray
    offsets: np.ndarray  # of rows, in buf
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray | None
    words: np.ndarray  # row i has the words words[i]:words[i + 1]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.words))

    def kept_text(self, row: int, keep: np.ndarray | None = None) -> bytes:
        """The row's words (those where keep is true) joined by one space."""
        found = self.buf[self.offsets[row] : self.offsets[row + 1]].tobytes().split()
        return b" ".join(found if keep is None else [found[i] for i in np.flatnonzero(keep)])


def _spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~_SPACE[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    filled = offsets[:-1] < offsets[1:]
    at, to = offsets[:-1][filled], offsets[1:][filled] - 1
    first[at], last[to] = solid[at], solid[to]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _long(buf: np.ndarray, fold: bool, hashed: bool) -> tuple[np.ndarray, ...]:
    """Spans and hashes of one long text, by pieces that end at white space."""
    parts, at = [], 0
    while at < len(buf):
        to = min(len(buf), at + PIECE)
        if to < len(buf):
            gaps = np.flatnonzero(_SPACE[buf[at:to]])
            while not len(gaps) and to < len(buf):
                to = min(len(buf), to + PIECE)
                gaps = np.flatnonzero(_SPACE[buf[at:to]])
            to = at + int(gaps[-1]) + 1 if len(gaps) and to < len(buf) else to
        b = buf[at:to]
        s, e = _spans(b, np.array([0, len(b)]))
        parts.append((s + at, e + at, hash_spans(b, s, e, fold) if hashed else None))
        at = to
    none = np.zeros(0, np.int64)
    s, e = (np.concatenate([p[i] for p in parts] or [none]) for i in (0, 1))
    return s, e, np.concatenate([p[2] for p in parts] or [none.astype(U)]) if hashed else None


def byte_rows(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column (null: empty), and the rows' offsets in them."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(kind).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(kind) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def read_words(column: pa.Array | pa.ChunkedArray, fold: bool = False, hashed: bool = True) -> Iterator[Texts]:
    """The words of a text column (null: none), some rows at a time. fold: A-Z count as a-z in the hashes."""
    buf, offsets = byte_rows(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        b, o = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if j == i + 1 and len(b) > PIECE:
            s, e, h = _long(b, fold, hashed)
        else:
            s, e = _spans(b, o)
            h = hash_spans(b, s, e, fold) if hashed else None
        yield Texts(i, b, o, s, e, h, np.searchsorted(s, o))
        i = j


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys. A sort is several times as fast here as numpy's own way by hashing."""
    s = np.sort(keys)
    return s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of each key among them."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
    at = np.empty(len(s), np.int32)
    at[order] = np.cumsum(new) - 1
    return s[new], at


def window_hashes(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive words; runs that cross rows are included, callers leave them out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    odd = mix64(np.arange(1, width + 1, dtype=U) + U((salt * 0x9E3779B97F4A7C15) & _MASK)) | U(1)
    out = hashes[:n] * odd[0]
    for k in range(1, width):
        out += hashes[k : k + n] * odd[k]
    return mix64(out)


def windows_inside(words: np.ndarray, width: int, total: int) -> np.ndarray:
    """For each run's first word: whether the run lies within one row."""
    n = total - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    row_end = np.repeat(words[1:], np.diff(words))[:n]
    return np.arange(n) + width <= row_end
