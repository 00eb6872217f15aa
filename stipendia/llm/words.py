"""Words, lines and rolling hashes of whole Arrow columns of text, in numpy.

Texts are handled in slices of a few megabytes, so memory follows the slice and the longest
single text, never the number of rows of a batch. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
HASH_BYTES = 1 << 20
_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
GRAM_BASE = 0xD1342543DE82EF95
GRAM_INVERSE = pow(GRAM_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 byte values lie in the ranges, ends included."""
    member = np.zeros(256, bool)
    for low, high in ranges:
        member[low:high + 1] = True
    return member


#: Words of `[^\x20\x09-\x0D]+`: white space in ASCII ends them.
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, small letters, all beyond ASCII.
ALPHANUMERIC = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
NOT_NEWLINE = ~byte_class((0x0A, 0x0A))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables are kept, as long as they are short."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, HASH_BYTES)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if size <= 1 << 24:
            _powers[base] = table
    return table[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit hash over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Texts:
    """The bytes of some texts, one after another; text i is data[ends[i-1]:ends[i]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per byte, by text."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def folded(self) -> Texts:
        """With A-Z as a-z."""
        return Texts(LOWER[self.data], self.offsets)


@dataclass
class Words:
    """Words of some texts: their place in the bytes, their text's number and their hash."""

    texts: Texts
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=len(self.texts))

    def firsts(self) -> np.ndarray:
        """Number of the first word of each text, and of the end."""
        return np.concatenate([[0], np.cumsum(self.counts())])

    def grams(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of n words of one text."""
        if len(self) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = self.hashes if hashes is None else hashes
        inside = np.flatnonzero(self.text[:len(self) - n + 1] == self.text[n - 1:])
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(GRAM_BASE, len(h)), out=total[1:])
        whole = (total[inside + n] - total[inside]) * powers(GRAM_INVERSE, len(h))[inside]
        return inside, mixed(whole + np.uint64(n))

    def joined(self, first: int, n: int, separator: bytes = b" ") -> bytes:
        """n words from `first`, with one separator between them."""
        raw = self.texts.data
        return separator.join(
            raw[a:b].tobytes() for a, b in zip(self.starts[first:first + n],
                                               self.ends[first:first + n]))


def split(texts: Texts, member: np.ndarray, hashed: bool = True) -> Words:
    """Maximal runs of the bytes of a class, never across texts."""
    inside = member[texts.data]
    n = len(inside)
    begins, ends = inside.copy(), inside.copy()
    edge = texts.offsets[(texts.offsets > 0) & (texts.offsets < n)]
    follows = np.zeros(n, bool)
    follows[1:] = inside[:-1]
    follows[edge] = False
    begins &= ~follows
    goes_on = np.zeros(n, bool)
    goes_on[:-1] = inside[1:]
    goes_on[edge - 1] = False
    ends &= ~goes_on
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    number = np.searchsorted(texts.offsets, first, side="right") - 1
    hashes = hash_runs(texts.data, first, last) if hashed else np.zeros(0, np.uint64)
    return Words(texts, first, last, number, hashes)


def hash_runs(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of each disjoint run of bytes; about a megabyte of them at a time."""
    out = np.zeros(len(first), np.uint64)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(last, first[at] + HASH_BYTES, side="right")))
        low, high = int(first[at]), int(last[to - 1])
        values = np.zeros(high - low + 1, np.uint64)
        np.multiply(BYTE_VALUES[data[low:high]], powers(BASE, high - low), out=values[:-1])
        np.cumsum(values[:-1], out=values[:-1])
        begin, end = first[at:to] - low, last[at:to] - low
        before = np.where(begin > 0, values[begin - 1], np.uint64(0))
        out[at:to] = (values[end - 1] - before) * powers(INVERSE, high - low)[begin]
        at = to
    return mixed(out + (last - first).astype(np.uint64))


def text_of(column: pa.Array) -> Texts:
    """The bytes of a string column without nulls, as they lie in memory."""
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize)
    ends = ends.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else \
        np.zeros(0, np.uint8)
    return Texts(raw[ends[0]:ends[-1]], ends - ends[0])


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Pieces of batches of about `limit` bytes of text, at least one row each."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).fill_null("")
        ends = text_of(column).offsets
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), text_of(column.slice(at, to - at))
            at = to


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def covered(n: int, first: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in a run of the given length from one of the first places."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, np.minimum(first + length, n), -1)
    return np.cumsum(steps[:-1]) > 0


def code_points(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a character."""
    return (data & 0xC0) != 0x80


def per_text(words: Words, values: np.ndarray) -> np.ndarray:
    """Sum by text of a value per word."""
    return np.bincount(words.text, weights=values, minlength=len(words.texts)).astype(np.int64)


def sliding(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """Smallest or largest of every `width` neighbours, in about log2(width) passes."""
    out, size = values, 1
    while size * 2 <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return best(out[:-rest], out[rest:]) if rest else out


def winnowed(words: Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the word runs that are smallest in a window of neighbouring runs.

    Any gram + window - 1 consecutive words of a text hold at least one of them. Shorter texts
    have none. All runs of a tie are kept.
    """
    span = gram + window - 1
    if len(words) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first, hashes = words.grams(gram)
    dense = np.full(len(words) - gram + 1, np.iinfo(np.uint64).max)
    dense[first] = hashes
    least = sliding(np.minimum, dense, window)
    least[words.text[:len(least)] != words.text[span - 1:]] = 0
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least,
                             np.zeros(window - 1, np.uint64)])
    kept = np.flatnonzero(sliding(np.maximum, padded, window)[:len(dense)] == dense)
    kept = kept[words.text[kept] == words.text[kept + gram - 1]]
    return kept, dense[kept]


def compact(words: Words, kept: np.ndarray) -> Texts:
    """The kept words of each text with one space between them."""
    chosen = np.flatnonzero(kept)
    owner = words.text[chosen]
    more = np.zeros(len(chosen), bool)
    more[:-1] = owner[1:] == owner[:-1]
    sizes = words.ends[chosen] - words.starts[chosen] + more
    ends = np.concatenate([[0], np.cumsum(sizes)])
    source = np.repeat(words.starts[chosen] - ends[:-1], sizes) + np.arange(ends[-1])
    data = np.append(words.texts.data, np.uint8(0x20))[source]
    data[ends[1:][more] - 1] = 0x20
    counts = np.bincount(owner, minlength=len(words.texts))
    return Texts(data, ends[np.concatenate([[0], np.cumsum(counts)])])


def pieces(texts: Texts) -> list[bytes]:
    raw = texts.data.tobytes()
    return [raw[a:b] for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist())]
