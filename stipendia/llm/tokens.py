"""Token ids of whole texts with a public tokenizer, each different word encoded once per worker.

For tokenizers that drop white space and never join a run of letters, a digit or a run of
other signs with its neighbours (checked by probes), the ids of a text are those of its runs
one after another. Runs are cut on bytes for ASCII and Latin letters; a stretch between white
space with any other character goes to the tokenizer as a whole. For other tokenizers whole texts go.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np

from stipendia.llm import words as W

CACHE_ENTRIES = 1_000_000
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[0x21:0x7F] = SIGN
CLASSES[W.byte_class((0x41, 0x5A), (0x61, 0x7A))] = LETTER
CLASSES[0x30:0x3A] = DIGIT
CLASSES[W.byte_class((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x20))] = SPACE
# Contractions and special tokens begin with these; their whole stretch is encoded at once.
CLASSES[[ord("'"), ord("<")]] = OTHER
NOT_SPACE = CLASSES != SPACE
PROBES = ["hello", "A", "straße", "É", "7", "!!", "&&&", ".", "|", "no", "ÿ", "-", "é"]


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@cache
def splits(path: str) -> bool:
    """Whether runs can be encoded alone: probed with all pairs, with and without a space."""
    def ids(text: str) -> list[int]:
        return tokenizer(path).encode(text, add_special_tokens=False).ids

    letters = [p for p in PROBES if p.isalpha()]
    for a in PROBES:
        if ids(a) != ids(a.lower()):
            return False
        for b in PROBES:
            spaced = all(ids(f" {a}{gap}{b}\n") == ids(a) + ids(b) for gap in (" ", "\n", " \t"))
            alike = (a in letters) == (b in letters) and not (a.isdigit() or b.isdigit())
            if not spaced or not alike and ids(a + b) != ids(a) + ids(b):
                return False
    return True


class Known:
    """Ids of different runs by their hash; those not used for longest are forgotten first."""

    def __init__(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.begin, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)
        self.clock = 0

    def find(self, hashes: np.ndarray, encoded: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and begin and number in them for each of the hashes, which ascend.

        `encoded` gives the ids of those with the numbers it gets, and how many each has.
        """
        self.clock += 1
        at = np.searchsorted(self.hashes, hashes)
        old = np.append(self.hashes, np.uint64(0))[at] == hashes
        old &= at < len(self.hashes)
        new = np.flatnonzero(~old)
        ids, sizes = encoded(new)
        begin = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, ids])
        self.begin = np.insert(self.begin, at[new], begin)
        self.size = np.insert(self.size, at[new], sizes)
        self.used = np.insert(self.used, at[new], 0)
        self.hashes = np.insert(self.hashes, at[new], hashes[new])
        at = np.searchsorted(self.hashes, hashes)
        self.used[at] = self.clock
        out = self.ids, self.begin[at], self.size[at]
        if len(self.hashes) > CACHE_ENTRIES:
            self._forget()
        return out

    def _forget(self) -> None:
        kept = np.sort(np.argsort(-self.used, kind="stable")[:CACHE_ENTRIES // 2])
        ids = self.ids[spread(self.begin[kept], self.size[kept])]
        self.hashes, self.size, self.used = self.hashes[kept], self.size[kept], self.used[kept]
        self.begin, self.ids = np.cumsum(self.size) - self.size, ids


_known: dict[str, Known] = {}


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of some stretches, one stretch after another."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def encode(texts: W.Texts, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and the number of ids of each text."""
    if not splits(path):
        found = tokenizer(path).encode_batch([t.decode() for t in W.pieces(texts)],
                                             add_special_tokens=False)
        counts = np.array([len(f.ids) for f in found], np.int64)
        return np.array([i for f in found for i in f.ids], np.uint32), counts
    runs, plain = cut(texts)
    hashes, first, number = np.unique(runs.hashes, return_index=True, return_inverse=True)
    raw = runs.texts.data.tobytes()

    def encoded(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = first[new]
        pieces = [raw[a:b] for a, b in zip(runs.starts[place].tolist(), runs.ends[place].tolist())]
        return run_ids(pieces, plain[place], tokenizer(path))

    ids, begin, size = _known.setdefault(path, Known()).find(hashes, encoded)
    each = size[number]
    return ids[spread(begin[number], each)], W.per_text(runs, each)


def cut(texts: W.Texts) -> tuple[W.Words, np.ndarray]:
    """The runs to encode, in small letters; stretches with other characters are whole. And which
    runs are one run of letters or signs or one digit."""
    data = texts.data
    kind = CLASSES[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    latin = after & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
    kind[latin] = LETTER
    kind[np.flatnonzero(latin) - 1] = LETTER
    stretches = W.split(texts, NOT_SPACE, hashed=False)
    odd = np.concatenate([[0], np.cumsum(kind == OTHER)])
    whole = odd[stretches.ends] > odd[stretches.starts]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[stretches.starts[whole]] += 1
    inside[stretches.ends[whole]] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    begins = np.ones(len(data), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    begins &= (kind != SPACE) & ~inside
    begins[stretches.starts] = True
    starts = np.flatnonzero(begins)
    owner = np.searchsorted(stretches.starts, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), stretches.ends[owner])
    small = W.LOWER[data]
    small[latin & (data <= 0x9E)] += 0x20
    folded = W.Texts(np.where(inside, data, small), texts.offsets)
    return W.Words(folded, starts, ends, stretches.text[owner],
                   W.hash_runs(folded.data, starts, ends)), ~whole[owner]


def run_ids(runs: list[bytes], plain: np.ndarray, tool) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the runs one after another, and how many each has; plain ones in one go."""
    sizes = np.zeros(len(runs), np.int64)
    some = np.flatnonzero(plain)
    found = joined([runs[i] for i in some.tolist()], tool)
    rest = np.flatnonzero(~plain)
    if found is None:
        some, rest = rest[:0], np.arange(len(runs))
    listed = [f.ids for f in tool.encode_batch([runs[i].decode() for i in rest.tolist()],
                                               add_special_tokens=False)]
    sizes[rest] = [len(i) for i in listed]
    if found is not None:
        sizes[some] = found[1]
    begin = np.cumsum(sizes) - sizes
    ids = np.zeros(sizes.sum(), np.uint32)
    ids[spread(begin[rest], sizes[rest])] = [i for part in listed for i in part]
    if found is not None:
        ids[spread(begin[some], sizes[some])] = found[0]
    return ids, sizes


def joined(plain: list[bytes], tool) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids of runs encoded in one text, and how many each has; None unless every run is
    exactly one of its words."""
    if not plain:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    text = b" ".join(plain).decode()
    found = tool.encode(text, add_special_tokens=False)
    if not found.ids or None in found.word_ids:
        return None
    owner = np.array(found.word_ids, np.int64)
    at = np.searchsorted(owner, np.arange(len(plain) + 1))
    if owner[-1] != len(plain) - 1 or (np.diff(owner) < 0).any() or (np.diff(at) == 0).any():
        return None
    lengths = np.fromiter(map(len, map(bytes.decode, plain)), np.int64, len(plain))
    begins = np.cumsum(lengths + 1) - lengths - 1
    places = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(owner)).reshape(-1, 2)
    if (places[at[:-1], 0] != begins).any() or (places[at[1:] - 1, 1] != begins + lengths).any():
        return None
    return np.array(found.ids, np.uint32), np.diff(at)
