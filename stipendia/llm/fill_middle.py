"""Fill-in-the-middle: whole texts cut at two units and put together in another order.

A unit is a word with the white space before it, or white space at the end of a text. Every text
is cut into blocks of BLOCK bytes; a Fenwick tree over its blocks holds how many units end and how
many code points begin in them. To find a cut, a descent by powers of two goes to the block in which
the wanted unit ends, adding up code points on its way, and only that block is searched. The
trees of all texts of a slice lie in one array, and all cuts go down together in numpy, in the
tasks that read the texts; nothing is shuffled.

Forms: `psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle, `plain` the text as it
is. Cuts and form follow from a digest of seed and id, so a task that runs again gives the same rows.

Defined cases: a null text is an empty one, and an empty text is plain; a text that holds a marker is
plain, so the others can be taken apart again; a null id is digested as no digits; repeated rows come out
alike; an empty table gives an empty table; input columns with the name of a result column give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipendia.llm import words as W

BLOCK = 256
#: The markers, and the seed and the shares in percent of the usual transformation.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, CHANGED, SUFFIX_FIRST = 42, 50, 80
ADDED = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint"}


class BlockTrees:
    """One Fenwick tree for each text over its blocks, with several counts a block."""

    def __init__(self, texts: W.Texts, *flags: np.ndarray) -> None:
        """`flags`: for each count, the bytes that it counts."""
        sizes = -(-np.diff(texts.offsets) // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.begins = np.repeat(texts.offsets[:-1], sizes) + BLOCK * self._number(sizes)
        rank = self._number(sizes) + 1
        reach = np.arange(len(rank)) + 1
        self.trees = []
        for flag in flags:
            counts = np.add.reduceat(flag, self.begins, dtype=np.int64) if len(rank) else np.zeros(0, np.int64)
            total = np.concatenate([[0], np.cumsum(counts)])
            # A node sums as many blocks up to its own as its lowest set bit says.
            self.trees.append(total[reach] - total[reach - (rank & -rank)])

    @staticmethod
    def _number(sizes: np.ndarray) -> np.ndarray:
        """Each block's number in its text."""
        return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def descend(self, text: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The block of each text in which the first count reaches `wanted`, from 1 up, and all
        counts of the blocks before it."""
        first, size = self.first[text], np.diff(self.first)[text]
        block = np.zeros(len(text), np.int64)
        before = [np.zeros(len(text), np.int64) for _ in self.trees]
        step = 1 << int(size.max(initial=0)).bit_length()
        while step := step >> 1:
            at = first + np.minimum(block + step, size) - 1
            go = (block + step <= size) & (before[0] + self.trees[0][at] < wanted)
            for total, tree in zip(before, self.trees):
                total += np.where(go, tree[at], 0)
            block += np.where(go, step, 0)
        return block, before


class Units:
    """The units of some texts, with cuts by number of units."""

    def __init__(self, texts: W.Texts) -> None:
        self.texts = texts
        words = W.split(texts, W.NON_SPACE, hashed=False)
        self.last = np.zeros(len(texts.data), np.int8)
        self.last[words.ends - 1] = 1
        full = np.flatnonzero(np.diff(texts.offsets))
        self.last[texts.offsets[full + 1] - 1] = 1
        self.begin = W.code_points(texts.data).astype(np.int8)
        self.counts = texts.sums(self.last)
        self.trees = BlockTrees(texts, self.last, self.begin)

    def cut(self, text: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and code points of each of the texts that its first units have."""
        size, chars = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        some = np.flatnonzero(units)
        block, (passed, points) = self.trees.descend(text[some], units[some])
        at = self.trees.begins[self.trees.first[text[some]] + block]
        # The end of the unit lies in this block: look at its bytes only.
        place = at[:, None] + np.arange(BLOCK)
        inside = place < self.texts.offsets[text[some] + 1][:, None]
        place = np.where(inside, place, 0)
        seen = np.cumsum(self.last[place] * inside, axis=1) + passed[:, None]
        end = np.argmax(seen == units[some][:, None], axis=1)
        ahead = np.cumsum(self.begin[place] * inside, axis=1)
        size[some] = at + end + 1 - self.texts.offsets[text[some]]
        chars[some] = points + ahead[np.arange(len(some)), end]
        return size, chars


def numbers(seed: int, doc: int | None) -> np.ndarray:
    """Four numbers below 2**32 from a digest of seed and id."""
    text = f"{seed}:{'' if doc is None else doc}"
    return np.frombuffer(hashlib.sha256(text.encode()).digest()[:16], ">u4").astype(np.int64)


def transform(texts: W.Texts, ids: list, seed: int, changed: int, suffix_first: int) -> pa.RecordBatch:
    """New texts, units, form, and code points of prefix and middle."""
    units = Units(texts)
    raw = W.pieces(texts)
    drawn = np.array([numbers(seed, i) for i in ids], np.int64).reshape(-1, 4)
    marked = np.array([any(m.encode() in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in raw], bool)
    chosen = np.flatnonzero((units.counts > 0) & ~marked & (drawn[:, 2] % 100 < changed))
    places = np.sort(drawn[chosen, :2] % (units.counts[chosen, None] + 1), axis=1)
    size, chars = units.cut(np.repeat(chosen, 2), places.ravel())
    forms = np.full(len(raw), "plain", object)
    forms[chosen] = np.where(drawn[chosen, 3] % 100 < suffix_first, "spm", "psm")
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    prefix_chars, middle_chars = [None] * len(raw), [None] * len(raw)
    for i, (a, b), (x, y) in zip(chosen.tolist(), size.reshape(-1, 2).tolist(), chars.reshape(-1, 2).tolist()):
        text = raw[i]
        parts = (s, text[b:], p, text[:a], m, text[a:b]) if forms[i] == "spm" else \
            (p, text[:a], s, text[b:], m, text[a:b])
        raw[i] = b"".join(parts)
        prefix_chars[i], middle_chars[i] = x, y - x
    return pa.RecordBatch.from_arrays(
        [pa.array(raw, pa.binary()).cast(pa.string()), pa.array(units.counts),
         pa.array(forms, pa.string()), pa.array(prefix_chars, pa.int64()),
         pa.array(middle_chars, pa.int64())], names=["_out", *ADDED])


def transformed(docs: DataFrame, id_column: str = "doc_id", text: str = "text", seed: int = SEED,
                changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The documents with their new texts, and n (units), form, prefix_chars, middle_chars."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in W.slices(batches, "_text"):
            ids = part.column("_id").to_pylist()
            found = transform(texts, ids, seed, changed, suffix_first)
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], *found.columns],
                                             names=[*part.schema.names[:-2], *found.schema.names])

    kept = [c for c in docs.columns if c not in ADDED and c != text]
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    column = {name: plain[f"c{i}"] for i, name in enumerate(docs.columns)}
    ready = plain.select(*(column[c] for c in kept), column[id_column].cast("long").alias("_id"),
                         column[text].cast("string").alias("_text"))
    passed = [f"{f.name} {f.dataType.simpleString()}" for f in ready.schema.fields[:-2]]
    added = ["_out string", *(f"{n} {t}" for n, t in ADDED.items())]
    found = ready.mapInArrow(rows, ", ".join([*passed, *added])).toDF(*kept, text, *ADDED)
    order = [c for c in docs.columns if c not in ADDED]
    return found.select(*(f"`{c}`" for c in [*order, *ADDED]))


def restored(text: Column, form: Column) -> Column:
    """The text that was transformed, from what came out and its form."""
    def between(first: str, second: str) -> Column:
        begin = F.locate(first, text) + len(first)
        return F.substr(text, begin, F.locate(second, text) - begin)

    middle = F.substr(text, F.locate(MIDDLE, text) + len(MIDDLE))
    return (F.when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
            .when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
            .otherwise(text))
