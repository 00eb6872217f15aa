"""Runs of repeated words: stretches of a text with a period, and the text with one period of each.

A run is a longest stretch of words with smallest period q, of at least LEAST words and EXPONENT periods. Its
words overlap their copies q words on by `overlap()` words or more, so all its words lie in word groups of
that size that occur twice in the text. Groups are hashed in numpy; only stretches covered by repeated
groups, with two equal groups near enough to each other, go word by word through the automaton of
runs.py, which decides on the words themselves. Nothing is shuffled; a text is handled in the task that reads it,
with memory in proportion to its longest such stretch.

Defined cases: a null or empty text has no words and no run; rows that repeat an id are handled
each for itself; an empty table gives an empty table; input columns with the name of a result column give way
to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipendia.llm import words as W
from stipendia.llm.runs import runs

LEAST, EXPONENT = 24, 3
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
ADDED = {"n_words": "bigint", "runs": RUN}

#: Takes the id and number of words of a text; None, or the word of the text that stands at each place.
Order = Callable[[int | None, int], np.ndarray | None]


def overlap(least: int, exponent: int) -> int:
    """So many consecutive words of any run equal those one period on."""
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


def arranged(words: W.Words, ids: list, order: Order | None) -> W.Words:
    """The words in the order that `order` asks for, text by text."""
    if order is None:
        return words
    places, firsts = np.arange(len(words)), words.firsts().tolist()
    for doc, a, b in zip(ids, firsts[:-1], firsts[1:]):
        chosen = order(doc, b - a)
        if chosen is not None:
            places[a:b] = a + chosen
    return W.Words(words.texts, words.starts[places], words.ends[places], words.text, words.hashes[places])


def candidates(words: W.Words, least: int, exponent: int) -> list[tuple[int, int]]:
    """Stretches of words outside of which no run has a word; no run reaches over their ends."""
    size = overlap(least, exponent)
    first, keys = words.grams(size)
    keys = W.mixed(keys + words.text[first].astype(np.uint64) * np.uint64(W.BASE))
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    if not len(same):
        return []
    earlier, later = first[order[same]], first[order[same + 1]]
    inside = W.covered(len(words), np.unique(np.concatenate([earlier, later])), size)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | (words.text[1:] != words.text[:-1])
    ends[:-1] &= ~inside[1:] | (words.text[1:] != words.text[:-1])
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # A run of period q repeats its groups within q words, a share of its length.
    nearest = np.full(len(begin), len(words))
    np.minimum.at(nearest, np.searchsorted(begin, earlier, side="right") - 1, later - earlier)
    length = end - begin
    kept = (length >= least) & (exponent * nearest <= length)
    return list(zip(begin[kept].tolist(), end[kept].tolist()))


def found_in(words: W.Words, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs (text, start in the text, length, period), and the words that repeat a period of one."""
    found, gone = [], np.zeros(len(words) + 1, np.int64)
    raw, firsts = words.texts.data.tobytes(), words.firsts()
    for begin, end in candidates(words, least, exponent):
        numbers: dict[bytes, int] = {}
        sequence = [numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(
            words.starts[begin:end].tolist(), words.ends[begin:end].tolist())]
        text = int(words.text[begin])
        for start, length, period in runs(sequence, least, exponent):
            found.append((text, begin + start - firsts[text], length, period))
            gone[begin + start + period] += 1
            gone[begin + start + length] -= 1
    return np.array(found, np.int64).reshape(-1, 4), np.cumsum(gone[:-1]) > 0


def collapsed(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST,
              exponent: int = EXPONENT, order: Order | None = None) -> DataFrame:
    """The documents with one period of each run, their kept words joined by one space; n_words, and
    the runs by start, then period, numbered in words from 0."""
    if least < 2 or exponent < 2:
        raise ValueError("a run needs two words and two periods at least")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in W.slices(batches, "_text"):
            ids = part.column("_id").to_pylist()
            words = arranged(W.split(texts, W.NON_SPACE), ids, order)
            found, gone = found_in(words, least, exponent)
            left = W.compact(words, ~gone)
            counts = np.bincount(found[:, 0], minlength=len(texts))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            fields = pa.StructArray.from_arrays(
                [pa.array(found[:, i]) for i in (1, 2, 3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-2], pa.LargeStringArray.from_buffers(
                    len(texts), pa.py_buffer(left.offsets.astype(np.int64)),
                    pa.py_buffer(left.data.tobytes())).cast(pa.string()),
                 pa.array(words.counts()), pa.ListArray.from_arrays(ends, fields)],
                names=[*part.schema.names[:-2], "_out", *ADDED])

    kept = [c for c in docs.columns if c not in ADDED and c != text]
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    column = {name: plain[f"c{i}"] for i, name in enumerate(docs.columns)}
    ready = plain.select(*(column[c] for c in kept), column[id_column].cast("long").alias("_id"),
                         column[text].cast("string").alias("_text"))
    passed = [f"{f.name} {f.dataType.simpleString()}" for f in ready.schema.fields[:-2]]
    added = ["_out string", *(f"{n} {t}" for n, t in ADDED.items())]
    found = ready.mapInArrow(rows, ", ".join([*passed, *added])).toDF(*kept, text, *ADDED)
    shown = [c for c in docs.columns if c not in ADDED]
    return found.select(*(f"`{c}`" for c in [*shown, *ADDED]))


def strongest(found: Column) -> Column:
    """The run of the greatest exponent; of equal ones the first start, then the least period."""
    def better(best: Column, run: Column) -> Column:
        # Exponents are compared in whole numbers, so nothing rounds.
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(found, F.try_element_at(found, F.lit(1)), better)
