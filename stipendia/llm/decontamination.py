"""Benchmark decontamination by winnowing.

The hashes of all runs of GRAM words are computed, and of every SPAN = GRAM + WINDOW - 1
consecutive words the smallest one is kept as a fingerprint. Two texts that share SPAN words
therefore share a fingerprint. Fingerprints of documents are joined with those of the benchmark; of the texts, only
those of documents with a common fingerprint are looked at again. There each hit is extended to all windows of SPAN
words around it, and these are joined with the benchmark's windows as text, so the result is exact.

An item of fewer words than SPAN is one window of its own length; documents are then looked
up by the hash of every run of that length, of which there are at most SPAN - 1 lengths.

A bitmap, sized by the number of fingerprints of the benchmark up to MOST_BITS, goes to all tasks and
keeps fingerprints that can have no partner out of the join. It only saves work: with a benchmark so large that
every bit is set, all fingerprints go to the join, 32 bytes each.

Defined cases: a null or empty text, of a document or an item, has no words and no windows;
repeated documents get equal rows; items of equal words are all listed; the ids of repeated items count
once; null item ids are not listed; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipendia.llm import words as W
from stipendia.llm.tables import given_id, identified, keyed, restored, written

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
#: Bits of the filter for each fingerprint of the benchmark, and the most there are: 8 MB.
BITS_EACH, MOST_BITS = 16, 1 << 26


def item_windows(benchmark: DataFrame, id_column: str, text: str) -> DataFrame:
    """One row for each item and different window: its words, their number, hash, prints.

    `prints` are the fingerprints of the window if it has SPAN words, else its own hash.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in W.slices(batches, "_text", 1 << 18):
            words = W.split(texts.folded(), W.ALPHANUMERIC)
            firsts, ids = words.firsts(), part.column(0).to_pylist()
            first, keys = words.grams(SPAN)
            out = [(ids[words.text[i]], words.joined(i, SPAN).decode(), SPAN) for i in first]
            for n, number in enumerate(np.diff(firsts)):
                if 0 < number < SPAN:
                    whole = words.joined(firsts[n], number).decode()
                    out.append((ids[n], whole, int(number)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()),
                 pa.array([r[1] for r in out], pa.string()),
                 pa.array([r[2] for r in out], pa.int64())], names=["item_id", "span", "length"])

    chosen = identified(benchmark, id_column, text).select("_id", "_text")
    found = chosen.mapInArrow(rows, "item_id bigint, span string, length bigint")
    return found.select(given_id("item_id").alias("item_id"), "span", "length").distinct()


def prints(windows: DataFrame) -> DataFrame:
    """The different fingerprints of windows; of short ones their hash."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in W.slices(batches, "span", 1 << 20):
            words = W.split(texts, W.ALPHANUMERIC)
            _, long = W.winnowed(words, GRAM, WINDOW)
            found, counts = [long], words.counts()
            for n in range(1, SPAN):
                first, keys = words.grams(n)
                found.append(keys[counts[words.text[first]] == n])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found).view(np.int64))], names=["print"])

    return windows.select("span").mapInArrow(rows, "print bigint").distinct()


def filter_bits(number: int) -> int:
    """Bits of the filter for so many fingerprints: a power of two."""
    return min(MOST_BITS, 1 << max(16, (number * BITS_EACH).bit_length()))


def bitmap(found: DataFrame, bits: int) -> np.ndarray:
    """Which values modulo `bits` occur. Spark sets the bits; at most bits / 64 rows come."""
    place = found.select(F.pmod("print", F.lit(bits)).cast("long").alias("p"))
    cells = place.groupBy(F.expr("p div 64").alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[cells["cell"].to_numpy()] = cells["mask"].to_numpy()
    return out


PRINTS = pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64()), ("print", pa.int64())]))


def fingerprints(docs: DataFrame, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """For every document its number of words and the fingerprints that the filter lets pass.

    `at` is the first word of a run. `length` is SPAN for a fingerprint, else the length of a short item.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = sent.value.view(np.uint64)

        def maybe(keys: np.ndarray) -> np.ndarray:
            signed = keys.view(np.int64) % np.int64(len(mask) * 64)
            return (mask[signed >> 6] >> (signed & 63).astype(np.uint64)) & np.uint64(1) > 0

        for part, texts in W.slices(batches, "_text"):
            words = W.split(texts.folded(), W.ALPHANUMERIC)
            found = [(SPAN, *W.winnowed(words, GRAM, WINDOW))]
            found += [(n, *words.grams(n)) for n in lengths]
            passed = [(at[chosen], np.full(chosen.sum(), n), keys.view(np.int64)[chosen])
                      for n, at, keys in found for chosen in [maybe(keys)]]
            at, size, keys = (np.concatenate(c) for c in zip(*passed))
            owner = words.text[at]
            order = np.argsort(owner, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
            values = pa.StructArray.from_arrays(
                [pa.array(c[order], pa.int64()) for c in (at - words.firsts()[owner], size, keys)],
                fields=list(PRINTS.value_type))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:2], pa.array(words.counts()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=PRINTS)],
                names=["_id", "_sum", "n_words", "prints"])

    return docs.mapInArrow(
        rows, "_id bigint, _sum bigint, n_words bigint, "
              "prints array<struct<at:bigint,length:bigint,print:bigint>>")


def extended(hits: DataFrame) -> DataFrame:
    """The windows as text around the hits of each document: _id, _sum, at, length, span."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in W.slices(batches, "_text"):
            words = W.split(texts.folded(), W.ALPHANUMERIC)
            firsts = words.firsts()
            keys = list(zip(*(part.column(c).to_pylist() for c in ("_id", "_sum"))))
            out = []
            for number, (start, each) in enumerate(zip(firsts.tolist(), part.column("hits").to_pylist())):
                places = set()
                for hit in each:
                    at, n = start + hit["at"], hit["length"]
                    first = range(at - WINDOW + 1, at + 1) if n == SPAN else [at]
                    places.update((i, n) for i in first if start <= i and i + n <= firsts[number + 1])
                out += [(*keys[number], i - start, n, words.joined(i, n).decode())
                        for i, n in sorted(places)]
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if name == "span" else pa.int64())
                 for c, name in zip(columns, WINDOWS)], names=WINDOWS)

    return hits.mapInArrow(rows, "_id bigint, _sum bigint, at bigint, length bigint, span string")


WINDOWS = ["_id", "_sum", "at", "length", "span"]


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id",
                  text: str = "text", item_column: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """One row a document: doc_id, _sum, n_words, n_hit, items (sorted as strings)."""
    windows = written(item_windows(benchmark, item_column, item_text), "benchmark-windows")
    lengths = sorted(r[0] for r in windows.select("length").where(F.col("length") < SPAN)
                     .distinct().collect())
    known = written(prints(windows), "benchmark-prints")
    bits = bitmap(known, filter_bits(known.count()))
    plain = identified(docs, id_column, text)
    base = written(fingerprints(plain, bits, lengths), "fingerprints")
    # Hits of one document are as many as its words at most; texts without a hit end here.
    common = base.where(F.size("prints") > 0).select("_id", "_sum", F.explode("prints").alias("p")).select(
        "_id", "_sum", "p.*").join(known, "print", "left_semi")
    places = written(common.groupBy("_id", "_sum").agg(
        F.collect_set(F.struct("at", "length")).alias("hits")), "hits")
    # Equal documents are judged once.
    spans = extended(plain.join(places, ["_id", "_sum"])).distinct()
    hits = written(spans.join(windows.select("span").distinct(), "span", "left_semi"), "windows")
    hit = hits.withColumn("word", F.explode(F.sequence("at", F.col("at") + F.col("length") - 1)))
    n_hit = hit.select("_id", "_sum", "word").distinct().groupBy("_id", "_sum").agg(
        F.count("*").alias("n_hit"))
    pairs = hits.select("_id", "_sum", "span").distinct().join(
        windows.where("item_id is not null").select("item_id", "span"), "span").select(
        "_id", "_sum", "item_id").distinct()
    items = pairs.groupBy("_id", "_sum").agg(
        F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    found = n_hit.join(items, ["_id", "_sum"], "left")
    return base.select("_id", "_sum", "n_words").join(found, ["_id", "_sum"], "left").select(
        given_id().alias("doc_id"), "_id", "_sum", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """The documents without a benchmark window, with the columns they had."""
    hit = contamination(docs, benchmark, id_column, text).where("n_hit > 0").select("_id", "_sum")
    return restored(keyed(docs, id_column, text).join(
        hit.distinct(), ["_id", "_sum"], "left_anti"), docs)
