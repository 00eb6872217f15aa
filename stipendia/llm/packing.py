"""Documents packed into sequences of a fixed number of tokens.

Each task tokenises the documents it reads and packs them at once: longer ones are cut, and every piece goes to
the fullest open sequence with room for it (best_fit.py). Sequences never reach over tasks, so
nothing is shuffled or gathered, and a task that runs again replaces all pieces of its sequences. Of the pieces
of one slice of text the longest are placed first, AHEAD at a time, while the sequences stay open: for
documents from a web crawl that leaves less than a hundredth of a percent to a percent unused, depending on the
size of a task, instead of one and a half percent.

Defined cases: a null or empty text has only the end id; rows that repeat an id are packed each; an
empty table gives an empty table; other columns than id and text do not matter and are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipendia.llm import tokens
from stipendia.llm import words as W
from stipendia.llm.best_fit import OpenBins

SIZE = 2048
#: Open sequences of a task, and pieces that are put in order of length before they are placed.
OPEN, AHEAD = 2048, 1024
PIECES = {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids": "binary",
          "sequence_id": "bigint", "offset": "bigint"}


def cut(ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place in all ids and number of the pieces of documents that end at `ends`."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    number = -(-(ends - begins) // size)
    doc = np.repeat(np.arange(len(ends)), number)
    piece = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    return doc, begins[doc] + piece * size, piece


def packed(docs: DataFrame, tokenizer: str, end: int, id_column: str = "doc_id", text: str = "text",
           size: int = SIZE, most: int = OPEN, ahead: int = AHEAD) -> DataFrame:
    """One row a piece: its document, number and place there, its ids (little-endian 32-bit numbers), the
    sequence it is in and where in it. `end` follows every document."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(size, most)
        for part, texts in W.slices(batches, "_text"):
            found, counts = tokens.encode(texts, tokenizer)
            flat = np.insert(found, np.cumsum(counts), end).astype("<u4")
            ends = np.cumsum(counts + 1)
            doc, begin, piece = cut(ends, size)
            length = np.diff(np.append(begin, len(flat)))
            sequence, offset = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
            for low in range(0, len(doc), ahead):
                window = length[low:low + ahead]
                for i in np.argsort(-window, kind="stable").tolist():
                    sequence[low + i], offset[low + i] = bins.place(int(window[i]))
            task = part.column("_task")[0].as_py() << 40 if part.num_rows else 0
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [
                None, pa.py_buffer(np.append(begin, len(flat)) * 4), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [part.column("_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)),
                 pa.array(piece * size), pa.array(length), raw.cast(pa.binary()),
                 pa.array(sequence + task), pa.array(offset)], names=list(PIECES))

    ready = docs.select(F.col(id_column).cast("long").alias("_id"), F.spark_partition_id().alias("_task"),
                        F.col(text).cast("string").alias("_text"))
    return ready.mapInArrow(rows, ", ".join(f"{n} {t}" for n, t in PIECES.items()))


def summary(pieces: DataFrame) -> DataFrame:
    """The pieces with the unsigned crc32 of their ids in place of them."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, its ids as one binary, and its pieces (doc_id, piece, length) in order.

    A group is one sequence, so it is never larger than that.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", joined.alias("ids"), F.transform("parts", lambda p: F.struct(
            p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["length"].alias("length"))
        ).alias("pieces"))
