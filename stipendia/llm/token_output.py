"""Token-id files in a static range asymmetric numeral system, read back in parallel.

Documents are dealt into ranges of ascending id and tokenised once; ids are kept as packed numbers.
Their frequencies over the whole corpus, one row a symbol, make one table that all files share. Each
task then writes its range as a file of independent blocks of whole documents, about BLOCK ids
each, with states at checkpoints inside a block and checksums of the bytes and of the ids.

    file    block ... block
    block   rANS block of all ids of its documents (see rans.py)
    tables  one file `tables` beside them

What a reader needs to find a block (file, place, size, document ids and their numbers of ids) is the
index, a table with one row a block. Any block, and inside it any checkpoint, can be decoded alone.

Defined cases: a null or empty text has only the end id; a null document id sorts first; rows
that repeat an id follow each other, however the table in between is split; an empty table gives no files and an empty index.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stipendia import session
from stipendia.llm import files, rans, tokens
from stipendia.llm import words as W
from stipendia.llm.tables import free, given_id, identified, written

BLOCK = 1 << 17
PACKED_BYTES = 16 << 20
#: Encoded bytes that one task decodes.
READ_BYTES = 8 << 20


@dataclass
class Stored:
    """Written token files: their folder and the index of their blocks."""

    folder: str
    index: DataFrame


def tokenised(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """_id, ids (little-endian numbers of two or four bytes) and row, which ascends with _id and has no gaps
    inside a range."""
    size = max(tokens.tokenizer(tokenizer).get_vocab_size(), end + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in W.slices(batches, "_text"):
            found, counts = tokens.encode(texts, tokenizer)
            found = np.insert(found, np.cumsum(counts), end).astype(kind)
            width = found.itemsize
            ends = np.concatenate([[0], np.cumsum(counts + 1)]) * width
            raw = pa.py_buffer(found.tobytes())
            yield pa.RecordBatch.from_arrays([
                part.column("_id"),
                pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(texts),
                    [None, pa.py_buffer(ends.astype(np.int64)), raw]).cast(pa.binary())],
                names=["_id", "ids"])

    ordered = docs.repartitionByRange("_id", "_sum").sortWithinPartitions("_id", "_sum")
    return ordered.mapInArrow(rows, "_id bigint, ids binary").withColumn(
        "row", F.monotonically_increasing_id())


def packed(batches: Iterator[pa.RecordBatch], column: str = "ids") -> Iterator[pa.RecordBatch]:
    """Slices of batches of about PACKED_BYTES in a binary column."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + PACKED_BYTES, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def frequencies(found: DataFrame, size: int) -> np.ndarray:
    """How often each symbol occurs in all documents; one row a symbol comes back."""
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for part in packed(batches):
            for ids in part.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])],
                                         names=["symbol", "n"])

    out = np.zeros(size, np.int64)
    for symbol, n in found.select("ids").mapInArrow(rows, "symbol bigint, n bigint").groupBy(
            "symbol").agg(F.sum("n")).collect():
        out[symbol] = n
    return out


def write(docs: DataFrame, tokenizer: str, end: int, folder: str | None = None,
          id_column: str = "doc_id", text: str = "text") -> Stored:
    """Tokenise and write all documents below `folder`, by default in the shared folder."""
    spark = docs.sparkSession
    folder = folder or session.scratch_path(spark, "tokens")
    size = max(tokens.tokenizer(tokenizer).get_vocab_size(), end + 1)
    found = written(tokenised(identified(docs, id_column, text), tokenizer, end), "ids")
    table = rans.tables(frequencies(found, size))
    out = files.Output(f"{folder}/tables")
    out.write(table.packed())
    out.close()
    rows = block_writer(folder, table, "<u2" if size <= 1 << 16 else "<u4")
    index = written(found.mapInArrow(rows, INDEX), "token-index")
    free(spark)
    return Stored(folder, index)


INDEX = ("file string, row bigint, place bigint, size bigint, n_ids bigint, "
         "docs array<bigint>, counts array<bigint>")


def block_writer(folder: str, table: rans.Tables, kind: str):
    """The task that writes blocks of whole documents, a file for each stretch of rows without a gap.

    Every attempt of a task writes names of its own. The index has those of the attempts that were
    committed; other files are never read.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, begin, following, waiting, held = None, "", 0, None, [], 0

        def flushed() -> dict:
            ids = np.concatenate([np.frombuffer(i, kind) for _, i in waiting])
            data = rans.encode(ids.astype(np.int64), table)
            return {"file": name, "row": begin, "place": out.write(data), "size": len(data), "n_ids": len(ids),
                    "docs": [d for d, _ in waiting],
                    "counts": [len(i) // np.dtype(kind).itemsize for _, i in waiting]}

        for part in packed(batches):
            done = []
            for doc, ids, row in zip(*(part.column(c).to_pylist() for c in ("_id", "ids", "row"))):
                if row != following:
                    if waiting:
                        done.append(flushed())
                        waiting, held = [], 0
                    if out:
                        out.close()
                    name = f"{folder}/ids-{row:016d}-{uuid.uuid4().hex}.rans"
                    out = files.Output(name)
                if not waiting:
                    begin = row
                following = row + 1
                waiting.append((doc, ids))
                held += len(ids)
                if held >= BLOCK * np.dtype(kind).itemsize:
                    done.append(flushed())
                    waiting, held = [], 0
            yield rows_of(done)
        if waiting:
            yield rows_of([flushed()])
        if out:
            out.close()

    return rows


def rows_of(done: list[dict]) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_pylist(done, pa.schema([
        ("file", pa.string()), ("row", pa.int64()), ("place", pa.int64()),
        ("size", pa.int64()), ("n_ids", pa.int64()), ("docs", longs), ("counts", longs)]))


def placed(stored: Stored) -> DataFrame:
    """The index with `start`, the ids of all blocks before. Only a row a file meets in one task."""
    index = stored.index
    sizes = index.groupBy("file").agg(F.min("row").alias("first"), F.sum("n_ids").alias("n"))
    order = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(
        before, "file").withColumn("start", F.col("before") + F.col("inside"))


def read(spark: SparkSession, stored: Stored, summary: bool = False) -> DataFrame:
    """One row a document, decoded from the files: doc_id, start, n_tokens, and its ids.

    With `summary` the ids' unsigned crc32 as little-endian 32-bit numbers stands for them.
    Blocks are decoded in parallel, each after a read of its own bytes only.
    """
    folder = stored.folder

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/tables"
        table = rans.Tables.unpacked(files.read_range(path, 0, files.file_size(path)))
        for batch in batches:
            for row in batch.to_pylist():
                data = files.read_range(row["file"], row["place"], row["size"])
                ids = rans.decode(data, table).astype("<u4")
                ends = np.concatenate([[0], np.cumsum(row["counts"])]).astype(np.int64)
                cuts = list(zip(ends[:-1], ends[1:]))
                last = pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in cuts], pa.int64()) \
                    if summary else pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["docs"], pa.int64()), pa.array(ends[:-1] + row["start"]),
                     pa.array(np.diff(ends)), last],
                    names=["_id", "start", "n_tokens", "ids"])

    chosen = placed(stored).select("file", "place", "size", "start", "docs", "counts")
    kind = "bigint" if summary else "array<bigint>"
    # The rows of the index are small, so their number of tasks follows the bytes they stand for.
    total = stored.index.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    found = chosen.repartition(total // READ_BYTES + 1, "file", "place").mapInArrow(
        rows, f"_id bigint, start bigint, n_tokens bigint, ids {kind}")
    return found.select(given_id().alias("doc_id"), "start", "n_tokens",
                        F.col("ids").alias("ids_crc32" if summary else "ids"))
