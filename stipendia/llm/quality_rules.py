"""Quality rules on repetition: characters inside repeated word runs and lines.

Every text is hashed at several run lengths in numpy, in the tasks that read it; nothing is
shuffled. Runs of words that occur twice or more in a text, and lines equal to an earlier line,
are marked, and the characters they cover are compared with all characters of its words.

Defined cases: a null or empty text has no words, so it fails the base rules; a text shorter
than a run length has no runs of it; repeated rows get equal results row by row; an empty table
gives an empty table. Other columns do not matter: results are computed from the text alone and
the columns returned beside the kept ones are named below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipendia.llm import words as W
from stipendia.llm.tables import restored

REPEATED_RUN = 3
#: Largest share of the words' characters, in percent, inside repeated runs of so many words.
RUN_LIMITS = {5: 50, 8: 45, 10: 40}
#: Largest share, in percent, inside lines equal to an earlier line.
LINE_LIMIT = 40
MIN_WORDS = 50
MAX_REPEATED = 50
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "dup_line_chars", *(f"dup_{n}_chars" for n in RUN_LIMITS)]


def measure(texts: W.Texts) -> dict[str, np.ndarray]:
    """The measures of some texts, an array each."""
    words = W.split(texts, W.NON_SPACE)
    begins = np.concatenate([[0], np.cumsum(W.code_points(texts.data), dtype=np.int64)])
    chars = begins[words.ends] - begins[words.starts]
    out = {"n_words": words.counts(), "word_chars": W.per_text(words, chars),
           "n_symbols": texts.sums(SYMBOLS[texts.data])}

    lines = W.split(texts, W.NOT_NEWLINE)
    solid = np.concatenate([[0], np.cumsum(W.NON_SPACE[texts.data], dtype=np.int64)])
    full = np.flatnonzero(solid[lines.ends] > solid[lines.starts])
    number = lines.text[full]
    keys = W.mixed(lines.hashes[full] + number.astype(np.uint64) * np.uint64(W.BASE))
    later = np.ones(len(full), bool)
    later[np.unique(keys, return_index=True)[1]] = False
    visible = solid_chars(texts, lines.starts[full], lines.ends[full])
    size = len(texts)
    out["n_dup_lines"] = np.bincount(number[later], minlength=size)
    out["dup_line_chars"] = np.bincount(
        number[later], weights=visible[later], minlength=size).astype(np.int64)

    for n in (REPEATED_RUN, *RUN_LIMITS):
        first, keys = words.grams(n)
        keys = W.mixed(keys + words.text[first].astype(np.uint64) * np.uint64(W.BASE))
        inside = W.covered(len(words), first[W.repeated(keys)], n)
        if n == REPEATED_RUN:
            out["n_repeat_words"] = W.per_text(words, inside)
        else:
            out[f"dup_{n}_chars"] = W.per_text(words, inside * chars)
    return out


def solid_chars(texts: W.Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Characters of words in each run of bytes."""
    flags = W.code_points(texts.data) & W.NON_SPACE[texts.data]
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and all measures, one row for each document."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in W.slices(batches, "_text"):
            found = measure(texts)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], *(pa.array(found[m].astype(np.int64)) for m in MEASURES)],
                names=[*part.schema.names[:-1], *MEASURES])

    chosen = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(rows, ", ".join([kept, *(f"{m} bigint" for m in MEASURES)]))


def judged(measures: DataFrame) -> DataFrame:
    """Adds base_failed and kept. Shares are compared in whole numbers, so nothing rounds."""
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    good = 100 * F.col("dup_line_chars") <= LINE_LIMIT * F.col("word_chars")
    for n, limit in RUN_LIMITS.items():
        good = good & (100 * F.col(f"dup_{n}_chars") <= limit * F.col("word_chars"))
    return measures.withColumn("base_failed", failed).withColumn("kept", ~failed & good)


def filtered(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with the columns they had."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    body = plain.columns[docs.columns.index(text)]
    return restored(judged(measured(plain, body, tuple(plain.columns))).where("kept"), docs)
