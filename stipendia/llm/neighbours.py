"""Quality classifier: nearest labelled neighbours in a latent semantic space.

Texts are counted as hashed runs of GRAM bytes in BUCKETS buckets, plus runs of three words that
come back (junk repeats itself), weighed by logarithm and by how many of all documents have the bucket. The
leading RANK directions of a bounded sample of labelled documents span the latent space. The
sample's vectors are broadcast: SAMPLE rows of RANK numbers, whatever the corpus holds. Each task takes
exact cosines of its documents with all of them, in blocks, and the NEIGHBOURS most similar vote
with weight similarity**SHARPNESS times how many labelled documents each stands for.

The sample takes SAMPLE / 2 documents of each label, the smallest by a hash of their id; only
ids outside the held-out part are used. Everything else covers all documents: document
frequencies are summed over the whole corpus, and every text is scored whole.

Defined cases: a null or empty text has no direction, so all sampled labels vote alike; rows that repeat an
id score alike if their texts are equal; a document labelled twice counts with the smaller label; null
labels and labels without document are left out; a null id is neither held out nor
labelled; without labels every score is 0.5; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipendia.llm import words as W

GRAM = 3
BUCKETS = 2048
REPEATS = 32
WIDTH = BUCKETS + REPEATS
RANK = 64
SAMPLE = 4000
NEIGHBOURS = 25
SHARPNESS = 4
BLOCK_ROWS = 256
SLICE = 1 << 20


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 3 == 1, F.lit(False))


def counts(texts: W.Texts) -> np.ndarray:
    """A row of bucket counts for each text; the last REPEATS buckets measure repetition."""
    n = len(texts)
    out = np.zeros((n, WIDTH), np.float32)
    data = texts.data.astype(np.uint32)
    if len(data) >= GRAM:
        code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 11)).astype(np.int64)
        owner = np.repeat(np.arange(n), np.diff(texts.offsets))
        same = owner[:-2] == owner[2:]
        flat = np.bincount(owner[:-2][same] * BUCKETS + bucket[same], minlength=n * BUCKETS)
        out[:, :BUCKETS] = flat.reshape(n, BUCKETS)
    words = W.split(texts.folded(), W.NON_SPACE)
    first, keys = words.grams(3)
    again = W.repeated(W.mixed(keys + words.text[first].astype(np.uint64) * np.uint64(W.BASE)))
    inside = W.per_text(words, W.covered(len(words), first[again], 3))
    total = np.maximum(words.counts(), 1)
    # A share of repeated words is written as so many equal buckets, as long as the text.
    share = np.ceil(REPEATS * inside / total).astype(np.int64)
    length = out[:, :BUCKETS].sum(axis=1)
    out[:, BUCKETS:] = (np.arange(REPEATS) < share[:, None]) * (length[:, None] / 50)
    return out


def frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each bucket; at most WIDTH + 1 rows come back."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDTH + 1, np.int64)
        for _, texts in W.slices(batches, "_text", SLICE):
            total[:-1] += (counts(texts) > 0).sum(axis=0)
            total[-1] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH + 1)), pa.array(total)],
                                         names=["bucket", "n"])

    out = np.zeros(WIDTH + 1, np.int64)
    for bucket, n in docs.select("_text").mapInArrow(rows, "bucket bigint, n bigint").groupBy(
            "bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return int(out[-1]), out[:-1]


def weighed(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length; a text without anything stays 0."""
    out = np.log1p(found) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """What is broadcast: weights of buckets, directions, labelled vectors, labels, weights."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    def latent(self, texts: W.Texts) -> np.ndarray:
        out = weighed(counts(texts), self.idf) @ self.directions
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: W.Texts) -> np.ndarray:
        """Share of label 1 among the nearest votes."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        rows = self.latent(texts)
        prior = float(self.weights @ self.labels / self.weights.sum())
        out = np.full(len(texts), prior)
        most = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), BLOCK_ROWS):
            near = rows[at:at + BLOCK_ROWS] @ self.vectors.T
            top = np.argpartition(-near, most - 1, axis=1)[:, :most]
            similar = np.clip(np.take_along_axis(near, top, axis=1), 0, 1).astype(np.float64)
            vote = similar ** SHARPNESS * self.weights[top]
            total = vote.sum(axis=1)
            seen = total > 0
            out[at:at + BLOCK_ROWS][seen] = (vote * self.labels[top]).sum(axis=1)[seen] / total[seen]
        return out


def fitted(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text",
           label: str = "quality", sample: int = SAMPLE) -> Model:
    """Frequencies over all documents; directions and labelled vectors from the sample."""
    plain = docs.select(F.col(id_column).alias("_id"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    total, seen = frequencies(plain)
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)
    idf[BUCKETS:] = 1
    usable = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()
                          & ~held_out(F.col(id_column))).groupBy(
        F.col(id_column).alias("_id")).agg(F.min(label).cast("int").alias("y"))
    sizes = dict(usable.groupBy("y").count().where("y in (0, 1)").collect())
    rank = F.xxhash64(F.col("_id").cast("string"))
    chosen = None
    for y in (0, 1):
        part = usable.where(F.col("y") == y).orderBy(rank, "_id").limit(sample // 2)
        chosen = part if chosen is None else chosen.union(part)
    # At most `sample` rows, so each task can have them all.
    rows = plain.join(F.broadcast(chosen), "_id").dropDuplicates(["_id"])
    found, y = sampled(rows, idf)
    have = np.array([(y == v).sum() for v in (0, 1)])
    weight = np.array([sizes.get(v, 0) / max(have[v], 1) for v in (0, 1)])[y]
    _, directions = np.linalg.eigh(found.T @ found)
    model = Model(idf, np.ascontiguousarray(directions[:, ::-1][:, :RANK]).astype(np.float32),
                  np.zeros((0, RANK), np.float32), y.astype(np.float64), weight)
    latent = found @ model.directions
    model.vectors = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return model


def sampled(rows: DataFrame, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighed vectors and labels of the sample, in order of id."""
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in W.slices(batches, "_text", SLICE):
            found = weighed(counts(texts), idf).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("y"), pa.array([r.tobytes() for r in found])],
                names=["_id", "y", "v"])

    kind = rows.schema["_id"].dataType.simpleString()
    got = rows.select("_id", "y", "_text").mapInArrow(vectors, f"_id {kind}, y int, v binary").collect()
    got.sort(key=lambda r: r[0])
    out = np.zeros((len(got), WIDTH), np.float32)
    for i, r in enumerate(got):
        out[i] = np.frombuffer(r[2], np.float16)
    return out, np.array([r[1] for r in got], np.int64)


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in W.slices(batches, "_text", SLICE):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sent.value.scores(texts))], names=["doc_id", "score"])

    plain = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    found = plain.mapInArrow(rows, f"doc_id {kind}, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))
