"""Substring removal by suffix automata of reference shards.

A word is removed if a run of SPAN words around it also starts in a document of a smaller id.
The reference is the corpus itself, so one automaton of everything, sent to everybody, would grow
with the input squared. Instead:

0. Documents of SPAN words or more with equal words are one: the smallest id goes on, and all words of
   the others start there too, so they are removed.
1. Winnowing gives each text of SPAN words or more fingerprints such that any SPAN words hold
   one. Fingerprints are counted; a document without a repeated one ends here, unchanged.
2. In the others, runs of SPAN words around repeated fingerprints are hashed, and for each hash
   its owner is found: the smallest document that has it.
3. Repeated runs of an owner, stitched together, are the reference passages. A shard is the
   passages of one owner, cut every SHARD runs. Passages of later documents go to all shards of
   their owner, nearly always one; where many go to one shard, they are dealt over several
   tasks and only this bounded shard is sent to each of them.
4. Each task builds the shard's suffix automaton over words and streams the passages through it.
   Stretches whose matching statistic reaches SPAN are removed. Words are compared as words, so
   a collision of hashes never removes anything.

Defined cases: a null or empty text has no words; documents with the same id never remove from
each other, and rows that repeat an id and text get equal results; a null id counts as the
smallest; texts shorter than SPAN words stay whole; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipendia.llm import words as W
from stipendia.llm.automaton import SuffixAutomaton
from stipendia.llm.tables import given_id, identified, keyed, written

SPAN = 50
GRAM = 20
#: Runs in a shard; its automaton has at most twice as many states.
SHARD = 20_000
#: Words of passages that one task streams through one shard.
TASK_WORDS = 50_000


def base_rows(docs: DataFrame, span: int) -> DataFrame:
    """_id, _sum, n_words, digest of all words, and the fingerprints of each document."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in W.slices(batches, "_text"):
            words = W.split(texts, W.NON_SPACE)
            whole = W.pieces(W.compact(words, np.ones(len(words), bool)))
            at, keys = W.winnowed(words, GRAM, span - GRAM + 1)
            owner = words.text[at]
            _, one = np.unique(W.mixed(keys + owner.astype(np.uint64)), return_index=True)
            one.sort()
            ends = np.searchsorted(owner[one], np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([
                *part.columns[:2], pa.array(words.counts()),
                pa.array([hashlib.sha256(t).hexdigest() for t in whole]),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                         pa.array(keys[one].view(np.int64)))],
                names=["_id", "_sum", "n_words", "digest", "prints"])

    return docs.mapInArrow(rows, "_id bigint, _sum bigint, n_words bigint, digest string, "
                                 "prints array<bigint>")


def suspects(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """Documents that share a fingerprint with another one: text and those fingerprints."""
    posted = heads.select("_id", "_sum", F.explode("prints").alias("print"))
    repeated = posted.groupBy("print").agg(F.min("_id").alias("low"), F.max("_id").alias("high"))
    shared = posted.join(repeated.where("low < high").select("print"), "print", "left_semi")
    listed = shared.groupBy("_id", "_sum").agg(F.collect_set("print").alias("prints"))
    return docs.join(listed, ["_id", "_sum"])


def runs(words: W.Words, prints: list[np.ndarray], span: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the runs of `span` words that hold a listed fingerprint."""
    at, keys = W.winnowed(words, GRAM, span - GRAM + 1)
    owner = words.text[at]
    known = np.concatenate([W.mixed(p.view(np.uint64) + np.uint64(i))
                            for i, p in enumerate(prints)] or [np.zeros(0, np.uint64)])
    hit = at[np.isin(W.mixed(keys + owner.astype(np.uint64)), known)]
    first, hashes = words.grams(span)
    around = W.covered(len(words), np.maximum(hit - (span - GRAM), 0), span - GRAM + 1)
    chosen = around[first]
    return first[chosen], hashes[chosen]


def listed(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column of longs, as arrays."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def run_rows(found: DataFrame, span: int) -> DataFrame:
    """The different runs of each document."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in W.slices(batches, "_text"):
            words = W.split(texts, W.NON_SPACE)
            first, keys = runs(words, listed(part.column("prints")), span)
            owner = words.text[first]
            _, one = np.unique(W.mixed(keys + owner.astype(np.uint64)), return_index=True)
            one.sort()
            yield pa.RecordBatch.from_arrays([
                part.column("_id").take(pa.array(owner[one])),
                part.column("_sum").take(pa.array(owner[one])),
                pa.array(keys[one].view(np.int64))], names=["_id", "_sum", "run"])

    return found.select("_id", "_sum", "_text", "prints").mapInArrow(
        rows, "_id bigint, _sum bigint, run bigint")


def passages(found: DataFrame, span: int, shard: int) -> DataFrame:
    """Passages of repeated runs with their owner; role 0 is reference and has its piece.

    `found` has for each document the lists runs and owners: repeated runs and their owner.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in W.slices(batches, "_text"):
            words = W.split(texts, W.NON_SPACE)
            lists = [listed(part.column(c)) for c in ("runs", "owners")]
            first, keys = runs(words, listed(part.column("prints")), span)
            number, begin = words.text[first], words.firsts()
            ids, sums = part.column("_id").to_pylist(), part.column("_sum").to_pylist()
            out = []
            cuts = np.searchsorted(number, np.arange(len(texts) + 1))
            for n in range(len(texts)):
                mine = slice(cuts[n], cuts[n + 1])
                order = np.argsort(lists[0][n])
                known = lists[0][n][order]
                if not len(known):
                    continue
                key = keys[mine].view(np.int64)
                where = np.minimum(np.searchsorted(known, key), len(known) - 1)
                at, home = first[mine] - begin[n], lists[1][n][order][where]
                own = home == ids[n]
                new = np.zeros(len(key), bool)
                new[np.unique(key, return_index=True)[1]] = True
                use = (known[where] == key) & (~own | new)
                at, home, piece = at[use], home[use], np.where(own, at // shard, 0)[use]
                if not len(at):
                    continue
                breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(home) != 0)
                                        | (np.diff(piece) != 0)) + 1
                for a, b in zip(np.r_[0, breaks], np.r_[breaks, len(at)]):
                    size = int(at[b - 1] - at[a]) + span
                    body = words.joined(int(begin[n] + at[a]), size).decode()
                    out.append((int(home[a]), int(piece[a]), int(home[a] != ids[n]), ids[n],
                                sums[n], int(at[a]), size, body))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(
                    zip(*out) if out else [[]] * 8, [*[pa.int64()] * 7, pa.string()])],
                names=PASSAGE)

    return found.mapInArrow(rows, ", ".join(
        f"{c} {'string' if c == 'body' else 'bigint'}" for c in PASSAGE))


PASSAGE = ["owner", "piece", "role", "_id", "_sum", "at", "size", "body"]


def dealt(found: DataFrame) -> DataFrame:
    """Passages by shard; those of later documents go to every piece of their owner.

    A shard that many passages go to is sent to several tasks.
    """
    owned = found.where("role = 0").select("owner", "piece").distinct()
    many = owned.where("piece > 0").select("owner").distinct()
    pieces = owned.join(many, "owner", "left_semi").groupBy("owner").agg(
        F.collect_list("piece").alias("pieces"))
    crowded = found.where("role = 1").groupBy("owner").agg(F.sum("size").alias("total")).where(
        F.col("total") > TASK_WORDS).select("owner", F.expr(f"total div {TASK_WORDS} + 1").alias("tasks"))
    both = found.join(crowded, "owner", "left").join(pieces, "owner", "left")
    tasks = F.coalesce("tasks", F.lit(1))
    goes = F.when((F.col("role") == 1) & F.col("pieces").isNotNull(), F.col("pieces")).otherwise(
        F.array("piece"))
    salts = F.when(F.col("role") == 0, F.sequence(F.lit(0), tasks.cast("int") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("_id", "_sum", "at"), tasks).cast("int")))
    spread = both.withColumn("salt", F.explode(salts)).withColumn("piece", F.explode(goes))
    return spread.drop("tasks", "pieces").repartition(
        "owner", "piece", "salt").sortWithinPartitions("owner", "piece", "salt", "role")


def matched(found: DataFrame, span: int) -> DataFrame:
    """Stretches of words of each document that the automaton of their shard holds."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = automaton = None
        numbers: dict[str, int] = {}
        for batch in batches:
            out = []
            for owner, piece, role, id_, sum_, at, body, salt in zip(*(
                    batch.column(c).to_pylist()
                    for c in ("owner", "piece", "role", "_id", "_sum", "at", "body", "salt"))):
                if (owner, piece, salt) != shard:
                    shard, automaton, numbers = (owner, piece, salt), SuffixAutomaton(), {}
                if role == 0:
                    automaton.add([numbers.setdefault(w, len(numbers)) for w in body.split(" ")])
                else:
                    sequence = [numbers.get(w, len(numbers)) for w in body.split(" ")]
                    out += [(id_, sum_, at + a, at + b)
                            for a, b in automaton.spans(sequence, span)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)],
                names=["_id", "_sum", "start", "stop"])

    return found.mapInArrow(rows, "_id bigint, _sum bigint, start bigint, stop bigint")


def cut(found: DataFrame) -> DataFrame:
    """Kept words and number of removed ones of documents with lists of starts and stops."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in W.slices(batches, "_text"):
            words = W.split(texts, W.NON_SPACE)
            begin = words.firsts()
            steps = np.zeros(len(words) + 1, np.int64)
            for n, (a, b) in enumerate(zip(listed(part.column("starts")),
                                           listed(part.column("stops")))):
                np.add.at(steps, begin[n] + a, 1)
                np.add.at(steps, begin[n] + b, -1)
            gone = np.cumsum(steps[:-1]) > 0
            kept = W.pieces(W.compact(words, ~gone))
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("_sum"),
                 pa.array(W.per_text(words, gone)), pa.array([t.decode() for t in kept])],
                names=["_id", "_sum", "n_removed", "kept"])

    return found.mapInArrow(rows, "_id bigint, _sum bigint, n_removed bigint, kept string")


def removals(docs: DataFrame, id_column: str = "doc_id", text: str = "text", span: int = SPAN,
             shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Two tables: every row's _id, _sum, n_words and digest; what is left of changed documents."""
    plain = identified(docs, id_column, text)
    base = written(base_rows(plain, span), "digests")
    long = base.where(F.col("n_words") >= span)
    equal = long.groupBy("digest").agg(F.min("_id").alias("first"))
    heads = long.join(equal, "digest").where("_id = first").select("_id", "_sum", "prints")
    copies = long.select("_id", "_sum", "n_words", "digest").join(equal, "digest").where(
        "_id > first").select("_id", "_sum", F.col("n_words").alias("n_removed"),
                              F.lit("").alias("kept")).dropDuplicates(["_id", "_sum"])

    found = written(suspects(plain, heads).dropDuplicates(["_id", "_sum"]), "suspects")
    posted = run_rows(found, span)
    owners = posted.groupBy("run").agg(
        F.min("_id").alias("owner"), F.max("_id").alias("last")).where("owner < last").drop("last")
    homes = posted.join(owners, "run").groupBy("_id", "_sum").agg(
        F.collect_list(F.struct("run", "owner")).alias("h")).select(
        "_id", "_sum", F.col("h.run").alias("runs"), F.col("h.owner").alias("owners"))
    homes = written(homes, "owners")
    parts = written(passages(found.join(homes, ["_id", "_sum"]), span, shard), "passages")
    spans = matched(dealt(parts), span).groupBy("_id", "_sum").agg(
        F.collect_list(F.struct("start", "stop")).alias("s")).select(
        "_id", "_sum", F.col("s.start").alias("starts"), F.col("s.stop").alias("stops"))
    changed = cut(found.select("_id", "_sum", "_text").join(spans, ["_id", "_sum"]))
    return base.select("_id", "_sum", "n_words", "digest"), written(
        changed.unionByName(copies), "changed")


def digests(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
            span: int = SPAN, shard: int = SHARD) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 of its kept words."""
    base, changed = removals(docs, id_column, text, span, shard)
    left = changed.select("_id", "_sum", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return base.join(left, ["_id", "_sum"], "left").select(
        given_id().alias("doc_id"), "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"))


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                 span: int = SPAN) -> DataFrame:
    """The documents with the words that are left; unchanged texts keep their white space."""
    _, changed = removals(docs, id_column, text, span)
    body = f"c{docs.columns.index(text)}"
    both = keyed(docs, id_column, text).join(changed, ["_id", "_sum"], "left")
    return both.select(*(
        F.coalesce("kept", body).alias(body) if f"c{i}" == body else F.col(f"c{i}")
        for i in range(len(docs.columns)))).toDF(*docs.columns)
