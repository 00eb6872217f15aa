"""Near-duplicate documents by an inverted join of MinHash coordinates.

A document's set are its different shingles. Its signature has COORDINATES values; documents
of similarity 0.8 agree in 80 % of them on average, and in fewer than MATCHES with a chance
of about 3e-6. Documents are posted under each (coordinate, value) pair; then

* documents with equal sets are one node, posted once;
* values posted once cannot collide, and a document with fewer than MATCHES shared values is
  skipped altogether;
* of a document's values in order of their number of postings, rarest first, two documents
  with MATCHES collisions must share one among all but the last MATCHES - 1. Only that prefix is
  merged; the long lists at the end are skipped;
* the center of a list is its document whose values are posted most often, and all lists of one center
  make a group. Collisions are counted between the signatures of a group, in blocks inside
  tasks; documents without a partner of MATCHES collisions leave. Only documents come out, never pairs;
* what is left is compared with the center on full sets. Documents not connected with the
  center are then compared with all others of the group, again in blocks. Only links come out.

So no list of pairs is ever made: rows grow with documents, and a group of copies costs rows by its
length, and comparisons of its strays with its members inside blocks.

Every link is confirmed on full sets. The components of links are found with star contraction.

Defined cases: a null text or one without words has an empty set and is linked with nothing;
a text of fewer words than a shingle has one shingle, all of them; rows of equal id and text are one
document, and of those with words one row stays; rows of one id, or of no id, with different texts are
different documents, each searched and compared; the smallest id stays, of equal ids the text with the
smallest hash; a null id counts as the smallest; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipendia.llm import words as W
from stipendia.llm.components import components
from stipendia.llm.tables import given_id, identified, keyed, restored, written

COORDINATES = 64
MATCHES = 36
PERCENT = 80
#: Documents of each kind in a block comparison.
BLOCK = 500
SEEDS, FACTORS = np.random.default_rng(8).integers(
    1, 2**63, (2, COORDINATES), dtype=np.uint64)
FACTORS = FACTORS * np.uint64(2) + np.uint64(1)


def shingles(texts: W.Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The text's number and hash of each different shingle, ordered by text."""
    words = W.split(texts.folded(), W.NON_SPACE)
    first, keys = words.grams(width)
    owner = words.text[first]
    counts, begin = words.counts(), words.firsts()
    for n in range(1, width):
        at, short = words.grams(n)
        whole = (counts[words.text[at]] == n) & (begin[words.text[at]] == at)
        owner = np.concatenate([owner, words.text[at[whole]]])
        keys = np.concatenate([keys, short[whole]])
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], keys[new]


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """_id, _sum, n_shingles, two hashes of the whole set, and the coordinates as numbers."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in W.slices(batches, "_text"):
            owner, keys = shingles(texts, width)
            counts = np.bincount(owner, minlength=len(texts))
            full = np.flatnonzero(counts)
            at = np.searchsorted(owner, full)
            out = np.zeros((len(texts), COORDINATES), np.uint64)
            for c in range(COORDINATES if len(full) else 0):
                least = np.minimum.reduceat((keys ^ SEEDS[c]) * FACTORS[c], at)
                out[full, c] = W.mixed(least + SEEDS[c])
            marks = np.zeros((2, len(texts)), np.uint64)
            for i, step in enumerate((0, W.GRAM_BASE) if len(full) else ()):
                marks[i, full] = np.add.reduceat(W.mixed(keys ^ np.uint64(step)), at)
            ends = pa.array(np.arange(len(texts) + 1) * COORDINATES, pa.int32())
            yield pa.RecordBatch.from_arrays([
                *part.columns[:2], pa.array(counts.astype(np.int64)),
                *(pa.array(m.view(np.int64)) for m in marks),
                pa.ListArray.from_arrays(ends, pa.array(out.view(np.int64).ravel()))],
                names=["_id", "_sum", "n_shingles", "mark", "mark2", "values"])

    return docs.mapInArrow(rows, "_id bigint, _sum bigint, n_shingles bigint, mark bigint, "
                                 "mark2 bigint, values array<bigint>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """node and its full set of shingles."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in W.slices(batches, "_text"):
            owner, keys = shingles(texts, width)
            ends = np.searchsorted(owner, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([
                part.column("node"),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.view(np.int64)))],
                names=["node", "shingles"])

    return docs.select("node", "_text").mapInArrow(rows, "node bigint, shingles array<bigint>")


def members(docs: DataFrame, width: int) -> DataFrame:
    """Every row with head_id, head_sum: the document of the smallest id, then hash, of an equal set.

    Rows without words are their own heads. Only heads have `values`.
    """
    signed = written(signatures(docs, width), "signatures")
    first = signed.groupBy("mark", "mark2", "n_shingles").agg(
        F.min(F.struct("_id", "_sum")).alias("first"))
    head = lambda c: F.when(F.col("n_shingles") > 0, F.col(f"first.{c}")).otherwise(F.col(c))
    joined = signed.join(first, ["mark", "mark2", "n_shingles"]).select(
        "_id", "_sum", "n_shingles", head("_id").alias("head_id"), head("_sum").alias("head_sum"), "values")
    return written(joined.withColumn("values", F.when(is_head(), F.col("values"))), "nodes")


def is_head() -> Column:
    return (F.col("_id") == F.col("head_id")) & (F.col("_sum") == F.col("head_sum"))


def numbered(every: DataFrame) -> DataFrame:
    """The heads with words, each once: node (its number, fixed by writing), _id, _sum, n_shingles, values."""
    heads = every.where(is_head() & (F.col("n_shingles") > 0)).dropDuplicates(["_id", "_sum"])
    return written(heads.select(F.monotonically_increasing_id().alias("node"),
                                "_id", "_sum", "n_shingles", "values"), "heads")


def prefixes(heads: DataFrame) -> DataFrame:
    """value, node, weight: the lists to merge, without what prefix and skip rules leave out.

    The weight of a node is the number of postings of all its shared values.
    """
    posted = heads.select("node", F.explode("values").alias("value"))
    counted = posted.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    ranked = posted.join(counted, "value").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("n", "value"))).alias("shared"))
    merged = ranked.where(F.size("shared") >= MATCHES).select(
        "node", F.aggregate("shared", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("weight"),
        F.explode(F.expr(f"slice(shared, 1, size(shared) - {MATCHES} + 1)")).alias("s"))
    return merged.select(F.col("s.value").alias("value"), "node", "weight")


def heaviest() -> Column:
    """The node of the largest weight, of equal ones the largest node: no tie depends on the order of rows."""
    return F.max_by("node", F.struct("weight", "node"))


def centered(lists: DataFrame) -> DataFrame:
    """center, node, weight: the nodes of all lists of each center, with itself."""
    centers = lists.groupBy("value").agg(
        heaviest().alias("center"), F.count("*").alias("n")).where("n > 1")
    return lists.join(centers.drop("n"), "value").select("center", "node", "weight").distinct()


def seated(groups: DataFrame, payload: DataFrame) -> DataFrame:
    """Rows of groups (center, node, n, asking, asks, ...) dealt to the blocks that compare them.

    A group of up to BLOCK nodes is one block. In a larger one every block of asking nodes meets
    every block of nodes. `role` has 1 for a node that is compared with and 2 for one that asks.
    """
    rows, columns = (F.expr(f"int(({c} - 1) div {BLOCK})") for c in ("asking", "n"))
    spot = F.xxhash64("node")
    i, j = F.pmod(spot, rows + 1).cast("int"), F.pmod(spot, columns + 1).cast("int")
    seat = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.alias("role"))
    alone = F.array(seat(F.lit(0), F.lit(0), F.when(F.col("asks"), 3).otherwise(1)))
    as_node = F.transform(F.sequence(F.lit(0), rows), lambda k: seat(k, j, F.lit(1)))
    asking = F.transform(F.sequence(F.lit(0), columns), lambda k: seat(i, k, F.lit(2)))
    many = F.when(F.col("asks"), F.concat(as_node, asking)).otherwise(as_node)
    dealt = groups.withColumn("seat", F.explode(F.when(columns > 0, many).otherwise(alone)))
    ready = dealt.select("*", "seat.*").drop("seat", "n", "asking", "asks").join(payload, "node")
    return ready.repartition("center", "i", "j").sortWithinPartitions("center", "i", "j")


def by_block(batches: Iterator[pa.RecordBatch], columns: list[str], numbers: str):
    """(center, nodes, asking nodes) of each block; a node is a tuple of columns and an array."""
    key, nodes, asking = None, [], []
    for batch in batches:
        seats = zip(*(batch.column(c).to_pylist() for c in ("center", "i", "j")))
        arrays = batch.column(numbers)
        rows = zip(seats, batch.column("role").to_pylist(),
                   zip(*(batch.column(c).to_pylist() for c in columns)))
        for n, (seat, role, row) in enumerate(rows):
            if seat != key:
                if nodes and asking:
                    yield key[0], nodes, asking
                key, nodes, asking = seat, [], []
            entry = (*row, arrays[n].values.to_numpy(zero_copy_only=False))
            if role & 1:
                nodes.append(entry)
            if role & 2:
                asking.append(entry)
    if nodes and asking:
        yield key[0], nodes, asking


def partnered(around: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """center, node, weight of nodes that collide often enough with another one of their group."""
    sizes = around.groupBy("center").agg(F.count("*").alias("n"))
    groups = around.join(sizes, "center").withColumn("asking", F.col("n")).withColumn(
        "asks", F.lit(True))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        blocks = by_block(batches, ["node", "weight", "n_shingles"], "values")
        for center, nodes, asking in blocks:
            theirs, size = np.array([n[3] for n in nodes]), np.array([n[2] for n in nodes])
            names = np.array([n[0] for n in nodes])
            step = max(1, (1 << 24) // theirs.size)
            for at in range(0, len(asking), step):
                some = asking[at:at + step]
                same = (np.array([a[3] for a in some])[:, None, :] == theirs[None]).sum(axis=2)
                mine = np.array([a[2] for a in some])[:, None]
                fits = 100 * np.minimum(mine, size) >= percent * np.maximum(mine, size)
                other = np.array([a[0] for a in some])[:, None] != names
                for k in np.flatnonzero(((same >= MATCHES) & fits & other).any(axis=1)):
                    out.append((center, some[k][0], some[k][1]))
            if len(out) >= 10_000:
                yield triples(out)
                out = []
        yield triples(out)

    found = written(seated(groups, heads.select("node", "n_shingles", "values")).mapInArrow(
        rows, "old bigint, node bigint, weight bigint").distinct(), "partners")
    centers = found.groupBy("old").agg(heaviest().alias("center"))
    return found.join(centers, "old").select("center", "node").distinct()


def triples(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["old", "node", "weight"])


def confirmed(pairs: DataFrame, heads: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b with enough collisions and, on full sets, enough similarity."""
    one = heads.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"),
                       F.col("values").alias("va"))
    two = heads.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"),
                       F.col("values").alias("vb"))
    near = pairs.join(one, "a").join(two, "b").where(
        (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        & (F.size(F.array_intersect("va", "vb")) >= MATCHES)).select("a", "b")
    full = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - same
    return full.where(100 * same >= percent * union).select("a", "b")


def divided(around: DataFrame, found: DataFrame) -> DataFrame:
    """Groups that are not one component yet: center, node, component, n, asking, asks.

    Strays ask: nodes that are not connected with the center.
    """
    marked = around.join(found, "node", "left").select(
        "center", "node", F.coalesce("component", "node").alias("component"))
    home = marked.where("node = center").select("center", F.col("component").alias("home"))
    strays = marked.join(home, "center").withColumn("asks", F.col("component") != F.col("home"))
    sizes = strays.groupBy("center").agg(
        F.count("*").alias("n"), F.count_if("asks").alias("asking")).where("asking > 0 and n > 2")
    return strays.drop("home").join(sizes, "center")


def blocked(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b between strays and other nodes of their group, on full sets."""
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, nodes, asking in by_block(batches, ["node", "component"], "shingles"):
            out += linked(nodes, asking, percent)
            if len(out) >= 10_000:
                yield pairs_of(out)
                out = []
        yield pairs_of(out)

    return seated(groups, sets).mapInArrow(compared, "a bigint, b bigint")


def pairs_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def linked(nodes: list[tuple], asking: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links from each asking node, one for each component among the nodes it is similar to."""
    if not nodes or not asking:
        return []
    sizes = np.array([len(s) for _, _, s in nodes])
    flat, place = np.unique(np.concatenate([s for _, _, s in nodes]), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = []
    for node, component, own in asking:
        mine = np.zeros(len(flat), np.int32)
        at = np.minimum(np.searchsorted(flat, own), len(flat) - 1)
        mine[at[flat[at] == own]] = 1
        same = np.add.reduceat(mine[place], begin)
        near = np.flatnonzero(100 * same >= percent * (sizes + len(own) - same))
        others = {nodes[i][1]: nodes[i][0] for i in near if nodes[i][1] != component}
        out += [(node, other) for other in others.values()]
    return out


def links(heads: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links a, b that connect all similar nodes; see the module's text."""
    lists = written(prefixes(heads), "lists")
    listed = written(centered(lists), "around")
    around = written(partnered(listed, heads, percent), "groups")
    keys = around.select("node").distinct().join(heads.select("node", "_id", "_sum"), "node")
    sets = written(shingle_sets(docs.join(keys, ["_id", "_sum"])
                                .dropDuplicates(["_id", "_sum"]), width), "sets")
    pairs = around.where("node <> center").select(
        F.col("center").alias("a"), F.col("node").alias("b"))
    found = written(confirmed(pairs, heads, sets, percent), "confirmed")
    apart = written(divided(around, components(found)), "divided")
    return found.union(written(blocked(apart, sets, percent), "confirmed"))


def smallest(found: DataFrame, heads: DataFrame) -> DataFrame:
    """Heads in components, with component, component_sum: its document of the smallest id, then hash."""
    named = found.join(heads.select("node", "_id", "_sum"), "node")
    first = named.groupBy("component").agg(F.min(F.struct("_id", "_sum")).alias("first"))
    return named.join(first, "component").select(
        F.col("_id").alias("head_id"), F.col("_sum").alias("head_sum"),
        F.col("first._id").alias("component"), F.col("first._sum").alias("component_sum"))


def groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5,
           percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, _id, _sum, n_shingles, component (an _id), kept.

    Of a component the rows of one id and text are `kept`; see the module's text.
    """
    plain = identified(docs, id_column, text)
    every = members(plain, width)
    heads = numbered(every)
    found = smallest(components(links(heads, plain, width, percent)), heads)
    joined = every.join(found, ["head_id", "head_sum"], "left").select(
        "_id", "_sum", "n_shingles", F.coalesce("component", "head_id").alias("component"),
        F.coalesce("component_sum", "head_sum").alias("component_sum"))
    return joined.select(
        given_id().alias("doc_id"), "_id", "_sum", "n_shingles", "component",
        ((F.col("_id") == F.col("component")) & (F.col("_sum") == F.col("component_sum"))).alias("kept"))


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                 width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The document of the smallest id in each group, and all rows without words, with the columns they had.

    Of rows that repeat its id and text the one with the smallest hash of all other columns stays.
    """
    kept = groups(docs, id_column, text, width, percent).where("kept and n_shingles > 0").select(
        "_id", "_sum").distinct()
    rows = keyed(docs, id_column, text)
    own = [f"c{i}" for i in range(len(docs.columns))]
    body = f"c{docs.columns.index(text)}"
    worded = F.coalesce(F.col(body).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    mark = F.xxhash64(F.to_json(F.struct(*(c for c in own if c != body))))
    one = rows.where(worded).groupBy("_id", "_sum").agg(F.min_by(F.struct(*own), mark).alias("row"))
    single = one.join(kept, ["_id", "_sum"], "left_semi").select("row.*")
    return restored(single.union(rows.where(~worded).select(*own)), docs)
