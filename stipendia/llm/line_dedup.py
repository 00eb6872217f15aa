"""Line deduplication over overlapping windows of three lines.

Every run of three consecutive lines of a document is a window, known by two 64-bit hashes. A
window that occurs again, in any document or further down in the same one, is kept where it
comes first (smallest id, then hash of the text, then position) and its lines are removed at all later places; the
places of overlapping windows are merged. Everything is a DataFrame expression.

First places are combined before the shuffle, so a very frequent window is one row a task. They are
written before they are joined with all places, so both sides of that join are dealt anew and adaptive execution
splits it where a window is frequent. A document's lines are compared with its places as two sets, in time in
proportion to its lines.

Defined cases: lines end at \\n; lines count as they are, white space included; a window of
blank lines only is none; a document of fewer than three lines, null or empty, stays as it is; rows
that repeat an id and text are one document, and come out alike; rows of one id with different texts are
different documents; a null id counts as the smallest; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipendia.llm.tables import identified, keyed, written

WINDOW = 3


def windows(docs: DataFrame, size: int) -> DataFrame:
    """_id, _sum, at (the first line's number), and two hashes of each window."""
    lines = F.split("_text", "\n", -1)
    listed = docs.select("_id", "_sum", lines.alias("lines")).where(F.size("lines") >= size)

    def window(i: Column) -> Column:
        joined = F.array_join(F.slice("lines", i + 1, size), "\n")
        return F.struct(i.cast("long").alias("at"), F.xxhash64(joined).alias("h1"),
                        F.xxhash64(F.lit(size), joined).alias("h2"),
                        (F.trim(F.translate(joined, "\n\r\t\x0b\x0c", "     ")) != "").alias("full"))

    places = F.sequence(F.lit(0), F.size("lines") - size)
    return listed.select("_id", "_sum", F.explode(F.transform(places, window)).alias("w")).select(
        "_id", "_sum", "w.*").where("full").drop("full")


def repeats(docs: DataFrame, size: int) -> DataFrame:
    """_id, _sum and the first lines of the windows to remove."""
    found = written(windows(docs, size), "windows")
    place = F.struct("_id", "_sum", "at")
    first = written(found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where(
        "n > 1").drop("n"), "first-places")
    later = found.join(first, ["h1", "h2"]).where(place != F.col("first"))
    return later.groupBy("_id", "_sum").agg(F.collect_set(F.col("at").cast("int")).alias("starts"))


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                 size: int = WINDOW, counted: bool = False) -> DataFrame:
    """The documents with the lines that are left; with `counted` also n_lines and n_removed."""
    starts = repeats(identified(docs, id_column, text), size)
    body = f"c{docs.columns.index(text)}"
    both = keyed(docs, id_column, text).join(starts, ["_id", "_sum"], "left")
    gone = F.flatten(F.transform("starts", lambda at: F.sequence(at, at + size - 1)))
    ready = both.withColumn("lines", F.split(F.col(body), "\n", -1)).withColumn(
        "rest", F.when(F.col("starts").isNotNull(), F.array_except(
            F.sequence(F.lit(0), F.size("lines") - 1), gone)))
    left = F.array_join(F.transform("rest", lambda at: F.get("lines", at)), "\n")
    ready = ready.withColumn("left", F.when(F.col("rest").isNull(), F.col(body)).otherwise(left))
    out = [F.col("left").alias(n) if n == text else F.col(f"c{i}").alias(n)
           for i, n in enumerate(docs.columns)]
    if counted:
        number = F.when(F.col(body).isNull() | (F.col(body) == ""), F.lit(0)).otherwise(F.size("lines"))
        out += [number.cast("long").alias("n_lines"),
                F.coalesce(F.size("lines") - F.size("rest"), F.lit(0)).cast("long").alias("n_removed")]
    return ready.select(*out)
