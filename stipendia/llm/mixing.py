"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell, a combination of source, language and topic: one shuffle of counts that are
combined before it. From there on only cells are handled. A sweep scales the weights of all cells to the
target share of each source, then language, then topic; sweeps go on until all shares are met within
TOLERANCE, or SWEEPS are done. A document's probability is proportional to the raked weight of its cell
over the cell's tokens, and scaled so that a given share of all tokens is kept (without one, the largest
share that meets the targets; all tokens, if they are met already). No document is taken
twice: a cell that would need more than it has is kept whole, and the others share the rest in
proportion to their weights, so a large share can miss its targets; `shares` lists what is reached. The draw of a document is a hash of its id, so that it can be repeated.

Everything is DataFrame expressions. Cells are written after some sweeps, so plans stay short. Documents get the
probability of their cell by one join, which adaptive execution splits or broadcasts by size.

Defined cases: a null source, language or topic is a value of its own; a null or empty text has
no tokens, weighs nothing and is drawn with the probability of its cell, 1 if the whole cell is empty;
a target for a value that does not occur is left out and the others are scaled up; a value
without target keeps no tokens (probability 0); rows that repeat an id are drawn alike; a null id draws
as the text ''; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipendia.llm.tables import written

SWEEPS = 40
TOLERANCE = 1e-9
#: Sweeps between two writes of the cells.
CHAIN = 4
TEMPERATURE = 0.5
#: Share of the tokens to keep, in expectation.
KEEP = 0.5
MOST_STEPS = 200
DRAW_DIGITS = 12


def words(text: Column) -> Column:
    """Number of words of a text: starts of stretches without ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by rule: what kind of text it looks like."""
    body = F.coalesce(text, F.lit(""))
    return (F.when(F.contains(body, F.lit(" | ")), "table")
            .when(body.rlike("(?i)licen[sc]e"), "legal")
            .when(body.rlike("[0-9]{2}"), "figures")
            .otherwise("prose"))


def tempered(tokens: DataFrame, margin: str, temperature: float = TEMPERATURE) -> DataFrame:
    """Target shares (value, share): present shares to the power `temperature`, scaled to 1."""
    sums = tokens.groupBy(F.col(margin).alias("value")).agg(
        F.sum("tokens").alias("n")).where("n > 0")
    power = F.pow(F.col("n").cast("double"), F.lit(temperature))
    total = sums.agg(F.sum(power).alias("total"))
    return sums.crossJoin(total).select("value", (power / F.col("total")).alias("share"))


def raked(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS,
          tolerance: float = TOLERANCE) -> DataFrame:
    """The cells with `weight`: shares of tokens that meet all targets, as near as they can."""
    names = list(targets)
    for i, (name, target) in enumerate(targets.items()):
        wanted = target.select(F.col("value").alias(f"v{i}"), F.col("share").alias(f"t{i}"))
        cells = cells.join(wanted, F.col(name).eqNullSafe(F.col(f"v{i}")), "left").drop(f"v{i}")
    reachable = F.lit(True)
    for i in range(len(names)):
        reachable = reachable & F.col(f"t{i}").isNotNull()
    state = written(cells.withColumn("weight", F.when(
        reachable, F.col("tokens").cast("double")).otherwise(0.0)), "cells")
    done = 0
    while done < sweeps:
        for _ in range(min(CHAIN, sweeps - done)):
            for i, name in enumerate(names):
                state = scaled(state, name, i)
            done += 1
        state = written(state, "cells")
        worst = F.lit(0.0)
        for i, name in enumerate(names):
            held = F.sum("weight").over(Window.partitionBy(name))
            state = state.withColumn(f"gap{i}", F.when(held > 0, F.abs(
                held / F.col(f"t{i}") - 1)).otherwise(0.0))
            worst = F.greatest(worst, F.col(f"gap{i}"))
        gap = state.agg(F.max(worst)).first()[0]
        state = state.drop(*(f"gap{i}" for i in range(len(names))))
        if gap is None or gap <= tolerance:
            break
    return state.drop(*(f"t{i}" for i in range(len(names))))


def scaled(state: DataFrame, name: str, i: int) -> DataFrame:
    held = F.sum("weight").over(Window.partitionBy(name))
    factor = F.when(held > 0, F.col(f"t{i}") / held).otherwise(0.0)
    return state.withColumn("weight", F.col("weight") * factor)


def probabilities(cells: DataFrame, margins: list[str], keep: float | None) -> DataFrame:
    """The cells with the probability of keeping one of their documents.

    It is proportional to the raked weight over the tokens, at most 1, and scaled so that the
    expected tokens are the share `keep` of those in cells that may be kept. The scale is a fixed
    point: cells that reach 1 are set aside and the others share what is left. Without `keep` it is
    the largest at which no cell needs more than it has.
    """
    factor = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    ready = written(cells.select(*margins, "tokens", factor.alias("factor")), "factors")
    scale, tokens, usable = 0.0, F.col("tokens").cast("double"), F.col("factor") > 0
    if keep is None:
        most = ready.where(usable).agg(F.max("factor")).first()[0]
        scale = 1 / most if most else scale
    for _ in range(MOST_STEPS if keep is not None else 0):
        full = F.col("factor") * scale >= 1
        total, held, rest = ready.where(usable).agg(
            F.sum(tokens), F.sum(F.when(full, tokens).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(tokens * F.col("factor")))).first()
        step = (keep * total - held) / rest if rest else scale
        if step <= scale:
            break
        scale = step
    chance = F.when(F.col("tokens") == 0, 1.0).when(
        usable, F.least(F.lit(1.0), F.col("factor") * scale)).otherwise(0.0)
    return ready.select(*margins, F.round(chance, 12).alias("probability"))


def draw(id_: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), id_.cast("string"))), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16 ** DRAW_DIGITS))


def mixed(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
          source: str = "source", language: str = "lang", seed: str = "mix",
          temperature: float = TEMPERATURE, keep: float | None = KEEP, sweeps: int = SWEEPS) -> DataFrame:
    """All documents with _source, _lang, _topic, _tokens, _probability and _kept beside their columns.

    Own columns are c0, c1, ... so that no name clashes.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {n: F.col(f"c{docs.columns.index(n)}") for n in (id_column, text, source, language)}
    margins = ["_source", "_lang", "_topic"]
    marked = plain.select("*", at[source].alias("_source"), at[language].alias("_lang"),
                          topic(at[text]).alias("_topic"), words(at[text]).alias("_tokens"))
    cells = written(marked.groupBy(*margins).agg(F.sum("_tokens").alias("tokens")), "cells")
    targets = {m: tempered(cells, m, temperature) for m in margins}
    chances = probabilities(raked(cells, targets, sweeps), margins, keep)
    own = chances.select(*(F.col(m).alias(f"o{m}") for m in margins),
                         F.col("probability").alias("_probability"))
    match = [F.col(m).eqNullSafe(F.col(f"o{m}")) for m in margins]
    joined = marked.join(own, match).drop(*(f"o{m}" for m in margins))
    return joined.withColumn("_kept", draw(at[id_column], seed) < F.col("_probability"))


def shares(found: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """margin, value, target, reached: shares of tokens, wanted and expected, of what `mixed` returned."""
    margins = ["_source", "_lang", "_topic"]
    cells = written(found.groupBy(*margins).agg(
        F.sum("_tokens").alias("tokens"),
        F.sum(F.col("_tokens") * F.col("_probability")).alias("expected")), "shares")
    total = cells.agg(F.sum("expected").alias("total"))
    parts = []
    for m in margins:
        held = cells.groupBy(F.col(m).alias("held")).agg(F.sum("expected").alias("n")).crossJoin(total)
        parts.append(tempered(cells, m, temperature).join(held, F.col("value").eqNullSafe(F.col("held"))).select(
            F.lit(m[1:]).alias("margin"), F.col("value").cast("string").alias("value"),
            F.col("share").alias("target"), (F.col("n") / F.col("total")).alias("reached")))
    return parts[0].union(parts[1]).union(parts[2])


def sampled(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The drawn documents, with the columns they had."""
    found = mixed(docs, id_column, text, **options).where("_kept")
    return found.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)
