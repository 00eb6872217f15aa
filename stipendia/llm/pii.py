"""Personal data by weak supervision: labelers vote, expectation maximisation weighs them.

1. Patterns give candidate spans. The base kinds (email, ip, card, phone) have a strict rule
   besides; what passes it is always reported. Other kinds and base candidates that fail
   their rule are decided below.
2. Four labelers vote 1, 0 or -1 on each candidate: its form (checksum, ranges, digits), a gazetteer
   (domains, calling codes, issuers, key names), words before it, and its edges.
3. Vote patterns are counted by kind: at most 3**4 rows a kind. Expectation maximisation over these
   counts (Dawid and Skene) estimates how each labeler votes on true and on false candidates,
   and the chance that a candidate of a pattern is true.
4. A naive Bayes classifier over features of the span (length, share of digits, edges,
   votes) is trained on these chances over all candidates. Candidates of ACCEPT or more that overlap
   no base span are added, but without the right form only if words before them speak for their
   kind; of several that overlap each other, the one that begins first (then longest).

All of it is DataFrame and SQL expressions. Patterns are possessive and begin only where a run
begins, or where the match before ended, so very long runs take linear time; that finds the
leftmost matches of the plain patterns.

Places are code points, ends exclusive. Only short pieces around a match leave a text, so
a text with many matches is never copied.

Defined cases: a null or empty text has no spans; rows that repeat an id and text are one
document with one result for each row; a null id is kept; an empty table gives an empty table; columns besides
id and text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipendia.llm.tables import given_id, identified, written

# Candidate patterns by kind, in the order of reports.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local": r"(?<![0-9+.)-])(?<![0-9)] )(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+",
}
BASE = ["email", "ip", "card", "phone"]
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# What the gazetteer labeler knows, and words that speak for or against a kind.
DOMAINS = r"(?i)\.(com|org|net|edu|gov|info|io|int|de|fr|es|uk|it|nl|ch|at|eu)$"
CALLING = r"^\+(1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38)"
KEYS = r"(?i)(token|secret|passw(or)?d|api[_-]?key|access[_-]?key|auth|bearer)\W{0,6}$"
BEFORE = {
    "email": r"(?i)(e-?mail|contact|write|mailto|correo|courriel)\W",
    "ip": r"(?i)\b(ip|host|server|address|client|login)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|carte|karte|tarjeta)\b",
    "phone": r"(?i)\b(phone|call|tel|mobile|fax|cell)\b",
    "ssn": r"(?i)\b(ssn|social security|tax)\b",
    "local": r"(?i)\b(phone|call|tel|mobile|fax|cell)\b",
    "secret": KEYS,
}
AGAINST = r"(?i)\b(version|isbn|issn|page|order|invoice|ref|sha|md5|commit|checksum)\W{0,3}$"
AROUND = 40
ROUNDS = 20
ACCEPT = 0.9
VOTES = ["form", "known", "context", "edges"]
FEATURES = ["form", "known", "context", "edges", "long", "digits", "left", "right"]


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d, i: (
        d.cast("int") * (1 + i % 2)))
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def strict(kind: str, found: Column) -> Column:
    """Whether a candidate has the form its kind asks for."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "ssn":
        return ~found.rlike("^(000|666|9..)-|-00-|-0000$")
    if kind == "local":
        return digits.rlike("^[2-9]..[2-9]")
    if kind == "secret":
        return found.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | (
            found.rlike("[A-Z]") & found.rlike("[a-z]") & found.rlike("[0-9].*[0-9].*[0-9]"))
    return F.lit(True)


def known(kind: str, found: Column, left: Column) -> Column:
    """The vote of the gazetteer."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    for_ = {"email": found.rlike(DOMAINS), "ip": found.rlike(r"^0*([1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\."),
            "card": digits.rlike(ISSUERS), "phone": found.rlike(CALLING),
            "ssn": found.rlike("^(00[1-9]|0[1-9]|[1-6]|7[0-7])"),
            "local": digits.rlike("^[2-9][0-8]"), "secret": left.rlike(KEYS)}[kind]
    weak = kind in ("email", "phone", "secret")
    return F.when(for_, 1).otherwise(0 if weak else -1)


def matches(docs: DataFrame, kind: str) -> DataFrame:
    """_id, _sum, start, stop, found, left, right for each candidate of a kind.

    split() gives the stretches between matches; lengths of these and of the matches add up to
    the places.
    """
    pattern = F.lit(PATTERNS[kind])
    some = F.contains("_text", F.lit(NEEDS[kind])) if kind in NEEDS else F.col("_text").rlike("[0-9]")
    parts = docs.where(some).select(
        "_id", "_sum", F.split("_text", PATTERNS[kind], -1).alias("gaps"),
        F.regexp_extract_all("_text", pattern, F.lit(0)).alias("found")).where(F.size("found") > 0)
    gap = F.transform("gaps", lambda g: F.struct(
        F.length(g).alias("n"), F.right(g, F.lit(AROUND)).alias("left"),
        F.left(g, F.lit(1)).alias("right")))
    zipped = F.transform("found", lambda f, i: F.struct(
        i.alias("i"), f.alias("found"), F.get(F.col("around"), i)["n"].alias("n"),
        F.get(F.col("around"), i)["left"].alias("left"),
        F.get(F.col("around"), i + 1)["right"].alias("right")))
    each = parts.select("_id", "_sum", "found", gap.alias("around")).select(
        "_id", "_sum", F.explode(zipped).alias("m")).select("_id", "_sum", "m.*")
    inside = Window.partitionBy("_id", "_sum").orderBy("i")
    size = F.length("found")
    stop = F.sum(F.col("n") + size).over(inside)
    return each.dropDuplicates(["_id", "_sum", "i"]).select(
        "_id", "_sum", F.lit(kind).alias("kind"), (stop - size).cast("long").alias("start"),
        stop.cast("long").alias("stop"), "found", "left", "right",
        strict(kind, F.col("found")).alias("strict"),
        known(kind, F.col("found"), F.col("left")).alias("known"),
        F.when(F.col("left").rlike(AGAINST), -1).when(
            F.col("left").rlike(BEFORE[kind]), 1).otherwise(0).alias("context"))


def candidates(docs: DataFrame) -> DataFrame:
    """All candidates of all kinds with the votes and the features of their span."""
    found = None
    for kind in PATTERNS:
        one = matches(docs, kind)
        found = one if found is None else found.unionByName(one)
    before, after = F.right("left", F.lit(1)), F.col("right")
    size = F.length("found")
    digits = F.length(F.regexp_replace("found", "[^0-9]", ""))
    return found.select(
        "_id", "_sum", "kind", "start", "stop", "strict",
        F.when(F.col("strict"), 1).otherwise(-1).alias("form"), "known", "context",
        F.when(before.rlike("[A-Za-z0-9]") | after.rlike("[A-Za-z0-9]"), -1).otherwise(1).alias("edges"),
        F.least(size, F.lit(AROUND)).alias("long"),
        (4 * digits / size).cast("int").alias("digits"),
        side(before).alias("left"), side(after).alias("right"))


def side(char: Column) -> Column:
    """The class of a neighbouring character."""
    return F.when(char == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike("[A-Za-z]"), 2).when(
        char.rlike("[0-9]"), 3).when(char.rlike("""["'`=:<>(]"""), 4).otherwise(5)


def reliabilities(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, the votes and `belief`, the chance that a candidate with these votes is true.

    Expectation maximisation as one expression per kind over its counted vote patterns. It starts
    from the majority of votes. Every count has one more vote of each sort, so nothing is 0.
    """
    votes = ", ".join(f"'{v}', {v}" for v in VOTES)
    counted = found.groupBy("kind", *VOTES).agg(F.count("*").cast("double").alias("n"))
    table = counted.groupBy("kind").agg(F.sort_array(F.collect_list(F.expr(
        f"named_struct({votes}, 'n', n)"))).alias("p"))

    def mass(true: bool, vote: str | None = None) -> str:
        weight = "x.n * x.q" if true else "x.n * (1 - x.q)"
        test = f"if(x.{vote} = y.{vote}, {weight}, 0D)" if vote else weight
        return f"aggregate(z, 0D, (a, x) -> a + {test})"

    def likelihood(true: bool) -> str:
        whole = mass(true)
        return " + ".join([f"ln({whole} + 1)", *(
            f"ln(({mass(true, v)} + 1) / ({whole} + 3))" for v in VOTES)])

    fields = ", ".join(f"'{v}', y.{v}" for v in VOTES)
    start = " + ".join(f"y.{v}" for v in VOTES)
    first = f"transform(p, y -> named_struct({fields}, 'n', y.n, 'q', 1 / (1 + exp(-CAST({start} AS DOUBLE)))))"
    step = (f"transform(z, y -> named_struct({fields}, 'n', y.n, 'q', "
            f"1 / (1 + exp(({likelihood(False)}) - ({likelihood(True)})))))")
    done = F.expr(f"aggregate(sequence(1, {rounds}), {first}, (z, k) -> {step})")
    return table.select("kind", F.explode(done).alias("e")).select(
        "kind", *(f"e.{v}" for v in VOTES), F.col("e.q").alias("belief"))


def classified(found: DataFrame, beliefs: DataFrame) -> DataFrame:
    """The candidates with `score`: naive Bayes over their features, trained on the beliefs."""
    trained = found.join(beliefs, ["kind", *VOTES])
    kinds = trained.groupBy("kind").agg(F.sum("belief").alias("t"), F.sum(1 - F.col("belief")).alias("f"))
    pairs = F.explode(F.array(*(
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("value")) for f in FEATURES)))
    values = trained.select("kind", "belief", pairs.alias("v")).groupBy("kind", "v.feature", "v.value").agg(
        F.sum("belief").alias("vt"), F.sum(1 - F.col("belief")).alias("vf"))
    weights = values.join(kinds, "kind").select("kind", "feature", "value", F.log(
        (F.col("vt") + 1) / (F.col("t") + AROUND) * (F.col("f") + AROUND) / (F.col("vf") + 1)).alias("w"))
    table = weights.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws("=", "feature", F.col("value").cast("string")), "w"))).alias("weights"))
    prior = kinds.select("kind", F.log((F.col("t") + 1) / (F.col("f") + 1)).alias("prior"))
    logit = F.col("prior")
    for f in FEATURES:
        logit = logit + F.coalesce(F.element_at("weights", F.concat_ws(
            "=", F.lit(f), F.col(f).cast("int").cast("string"))), F.lit(0.0))
    return found.join(table, "kind").join(prior, "kind").withColumn(
        "score", 1 / (1 + F.exp(-logit))).drop("weights", "prior")


def order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PATTERNS)), kind)


def spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
          accept: float = ACCEPT) -> tuple[DataFrame, DataFrame]:
    """Two tables: _id, _sum of every row; and the reported spans with `base` and score."""
    plain = identified(docs, id_column, text)
    found = written(candidates(plain), "candidates")
    scored = written(classified(found, reliabilities(found)), "scored")
    base = F.col("strict") & F.col("kind").isin(BASE)
    sure = (F.col("score") >= accept) & (F.col("strict") | (F.col("context") == 1))
    chosen = scored.withColumn("base", base).where(base | sure).select(
        "_id", "_sum", "kind", "start", "stop", "base", "score")
    # Added spans must not touch a base span or an added one that begins before.
    place = Window.partitionBy("_id", "_sum").orderBy(
        F.desc("base"), "start", F.desc("stop"), order(F.col("kind")))
    mine = F.max(F.when(~F.col("base"), F.col("stop"))).over(
        place.rowsBetween(Window.unboundedPreceding, -1))
    added = chosen.withColumn("until", F.when(~F.col("base"), mine))
    fixed = chosen.where("base").groupBy("_id", "_sum").agg(
        F.collect_list(F.struct("start", "stop")).alias("fixed"))
    free = added.where("not base and (until is null or start >= until)").join(
        fixed, ["_id", "_sum"], "left").where(F.expr(
            "fixed is null or not exists(fixed, b -> b.start < stop and start < b.stop)"))
    columns = ["_id", "_sum", "kind", "start", "stop", "base", "score"]
    return plain.select("_id", "_sum"), chosen.where("base").select(*columns).union(free.select(*columns))


def listed(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, numbers of base spans, and texts of base and of all spans."""
    rows, found = spans(docs, id_column, text)
    written_as = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("stop").cast("string"))
    entry = F.struct(order(F.col("kind")).alias("k"), "start", "stop", written_as.alias("t"))
    lists = found.groupBy("_id", "_sum").agg(
        *(F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE),
        F.array_sort(F.collect_list(F.when(F.col("base"), entry))).alias("b"),
        F.array_sort(F.collect_list(entry)).alias("a"))
    joined = rows.join(lists, ["_id", "_sum"], "left")
    return joined.select(
        given_id().alias("doc_id"),
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE),
        F.coalesce(F.array_join("b.t", ","), F.lit("")).alias("base_spans"),
        F.coalesce(F.array_join("a.t", ","), F.lit("")).alias("spans"))


def masked(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the text with each span replaced by its kind in brackets."""
    _, found = spans(docs, id_column, text)
    # A span that begins inside the one before is part of it.
    lists = found.groupBy("_id", "_sum").agg(F.array_sort(F.collect_list(
        F.struct("start", "stop", "kind"))).alias("s"))
    body = F.expr(
        "aggregate(s, named_struct('out', '', 'at', 0L), (a, x) -> named_struct("
        "'out', if(x.start < a.at, a.out, concat(a.out, substring(_text, int(a.at) + 1, "
        "int(x.start - a.at)), '[', x.kind, ']')), 'at', greatest(a.at, x.stop)), "
        "a -> concat(a.out, substring(_text, int(a.at) + 1)))")
    return identified(docs, id_column, text).join(lists, ["_id", "_sum"], "left").select(
        given_id().alias("doc_id"),
        F.when(F.col("s").isNull(), F.col("_text")).otherwise(body).alias("text"))
