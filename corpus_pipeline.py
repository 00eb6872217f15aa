"""From raw documents to token files: the corpus operators one after another.

Each stage gets what the one before kept, as a table, and returns the columns of documents;
the last one returns what it reads back from the token files. Near-duplicates are found on shingles
of five words at a similarity of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stipendia.llm import decontamination, minhash, mixing, quality_rules, token_output
from stipendia.llm.queries import END, TOKENIZER
from stipendia.llm.tables import ship, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules pass."""
    ship(spark)
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates."""
    ship(spark)
    return minhash.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics come near their target weights."""
    ship(spark)
    return mixing.sampled(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes all documents as token files; doc_id, start, n_tokens, ids_crc32 as read back."""
    ship(spark)
    stored = token_output.write(docs, TOKENIZER, END)
    return token_output.read(spark, stored, summary=True)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixture),
    ("token files", token_files),
]

#: SQL cannot run the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; between stages the table is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
