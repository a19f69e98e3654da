"""A training corpus from ``documents``: toxic documents go, near duplicates and contaminated ones too, sources are mixed, tokens written.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame; all but the last return the columns of documents. Rows
without doc_id or text pass every stage that has no reason to drop them, as the
stages say; texts of any length are read whole; an empty table stays empty; other
columns, of whatever name, are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigscan.llm import toxicity
from sigscan.llm.decontam import drop_contaminated
from sigscan.llm.mixing import mixed_documents
from sigscan.llm.queries import vocabulary
from sigscan.llm.simhash import simhash_dedup
from sigscan.llm.tokens import token_output
from sigscan.session import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents predicted toxic go. A null or empty text stays; rows that repeat another share its fate; without labels of both kinds all stay."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group the document with the least doc_id stays.

    Null and blank texts are one group, their fingerprint being zero. Of rows that
    repeat a doc_id and a fingerprint one stays; a row without doc_id stays.
    """
    return simhash_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: contaminated documents go, the others stay as they are, null and empty texts and rows without doc_id among them; each row is judged by its own text."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: each document as often as the mix takes it, in the order of the schedule.

    A null source is one of its own. A text without words has nothing to take and
    goes. Rows that agree in doc_id, source and text are taken alike.
    """
    return mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token files; returns where each document's ids lie. A null text is an empty one, a null doc_id sorts first, rows of one doc_id follow each other."""
    return token_output(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Training and tokenizing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what a stage returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
