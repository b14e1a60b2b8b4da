"""Corpus pipeline: documents in, packed token pieces out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
docs of the next one.  ``run`` applies them to the documents table.

1. toxicity: documents whose score is 0.5 or more go.
2. exact_dedup: of equal texts (white-space runs as one space) the smallest doc_id stays.
3. simhash_dedup: of each near-duplicate component its smallest doc_id stays.
4. secrets: every secret span in a text is replaced by a mark; all documents stay.
5. packing: the remaining texts as token pieces in windows of at most 1024 ids.

Every stage works on all rows of its predecessor.  Null and empty texts are
clean, equal to each other and survive as one document.  Columns beyond those
of documents pass through until packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import exact, packing, secrets, simhash, toxicity
from codeloom.llm.common import save
from codeloom.llm.queries import tokenizer
from codeloom.session import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def simhash_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer()).drop("padded_to")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_dedup", simhash_dedup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

# Trained scores, XXH64 fingerprints and BPE ids are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
