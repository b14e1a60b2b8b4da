"""Shared, materialized intermediate tables for the registered queries.

The parsed corpus is the expensive part (Python ``ast`` in tasks).  It is
computed once per (session, data directory) and written as a parquet table
into the shared ``spark.checkpoint.dir``: the several joins that read it
do not re-run the parser, a lost executor re-reads table files instead of
re-parsing, and readers prune columns and nested fields.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codeloom.operators import extract, graph
from codeloom.session import checkpoint_dir
from codeloom.sources import fixtures

_CACHE: dict[tuple, DataFrame] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing a parquet table into the shared checkpoint dir.

    A written table (not a local checkpoint) survives executor loss, is
    columnar -- later readers prune columns and nested fields -- and
    keeps the partitioning of the writer.
    """
    spark = df.sparkSession
    out = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(out)
    return spark.read.parquet(out)


def _memo(spark: SparkSession, sf_dir: str, key: str, build) -> DataFrame:
    k = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"), key)
    if k not in _CACHE:
        _CACHE[k] = build()
    return _CACHE[k]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo(spark, sf_dir, "corpus", lambda: materialize(fixtures.code_corpus(spark, sf_dir)))


def code_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.code_rows(spark, sf_dir)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parse per file: File record + per-function paths, written once.

    Parsing is heavy for its input size, so files are dealt to all shuffle partitions.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _memo(spark, sf_dir, "parsed", lambda: materialize(extract.extract_corpus(corpus(spark, sf_dir).repartition(parts, "path"))))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.meta_of(parsed(spark, sf_dir))


def function_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.function_paths_of(parsed(spark, sf_dir))


def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("path")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the edge rules look for in the bodies, from one scan of them."""
    return _memo(spark, sf_dir, "tokens", lambda: materialize(graph.body_tokens(meta(spark, sf_dir))))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dependency edges, from one scan of the bodies."""
    build = lambda: materialize(graph.edges_of_tokens(tokens(spark, sf_dir), meta(spark, sf_dir), file_paths(spark, sf_dir)))
    return _memo(spark, sf_dir, "edges", build)


def clear() -> None:
    _CACHE.clear()
