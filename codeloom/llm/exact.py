"""Exact deduplication as a keyed streaming state (operator 10).

The texts are written once, in arrival order of their partitions, to a content
table in the shared folder.  A structured stream reads its key columns and
keeps, per digest of the normalised text, one state row that never expires:
the stable identifier (smallest document id), the locator of that row in the
content table, and the number of rows.  RocksDB holds the state, so it may
exceed memory.  The state is a streaming aggregate: copies are merged on the
map side, and a digest that a third of all rows share costs one state update
per map task.  A hit is not trusted to the digest: the full normalised texts of
every hit and of its retained row, found by locator, are compared.  Rows whose
bytes differ in spite of an equal digest are grouped by their text instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import save, sealed, store, unsealed, work_dir

RESULTS = ("keep_id", "group_size", "kept", "text_sha256")
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Many small stores: do not reserve disk ahead, and commit changes instead of whole files.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def content_table(docs: DataFrame, digest: Callable[[Column], Column]) -> tuple[DataFrame, str]:
    """The rows of ``docs`` with their digest and a locator, stored in the shared folder; its path."""
    text = normalised(F.col("text"))
    return store(docs.withColumns({"__digest": digest(text), "__at": F.monotonically_increasing_id()}), "content")


def stream_state(keys: DataFrame, path: str, bytes_per_trigger: int = 64 << 30) -> DataFrame:
    """Run the keyed state over the stored table ``keys`` (__digest, doc_id, __at); its last rows.

    Each micro-batch writes the state rows it
    changed, tagged by batch, under the shared folder; a replayed batch
    overwrites its own folder.  The last row of a digest is its state.
    """
    spark = keys.sparkSession
    out, log = work_dir(spark, "state"), work_dir(spark, "statelog")
    had = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        stream = spark.readStream.schema(keys.schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(path)
        state = stream.groupBy("__digest").agg(F.min(F.struct("doc_id", "__at")).alias("__first"), F.count("*").alias("group_size"))

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("__batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b{batch_id}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", log).foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for key, value in had.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    rows = spark.read.parquet(f"{out}/*")
    return rows.groupBy("__digest").agg(F.max_by(F.struct("__first", "group_size"), "__batch").alias("s")).select("__digest", "s.*")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, bytes_per_trigger: int = 64 << 30) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 of every row.

    Of rows with equal normalised texts the one with the smallest doc_id stays.
    Null texts equal the empty text.  A null doc_id sorts before all others.
    Repeated rows (same id, same text) are told apart by their place in the
    content table, so exactly one row of each group is kept.  An empty table
    gives an empty result.  Extra columns pass through; those named like the
    results, in any case, are replaced.
    """
    rows, inner = sealed(docs, "doc_id", "text")
    return _groups(rows, digest, bytes_per_trigger).select(*unsealed(inner, RESULTS), *RESULTS)


def drop_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256, bytes_per_trigger: int = 64 << 30) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with the given columns only and their values unchanged."""
    rows, inner = sealed(docs, "doc_id", "text")
    return _groups(rows, digest, bytes_per_trigger).filter("kept").select(*unsealed(inner))


def _groups(docs: DataFrame, digest: Callable[[Column], Column], bytes_per_trigger: int) -> DataFrame:
    """``docs``, sealed, with the results."""
    table, path = content_table(docs, digest)
    keys = table.select("__digest", "doc_id", "__at")
    if keys.isEmpty():
        return _result(table, docs.columns, table.select("__digest", F.struct("doc_id", "__at").alias("__first"), F.lit(1).cast("long").alias("group_size")))
    groups = save(stream_state(keys, path, bytes_per_trigger), "groups")
    # Full bytes of hits against the retained row, found by its locator.
    several = groups.filter("group_size > 1")
    text = normalised(F.col("text"))
    members = table.join(several.select("__digest", F.col("__first.__at").alias("__to")), "__digest")
    members = save(members.select("__at", "__to", text.alias("t")), "members")
    hit, first = members.filter("__at <> __to"), members.filter("__at = __to").select("__to", F.col("t").alias("u"))
    differ = save(hit.join(first, "__to").filter("t <> u").select("__at"), "differ")
    unlike = not differ.isEmpty()
    if unlike:
        # Digests that stand for several texts: group their rows by the text itself.
        mixed = table.join(differ, "__at", "left_semi").select("__digest").distinct()
        rows = table.join(mixed, "__digest", "left_semi").withColumn("__text", text)
        table = table.join(mixed, "__digest", "left_anti").unionByName(rows.withColumn("__digest", F.concat_ws(":", "__digest", "__text")).drop("__text"))
        split = rows.groupBy(F.concat_ws(":", "__digest", "__text").alias("__digest")).agg(F.min(F.struct("doc_id", "__at")).alias("__first"), F.count("*").alias("group_size"))
        groups = groups.join(mixed, "__digest", "left_anti").unionByName(split)
    return _result(table, docs.columns, groups, None if digest is sha256 and not unlike else text)


def _result(table: DataFrame, columns: list[str], groups: DataFrame, text: Column | None = None) -> DataFrame:
    return table.join(groups, "__digest").select(
        *columns,
        F.col("__first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("__at") == F.col("__first.__at")).alias("kept"),
        (F.col("__digest") if text is None else sha256(text)).alias("text_sha256"),
    )
