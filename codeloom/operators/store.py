"""Object tables and change logs.

An object class is a table keyed by ``id``.  Inserts, patches, replaces
and deletes are DataFrame -> DataFrame operators that return the new
table; a writer commits it as a new version directory.  The change-log
fold (M6) first leaves out, task by task, what later events of the same task
make void, then deals the rest by ranges of (id, order) and folds each range
to a few events an id: an id that owns a third of the log is spread over many
tasks, and no row of the raw log is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_objects(table: DataFrame, *fields: str) -> DataFrame:
    """All objects of a class, chosen properties (pruned at the scan)."""
    return table.select(*fields) if fields else table


def add_property(table: DataFrame, name: str, data_type: str) -> DataFrame:
    """Schema evolution; existing objects read the new property as null."""
    return table.withColumn(name, F.lit(None).cast(data_type))


def object_by_id(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Point lookups for a set of ids (left semi join; a single id is a filter)."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def first_by_key(table: DataFrame, requests: DataFrame, key: str, order: str) -> DataFrame:
    """For each requested key, the first matching row (or a miss).

    ``min_by`` keeps one row per key as a partial aggregate.
    """
    cols = [c for c in table.columns if c != key]
    first = table.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("hit"))
    return requests.select(key).distinct().join(first, key, "left").select(key, F.col("hit").isNotNull().alias("found"), "hit.*")


def batch_insert(table: DataFrame, new: DataFrame, key: str = "id", order: str = "_seq") -> tuple[DataFrame, DataFrame]:
    """M1 / M2: add objects; one status per object (``inserted`` / ``duplicate``).

    ``order`` tells the rows of ``new`` apart (a place in the batch, unique within an id).  Within the
    batch the first row of an id is inserted, later ones are duplicates; an id already in the
    table is a duplicate.  The first rows are a partial aggregate, and a status is
    found by (id, order), so that an id with a third of the batch is no hot key.
    Returns (new table, statuses).
    """
    cols = [c for c in table.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(order, *cols), F.col(order)).alias("_f"))
    first = first.join(table.select(key), key, "left_anti")
    won = first.select(key, F.col(f"_f.{order}").alias(order), F.lit(True).alias("_won"))
    statuses = new.select(key, order).join(won, [key, order], "left").select(key, F.when(F.col("_won"), "inserted").otherwise("duplicate").alias("status"))
    return table.unionByName(first.select(key, "_f.*").select(*table.columns)), statuses


def merge_update(table: DataFrame, patches: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """M3: overwrite only the given properties; the last patch of an id wins.

    ``patches`` has ``key``, ``order``, and for every property ``c`` in
    ``columns`` a value column ``c`` plus a presence flag ``has_<c>``
    (an explicit null is a value, an absent property is not).
    """
    aggs = [
        F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(f"has_{c}"), F.col(order))).alias(f"p_{c}") for c in columns
    ]
    last = patches.groupBy(key).agg(*aggs)
    j = table.join(last, key, "left")
    out = [F.col(key)] + [
        (F.when(F.col(f"p_{c}").isNotNull(), F.col(f"p_{c}.v")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c))
        for c in table.columns
        if c != key
    ]
    return j.select(*out)


def replace_object(table: DataFrame, replacements: DataFrame, key: str, order: str) -> DataFrame:
    """M4: the whole object is replaced (absent properties become null); last wins.

    An id that the table does not have stays unknown, as in M3 and M6.
    """
    cols = [c for c in replacements.columns if c not in (key, order)]
    last = replacements.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("r")).select(key, "r.*")
    last = last.join(table.select(key), key, "left_semi")
    kept = table.join(last.select(key), key, "left_anti")
    return kept.unionByName(last, allowMissingColumns=True).select(*table.columns)


def delete_object(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """M5: delete by id (left anti join)."""
    return table.join(ids.select(key), key, "left_anti")


def _void(props: list[str], key: str, all_inserts: bool, hold: int = 10_000):
    """Mapper over events sorted by (key, order): those that may still matter, in order.

    Of an id's events stay the last delete, and of those after it the first insert
    (``all_inserts``: every one, for a later delete of another task may make an insert the first),
    the last replace and the last patch of each property.  Folding a log in parts that follow
    each other in order and then folding what is left gives the same as folding it at once.
    """

    def keep(batch: pa.RecordBatch, edges: np.ndarray) -> np.ndarray:
        kind = batch.column("kind")
        n, at = batch.num_rows, np.arange(batch.num_rows)
        head = edges[:-1]
        is_ = {k: pc.equal(kind, k).fill_null(False).to_numpy(zero_copy_only=False) for k in ("delete", "insert", "replace", "patch")}
        last = lambda mask: np.maximum.reduceat(np.where(mask, at, -1), head)
        gone = last(is_["delete"])
        alive = at > np.repeat(gone, np.diff(edges))
        out = np.zeros(n + 1, bool)  # one more place takes "none"
        out[gone] = True
        if all_inserts:
            out[:n] |= is_["insert"] & alive
        else:
            out[np.minimum.reduceat(np.where(is_["insert"] & alive, at, n), head)] = True
        out[last(is_["replace"] & alive)] = True
        for p in props:
            has = batch.column(f"has_{p}").fill_null(False).to_numpy(zero_copy_only=False)
            out[last(is_["patch"] & has & alive)] = True
        return out[:n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # what is left of the last id, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            ids = batch.column(key)
            new = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.flatnonzero(new) + 1, batch.num_rows]
            mask = keep(batch, edges)
            cut = int(edges[-2])
            yield batch.slice(0, cut).filter(pa.array(mask[:cut]))
            held = batch.slice(cut).filter(pa.array(mask[cut:]))
            if held.num_rows > hold:  # nothing is lost by letting them go early
                yield held
                held = None
        if held is not None:
            yield held

    return run


def fold_changes(changes: DataFrame, key: str, props: list[str]) -> DataFrame:
    """The events of an ordered change log that can matter: a few an id and range.

    ``changes`` has ``_o`` as its order; rows without an id, or of another kind, go.
    """
    log = changes.where(F.col(key).isNotNull() & F.col("kind").isin("insert", "replace", "patch", "delete"))
    # First in each task of the scan, which shrinks a hot id before the shuffle ...
    part = log.sortWithinPartitions(key, "_o").mapInArrow(_void(props, key, True), log.schema)
    # ... then in each range of (id, order), which spreads a hot id over tasks.
    return part.repartitionByRange(key, "_o").sortWithinPartitions(key, "_o").mapInArrow(_void(props, key, False), log.schema)


def apply_changes(table: DataFrame, changes: DataFrame, key: str, order: Column | str, props: list[str]) -> DataFrame:
    """M6: fold an ordered change log into the final table.

    ``changes``: key, order (unique within an id), ``kind`` in (insert, replace, patch, delete),
    one value column per property and ``has_<p>`` flags for patches.
    Sequential semantics: replace / patch need a live object, delete kills
    it, insert revives a dead id (on a live id it is a duplicate).

    The log is folded to a few events an id and range (``fold_changes``).  Of these,
    per id: (A) the last delete; (B) among the events after it the first insert (the
    revival, needed when there was a delete or no initial row), the last replace and
    per property the last patch.  Only the *last* replace / patch can matter, so validity is an
    order check: a replace counts if it is after the revival point, a patch if
    it is after the last valid reset.
    """
    o = F.col(order) if isinstance(order, str) else order
    names = [key, "kind", *props, *(f"has_{p}" for p in props)]
    ch = fold_changes(changes.select(*names, o.alias("_o")), key, props)
    payload = [F.col(p).alias(f"v_{p}") for p in props]
    last_del = ch.groupBy(key).agg(F.max(F.when(F.col("kind") == "delete", F.col("_o"))).alias("_last_del"))
    after = ch.join(last_del, key).where(F.col("_last_del").isNull() | (F.col("_o") > F.col("_last_del")))
    kind = F.col("kind")
    agg = after.groupBy(key).agg(
        F.min_by(F.struct("_o", *payload), F.when(kind == "insert", F.col("_o"))).alias("_rev"),
        F.max_by(F.struct("_o", *payload), F.when(kind == "replace", F.col("_o"))).alias("_rep"),
        *[F.max_by(F.struct("_o", F.col(p).alias("v")), F.when((kind == "patch") & F.col(f"has_{p}"), F.col("_o"))).alias(f"_p_{p}") for p in props],
    )
    state = last_del.join(agg, key, "left")
    init = table.select(key, *[F.col(p).alias(f"i_{p}") for p in props]).withColumn("_init", F.lit(True))
    st = state.join(init, key, "full")

    needs_revival = F.col("_last_del").isNotNull() | F.col("_init").isNull()
    live = F.when(needs_revival, F.col("_rev").isNotNull()).otherwise(F.lit(True))
    start = F.when(needs_revival, F.col("_rev._o"))
    rep_ok = F.col("_rep").isNotNull() & (start.isNull() | (F.col("_rep._o") > start))
    reset = F.when(rep_ok, F.col("_rep._o")).otherwise(start)

    def value(p):
        base = F.when(rep_ok, F.col(f"_rep.v_{p}")).when(needs_revival, F.col(f"_rev.v_{p}")).otherwise(F.col(f"i_{p}"))
        patch_ok = F.col(f"_p_{p}").isNotNull() & (reset.isNull() | (F.col(f"_p_{p}._o") > reset))
        return F.when(patch_ok, F.col(f"_p_{p}.v")).otherwise(base).alias(p)

    return st.where(live).select(key, *[value(p) for p in props])


def to_document(df: DataFrame, key: str, doc: Column) -> DataFrame:
    """Record -> nested JSON document text."""
    return df.select(key, F.to_json(doc).alias("doc"))


def properties(kind: T.DataType, value: Column) -> Column:
    """The nested property form of a value of type ``kind``, as an expression.

    Structs keep the order of their fields, a null one stays null; lists and maps go through entry by entry, a null
    one is empty; map keys become text.  The expression follows from the type alone, at any depth.
    """
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(properties(f.dataType, value[f.name]).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.transform(value, lambda x: properties(kind.elementType, x)), F.array())
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(e["key"].cast("string").alias("key"), properties(kind.valueType, e["value"]).alias("value"))
        return F.map_from_entries(F.coalesce(F.transform(F.map_entries(value), entry), F.array()))
    return value


def documents(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """P6 for whole records: (key, doc), the JSON text of the properties of each row; nulls are written out.

    A document is bounded by its row: lists are those of the record, none is gathered over rows.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    doc = F.struct(*(properties(f.dataType, F.col(f.name)).alias(f.name) for f in fields))
    return df.select(key, F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc"))


def create_class(spark, name: str, schema, location: str | None = None) -> None:
    """Register an object class as a parquet table (``CREATE TABLE ... USING parquet``)."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet{loc}")


def class_schema(spark, name: str):
    """Read one class's schema back (name, type) from the catalog."""
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(name)]
