"""Whitening of embeddings with MLlib block matrices (operator 13).

1. Rows are numbered and written once; their integer entries are summed exactly.
2. The centred rows become the blocks of a distributed ``BlockMatrix``.  Its
   transpose times itself is the scatter; the product is split along the rows,
   so that a task holds some blocks only.
3. The scatter, one number for each pair of dimensions, is decomposed locally by ``eigh``.
4. The blocks times the whitening matrix are the projected rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import save

SCALE, SHIFT = 1024, 100_000
WIDE = 1 << 61  # entries from here on do not fit the integer arithmetic
BLOCKS = T.StructType([T.StructField("at", T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.LongType())])), T.StructField("block", MatrixUDT())])
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, dims, part, i, x) of the usable vectors; ``i`` numbers those of one length in a partition."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        ids, lists = batch.column("vec_id"), batch.column("embedding")
        size = np.where(lists.is_valid(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
        flat = lists.flatten()
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(SCALE * flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)) + SHIFT
            bad = ~(np.abs(x) < WIDE)  # also null, NaN and infinity
        ends = np.cumsum(size)
        wrong = np.r_[0, np.cumsum(bad)]
        good = np.flatnonzero((size > 0) & (wrong[ends] == wrong[ends - size]))
        if not len(good):
            continue
        number = np.empty(len(good), np.int64)
        for d in np.unique(size[good]):
            of = size[good] == d
            number[of] = seen.get(d, 0) + np.arange(of.sum())
            seen[d] = seen.get(d, 0) + int(of.sum())
        keep = np.repeat(np.isin(np.arange(len(size)), good), size)
        bounds = np.r_[0, np.cumsum(size[good])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(x[keep].astype(np.int64)))
        cols = [ids.take(pa.array(good)), pa.array(size[good].astype(np.int32)), pa.array(np.full(len(good), part, np.int32)), pa.array(number), lists]
        yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "dims", "part", "i", "x"])


def _rows(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, d)


def _sums(d: int):
    """Mapper: per batch and dimension the sums of the high and the low parts of the entries, which no long overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch, d)
                cols = [np.arange(d), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["dim", "hi", "lo"])

    return run


def _deviations(d: int, n: int, sums: list[int]):
    """Mapper: (block, index, vec_id, deviation), the exact sum of (n * x - S)^2; null where 38 digits do not hold it."""
    low = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _rows(batch, d) - low  # n * x - S = n * y - rest
            most = int(np.abs(y).max()) * n + n
            if most * most * d < 1 << 62:
                dev = pa.array(((y * n - rest.astype(np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                exact = ((y.astype(object) * n - rest) ** 2).sum(axis=1)
                dev = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("index"), batch.column("vec_id"), dev], names=["block", "index", "vec_id", "deviation"])

    return run


def _matrix(values: np.ndarray) -> pa.StructArray:
    """One dense matrix in the form of MLlib's matrix type, row by row."""
    none = pa.array([None], pa.list_(pa.int32()))
    cols = [pa.array([1], pa.int8()), *(pa.array([k], pa.int32()) for k in values.shape), none, none, pa.array([values.ravel()], pa.list_(pa.float64())), pa.array([True])]
    return pa.StructArray.from_arrays(cols, names=["type", "numRows", "numCols", "colPtrs", "rowIndices", "values", "isTransposed"])


def _blocks(d: int, n: int, sums: list[int], wide: int):
    """Mapper over rows sorted by block and index: the centred rows as matrix blocks of at most ``wide`` columns."""
    low = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])

    def flush(block: int, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        y = np.concatenate(rows)
        for j, at in enumerate(range(0, d, wide)):
            place = pa.StructArray.from_arrays([pa.array([block], pa.int64()), pa.array([j], pa.int64())], names=["row", "col"])
            yield pa.RecordBatch.from_arrays([place, _matrix(y[:, at : at + wide])], names=["at", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("block").to_numpy()
            y = (_rows(batch, d) - low).astype(np.float64) - rest
            edges = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)]
            for a, b in zip(edges[:-1], edges[1:]):
                if now is not None and block[a] != now:
                    yield from flush(now, held)
                    held = []
                now = int(block[a])
                held.append(y[a:b])
        if held:
            yield from flush(now, held)

    return run


def _projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mapper over MLlib's blocks: (block, w), the projected rows of a block as bytes, row by row."""
    for batch in batches:
        for at, m in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
            shape = m["numRows"], m["numCols"]
            w = np.array(m["values"]).reshape(shape) if m["isTransposed"] else np.array(m["values"]).reshape(shape[::-1]).T
            yield pa.RecordBatch.from_arrays([pa.array([at["_1"]], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["block", "w"])


def _moments(c: int, mean: np.ndarray | None):
    """Mapper: per block the sums of the projected columns, or of the products of the centred ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in batch.column("w").to_pylist():
                w = np.frombuffer(w).reshape(-1, c)
                out = w.sum(axis=0) if mean is None else ((w - mean).T @ (w - mean)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["at", "v"])

    return run


def _answer(c: int, n: int, explained: np.ndarray, flat: np.ndarray, error: float):
    """Mapper over (members, w): one row per vector and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, w in enumerate(batch.column("w").to_pylist()):
                members = batch.column("members")[i].values
                ids, dev = members.field("vec_id"), members.field("deviation")
                m = len(ids)
                w = np.frombuffer(w).reshape(m, c).ravel()
                each = pa.array(np.repeat(np.arange(m), c))
                cols = [ids.take(each), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)), pa.array(np.full(m * c, n, np.int64)), dev.take(each)]
                cols += [pa.array(w, mask=np.tile(flat, m)), pa.array(np.tile(explained, m)), pa.array(np.full(m * c, error))]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def _product(left: BlockMatrix, right: BlockMatrix, parts: int = 1) -> BlockMatrix:
    """``left.multiply(right)``, with the inner dimension dealt to ``parts`` groups of tasks."""
    model = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(model, left.rowsPerBlock, right.colsPerBlock)


def whiten(vectors: DataFrame, components: int = 8, wide: int = 1024) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row per usable vector and component.

    Vectors that are null, empty or hold a null, NaN or infinite entry are left out, as are
    entries beyond 2^51 in size, whose integers do not fit, and vectors of another
    length than the most frequent one (of equally frequent ones the longest).  Rows that repeat
    an id or a vector all count and all come out; a null vec_id stays null.
    Components beyond the number of dimensions do not come; one without variance (eigenvalue within
    rounding of 0) has a null ``whitened`` and does not count in ``identity_error``.
    Eigenvectors have their largest entry positive.  ``deviation`` is exact; null beyond 38 digits.
    No usable vector gives an empty result.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = save(given.mapInArrow(_integers, "vec_id long, dims int, part int, i long, x array<long>"), "vectors")
    size = kept.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if size is None:
        return spark.createDataFrame([], OUT)
    d, n = size["dims"], size["count"]
    kept = kept.filter(F.col("dims") == d)

    sums = [0] * d
    for r in kept.select("x").mapInArrow(_sums(d), "dim long, hi long, lo long").groupBy("dim").agg(*(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("hi", "lo"))).collect():
        sums[r["dim"]] = (int(r["hi"]) << 32) + int(r["lo"])

    # Rows are numbered through from their place in their partition: one row a partition reaches the driver.
    offsets, at = [], 0
    for r in kept.groupBy("part").agg(F.count("*").alias("rows")).orderBy("part").collect():
        offsets.append((r["part"], at))
        at += r["rows"]
    cols = min(d, wide)
    rows = 1024
    while rows < n / 20_000 and rows * cols < 1 << 22:  # the keys of all blocks reach the driver
        rows *= 2
    index = F.col("i") + F.col("first")
    kept = kept.join(F.broadcast(spark.createDataFrame(offsets, "part int, first long")), "part")
    kept = kept.select("vec_id", "x", index.alias("index"), F.floor(index / rows).alias("block"))

    dealt = kept.select("block", "index", "x").repartition("block").sortWithinPartitions("block", "index")
    blocks = dealt.mapInArrow(_blocks(d, n, sums, cols), BLOCKS)
    matrix = BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, rows, cols, n, d), rows, cols)
    parts = -(-n // (16 * rows))
    scatter = _product(matrix.transpose(), matrix, parts).toLocalMatrix().toArray()
    v = (scatter + scatter.T) / (2 * n)
    values, vectors_ = np.linalg.eigh(v)
    c = min(components, d)
    values, vectors_ = values[::-1][:c], vectors_[:, ::-1][:, :c]
    vectors_ = vectors_ * np.where(vectors_[np.abs(vectors_).argmax(axis=0), np.arange(c)] < 0, -1.0, 1.0)
    flat = values <= max(float(values[0]), 0.0) * d * np.finfo(float).eps
    white = np.where(flat, 0.0, vectors_ / np.sqrt(np.where(flat, 1.0, values)))
    trace = float(np.trace(v))
    explained = values / trace if trace > 0 else np.zeros(c)

    pieces = [((j, 0), Matrices.dense(len(p), c, p.T.ravel())) for j, p in enumerate(white[k : k + cols] for k in range(0, d, cols))]
    projection = BlockMatrix(spark.sparkContext.parallelize(pieces, len(pieces)), cols, c, d, c)
    projected = callMLlibFunc("getMatrixBlocks", _product(matrix, projection)._java_matrix_wrapper._java_model)
    projected = save(projected.mapInArrow(_projected, "block long, w binary"), "whitened")

    def total(mean: np.ndarray | None) -> np.ndarray:
        sums = projected.select("w").mapInArrow(_moments(c, mean), "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
        return np.array([r["v"] for r in sums.orderBy("at").collect()]) / n

    covariance = total(total(None)).reshape(c, c)
    error = np.abs(covariance - np.eye(c))[~flat][:, ~flat]
    members = kept.mapInArrow(_deviations(d, n, sums), "block long, index long, vec_id long, deviation decimal(38,0)")
    members = members.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("index", "vec_id", "deviation"))).alias("members"))
    return members.join(projected, "block").select("members", "w").mapInArrow(_answer(c, n, explained, flat, float(error.max()) if error.size else 0.0), OUT)
