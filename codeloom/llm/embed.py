"""Near-duplicate vectors by a subspace pigeonhole join (operator 2).

Unit vectors with cosine >= c lie within squared distance t = 2 - 2c.  They
are rotated onto the principal axes of the table and cut into blocks of few
dimensions; block k gets the share of t that is its share of the variance.
The squared distances of the blocks add up, so a pair within t is within its
share in one block at least.  Each block is a range join: a grid over its
leading dimensions, whose cells are as wide as the block's radius, joins
every cell with itself and its neighbours.  Both sides of a joined row are
tiles of bounded size.  Within a tile pair, block distances select candidates
and the cosine, in double precision, decides.  A pair that several blocks find
counts in the first of them only.

Vectors of different lengths never link.  Lengths up to the same power of two are
joined in one go: the length is part of the key, and shorter vectors are filled
with zeros, which changes no cosine.

Equal vectors are collapsed before and counted by weight.  A tile pair emits
counts per vector and a star per linked group, not its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import held, save, share, star
from codeloom.llm.components import components

SLACK = 1e-9  # widens ranges so that rounding loses no pair


def rotation(units: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal axes (columns, largest first) of the second moments, and their variances.

    Each task sums a dims x dims matrix over its rows; these sums meet at the
    driver, so what it receives depends on dims alone.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dims, dims)), 0
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            total += x.T @ x
            n += len(x)
        i, j = np.divmod(np.arange(dims * dims), dims)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    sums = units.select("v").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    m = np.zeros((dims, dims))
    for r in sums:
        m[r["i"], r["j"]] = r["s"]
    values, axes = np.linalg.eigh((m + m.T) / 2)
    return np.ascontiguousarray(axes[:, ::-1]), np.maximum(values[::-1], 0)


def blocks_of(variance: np.ndarray, width: int) -> list[tuple[list[int], float]]:
    """Blocks of ``width`` axes with their shares of the squared distance.

    Axes are dealt in turn, so that each block gets strong and weak ones, its
    strongest first.
    """
    n = max(1, len(variance) // width)
    dims = [list(range(k, len(variance), n)) for k in range(n)]
    total = variance.sum()
    shares = [variance[d].sum() / total if total > 0 else 1 / n for d in dims]
    floor = 0.25 / n  # no block without any room
    shares = [max(s, floor) for s in shares]
    return [(d, s / sum(shares)) for d, s in zip(dims, shares)]


def near_vectors(table: DataFrame, cosine: float, width: int = 16, grid: int = 2, tile: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector of ``table`` (vec_id, embedding, label).

    Vectors link when labels are equal and not null, lengths are equal and their
    cosine is at least ``cosine``.  Null, empty and zero vectors and those with null or non-finite
    components link with nothing.  n_links counts other rows, equal vectors
    included; repeated rows (same vec_id) count as rows.  A null vec_id gets
    a null component and links nothing.  Other columns are ignored; an empty
    table gives an empty result.
    """
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("long").alias("label"))
    # Null components drop out of the sum, so the check looks at them first.
    finite = ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate(F.transform("e", lambda x: x / F.col("__top")), F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("__ok", F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("e") > 0, F.lit(False)) & F.coalesce(finite, F.lit(False)))
    # Scaled by the largest component first: squares of tiny or huge ones leave the range of doubles.
    rows = rows.withColumn("__top", F.when(F.col("__ok"), F.array_max(F.transform("e", lambda x: F.abs(x)))))
    rows = rows.withColumn("__ok", F.col("__ok") & (F.coalesce(F.col("__top"), F.lit(0.0)) > 0))
    rows = save(rows, "vectors")
    good = rows.filter("__ok")
    distinct = good.groupBy("label", "e").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("__top").alias("__top"))
    units = distinct.withColumn("__norm", norm).select("label", "id", "n", F.transform("e", lambda x: x / F.col("__top") / F.col("__norm")).alias("v"), F.size("e").alias("dims"))
    units = save(units, "units")
    found = []
    # The bits of dims - 1, so one row for each power of two.
    for r in units.groupBy(F.length(F.bin(F.col("dims") - 1)).alias("bits")).agg(F.min("dims").alias("low"), F.max("dims").alias("dims")).orderBy("bits").collect():
        some, dims = units.filter(F.col("dims").between(r["low"], r["dims"])), r["dims"]
        if r["low"] < dims:
            some = some.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dims) - F.col("dims"))))
        found.append(_links(some, dims, cosine, min(width, dims), grid, tile))
    if found:
        links = found[0]
        for f in found[1:]:
            links = links.union(f)
        links = save(links, "links")
    else:
        links = spark.createDataFrame([], "id long, n long, to long")
    direct = links.filter("to is null").groupBy("id").agg(F.sum("n").alias("far"))
    comps = components(links.filter("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    known = distinct.select("label", "e", "id", "n").join(direct, "id", "left").join(comps, F.col("id") == F.col("node"), "left")
    known = known.select("label", "e", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = good.select("vec_id", "label", "e").join(known, ["label", "e"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not __ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links(units: DataFrame, dims: int, cosine: float, width: int, grid: int, tile: int) -> DataFrame:
    """Rows (id, n, null): linked weight found; rows (id, null, to): links that span linked groups."""
    axes, variance = rotation(units, dims)
    limit = max(0.0, 2 - 2 * cosine) + SLACK
    blocks = blocks_of(variance, width)
    reach = [limit * s + SLACK for _, s in blocks]
    plan = share(units.sparkSession, (axes, blocks, reach, cosine))
    grid = min(grid, width)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, blocks, reach, _ = held(plan)
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) @ axes
            for k, (at, _) in enumerate(blocks):
                cell = np.floor(x[:, at[:grid]] / np.sqrt(reach[k])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), batch.column("dims"), pa.array(np.full(len(x), k, np.int32)), pa.array(list(cell), pa.list_(pa.int32())), batch.column("id"), batch.column("n"), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["label", "dims", "block", "cell", "id", "n", "x"],
                )

    placed = units.mapInArrow(cells, "label long, dims int, block int, cell array<int>, id long, n long, x binary")
    placed = save(placed, "placed")
    key = ["label", "dims", "block", "cell"]
    sizes = placed.groupBy(*key).agg(F.ceil(F.count("*") / tile).alias("tiles"))
    placed = placed.join(sizes, key).withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")))
    tiles = save(placed.groupBy(*key, "t").agg(F.collect_list(F.struct("id", "n", "x")).alias("m")).select(*key, "t", F.col("m.id").alias("id"), F.col("m.n").alias("n"), F.col("m.x").alias("x")), "tiles")
    steps = [s for s in itertools.product((-1, 0, 1), repeat=grid) if s >= (0,) * grid]
    near = tiles.withColumn("step", F.explode(F.array(*[F.array(*map(F.lit, s)) for s in steps])))
    near = near.select(
        "label", "dims", "block", F.zip_with("cell", "step", lambda c, s: c + s).alias("cell"), F.col("t").alias("t1"), F.col("id").alias("id1"), F.col("n").alias("n1"), F.col("x").alias("x1"),
        F.exists("step", lambda s: s != 0).alias("other"),
    )
    pairs = near.join(tiles, key).filter("other or t1 <= t").select("block", (~F.col("other") & (F.col("t1") == F.col("t"))).alias("same"), "id1", "n1", "x1", "id", "n", "x")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, blocks, reach, cosine = held(plan)
        for batch in batches:
            for r in range(batch.num_rows):
                k, same = batch.column("block")[r].as_py(), batch.column("same")[r].as_py()
                a, na, b, nb = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("id1", "n1", "id", "n"))
                x, y = (np.frombuffer(b"".join(batch.column(c)[r].as_py())).reshape(-1, dims) for c in ("x1", "x"))
                i, j = _candidates(x, y, blocks[k][0], reach[k])
                if same:
                    i, j = i[i < j], j[i < j]
                got = []
                for at in range(0, len(i), 65536):
                    p, q = i[at : at + 65536], j[at : at + 65536]
                    ok = np.einsum("ij,ij->i", x[p], y[q]) >= cosine - 1e-15
                    p, q = p[ok], q[ok]
                    for e in range(k + 1):  # counted in the first block that has it in reach
                        d = x[p][:, blocks[e][0]] - y[q][:, blocks[e][0]]
                        within = np.einsum("ij,ij->i", d, d) <= reach[e]
                        mine = within if e == k else ~within
                        p, q = p[mine], q[mine]
                    got.append((p, q))
                p, q = (np.concatenate(z) for z in zip(*got)) if got else (i, j)
                if not len(p):
                    continue
                ids = np.concatenate([a, b])
                far = np.concatenate([np.bincount(p, nb[q], len(a)), np.bincount(q, na[p], len(b))]).astype(np.int64)
                u, v = star(a[p], b[q])
                hit = far > 0
                m = int(hit.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids[hit], u])),
                        pa.array(np.concatenate([far[hit], np.zeros(len(u), np.int64)]), mask=np.arange(m + len(u)) >= m),
                        pa.array(np.concatenate([np.zeros(m, np.int64), v]), mask=np.arange(m + len(u)) < m),
                    ],
                    names=["id", "n", "to"],
                )

    return pairs.mapInArrow(verify, "id long, n long, to long")


def _candidates(x: np.ndarray, y: np.ndarray, at: list[int], reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose block distance is within reach (a little more, for rounding)."""
    p, q = x[:, at], y[:, at]
    i, j = [], []
    for k in range(0, len(p), 512):
        part = p[k : k + 512]
        d = (part * part).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * part @ q.T
        a, b = np.nonzero(d <= reach + 1e-7)
        i.append(a + k)
        j.append(b)
    return np.concatenate(i), np.concatenate(j)
